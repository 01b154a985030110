"""Arithmetic and nulls as the cleaning rules expect them: no NaN, no errors on zero."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def r_div(a: Column, b: Column) -> Column:
    """a / b; a signed infinity for x / 0, null for 0 / 0 and for nulls."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when((b == 0) & (a > 0), F.lit(INF)).when((b == 0) & (a < 0), F.lit(-INF))


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF)


def only_finite(c: Column) -> Column:
    return F.when(finite(c), c)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN becomes null in every double column."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


def has(df: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(df.columns)


def need(df: DataFrame, missing: str, *columns: str) -> bool:
    """Whether the columns are there; if not: silent, warn, or abort."""
    gone = [c for c in columns if c not in df.columns]
    if gone and missing == "warn":
        warnings.warn(f"columns {', '.join(gone)} are missing; the step is skipped", stacklevel=3)
    if gone and missing == "abort":
        raise ValueError(f"columns {', '.join(gone)} are required")
    return not gone


def first_of(df: DataFrame, *columns: str) -> str | None:
    return next((c for c in columns if c in df.columns), None)
