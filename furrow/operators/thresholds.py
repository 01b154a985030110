"""Thresholds as one row for each field, from exact interpolated quantiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.rcompat import finite, first_of, has, only_finite
from furrow.operators import motion, order


def join_fields(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Each point with its field's row; without fields, the single row goes to every point."""
    on = order.keys(df)
    return df.join(rows, on) if on else df.crossJoin(F.broadcast(rows))


def _same(aggregate: Column) -> Column:
    return aggregate


def _bounds(value: Column, low: float, high: float, scale: float, over: Callable[[Column], Column] = _same) -> tuple[Column, Column]:
    a, b = over(F.percentile(value, low)), over(F.percentile(value, high))
    return a - scale * (b - a), b + scale * (b - a)


def yield_bounds(df: DataFrame, low: float, high: float, scale: float, least: float, over: Callable[[Column], Column] = _same) -> dict[str, Column]:
    """``min_yield`` and ``max_yield`` as aggregates, or as windows; none without a column of yield or flow."""
    column = first_of(df, "Yield_kg_ha", "Yield_buacre", "Flow")
    if not column:
        return {}
    y = only_finite(F.col(column))
    a, b = _bounds(y, low, high, scale, over)
    enough = over(F.count(y)) > 10
    return {"min_yield": F.when(enough, F.greatest(F.lit(float(least)), a)).otherwise(float(least)), "max_yield": F.when(enough, b).otherwise(300.0)}


def velocity_bounds(low: float, high: float, scale: float, least: float, over: Callable[[Column], Column] = _same) -> dict[str, Column]:
    """``min_velocity`` and ``max_velocity`` of a column ``velocity``, as aggregates or as windows."""
    a, b = _bounds(F.col("velocity"), low, high, scale, over)
    enough = over(F.count("velocity")) > 10
    return {"min_velocity": F.when(enough, F.greatest(F.lit(float(least)), a)).otherwise(float(least)), "max_velocity": F.when(enough, b).otherwise(15.0)}


def auto_thresholds(df: DataFrame, yllim: float = 0.05, yulim: float = 0.95, yscale: float = 1.5, vllim: float = 0.02, vulim: float = 0.98, vscale: float = 1.5, minv_abs: float = 0.5, miny_abs: float = 0, gbuffer: float = 100) -> DataFrame:
    """min/max of yield, velocity, X and Y; the position box reaches outward by the buffer.

    Yield bounds of ten finite values or fewer are (miny_abs, 300); velocity
    bounds (minv_abs, 15).
    """
    out = yield_bounds(df, yllim, yulim, yscale, miny_abs)
    if has(df, "X", "Y", "Interval") or has(df, "velocity"):
        if not has(df, "velocity"):
            df = df.withColumn("velocity", motion.velocity(df))
        out |= velocity_bounds(vllim, vulim, vscale, minv_abs)
    if has(df, "X", "Y"):
        for c in ("X", "Y"):
            out |= {f"min_{c.lower()}": F.percentile(c, 0.02) - gbuffer, f"max_{c.lower()}": F.percentile(c, 0.98) + gbuffer}
    return df.groupBy(*order.keys(df)).agg(*(c.alias(n) for n, c in out.items()))


def typed_thresholds(df: DataFrame, types: tuple[str, ...] = ("yield", "velocity", "position", "moisture"), yllim: float = 0.10, yulim: float = 0.90, yscale: float = 1.1, vllim: float = 0.05, vulim: float = 0.95, vscale: float = 1.1, minv_abs: float = 0.5, gbuffer: float = 100, n_std: float = 3) -> DataFrame:
    """Yield from positive finite values with their mean and sd; the position range shrinks by the buffer; moisture is mean and spread."""
    out: dict[str, Column] = {}
    column = first_of(df, "Yield_kg_ha", "Yield", "Flow")
    if "yield" in types and column:
        y = F.when(finite(F.col(column)) & (F.col(column) > 0), F.col(column))
        low, high = _bounds(y, yllim, yulim, yscale)
        out |= {"min_yield": F.coalesce(F.greatest(F.lit(0.0), low), F.lit(0.0)), "max_yield": F.coalesce(high, F.lit(float("inf"))), "mean_yield": F.avg(y), "sd_yield": F.stddev_samp(y)}
    if "velocity" in types and has(df, "X", "Y"):
        df = df.withColumn("velocity", motion.velocity(df))
        low, high = _bounds(only_finite(F.col("velocity")), vllim, vulim, vscale)
        out |= {"min_velocity": F.coalesce(F.greatest(F.lit(minv_abs), low), F.lit(0.5)), "max_velocity": F.coalesce(high, F.lit(10.0))}
    if "position" in types and has(df, "X", "Y"):
        for c in ("X", "Y"):
            out |= {f"min_{c.lower()}": F.min(c) + gbuffer, f"max_{c.lower()}": F.max(c) - gbuffer}
    if "moisture" in types and has(df, "Moisture"):
        m, s = F.avg("Moisture"), F.stddev_samp("Moisture")
        out |= {"min_moisture": m - n_std * s, "max_moisture": m + n_std * s}
    return df.groupBy(*order.keys(df)).agg(*(c.alias(n) for n, c in out.items()))


def auto_ranges(df: DataFrame, yields: tuple[float, float] = (0.01, 0.99), coords: tuple[float, float] = (0.001, 0.999), speeds: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Plain quantiles of Flow, X, Y and of distance over interval."""
    speed = F.when(F.col("Interval") != 0, F.col("Distance") / F.col("Interval"))
    parts = {"flow": (F.col("Flow"), yields), "x": (F.col("X"), coords), "y": (F.col("Y"), coords), "velocity": (speed, speeds)}
    return df.groupBy(*order.keys(df)).agg(*(F.percentile(c, p).alias(f"{side}_{n}") for n, (c, q) in parts.items() for side, p in zip(("min", "max"), q, strict=True)))


def position_filter(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Keeps points in the box of ``auto_thresholds``; nulls go."""
    joined = join_fields(df, rows.select(*order.keys(df), *(F.col(c).alias(f"__{c}") for c in ("min_x", "max_x", "min_y", "max_y"))))
    return joined.filter(F.col("X").between(F.col("__min_x"), F.col("__max_x")) & F.col("Y").between(F.col("__min_y"), F.col("__max_y"))).select(*df.columns)
