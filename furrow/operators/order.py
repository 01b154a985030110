"""Window specifications: every one is partitioned by the field, if there is a ``field_id``.

Pipelines mark the points that a step removes instead of dropping them; windows and
joins of later steps then take the points that are still there, and those that are not, apart.

A field holds tens of thousands of points, so its partition is small; a table
of many fields scales by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec

#: Whether a point is still there, in pipelines.
ALIVE = "__alive"


def keys(df: DataFrame, *more: str) -> list[str]:
    return [c for c in ("field_id", ALIVE, *more) if c in df.columns]


def whole(df: DataFrame, *more: str) -> WindowSpec:
    """All points of a field (and of a pass or cell within it)."""
    return Window.partitionBy(*keys(df, *more))


def by_row(df: DataFrame, *more: str) -> WindowSpec:
    return whole(df, *more).orderBy("row_id")


def by_time(df: DataFrame, *more: str) -> WindowSpec:
    return whole(df, *more).orderBy("GPS_Time", "row_id")
