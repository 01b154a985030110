"""Velocity, acceleration and heading from consecutive points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from furrow.functions.rcompat import INF, finite, has, need, r_div
from furrow.operators import order


def _step(w: WindowSpec, n: int = 1) -> Column:
    """Distance to the point n rows before (or after, for negative n)."""
    return F.hypot(F.col("X") - F.lag("X", n).over(w), F.col("Y") - F.lag("Y", n).over(w))


def velocity(df: DataFrame, interval_null: float | None = None) -> Column:
    """Distance from the previous row over the interval; null in a field's first row."""
    interval = F.col("Interval") if has(df, "Interval") else F.lit(1.0)
    if interval_null is not None:
        interval = F.coalesce(interval.cast("double"), F.lit(interval_null))
    return r_div(_step(order.by_row(df)), interval)


def clean_velocity(df: DataFrame) -> Column:
    """As the pipelines take it: a null interval is 1, and what is not finite is 0."""
    v = velocity(df, 1.0)
    return F.when(finite(v), v).otherwise(0.0)


def distances(df: DataFrame) -> DataFrame:
    """``distance`` to the previous point; 0 in the first row."""
    need(df, "abort", "X", "Y")
    return df.withColumn("distance", F.coalesce(_step(order.by_row(df)), F.lit(0.0)))


def velocity_jump(df: DataFrame, max_acceleration: float = 5, max_deceleration: float = -8) -> DataFrame:
    """Adds ``velocity_jump``: the change of velocity around a point is out of bounds; never so at a field's ends."""
    if not need(df, "warn", "X", "Y", "GPS_Time"):
        return df
    w = order.by_time(df)
    interval = F.coalesce(F.col("Interval").cast("double"), F.lit(1.0)) if has(df, "Interval") else F.lit(1.0)
    near = lambda n: F.coalesce(F.lag("Interval", n).over(w).cast("double"), F.lit(1.0)) if has(df, "Interval") else F.lit(1.0)
    a = r_div(r_div(_step(w, -1), near(-1)) - r_div(_step(w, 1), near(1)), interval)
    return df.withColumn("velocity_jump", F.coalesce((a > max_acceleration) | (a < max_deceleration), F.lit(False)))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def heading_anomaly(df: DataFrame, max_change: float = 60) -> DataFrame:
    """Adds ``heading_anomaly``: the direction turns by more than the bound from one step to the next."""
    if not need(df, "warn", "X", "Y", "GPS_Time"):
        return df
    w = order.by_time(df)
    df = df.withColumn("__h", bearing(F.col("X") - F.lag("X").over(w), F.col("Y") - F.lag("Y").over(w)))
    turn = F.abs(F.col("__h") - F.lag("__h").over(w))
    return df.withColumn("heading_anomaly", F.coalesce(F.least(turn, 360 - turn) > max_change, F.lit(False))).drop("__h")


def smooth_heading(df: DataFrame, x: str = "X", y: str = "Y", turn: float = 30, spread: float = 15) -> DataFrame:
    """Adds ``heading``: from a point back to its predecessor, smoothed between turns.

    A turn above the bound starts a segment.  In a wide-spread segment a point
    takes the circular mean of three neighbours, its ends stay raw; in a narrow one of three points or
    more all take the segment's circular mean; shorter ones stay raw.
    """
    w = order.by_time(df)
    raw = bearing(F.lag(x).over(w) - F.col(x), F.lag(y).over(w) - F.col(y))
    df = df.withColumn("__raw", raw)
    df = df.withColumn("__raw", F.coalesce("__raw", F.lead("__raw").over(w), F.lit(0.0)))
    change = F.abs(F.col("__raw") - F.lag("__raw").over(w))
    df = df.withColumn("__turn", F.coalesce((F.least(change, 360 - change) > turn).cast("int"), F.lit(0)))
    df = df.withColumn("__seg", F.sum("__turn").over(w))
    rad = F.radians("__raw")
    df = df.withColumns({"__sin": F.sin(rad), "__cos": F.cos(rad)})
    seg, in_seg = order.whole(df, "__seg"), order.by_time(df, "__seg")
    three = in_seg.rowsBetween(-1, 1)
    ms, mc = F.avg("__sin").over(seg), F.avg("__cos").over(seg)
    length = F.least(F.lit(1.0), F.greatest(F.hypot(ms, mc), F.lit(1e-12)))
    sd = F.degrees(F.sqrt(-2 * F.log(length)))
    mean3 = bearing(F.avg("__sin").over(three), F.avg("__cos").over(three))
    n, n3 = F.count("*").over(seg), F.count("*").over(three)
    heading = F.when(sd > spread, F.when(n3 == 3, mean3).otherwise(F.col("__raw"))).when(n >= 3, bearing(ms, mc)).otherwise(F.col("__raw"))
    return df.withColumn("heading", heading).drop("__raw", "__turn", "__seg", "__sin", "__cos")


__all__ = ["INF", "bearing", "clean_velocity", "distances", "heading_anomaly", "smooth_heading", "velocity", "velocity_jump"]
