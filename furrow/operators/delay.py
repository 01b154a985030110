"""Sensor delays: shifts, interpolation, trimming, and the search for the best shift."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.rcompat import has, need
from furrow.operators import order

MAX_NEIGHBOURS, MIN_VALID = 10, 50
_NEAR = 1e-10


def shifted(df: DataFrame, column: str, delay: int) -> Column:
    """The value ``delay`` rows later in the field; earlier for a negative one."""
    w = order.by_row(df)
    return F.lead(column, delay).over(w) if delay >= 0 else F.lag(column, -delay).over(w)


def flow_delay(df: DataFrame, delay: int = 2, column: str = "Flow") -> DataFrame:
    """Shifts the column and keeps what it was as ``<column>_raw``; 0 changes nothing."""
    if delay == 0:
        return df
    return df.withColumn(f"{column}_raw", F.col(column)).withColumn(column, shifted(df, f"{column}", delay))


def moisture_delay(df: DataFrame, delay: int = 15, direction: str = "forward") -> DataFrame:
    """Forward takes the value of earlier rows; rows without one go.  0 only adds the copy."""
    raw = df.withColumn("Moisture_raw", F.col("Moisture"))
    if delay == 0:
        return raw
    value = shifted(df, "Moisture", -delay if direction == "forward" else delay)
    return raw.withColumn("Moisture", value).filter(F.col("Moisture").isNotNull())


def interpolate(df: DataFrame, column: str = "Flow", edges: bool = False) -> DataFrame:
    """Fills nulls on the line between the nearest values before and after, by row number.

    Nulls at a field's ends stay, or take the field's mean with ``edges``.
    Fields with fewer than two values stay as they are.
    """
    w, all_rows = order.by_row(df), order.whole(df)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    v = F.col(column)
    df = df.withColumn("__n", F.row_number().over(w)).withColumn("__i", F.when(v.isNotNull(), F.col("__n")))
    df = df.withColumns({"__v0": F.last(column, ignorenulls=True).over(before), "__i0": F.last("__i", ignorenulls=True).over(before), "__v1": F.first(column, ignorenulls=True).over(after), "__i1": F.first("__i", ignorenulls=True).over(after)})
    df = df.withColumns({"__count": F.count(column).over(all_rows), "__mean": F.avg(column).over(all_rows)})
    line = F.col("__v0") + (F.col("__v1") - F.col("__v0")) * (F.col("__n") - F.col("__i0")) / (F.col("__i1") - F.col("__i0"))
    filled = F.coalesce(v, F.when(F.col("__count") >= 2, line), *([F.col("__mean")] if edges else []))
    return df.withColumn(column, filled).drop("__n", "__i", "__v0", "__i0", "__v1", "__i1", "__count", "__mean")


def trim_passes(df: DataFrame, delay: float) -> DataFrame:
    """Drops as many seconds at an end of each pass as the delay is long: the first ones, or the last for a negative one.

    A null interval makes the running time null from there on, and such rows
    stay.  Adds ``row_in_pass`` and ``n_in_pass``.
    """
    w, whole = order.by_time(df, "Pass"), order.whole(df, "Pass")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    broken = F.max(F.col("Interval").isNull()).over(upto)
    run = F.when(~broken, F.sum("Interval").over(upto))
    total = F.when(~F.max(F.col("Interval").isNull()).over(whole), F.sum("Interval").over(whole))
    df = df.withColumns({"__run": run, "__total": total, "row_in_pass": F.row_number().over(w), "n_in_pass": F.count("*").over(whole)})
    keep = (F.col("__total") - F.col("__run")) > abs(delay) if delay < 0 else F.col("__run") > abs(delay)
    return (df.filter(keep | keep.isNull()) if delay else df).drop("__run", "__total")


def grid_sample(df: DataFrame, max_points: int = 10_000, cellsize: float = 100, seed: int | Column = 42) -> DataFrame:
    """Whole cells in the order of a hash, as long as a field's points do not exceed the maximum; all points if not even one cell fits.

    ``seed`` may be a column ``iter``: each of its values is sampled on its own.
    """
    cell = {"__cx": F.floor(F.col("X") / cellsize), "__cy": F.floor(F.col("Y") / cellsize)}
    seed = F.lit(seed) if isinstance(seed, int) else seed
    columns, df = df.columns, df.withColumns(cell).withColumn("__h", F.xxhash64("__cx", "__cy", seed))
    field = order.whole(df, "iter")
    # All points of a cell are peers, so a running count takes in whole cells.
    df = df.withColumn("__upto", F.count("*").over(field.orderBy("__h", "__cx", "__cy")))
    df = df.withColumn("__least", F.min("__upto").over(field))
    return df.filter((F.col("__upto") <= max_points) | (F.col("__least") > max_points)).select(*columns)


def _nearest(x: np.ndarray, y: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and indices of many nearest points of each point in order, ties by index; infinite where that order is not sure."""
    n = len(x)
    many = min(many, n - 1)
    dist, near = np.empty((n, many)), np.empty((n, many), np.int64)
    for a in range(0, n, 500):
        dx, dy = x[a : a + 500, None] - x, y[a : a + 500, None] - y
        d = dx * dx + dy * dy
        d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
        at = np.sort(np.argpartition(d, many - 1, axis=1)[:, :many], axis=1)
        own = np.take_along_axis(d, at, axis=1)
        by = np.argsort(own, axis=1, kind="stable")
        own = np.take_along_axis(own, by, axis=1)
        # Of points as far as the last one, some may have been left out.
        if many < n - 1:
            own[own == own[:, -1:]] = np.inf
        dist[a : a + 500], near[a : a + 500] = own, np.take_along_axis(at, by, axis=1)
    return dist, near


class Places:
    """The points of a field, whose neighbours serve the scores of all delays."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y
        self.dist, self.near = _nearest(x, y, 4 * MAX_NEIGHBOURS) if len(x) > 1 else (np.empty((len(x), 0)), np.empty((len(x), 0), np.int64))

    def moran(self, value: np.ndarray, k: int) -> float:
        """Moran's I of the points with a value, with inverse squared distances to the k nearest such points, ties by order; 0 where it has no meaning."""
        ok = ~np.isnan(value)
        some, n = np.flatnonzero(ok), int(ok.sum())
        if n < k + 5 or len(np.unique(self.x[ok])) < 3 or len(np.unique(self.y[ok])) < 3:
            return 0.0
        sd = value[ok].std(ddof=1)
        if not sd > 0:
            return 0.0
        z = np.where(ok, (value - value[ok].mean()) / sd, 0.0)
        usable = ok[self.near] & np.isfinite(self.dist)
        rank = np.cumsum(usable, axis=1)
        take = usable & (rank <= k)
        w = np.where(take, 1 / (np.where(take, self.dist, 1.0) + _NEAR), 0.0)
        with np.errstate(invalid="ignore"):
            part = z * (w * z[self.near]).sum(axis=1) / w.sum(axis=1)
        found = rank[:, -1] >= k if rank.shape[1] else np.zeros(len(value), bool)
        # The few points that have too many neighbours without a value look at all points.
        rest = np.flatnonzero(ok & ~found)
        for a in range(0, len(rest), 500):
            i = rest[a : a + 500]
            dx, dy = self.x[i, None] - self.x[some], self.y[i, None] - self.y[some]
            d = dx * dx + dy * dy
            d[i[:, None] == some] = np.inf
            near = np.argsort(d, axis=1, kind="stable")[:, :k]
            own = 1 / (np.take_along_axis(d, near, axis=1) + _NEAR)
            part[i] = z[i] * (own * z[some[near]]).sum(axis=1) / own.sum(axis=1)
        return float(part[ok].sum()) / float((z * z).sum())


def delay_scores(df: DataFrame, delays: list[int], column: str = "Flow") -> DataFrame:
    """Rows (field_id, delay, iter, score): Moran's I of the shifted values; null for fifty valid rows or fewer.

    A field, or one ``iter`` of its points where the table has that column, is one
    group: its points are bounded by the sample that is taken before.
    """
    on = order.keys(df)
    turn = F.col("iter") if has(df, "iter") else F.lit(1).alias("iter")
    given = df.select(*on, turn, "row_id", F.col("X").cast("double").alias("X"), F.col("Y").cast("double").alias("Y"), F.col(column).cast("double").alias("v"))
    by = [*on, "iter"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields if f.name in on), "delay int, iter int, score double"])

    def score(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("row_id")
        # The row that a value moves from, before points without a place go.
        placed = np.flatnonzero((points["X"].notna() & points["Y"].notna()).to_numpy())
        v = points["v"].to_numpy()
        places = Places(points["X"].to_numpy()[placed], points["Y"].to_numpy()[placed])
        rows = []
        for d in delays:
            source = placed + d
            moved = np.where((source >= 0) & (source < len(v)), v[np.clip(source, 0, max(len(v) - 1, 0))], np.nan) if len(v) else v
            n = int((~np.isnan(moved)).sum())
            rows.append((*key[:-1], d, key[-1], places.moran(moved, min(MAX_NEIGHBOURS, n // 10)) if n > MIN_VALID else None))
        return pd.DataFrame(rows, columns=[*on, "delay", "iter", "score"])

    return given.groupBy(*by).applyInPandas(score, schema)


@dataclass
class DelayResult:
    """``scores``: (field_id, delay, mean_score, sd_score); ``best``: (field_id, delay, mean_score, stability); the delays tried."""

    scores: DataFrame
    best: DataFrame
    delays: list[int]


def delay_adjustment(df: DataFrame, delays: list[int] | None = None, n_iterations: int = 5, column: str = "Flow", max_points: int = 10_000) -> DelayResult:
    """The delay of the highest mean score in each field, the smallest of equals; 0 for a field that has none.

    Fields above ``max_points`` are sampled anew in each iteration; for others all
    iterations agree, so one is computed and the spread is 0.  Delays are in rows.
    """
    delays = list(range(-25, 26)) if delays is None else delays
    on = order.keys(df)
    if not has(df, column, "X", "Y"):
        warnings.warn("columns for the delay search are missing; the delay is 0", stacklevel=2)
        none = df.limit(0).select(*on, F.lit(0).alias("delay"), F.lit(0.0).alias("mean_score"), F.lit(0.0).alias("sd_score"), F.lit(0.0).alias("stability"))
        return DelayResult(none.drop("stability"), none.drop("sd_score"), delays)
    large = F.count("*").over(order.whole(df)) > max_points
    turns = df.select(*on, "row_id", "X", "Y", column).withColumn("__large", large)
    turns = turns.withColumn("iter", F.explode(F.when(F.col("__large"), F.sequence(F.lit(1), F.lit(n_iterations))).otherwise(F.array(F.lit(1)))))
    scores = delay_scores(grid_sample(turns, max_points, 100, F.col("iter") * 100), delays, column)
    sd = F.coalesce(F.stddev_samp("score"), F.lit(0.0) if n_iterations > 1 else F.lit(None).cast("double"))
    per_delay = scores.groupBy(*on, "delay").agg(F.avg("score").alias("mean_score"), sd.alias("sd_score"))
    # The highest score, then the smallest delay; a field without scores has the delay 0.
    best = per_delay.groupBy(*on).agg(F.max(F.when(F.col("mean_score").isNotNull(), F.struct("mean_score", (-F.col("delay")).alias("minus"), "sd_score"))).alias("b"))
    stability = F.when(F.col("b.mean_score") != 0, F.col("b.sd_score") / F.col("b.mean_score"))
    best = best.select(*on, F.coalesce(-F.col("b.minus"), F.lit(0)).alias("delay"), "b.mean_score", stability.alias("stability"))
    return DelayResult(per_delay, best, delays)


def top_delays(result: DelayResult, n: int = 5) -> DataFrame:
    on = [c for c in result.scores.columns if c == "field_id"]
    w = Window.partitionBy(*on).orderBy(F.desc_nulls_last("mean_score"), "delay")
    return result.scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def shift_by_field(df: DataFrame, found: DelayResult, column: str, edges: bool = True) -> DataFrame:
    """Shifts each field by its own delay, without a driver round trip, and fills the gaps; adds ``<column>_raw`` and ``<column>_delay``.

    The delays tried are few, so each is a window expression, and all share one sort.
    """
    on = order.keys(df)
    delay = found.best.select(*on, F.col("delay").alias(f"{column}_delay"))
    df = df.join(delay, on, "left") if on else df.crossJoin(F.broadcast(delay))
    tried = {d: shifted(df, column, d) for d in found.delays}
    chosen = F.coalesce(f"{column}_delay", F.lit(0))
    value = F.coalesce(*(F.when(chosen == d, v) for d, v in tried.items()), F.when(~chosen.isin(*tried), F.col(column)))
    return interpolate(df.withColumn(f"{column}_raw", F.col(column)).withColumn(column, value), column, edges)


def optimize_delays(df: DataFrame, types: str = "both", method: str = "delay_adjustment", delays: list[int] | None = None, n_iterations: int = 10, apply_correction: bool = True) -> tuple[DataFrame, dict[str, DelayResult]]:
    """Searches the delay of Flow, Moisture or both, and shifts them if wanted."""
    if method != "delay_adjustment" or types not in ("flow", "moisture", "both"):
        raise ValueError("unknown method or type")
    found = {}
    for name, column in (("flow", "Flow"), ("moisture", "Moisture")):
        if types in (name, "both") and need(df, "warn", column):
            found[name] = delay_adjustment(df, delays, n_iterations, column)
            if apply_correction:
                df = shift_by_field(df, found[name], column)
    return df, found
