"""What each step removes, and reports on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.rcompat import finite, has
from furrow.operators import motion, order, spatial, thresholds

LOG = "orig_row_id long, step string, reason string, value double"


def removed(before: DataFrame, after: DataFrame, step: str, reason: str, value: str | None = None) -> DataFrame:
    """Deletion log rows of the points that are in ``before`` only."""
    on = order.keys(before)
    gone = before.join(after.select(*on, "orig_row_id"), [*on, "orig_row_id"], "left_anti")
    shown = F.col(value).cast("double") if value and value in before.columns else F.lit(None).cast("double")
    return gone.select(*on, "orig_row_id", F.lit(step).alias("step"), F.lit(reason).alias("reason"), shown.alias("value"))


def split(df: DataFrame, keep: Column, step: str, reason: str, value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept points and the log of the others; a null condition removes."""
    ok = F.coalesce(keep, F.lit(False))
    shown = F.col(value).cast("double") if value and value in df.columns else F.lit(None).cast("double")
    return df.filter(ok), df.filter(~ok).select(*order.keys(df), "orig_row_id", F.lit(step).alias("step"), F.lit(reason).alias("reason"), shown.alias("value"))


def deletions_by_step(log: DataFrame) -> DataFrame:
    return log.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "step")


def filter_counts(df: DataFrame, velocity_jump: bool = False, heading_anomaly: bool = False, n_std: float = 3, overlap: float = 0.5, cellsize: float = 0.3, n_swaths: float = 5, lsd_limit: float = 2.4, min_cells: int = 3, swath_unit: str = "in") -> DataFrame:
    """How many points each filter would drop on its own, one row a field, counted in one aggregate."""
    on, w = order.keys(df), order.whole(df)
    drop: dict[str, Column] = {}
    if has(df, "HeaderStatus"):
        drop["header"] = ~(F.col("HeaderStatus").isin(0, 1, 33) | F.col("HeaderStatus").isNull())
    if has(df, "GPSStatus"):
        s = F.col("GPSStatus").try_cast("double")
        drop["gps"] = ~(s.isNull() | (s >= 4))
    df = df.withColumn("velocity", motion.clean_velocity(df))
    limits = thresholds.auto_thresholds(df, 0.10, 0.90, 1.1, 0.05, 0.95, 1.1)
    df = thresholds.join_fields(df, limits)
    drop["velocity"] = ~F.col("velocity").between(F.col("min_velocity"), F.col("max_velocity"))
    if velocity_jump:
        df = motion.velocity_jump(df, 3, -5).withColumnRenamed("velocity_jump", "__jump")
        drop["velocity_jump"] = F.col("__jump")
    if heading_anomaly:
        df = motion.heading_anomaly(df).withColumnRenamed("heading_anomaly", "__turn")
        drop["heading_anomaly"] = F.col("__turn")
    if has(df, "Yield_kg_ha"):
        drop["null_yield"] = ~F.coalesce(F.col("Yield_kg_ha") > 0, F.lit(False))
        drop["yield_range"] = ~F.coalesce(F.col("Yield_kg_ha").between(F.col("min_yield"), F.col("max_yield")), F.lit(False))
    if has(df, "Moisture"):
        m, s = F.avg("Moisture").over(w), F.stddev_samp("Moisture").over(w)
        df = df.withColumns({"__lo": m - n_std * s, "__hi": m + n_std * s})
        drop["moisture"] = ~(F.col("Moisture").isNull() | F.col("Moisture").between(F.col("__lo"), F.col("__hi")))
    if has(df, "Swath"):
        df = spatial.overlap_ratio(df, cellsize, swath_unit)
        drop["overlap"] = F.col("overlap_ratio") > overlap
        df = spatial.local_sd(df, n_swaths, lsd_limit, min_cells, swath_unit=swath_unit)
        drop["local_sd"] = F.coalesce(F.col("local_sd_outlier"), F.lit(True))
    return df.groupBy(*on).agg(*(F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in drop.items()))


def pass_medians(df: DataFrame, limit: float = 2.5) -> DataFrame:
    """Passes whose median yield is far from the others' (``abnormal``)."""
    on = order.keys(df)
    per_pass = df.filter(F.col("Pass").isNotNull()).groupBy(*on, "Pass").agg(F.percentile("Yield_kg_ha", 0.5).alias("median_yield"), F.count("*").alias("n_points"))
    w = order.whole(per_pass)
    far = F.abs(F.col("median_yield") - F.percentile("median_yield", 0.5).over(w)) > limit * F.stddev_samp("median_yield").over(w)
    return per_pass.withColumn("abnormal", F.coalesce(far, F.lit(False)))


def abnormal_passes(df: DataFrame, limit: float = 2.5) -> DataFrame:
    """Adds ``__abnormal``: the point is in such a pass; false without a pass."""
    in_pass, field = order.whole(df, "Pass"), order.whole(df)
    df = df.withColumns({"__median": F.when(F.col("Pass").isNotNull(), F.percentile("Yield_kg_ha", 0.5).over(in_pass)), "__place": F.row_number().over(in_pass.orderBy("row_id"))})
    once = F.when(F.col("__place") == 1, F.col("__median"))  # one value a pass
    far = F.abs(F.col("__median") - F.percentile(once, 0.5).over(field)) > limit * F.stddev_samp(once).over(field)
    return df.withColumn("__abnormal", F.coalesce(far, F.lit(False))).drop("__median", "__place")


def pass_filter(df: DataFrame, limit: float = 2.5) -> DataFrame:
    bad = pass_medians(df, limit).filter("abnormal").select(*order.keys(df), "Pass")
    return df.join(bad, [*order.keys(df), "Pass"], "left_anti")


def stats(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    m, s = F.avg(column), F.stddev_samp(column)
    cv = F.when(m != 0, s / m * 100)
    values = {"n": F.count("*"), "mean": m, "sd": s, "cv": cv, "min": F.min(column), "max": F.max(column)}
    return df.groupBy(*order.keys(df)).agg(*(c.alias(prefix + n) for n, c in values.items()))


def validate(clean: DataFrame, raw: DataFrame, column: str = "Flow") -> DataFrame:
    """Retention, variation before and after, its improvement, and a warning for too few or hardly any removed points."""
    a, b = stats(raw, column, "raw_"), stats(clean, column, "clean_")
    both = thresholds.join_fields(a, b) if not order.keys(raw) else a.join(b, order.keys(raw), "left")
    retention = F.coalesce("clean_n", F.lit(0)) / F.col("raw_n")
    out = both.withColumn("retention", retention).withColumn("cv_improvement", F.when(F.col("raw_cv") != 0, (F.col("raw_cv") - F.col("clean_cv")) / F.col("raw_cv")))
    return out.withColumn("warning", F.when(F.col("retention") < 0.5, "too many points removed").when(F.col("retention") > 0.99, "hardly any points removed"))


#: The column that shows why a step removes a point, and its unit.
STEP_VALUES = {"gps": ("GPSStatus", ""), "velocity": ("velocity", "m/s"), "header": ("HeaderStatus", ""), "null_yield": ("Yield_kg_ha", "kg/ha"), "yield_range": ("Yield_kg_ha", "kg/ha"), "moisture": ("Moisture", "%"), "overlap": ("overlap_ratio", ""), "local_sd": ("Flow", "kg/ha"), "pass": ("Yield_kg_ha", "kg/ha")}


def diagnostics(raw: DataFrame, log: DataFrame) -> DataFrame:
    """Every raw point for every step of the log: kept or removed, with a value and its unit; a value in the log wins.

    Steps are a few names, so they are spread over the points as an array.
    """
    on = order.keys(raw)
    steps = [r["step"] for r in log.select("step").distinct().orderBy("step").collect()]
    shown, unit = F.lit(None).cast("double"), F.lit("kg/ha")
    for step, (column, name) in STEP_VALUES.items():
        if column in raw.columns:
            shown = F.when(F.col("step") == step, F.col(column).cast("double")).otherwise(shown)
            unit = F.when(F.col("step") == step, F.lit(name)).otherwise(unit)
    if "Flow" in raw.columns:
        shown = F.when(~F.col("step").isin(*STEP_VALUES), F.col("Flow").cast("double")).otherwise(shown)
    wide = raw.withColumn("step", F.explode(F.array(*map(F.lit, steps)).cast("array<string>")))
    marks = log.groupBy(*on, "orig_row_id", "step").agg(F.first("value").alias("__value"), F.lit(True).alias("__gone"))
    out = wide.join(marks, [*on, "orig_row_id", "step"], "left")
    status = F.when(F.col("__gone"), "removed").otherwise("kept")
    return out.select(*on, "orig_row_id", "step", status.alias("status"), F.coalesce("__value", shown).alias("value"), unit.alias("unit"))


def diagnostic_stats(diagnosed: DataFrame) -> DataFrame:
    """Numbers, mean, median, spread, quartiles and range of each step's kept and removed points."""
    v = F.col("value")
    return diagnosed.groupBy("step", "status").agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_samp(v).alias("sd"), F.percentile(v, 0.25).alias("q25"), F.percentile(v, 0.75).alias("q75"), F.min(v).alias("min"), F.max(v).alias("max"))


def histogram(df: DataFrame, column: str, width: float = 250) -> DataFrame:
    return df.filter(finite(F.col(column))).groupBy((F.floor(F.col(column) / width) * width).cast("double").alias("bin")).agg(F.count("*").alias("n"))


def clamped_histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Values clamped to their quantiles 0.02 and 0.98, counted in equal bins, for each field; in the last bin where the quantiles are equal.

    Quantiles are weighted means of two neighbours in order, also of equal ones: a last
    bit of difference there moves values across the edges of bins.
    """
    on, w = order.keys(df), order.whole(df)
    df = df.filter(finite(F.col(column))).withColumns({"__n": F.count("*").over(w), "__place": F.row_number().over(w.orderBy(column)) - 1})

    def quantile(q: float) -> Column:
        at = (F.col("__n") - 1) * F.lit(q)
        near = lambda place: F.max(F.when(F.col("__place") == place, F.col(column))).over(w)
        return near(F.floor(at)) * (1 - (at - F.floor(at))) + near(F.ceil(at)) * (at - F.floor(at))

    df = df.withColumns({"__a": quantile(0.02), "__b": quantile(0.98)})
    v = F.least(F.greatest(F.col(column), F.col("__a")), F.col("__b"))
    at = F.when(F.col("__b") != F.col("__a"), F.least(F.floor((v - F.col("__a")) / (F.col("__b") - F.col("__a")) * bins), F.lit(bins - 1))).otherwise(bins - 1)
    return df.withColumn("bin", at.cast("int")).groupBy(*on, "bin").agg(F.count("*").alias("n"))
