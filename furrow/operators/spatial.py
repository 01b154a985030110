"""Overlap, local outliers and stray positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.rcompat import need
from furrow.operators import motion, order

INCH = 0.0254
MAD_SCALE = 1.4826


def _cells(size: float | Column) -> dict[str, Column]:
    return {"__cx": F.floor(F.col("X") / size), "__cy": F.floor(F.col("Y") / size)}


def cell_overlap(df: DataFrame, cellsize: float = 0.3, max_pass: int = 50) -> DataFrame:
    """Adds ``overlap_flag``: more points than ``max_pass`` share the point's cell."""
    df = df.withColumns(_cells(cellsize))
    n = F.count("*").over(order.whole(df, "__cx", "__cy"))
    return df.withColumn("overlap_flag", n > max_pass).drop("__cx", "__cy")


def overlap_ratio(df: DataFrame, cellsize: float = 0.3, swath_unit: str = "in") -> DataFrame:
    """Adds ``overlap_ratio``: the share of a point's footprint that earlier points have covered.

    A cell is covered when a row is reached if the smallest row among all that cover it is
    smaller, so one aggregate over cells replaces the row-by-row marking.
    """
    need(df, "abort", "X", "Y", "Swath")
    on, w = order.keys(df), order.whole(df)
    half = F.col("Swath") * (INCH if swath_unit == "in" else 1.0) / 2
    base = df.select(*on, "row_id", "X", "Y", half.alias("half"), *(f(c).over(w).alias(f"{n}{c}") for c in ("X", "Y") for n, f in (("lo", F.min), ("hi", F.max))))
    for c in ("X", "Y"):
        base = base.withColumn(f"o{c}", F.floor(F.col(f"lo{c}") / cellsize) * cellsize)
        base = base.withColumn(f"n{c}", F.greatest(F.lit(1), F.ceil((F.ceil(F.col(f"hi{c}") / cellsize) * cellsize - F.col(f"o{c}")) / cellsize)))
        base = base.withColumn(f"c{c}", F.floor((F.col(c) - F.col(f"o{c}")) / cellsize) + 1)
    inside = F.col("cX").between(1, F.col("nX")) & F.col("cY").between(1, F.col("nY"))
    reach = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("half") / cellsize))
    marks = base.filter(inside).withColumn("kx", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("cX") - reach), F.least("nX", F.col("cX") + reach))))
    marks = marks.withColumn("ky", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("cY") - 1), F.least("nY", F.col("cY") + 1))))
    dx, dy = F.col("oX") + (F.col("kx") - 0.5) * cellsize - F.col("X"), F.col("oY") + (F.col("ky") - 0.5) * cellsize - F.col("Y")
    marks = marks.filter(F.sqrt(dx * dx + dy * dy) <= F.col("half")).select(*on, "row_id", "kx", "ky")
    first = F.min("row_id").over(Window.partitionBy(*on, "kx", "ky"))
    ratio = marks.withColumn("first", first).groupBy(*on, "row_id").agg((F.sum((F.col("first") < F.col("row_id")).cast("int")) / F.count("*")).alias("overlap_ratio"))
    return df.join(ratio, [*on, "row_id"], "left").withColumn("overlap_ratio", F.coalesce("overlap_ratio", F.lit(0.0)))


def overlap_filter(df: DataFrame, cellsize: float = 0.3, threshold: float = 0.5, swath_unit: str = "in") -> DataFrame:
    return overlap_ratio(df, cellsize, swath_unit).filter(F.col("overlap_ratio") <= threshold)


def _grid(df: DataFrame, n_swaths: float, unit: str) -> DataFrame:
    size = n_swaths * F.avg("Swath").over(order.whole(df)) * (INCH if unit == "in" else 1.0)
    return df.withColumn("__size", size).withColumns(_cells(F.col("__size")))


def local_sd(df: DataFrame, n_swaths: float = 5, limit: float = 3, min_cells: int = 3, column: str = "Flow", swath_unit: str = "in") -> DataFrame:
    """Adds ``local_sd_outlier``: outside mean and spread of the cell, or of the field where the cell has few rows; null for a null value."""
    if not need(df, "warn", "X", "Y", column, "Swath"):
        return df
    df = _grid(df, n_swaths, swath_unit)
    cell, all_rows = order.whole(df, "__cx", "__cy"), order.whole(df)
    full = F.count("*").over(cell) >= min_cells
    mean = F.coalesce(F.when(full, F.avg(column).over(cell)), F.avg(column).over(all_rows))
    sd = F.coalesce(F.when(full, F.stddev_samp(column).over(cell)), F.stddev_samp(column).over(all_rows))
    v = F.col(column)
    return df.withColumns({"__m": mean, "__s": sd}).withColumn("local_sd_outlier", (v > F.col("__m") + limit * F.col("__s")) | (v < F.col("__m") - limit * F.col("__s"))).drop("__size", "__cx", "__cy", "__m", "__s")


def local_sd_filter(df: DataFrame, **params) -> DataFrame:
    flagged = local_sd(df, **params)
    return flagged.filter(~F.col("local_sd_outlier")).drop("local_sd_outlier") if "local_sd_outlier" in flagged.columns else df


def local_mad(df: DataFrame, n_swaths: float = 5, limit: float = 2.4, min_cells: int = 3, column: str = "Flow", swath_unit: str = "in") -> DataFrame:
    """Adds ``local_sd_outlier``: beyond the cell's median by more than limit times its scaled deviation, scaled once more."""
    if not need(df, "silent", "X", "Y", column, "Swath"):
        return df
    df = _grid(df, n_swaths, swath_unit)
    cell = order.whole(df, "__cx", "__cy")
    ok = F.col("X").isNotNull() & F.col("Y").isNotNull() & F.col(column).isNotNull()
    df = df.withColumn("__v", F.when(ok, F.col(column))).withColumn("__n", F.count("__v").over(cell)).withColumn("__med", F.percentile("__v", 0.5).over(cell))
    df = df.withColumn("__mad", MAD_SCALE * F.percentile(F.abs(F.col("__v") - F.col("__med")), 0.5).over(cell))
    reach = limit * MAD_SCALE * F.col("__mad")
    out = (F.col("__n") >= min_cells) & (F.col("__mad") > 0) & (F.abs(F.col("__v") - F.col("__med")) > reach)
    return df.withColumn("local_sd_outlier", F.coalesce(out, F.lit(False))).drop("__size", "__cx", "__cy", "__v", "__n", "__med", "__mad")


def pass_std_filter(df: DataFrame, limit: float = 3, column: str = "Flow") -> DataFrame:
    """Keeps values within mean and spread of their pass; nulls go."""
    if not need(df, "warn", "Pass"):
        return df
    w = order.whole(df, "Pass")
    m, s = F.avg(column).over(w), F.stddev_samp(column).over(w)
    return df.withColumns({"__m": m, "__s": s}).filter(F.col(column).between(F.col("__m") - limit * F.col("__s"), F.col("__m") + limit * F.col("__s"))).drop("__m", "__s")


def sliding_window(df: DataFrame, size: int = 11, n_std: float = 3, column: str = "Flow") -> DataFrame:
    """Keeps values near the centred rolling mean; where the window is not full there is none, and the row stays."""
    w = order.by_row(df).rowsBetween(-(size // 2), size // 2)
    mean = F.when((F.count("*").over(w) == size) & (F.count(column).over(w) == size), F.avg(column).over(w))
    df = df.withColumns({"__m": mean, "__s": F.stddev_samp(column).over(w)})
    ok = F.abs(F.col(column) - F.col("__m")) <= n_std * F.col("__s")
    return df.filter(F.coalesce(ok, F.lit(True))).drop("__m", "__s")


def stray_positions(df: DataFrame, buffer: float = 50, min_points: int = 5, grid: float = 20) -> DataFrame:
    """Adds ``position_stray``: the point's cell has few points and no point of a well-filled cell lies within the buffer.

    If no cell is well filled, the fullest four fifths count as such.  Points meet
    through buckets of the buffer's size, so only neighbouring buckets are compared.
    """
    on, w = order.keys(df), order.whole(df)
    lo = {c: F.min(c).over(w) for c in ("X", "Y")}
    base = df.withColumns({"__cx": F.floor((F.col("X") - lo["X"]) / grid), "__cy": F.floor((F.col("Y") - lo["Y"]) / grid), "__small": (F.max("X").over(w) - lo["X"] < grid) | (F.max("Y").over(w) - lo["Y"] < grid)})
    cells = base.groupBy(*on, "__cx", "__cy").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*on)
    cells = cells.withColumns({"best": F.max("n").over(by), "r": F.row_number().over(by.orderBy(F.desc("n"), "__cx", "__cy")), "all": F.count("*").over(by)})
    good = F.when(F.col("best") >= min_points, F.col("n") >= min_points).otherwise(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("all") * 0.8)))
    base = base.join(cells.select(*on, "__cx", "__cy", good.alias("__ok")), [*on, "__cx", "__cy"])
    near = {"bx": F.floor(F.col("X") / buffer), "by": F.floor(F.col("Y") / buffer)}
    ok = base.filter("__ok").select(*on, F.col("X").alias("vx"), F.col("Y").alias("vy"), *(c.alias(n) for n, c in near.items()))
    lost = base.filter("NOT __ok").select(*on, "row_id", "X", "Y", *(c.alias(n) for n, c in near.items()))
    for b in ("bx", "by"):
        lost = lost.withColumn(b, F.explode(F.array(F.col(b) - 1, F.col(b), F.col(b) + 1)))
    saved = lost.join(ok, [*on, "bx", "by"]).filter(F.hypot(F.col("X") - F.col("vx"), F.col("Y") - F.col("vy")) <= buffer).select(*on, "row_id", F.lit(True).alias("__saved")).distinct()
    out = base.join(saved, [*on, "row_id"], "left").withColumn("position_stray", ~F.col("__small") & ~F.col("__ok") & F.col("__saved").isNull())
    return out.select(*df.columns, "position_stray")


def position_box(df: DataFrame, gbuffer: float = 100) -> DataFrame:
    """Adds ``position_outlier``: outside the field's bounding box shrunk by the buffer; never so if the box collapses."""
    w = order.whole(df)
    box = {"__x0": F.min("X").over(w) + gbuffer, "__x1": F.max("X").over(w) - gbuffer, "__y0": F.min("Y").over(w) + gbuffer, "__y1": F.max("Y").over(w) - gbuffer}
    df = df.withColumns(box)
    inside = F.col("X").between(F.col("__x0"), F.col("__x1")) & F.col("Y").between(F.col("__y0"), F.col("__y1"))
    collapsed = (F.col("__x0") >= F.col("__x1")) | (F.col("__y0") >= F.col("__y1"))
    return df.withColumn("position_outlier", F.coalesce(~collapsed & ~inside, F.lit(False))).drop(*box)


FLAGS = {"overlap": "overlap_flag", "local_sd": "local_sd_outlier", "velocity_jump": "velocity_jump", "heading": "heading_anomaly", "position": "position_outlier"}


def detect_anomalies(df: DataFrame, types: str | list[str] = "all", action: str = "filter", **params) -> DataFrame:
    """Runs the named detectors in the caller's order: ``filter`` drops what they flag, ``detect`` keeps the flags, ``report`` returns the data as they are."""
    if action not in ("filter", "detect", "report"):
        raise ValueError(f"unknown action {action}")
    names = list(FLAGS) if types == "all" else [types] if isinstance(types, str) else list(types)
    given = {
        "overlap": lambda d: cell_overlap(d, params.get("cellsize", 0.3), params.get("max_pass", 50)),
        "local_sd": lambda d: local_mad(d, params.get("n_swaths", 5), params.get("lsd_limit", 2.4), params.get("min_cells", 3)),
        "velocity_jump": lambda d: motion.velocity_jump(d, params.get("max_acceleration", 5), params.get("max_deceleration", -8)),
        "heading": lambda d: motion.heading_anomaly(d, params.get("max_heading_change", 60)),
        "position": lambda d: position_box(d, params.get("gbuffer", 100)),
    }
    if action == "report":
        return df
    for name in names:
        flagged = given[name](df)
        flag = FLAGS[name]
        df = flagged if action == "detect" or flag not in flagged.columns else flagged.filter(~F.col(flag)).drop(flag)
    return df


def coherence(df: DataFrame, column: str = "Flow", bins: int = 50) -> DataFrame:
    """``rsc`` of each field: how far cell means between quantile breaks follow the whole, 0 to 1; 0 for few full cells."""
    on, w = order.keys(df), order.whole(df)
    points = [i / (bins - 1) for i in range(bins)]
    df = df.withColumns({f"__b{c}": F.percentile(c, points).over(w) for c in ("X", "Y")})
    reached = lambda c: F.size(F.filter(f"__b{c}", lambda b: b <= F.col(c)))
    at = {f"__k{c}": reached(c) for c in ("X", "Y")}
    df = df.withColumns({"__mean": F.avg(column).over(w), "__var": F.var_samp(column).over(w), **at})
    inside = F.col("__kX").between(1, bins - 1) & F.col("__kY").between(1, bins - 1) & F.col(column).isNotNull()
    cells = df.filter(inside).groupBy(*on, "__kX", "__kY").agg(F.avg(column).alias("m"), F.count("*").alias("n"), F.first("__mean").alias("mean"), F.first("__var").alias("var")).filter("n > 2")
    within = F.avg((F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))) / F.first("var")
    score = F.when((F.count("*") >= 10) & (F.first("var") > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - within))).otherwise(0.0)
    return cells.groupBy(*on).agg(score.alias("rsc"))
