"""Cleaning pipelines: ordered steps over fields, with a log of what each removes.

Filters change a point's neighbours, so velocities and windows are taken anew after each.  A
step does not drop points but marks them with its name, and the windows of later steps are
partitioned by whether a point is marked: one pass over the fields gives both what is clean and
the log.  The delay of each field is joined to its points, so no value returns to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import geo, units
from furrow.functions.rcompat import has, need, no_nan
from furrow.operators import audit, delay, filters, motion, order, spatial, thresholds
from furrow.sources.text import read_yield_data


@dataclass(frozen=True)
class CleaningParams:
    """Which steps run, and their bounds."""

    position: bool = False
    delays: bool = True
    gps: bool = True
    velocity: bool = True
    velocity_jump: bool = False
    heading: bool = False
    trim: bool = True
    header: bool = True
    null_yield: bool = True
    yield_range: bool = True
    moisture: bool = True
    overlap: bool = True
    local_sd: bool = True
    pass_filter: bool = False
    delay_range: tuple[int, ...] = tuple(range(-25, 26))
    n_iterations: int = 10
    yllim: float = 0.10
    yulim: float = 0.90
    yscale: float = 1.1
    vllim: float = 0.05
    vulim: float = 0.95
    vscale: float = 1.1
    minv_abs: float = 0.5
    miny_abs: float = 0
    gbuffer: float = 100
    n_std: float = 3
    cellsize: float = 0.3
    overlap_threshold: float = 0.5
    n_swaths: float = 5
    lsd_limit: float = 2.4
    min_cells: int = 3
    max_acceleration: float = 3
    max_deceleration: float = -5
    max_heading_change: float = 60
    pass_threshold: float = 2.5
    swath_unit: str = "m"
    min_gps: float = 4


@dataclass
class CleanResult:
    """Clean points, the log of deletions, their sums by step, and the comparison of before and after.

    ``marked`` holds every point with the step that removed it; persist it if
    several of the others are wanted.
    """

    marked: DataFrame
    raw: DataFrame
    delays: DataFrame | None = None
    params: CleaningParams = field(default_factory=CleaningParams)

    @property
    def clean(self) -> DataFrame:
        kept = self.marked.filter("__step IS NULL").drop("__step", "__value", "Flow_delay")
        return kept.orderBy(*order.keys(kept), "GPS_Time", "row_id")

    @property
    def deletions(self) -> DataFrame:
        on = order.keys(self.marked)
        reason = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))[F.col("__step")]
        return self.marked.filter("__step IS NOT NULL").select(*on, "orig_row_id", F.col("__step").alias("step"), reason.alias("reason"), F.col("__value").alias("value"))

    def by_step(self) -> DataFrame:
        return audit.deletions_by_step(self.deletions)

    def validation(self, column: str = "Yield_kg_ha") -> DataFrame:
        return audit.validate(self.clean, self.raw, column)

    def polygons(self, imperial: bool = False) -> DataFrame:
        shapes = geo.polygons(motion.smooth_heading(self.clean))
        return shapes.withColumn("Yield_bu_ac", F.col("Yield_kg_ha") * units.KGHA_TO_BUACRE["maize"]) if imperial else shapes


#: Why each step removes a point.
REASONS = {
    "no_flow": "no flow, swath or distance",
    "trim": "within the delay of a pass's end",
    "position": "far from the field",
    "gps": "poor GPS status",
    "velocity": "velocity out of range",
    "velocity_jump": "sudden change of velocity",
    "heading": "sudden change of direction",
    "header": "header not at work",
    "null_yield": "no yield",
    "yield_range": "yield out of range",
    "moisture": "moisture out of range",
    "overlap": "harvested before",
    "local_sd": "unlike its neighbours",
    "pass_filter": "abnormal pass",
}
FLOW_COLUMNS = ("Flow", "Distance", "Swath", "Interval")


def _dry(df: DataFrame) -> DataFrame:
    """``Yield_kg_ha`` is the wet yield so far; adds that by name, and dries it where moisture is known."""
    df = df.withColumn("Yield_kg_ha_wet", F.col("Yield_kg_ha"))
    if not has(df, "Moisture"):
        return df
    df = df.withColumn("__standard", units.standard_moisture_of_field(df))
    dry = units.dry_yield(F.col("Yield_kg_ha_wet"), F.coalesce("Moisture", F.col("__standard")), F.col("__standard"))
    return df.withColumn("Yield_kg_ha", dry).drop("__standard")


def wet_and_dry(df: DataFrame) -> DataFrame:
    """Flow above a mean of 100 is wet yield in kg/ha; else yield follows from flow.  Dry yield where moisture is known."""
    return _dry(units.flow_to_yield(df, force=True))


def prepare(df: DataFrame, p: CleaningParams) -> tuple[DataFrame, DataFrame | None]:
    """The first phase: positions and delays.  Persist its result to run several second phases."""
    df = no_nan(df) if "orig_row_id" in df.columns else no_nan(df).withColumn("orig_row_id", F.col("row_id"))
    if not has(df, "X", "Y"):
        df = geo.latlon_to_utm(df)
    best = None
    if p.delays:
        df, found = delay.optimize_delays(df, "flow", delays=list(p.delay_range), n_iterations=p.n_iterations)
        best = found["flow"].best if "flow" in found else None
    return df, best


Made = tuple[DataFrame, Column]


def filter_steps(p: CleaningParams) -> list[tuple[str, str | None, Callable[[DataFrame], Made]]]:
    """(step, shown column, points with what the condition needs and the condition to stay), in order."""

    def field_bounds(bounds: Callable[[DataFrame, Callable[[Column], Column]], dict[str, Column]], column: str) -> Callable[[DataFrame], Made]:
        def made(d: DataFrame) -> Made:
            w = order.whole(d)
            low, high = bounds(d, lambda c: c.over(w)).values()
            return d.withColumns({"__low": low, "__high": high}), F.col(column).between(F.col("__low"), F.col("__high"))

        return made

    velocity = field_bounds(lambda d, over: thresholds.velocity_bounds(p.vllim, p.vulim, p.vscale, p.minv_abs, over), "velocity")
    yields = field_bounds(lambda d, over: thresholds.yield_bounds(d, p.yllim, p.yulim, p.yscale, p.miny_abs, over), "Yield_kg_ha")

    def spread(d: DataFrame) -> Made:
        if not has(d, "Moisture"):
            return d, F.lit(True)
        w = order.whole(d)
        d = d.withColumns({"__low": F.avg("Moisture").over(w) - p.n_std * F.stddev_samp("Moisture").over(w), "__high": F.avg("Moisture").over(w) + p.n_std * F.stddev_samp("Moisture").over(w)})
        return d, F.col("Moisture").isNull() | F.col("Moisture").between(F.col("__low"), F.col("__high"))

    return [
        ("position", None, lambda d: (spatial.stray_positions(d), ~F.col("position_stray"))),
        ("gps", "GPSStatus", lambda d: (d, F.col("GPSStatus").isNull() | (F.col("GPSStatus") >= p.min_gps) if has(d, "GPSStatus") else F.lit(True))),
        ("velocity", "velocity", lambda d: velocity(d.withColumn("velocity", motion.clean_velocity(d)))),
        ("velocity_jump", None, lambda d: (motion.velocity_jump(d, p.max_acceleration, p.max_deceleration), ~F.col("velocity_jump"))),
        ("heading", None, lambda d: (motion.heading_anomaly(d, p.max_heading_change), ~F.col("heading_anomaly"))),
        ("header", "HeaderStatus", lambda d: (d, F.col("HeaderStatus").isin(0, 1, 33) | F.col("HeaderStatus").isNull() if has(d, "HeaderStatus") else F.lit(True))),
        ("null_yield", "Yield_kg_ha", lambda d: (d, F.col("Yield_kg_ha") > 0)),
        ("yield_range", "Yield_kg_ha", yields),
        ("moisture", "Moisture", spread),
        ("overlap", "overlap_ratio", lambda d: (spatial.overlap_ratio(d, p.cellsize, p.swath_unit), F.col("overlap_ratio") <= p.overlap_threshold)),
        ("local_sd", "Yield_kg_ha", lambda d: (spatial.local_sd(d, p.n_swaths, p.lsd_limit, p.min_cells, "Yield_kg_ha", p.swath_unit), ~F.col("local_sd_outlier"))),
        ("pass_filter", "Yield_kg_ha", lambda d: (audit.abnormal_passes(d, p.pass_threshold), ~F.col("__abnormal"))),
    ]


def unmarked(df: DataFrame) -> DataFrame:
    """The points with the marks of the steps: none yet."""
    return df.withColumns({order.ALIVE: F.lit(True), "__step": F.lit(None).cast("string"), "__value": F.lit(None).cast("double")})


def mark(df: DataFrame, made: Made, step: str, shown: str | None = None) -> DataFrame:
    """Marks the points that are still there and do not meet the condition; a null condition removes."""
    columns, (seen, keep) = df.columns, made
    columns += [c for c in ("velocity", "overlap_ratio", "__direct") if c in seen.columns and c not in columns]
    seen = seen.withColumn("__gone", F.col(order.ALIVE) & ~F.coalesce(keep, F.lit(False)))
    value = F.col(shown).cast("double") if shown and shown in seen.columns else F.lit(None).cast("double")
    gone = F.col("__gone")
    return seen.withColumns({"__step": F.when(gone, step).otherwise(F.col("__step")), "__value": F.when(gone, value).otherwise(F.col("__value")), order.ALIVE: F.col(order.ALIVE) & ~gone}).select(*columns)


def run_filters(df: DataFrame, p: CleaningParams) -> DataFrame:
    """The second phase: the marked points after the steps that are on."""
    for step, shown, make in filter_steps(p):
        if getattr(p, step):
            df = mark(df, make(df), step, shown)
    return df


def clean_yield(df: DataFrame, params: CleaningParams | None = None, **changes) -> CleanResult:
    """The whole pipeline: delays, yield, filters, spatial filters and the log; every point is kept or logged."""
    p = replace(params or CleaningParams(), **changes)
    raw, best = prepare(df, p)
    points = unmarked(raw)
    if need(raw, "warn", *FLOW_COLUMNS):
        points = mark(points, units.usable_flow(points), "no_flow")
        points = points.withColumn("Yield_kg_ha", units.yield_of_flow(points)).drop("__direct")
    points = _dry(points)
    if best is not None and p.trim and has(points, "Pass"):
        points = mark(points, _trim(points), "trim")
    return CleanResult(run_filters(points, p).drop(order.ALIVE), wet_and_dry(raw), best, p)


def _trim(df: DataFrame) -> Made:
    """As ``delay.trim_passes`` with each field's own ``Flow_delay``."""
    w = order.by_time(df, "Pass")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__run": F.sum("Interval").over(upto), "__total": F.sum("Interval").over(order.whole(df, "Pass")), "__gap": F.max(F.col("Interval").isNull()).over(upto)})
    d = F.col("Flow_delay")
    keep = F.when(d < 0, F.col("__total") - F.col("__run") > F.abs(d)).when(d > 0, F.col("__run") > d).otherwise(True)
    return df, F.col("__gap") | F.coalesce(keep, F.lit(True))


def clean_yield_fast(prepared: DataFrame, **on: bool | float) -> CleanResult:
    """The second phase alone over a persisted first phase; every filter is off unless asked for."""
    off = {step: False for step, *_ in filter_steps(CleaningParams())}
    p = replace(CleaningParams(), **(off | {"delays": False, "trim": False} | on))
    yields = wet_and_dry(prepared)
    return CleanResult(run_filters(unmarked(yields), p).drop(order.ALIVE), yields, None, p)


def clean_yield_with_tracking(df: DataFrame, progress: Callable[[str, int], None] | None = None, **changes) -> CleanResult:
    """As ``clean_yield`` with motion filters and the pass filter on.

    With ``progress`` the pipeline runs at once, its marked points are persisted, and
    ``progress`` hears of every step in order: its name and how many points it removed.
    """
    result = clean_yield(df, **({"velocity_jump": True, "heading": True, "pass_filter": True} | changes))
    if progress:
        result.marked = result.marked.persist()
        removed = {r["step"]: r["n"] for r in result.by_step().collect()}  # one row a step
        for step in REASONS:
            if step in removed or getattr(result.params, step, False):
                progress(step, removed.get(step, 0))
    return result


def clean_file(spark: SparkSession, path: str, output: str | None = None, log_file: str | None = None, **changes) -> CleanResult:
    """Reads a log, cleans it, and writes the points and a report if asked to."""
    from furrow.sinks import report
    from furrow.sinks import files

    result = clean_yield(read_yield_data(spark, path), **changes)
    if output:
        files.export(result.clean, output, overwrite=True)
    if log_file:
        report.write(result, log_file, path)
    return result


#: Wider quantile bounds and a local limit of 3.
OLDER = {"yllim": 0.05, "yulim": 0.95, "yscale": 1.5, "vllim": 0.02, "vulim": 0.98, "vscale": 1.5, "lsd_limit": 3}


def clean_yield_older(df: DataFrame, **changes) -> CleanResult:
    """The older variant of the pipeline."""
    return clean_yield(df, **(OLDER | changes))


def shapes(df: DataFrame, geometry: str = "polygon", **changes) -> DataFrame:
    """Cleaned points as polygons or points."""
    if geometry not in ("polygon", "point"):
        raise ValueError("geometry is polygon or point")
    result = clean_yield(df, **changes)
    return result.polygons() if geometry == "polygon" else geo.points(result.clean)
