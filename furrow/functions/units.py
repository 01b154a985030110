"""Units, flow and yield.  Table-wide choices depend on a field's means and stay in the plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.rcompat import has, need, r_div
from furrow.operators import motion, order

LB, FOOT, INCH = 0.453592, 0.3048, 0.0254
#: Standard moisture and bushel factors by crop.
MOISTURE_STANDARD = {"maize": 15.5, "corn": 15.5, "soybean": 13.0, "wheat": 13.5, "barley": 14.8, "canola": 10.0}
KGHA_TO_BUACRE = {"maize": 0.0159, "corn": 0.0159, "soybean": 0.0149, "wheat": 0.015}
BUACRE_TO_KGHA = {"maize": 62.77, "corn": 62.77, "soybean": 67.25, "wheat": 65.0}
OTHER_MOISTURE, OTHER_TO_BUACRE, OTHER_TO_KGHA = 13.0, 0.015, 65.0


def mean(df: DataFrame, column: str) -> Column:
    return F.avg(column).over(order.whole(df))


def imperial_to_metric(df: DataFrame) -> DataFrame:
    """Inches become metres where the field's means say so."""
    columns = df.columns
    if has(df, "Distance"):
        m = mean(df, "Distance")
        df = df.withColumn("__d", m).withColumn("Distance", F.when((F.col("__d") > 20) & (F.col("__d") < 200), F.col("Distance") * INCH).otherwise(F.col("Distance")))
    if has(df, "Swath"):
        df = df.withColumn("__s", mean(df, "Swath"))
        inches = (F.col("__s") < 3) | F.col("__s").between(100, 200) | ((F.col("__s") > 200) & (F.col("__s") < 500))
        df = df.withColumn("Swath", F.when(inches, F.col("Swath") * INCH).otherwise(F.col("Swath")))
    return df.select(*columns)


def standard_moisture(df: DataFrame) -> DataFrame:
    """One row for each field: corn before soy before wheat, whatever grain any point names; else corn's."""
    return df.groupBy(*order.keys(df)).agg(_standard_moisture(lambda c: c).alias("standard_moisture"))


def standard_moisture_of_field(df: DataFrame) -> Column:
    """The same as a window over each field; corn's if no grain is named."""
    return _standard_moisture(lambda c: c.over(order.whole(df))) if has(df, "GrainType") else F.lit(15.5)


def _standard_moisture(over: Callable[[Column], Column]) -> Column:
    crop = F.lower("GrainType")
    held = lambda p: F.coalesce(over(F.max(crop.rlike(p))), F.lit(False))
    return F.when(held("corn|maize|mais"), 15.5).when(held("soy|soja"), 13.0).when(held("wheat|bl[eé]|barley|orge|oat|avoine"), 13.5).otherwise(15.5)


def pounds_per_bushel(grain: Column) -> Column:
    g = F.lower(grain)
    return F.when(g.rlike("soy|soja"), 60.0).when(g.rlike("wheat|bl[eé]|cereal"), 60.0).otherwise(56.0)


def flow_to_yield(df: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``Yield_kg_ha``, unless it is there and not forced.

    A field whose mean flow is between 100 and 50,000 holds kg/ha already.  In
    others, rows without a positive flow, swath and distance go, and the rest's
    mean below 0.5 means kg/s, else lbs/s.
    """
    if has(df, "Yield_kg_ha") and not force:
        return df
    if not need(df, "warn", "Flow", "Distance", "Swath", "Interval"):
        return df
    columns = [c for c in df.columns if c != "Yield_kg_ha"]
    df, usable = usable_flow(df)
    df = df.filter(usable)
    return df.withColumn("Yield_kg_ha", yield_of_flow(df)).select(*columns, "Yield_kg_ha")


def usable_flow(df: DataFrame) -> tuple[DataFrame, Column]:
    """The points with ``__direct``, whether their field's flow is kg/ha, and the condition for a yield."""
    m = mean(df, "Flow")
    df = df.withColumn("__m", m).withColumn("__direct", F.coalesce((F.col("__m") > 100) & (F.col("__m") < 50_000), F.lit(False))).drop("__m")
    return df, F.col("__direct") | ((F.col("Distance") > 0) & (F.col("Swath") > 0) & (F.col("Flow") > 0))


def yield_of_flow(df: DataFrame) -> Column:
    """Yield in kg/ha of usable points with ``__direct``."""
    kg = F.when(mean(df, "Flow") < 0.5, F.col("Flow")).otherwise(F.col("Flow") * LB)
    return F.when(F.col("__direct"), F.col("Flow")).otherwise(r_div(kg * F.col("Interval"), F.col("Swath") * F.col("Distance")) * 10_000)


def flow_simple(df: DataFrame) -> DataFrame:
    """``Yield`` in bushels an acre from lbs/s, inches and seconds."""
    v = r_div(F.col("Distance"), F.col("Interval")) / 12
    return df.withColumn("Yield", r_div(F.col("Flow") * 43_560, 56 * F.col("Swath") / 12 * v))


def flow_units(df: DataFrame, density: float = 56, scale: float = 1) -> DataFrame:
    return df.withColumn("Flow", F.col("Flow") / density * scale)


def to_yield(df: DataFrame, density: float = 56) -> DataFrame:
    """``Yield_buacre``; without positions flow over density, as a percentage if the swath is known."""
    if not has(df, "Swath"):
        return df.withColumn("Yield_buacre", F.col("Flow") / density)
    if not has(df, "X", "Y", "Interval") and not has(df, "velocity"):
        return df.withColumn("Yield_buacre", F.col("Flow") / density * 100)
    columns = df.columns
    df = df if has(df, "velocity") else df.withColumn("velocity", motion.velocity(df))
    value = r_div(F.col("Flow") * 0.0929 * 43_560, density * F.col("velocity") * F.col("Swath") / 39.37)
    return df.withColumn("Yield_buacre", value).select(*columns, "Yield_buacre")


def flow_lbs_to_kgha(df: DataFrame, moisture_standard: float = 13, first_row_units: bool = False) -> DataFrame:
    """Wet and dry yield from lbs/s; swath and distance in feet or inches by their means.

    ``first_row_units`` takes swath and distance of the field's first row for all.
    """
    if not need(df, "warn", "Flow", "Swath", "Distance", "Interval"):
        return df
    columns = df.columns
    for c, limit in (("Swath", 10), ("Distance", 1)):
        value = F.first(c).over(order.by_row(df)) if first_row_units else F.col(c)
        df = df.withColumn(f"__{c}", F.when(mean(df, c) > limit, value * FOOT).otherwise(value * INCH))
    df = df.withColumn("Yield_kg_ha_wet", r_div(F.col("Flow") * LB * F.col("Interval") * 10_000, F.col("__Swath") * F.col("__Distance")))
    dry = dry_yield(F.col("Yield_kg_ha_wet"), F.col("Moisture"), F.lit(moisture_standard)) if has(df, "Moisture") else F.col("Yield_kg_ha_wet")
    return df.withColumn("Yield_kg_ha", dry).select(*(c for c in columns if c not in ("Yield_kg_ha", "Yield_kg_ha_wet")), "Yield_kg_ha_wet", "Yield_kg_ha")


def dry_yield(wet: Column, moisture: Column, standard: Column) -> Column:
    return wet * (100 - moisture) / (100 - standard)


def convert_yield(df: DataFrame, source: str = "flow_lbs_s", to: str = "kg_ha", crop: str | None = None, moisture_standard: float | None = None) -> DataFrame:
    """flow_lbs_s to kg_ha, kg_ha to bu_acre and back, kg_ha to t_ha; other pairs warn and change nothing."""
    crop = (crop or "maize").lower()
    if (source, to) == ("flow_lbs_s", "kg_ha"):
        return flow_lbs_to_kgha(df, moisture_standard if moisture_standard is not None else MOISTURE_STANDARD.get(crop, OTHER_MOISTURE))
    factors = {("kg_ha", "bu_acre"): ("Yield_kg_ha", "Yield_buacre", KGHA_TO_BUACRE.get(crop, OTHER_TO_BUACRE)), ("bu_acre", "kg_ha"): ("Yield_buacre", "Yield_kg_ha", BUACRE_TO_KGHA.get(crop, OTHER_TO_KGHA)), ("kg_ha", "t_ha"): ("Yield_kg_ha", "Yield_t_ha", 0.001)}
    if (source, to) not in factors:
        need(df, "warn", f"{source} to {to}")
        return df
    column, name, factor = factors[source, to]
    return df.withColumn(name, F.col(column) * factor) if need(df, "warn", column) else df


def yield_to_flow(df: DataFrame, swath: float = 7.5, distance: float = 1.5, interval: float = 1) -> DataFrame:
    """``Flow`` in kg/s back from the yield, with defaults for what is null or missing."""
    value = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(float(d))) if has(df, c) else F.lit(float(d))
    return df.withColumn("Flow", r_div(F.col("Yield_kg_ha") * value("Swath", swath) * value("Distance", distance), value("Interval", interval) * 10_000))


def polygon_sizes(df: DataFrame) -> DataFrame:
    """``Swath_m`` and ``Distance_m``, unless there, by the fields' means."""
    if not has(df, "Swath_m"):
        m, s = mean(df, "Swath"), F.col("Swath")
        df = df.withColumn("__m", m).withColumn("Swath_m", F.when(F.col("__m") > 200, 8.0).when(F.col("__m") > 100, s * FOOT).when(F.col("__m").between(3, 50), s).when(F.col("__m") < 3, s * INCH).otherwise(s)).drop("__m")
    if not has(df, "Distance_m"):
        df = df.withColumn("__m", mean(df, "Distance")).withColumn("Distance_m", F.when(F.col("__m") > 30, F.col("Distance") * FOOT).when(F.col("__m") > 0.5, F.col("Distance")).otherwise(F.col("Distance") * INCH)).drop("__m")
    return df
