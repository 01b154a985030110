"""Raw sensor text: comma-separated logs without a header, or ``ID|csv`` lines.

One file is one field: its name is ``field_id`` where several are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import units
from furrow.functions.rcompat import no_nan

STANDARD = ["Longitude", "Latitude", "Flow", "GPS_Time", "Interval", "Distance", "Swath", "Moisture", "HeaderStatus", "Pass", "Serial", "FieldID", "LoadID", "GrainType"]
KINDS = {"Longitude": "double", "Latitude": "double", "Flow": "double", "GPS_Time": "long", "Interval": "long", "Distance": "double", "Swath": "double", "Moisture": "double", "HeaderStatus": "int", "Pass": "long", "GPSStatus": "int", "DOP": "double", "Altitude": "double"}
#: Whole numbers in the log, though measured: cut before any conversion.
WHOLE = ("Interval", "Distance", "Swath")


def column_names(first: list[str]) -> list[str]:
    """Names by the number of columns; sixteen come in two layouts, told apart by the first row's last value."""
    n = len(first)
    if n == 17:
        return [*STANDARD, "GPSStatus", "DOP", "Altitude"]
    if n == 16:
        try:
            float(first[15])
        except ValueError:
            return [*STANDARD, "Altitude", "Extra"]
        return [*STANDARD, "Variety", "Altitude"]
    if n == 15:
        return [*STANDARD, "Altitude"]
    return STANDARD[:n] + [f"extra_{i + 1}" for i in range(n - 14)]


def read_yield_text(spark: SparkSession, path: str | list[str], by_file: bool = False) -> DataFrame:
    """Points of one or more logs, numbered in the order of lines after rows without a flow of 0 or more went.

    Empty lines are skipped and what cannot be read as a number is null.  GPSStatus, DOP
    and Altitude are there as nulls if the log has none.  Swath and distance in
    inches become metres.  A missing file or an empty one aborts.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).filter(F.trim("value") != "")
    first = lines.orderBy("file", "line").select("value").first()
    if first is None:
        raise ValueError(f"no data in {path}")
    piped = F.regexp_like(F.lit(first[0]), F.lit(r"^[0-9]+\|"))
    if spark.range(1).select(piped).first()[0]:
        names = STANDARD
        parts = F.split(F.element_at(F.split("value", "\\|"), 2), ",", len(STANDARD))
    else:
        names = column_names(first[0].split(","))
        parts = F.split("value", ",")
    values = {n: F.trim(F.get("p", F.lit(i))) for i, n in enumerate(names)}
    values |= {n: F.lit(None).cast("string") for n in ("GPSStatus", "DOP", "Altitude") if n not in values}
    typed = {n: v.try_cast("double") if n in KINDS else v for n, v in values.items()}
    typed = {n: (v.cast("long") if n in WHOLE else v).cast(KINDS[n]) if n in KINDS else v for n, v in typed.items()}
    points = lines.withColumn("p", parts).select("file", "line", *(v.alias(n) for n, v in typed.items())).filter("Flow >= 0")
    w = Window.partitionBy("file").orderBy("line")
    points = points.withColumn("row_id", F.row_number().over(w).cast("long"))
    points = points.withColumnRenamed("file", "field_id").drop("line") if by_file else points.drop("file", "line")
    return units.imperial_to_metric(no_nan(points))


def read_yield_data(spark: SparkSession, path: str | None = None, data: DataFrame | None = None) -> DataFrame:
    """A table gets row numbers if it has none; a path is read as text."""
    if data is not None:
        if "row_id" in data.columns:
            return data
        keys = [c for c in ("field_id",) if c in data.columns]
        order = [c for c in ("GPS_Time",) if c in data.columns] or data.columns[:1]
        return data.withColumn("row_id", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    if path is None:
        raise ValueError("give a path or a table")
    return read_yield_text(spark, path)
