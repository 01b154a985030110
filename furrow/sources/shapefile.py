"""Zipped shapefiles: listing and reading in pure Python, one archive a task."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import units
from furrow.functions.rcompat import first_of, has
from furrow.operators import order

#: Columns of the maker's export and their names here, and patterns for what is named otherwise.
RENAMED = {
    "DISTANCE": "Distance", "SWATHWIDTH": "Swath", "VRYIELDMAS": "Flow", "SECTIONID": "Pass", "Crop": "GrainType", "WetMass": "Flow_Wet", "Moisture": "Moisture", "Time": "GPS_Time", "Heading": "Heading",
    "VARIETY": "Variety", "Elevation": "Altitude", "IsoTime": "IsoTime", "Machine": "Machine", "FUEL": "Fuel", "VEHICLSPEED": "Velocity", "DRYMATTER": "DryMatter", "PRODUCTHASH": "ProductHash",
}
PATTERNS = {"Flow": "yield|yld|rendement|rend|mass|vryield", "Moisture": "moisture|moist|humidite|humid", "Swath": "swath|width|largeur|larg|swathwidth", "Pass": "pass|passage|section|sectionid", "Distance": "distance|dist"}
ESSENTIAL = {"Flow": "double", "Moisture": "double", "Swath": "double", "Distance": "double", "Pass": "long", "Interval": "double", "GPS_Time": "long", "HeaderStatus": "int", "GrainType": "string"}


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def list_fields(spark: SparkSession, path: str) -> DataFrame:
    """Rows (Name, field_name, size_bytes) of the shapefiles in an archive."""

    def names(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(i.filename, i.filename.rsplit("/", 1)[-1][:-4], i.file_size) for i in z.infolist() if i.filename.lower().endswith(".shp")]
            yield pd.DataFrame(rows, columns=["Name", "field_name", "size_bytes"])

    return archives(spark, path).mapInPandas(names, "Name string, field_name string, size_bytes long")


def shape_points(shp: bytes) -> list[tuple[float, float] | None]:
    """A place for each record: the point itself, or the middle of the first ring or line."""
    out, at = [], 100
    while at + 12 <= len(shp):
        size = struct.unpack(">i", shp[at + 4 : at + 8])[0] * 2
        body, at = shp[at + 8 : at + 8 + size], at + 8 + size
        kind = struct.unpack("<i", body[:4])[0]
        if kind in (1, 11, 21):
            out.append(struct.unpack("<2d", body[4:20]))
        elif kind in (3, 5, 13, 15, 23, 25):
            n_parts, n = struct.unpack("<2i", body[36:44])
            xy = struct.unpack(f"<{2 * n}d", body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n])
            end = n - 1 if kind % 10 == 5 and n > 1 else n
            out.append((sum(xy[0 : 2 * end : 2]) / end, sum(xy[1 : 2 * end : 2]) / end))
        else:
            out.append(None)
    return out


def dbf_rows(dbf: bytes) -> list[dict[str, str | None]]:
    n, header, size = struct.unpack("<IHH", dbf[4:12])
    fields, at = [], 32
    while dbf[at] != 0x0D:
        fields.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), dbf[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        record, at, row = dbf[header + i * size : header + (i + 1) * size], 1, {}
        for name, length in fields:
            row[name] = record[at : at + length].decode("utf-8", "replace").strip() or None
            at += length
        rows.append(row)
    return rows


def read_field(spark: SparkSession, path: str, field_name: str) -> DataFrame:
    """Points of one field of an archive, with the units and columns of the engine; an unknown name aborts."""
    if not list_fields(spark, path).filter((F.col("field_name") == field_name) | (F.col("Name") == field_name)).count():
        raise ValueError(f"no field {field_name} in {path}")

    def records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for content in part["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = {i.lower(): i for i in z.namelist()}
                    shp = next((n for n in z.namelist() if n.lower().endswith(".shp") and field_name in (n, n.rsplit("/", 1)[-1][:-4])), None)
                    if shp is None:
                        continue
                    places, values = shape_points(z.read(shp)), dbf_rows(z.read(names[shp[:-4].lower() + ".dbf"]))
                    rows += [(i + 1, *(p or (None, None)), {k: v for k, v in r.items() if v is not None}) for i, (p, r) in enumerate(zip(places, values, strict=False))]
            yield pd.DataFrame(rows, columns=["row_id", "Longitude", "Latitude", "v"])

    raw = archives(spark, path).mapInPandas(records, "row_id long, Longitude double, Latitude double, v map<string,string>")
    columns = sorted({k for r in raw.select(F.explode(F.map_keys("v")).alias("k")).distinct().collect() for k in [r["k"]]})  # a table's columns
    table = raw.select("row_id", "Longitude", "Latitude", *(F.col("v")[c].alias(c) for c in columns))
    return to_metric(standardize(table))


def standardize(df: DataFrame) -> DataFrame:
    """Known names first, then a pattern for what is still missing; essential columns are there as nulls at least."""
    import re

    for old, new in RENAMED.items():
        if old in df.columns and (new not in df.columns or old == new):
            df = df.withColumnRenamed(old, new)
    for new, pattern in PATTERNS.items():
        if new not in df.columns:
            found = next((c for c in df.columns if re.search(pattern, c, re.I) and c not in ESSENTIAL), None)
            df = df.withColumnRenamed(found, new) if found else df
    for name, kind in ESSENTIAL.items():
        value = (F.col(name) if kind == "string" else F.col(name).cast("string").try_cast("double").cast(kind)) if name in df.columns else F.lit(None).cast(kind)
        df = df.withColumn(name, value)
    if "row_id" not in df.columns:
        from furrow.sources.text import read_yield_data

        df = read_yield_data(df.sparkSession, data=df)
    return df


def to_metric(df: DataFrame) -> DataFrame:
    """Flow in kg/ha, swath and distance in metres by their means, an interval and a pass of 1 if none, and dry yield."""
    fallback = first_of(df, "Flow_Wet", "DryMatter", "Yield")
    if fallback:
        df = df.withColumn("Flow", F.coalesce("Flow", F.col(fallback).cast("double")))
    w = order.whole(df)
    for c in ("Flow", "Flow_Wet"):
        if has(df, c):
            m = F.avg(F.col(c).cast("double")).over(w)
            df = df.withColumn("__m", m).withColumn(c, F.when((F.col("__m") > 0) & (F.col("__m") < 20), F.col(c).cast("double") * 1000).otherwise(F.col(c).cast("double"))).drop("__m")
    ladders = {"Swath": ((500, 0.001), (200, units.INCH), (50, 0.01)), "Distance": ((1000, 0.001), (200, 0.01), (30, units.INCH))}
    for c, steps in ladders.items():
        df, value = df.withColumn("__m", F.avg(c).over(w)), None
        for above, factor in steps:
            value = F.when(F.col("__m") > above, F.col(c) * factor) if value is None else value.when(F.col("__m") > above, F.col(c) * factor)
        df = df.withColumn(c, value.otherwise(F.col(c))).drop("__m")
    df = df.withColumns({"Interval": F.coalesce("Interval", F.lit(1.0)), "Pass": F.coalesce("Pass", F.lit(1).cast("long"))})
    standard = units.standard_moisture(df)
    df = df.join(standard, order.keys(df)) if order.keys(df) else df.crossJoin(F.broadcast(standard))
    dry = units.dry_yield(F.col("Flow"), F.coalesce("Moisture", F.col("standard_moisture")), F.col("standard_moisture"))
    return df.withColumns({"Yield_kg_ha_wet": F.col("Flow"), "Yield_kg_ha": dry}).drop("standard_moisture")


__all__ = ["list_fields", "read_field", "standardize", "to_metric"]
