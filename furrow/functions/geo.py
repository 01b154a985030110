"""Map projection, oriented rectangles and areas as column expressions.

The transverse Mercator projection is Krüger's series in the third flattening n,
to the sixth order (Karney, 2011).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.rcompat import has, need
from furrow.functions.units import LB, polygon_sizes
from furrow.operators import motion, order

# The WGS84 ellipsoid and the grid's scale and offsets.
A, FLATTENING, K0, EASTING, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
# Series coefficients, by power of n from the first on.
_ALPHA = [
    sum(c * _N ** (i + 1) for i, c in enumerate(row))
    for row in (
        (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
        (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
        (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
        (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
        (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
        (0, 0, 0, 0, 0, 212378941 / 319334400),
    )
]
_BETA = [
    sum(c * _N ** (i + 1) for i, c in enumerate(row))
    for row in (
        (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
        (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
        (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
        (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
        (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
        (0, 0, 0, 0, 0, 20648693 / 638668800),
    )
]


def utm_zone(df: DataFrame) -> DataFrame:
    """One row ``__zone``: the zone of the table's first row, so that all its fields are on one grid."""
    first = F.min_by("Longitude", F.struct(*(F.col(c) for c in ("field_id", "row_id") if has(df, c)), "Longitude"))
    return df.agg((F.floor((first + 180) / 6).cast("int") + 1).alias("__zone"))


def _asinh(x: Column) -> Column:
    """As C libraries have it: Spark's own loses digits near 0."""
    a = F.abs(x)
    return F.signum(x) * F.log1p(a + a * a / (1 + F.sqrt(1 + a * a)))


def _atanh(x: Column) -> Column:
    a = F.abs(x)
    return F.signum(x) * 0.5 * F.when(a < 0.5, F.log1p((a + a) + (a + a) * a / (1 - a))).otherwise(F.log1p((a + a) / (1 - a)))


def latlon_to_utm(df: DataFrame, zone: int | None = None) -> DataFrame:
    """Adds X and Y in metres, northern grid; nulls stay null."""
    need(df, "abort", "Longitude", "Latitude")
    columns = [c for c in df.columns if c not in ("X", "Y")]
    df = df.withColumn("__zone", F.lit(zone)) if zone is not None else df.crossJoin(F.broadcast(utm_zone(df)))
    lat, lon = F.radians("Latitude"), F.radians(F.col("Longitude") - (F.col("__zone") * 6 - 183))
    conformal = F.sinh(_atanh(F.sin(lat)) - _E * _atanh(_E * F.sin(lat)))
    df = df.withColumns({"__t": conformal, "__l": lon})
    df = df.withColumns({"__xi": F.atan2(F.col("__t"), F.cos("__l")), "__eta": _asinh(F.sin("__l") / F.sqrt(F.col("__t") * F.col("__t") + F.cos("__l") * F.cos("__l")))})
    east, north = F.col("__eta"), F.col("__xi")
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * F.col("__xi")) * F.sinh(2 * j * F.col("__eta"))
        north = north + a * F.sin(2 * j * F.col("__xi")) * F.cosh(2 * j * F.col("__eta"))
    return df.select(*columns, (EASTING + K0 * _RADIUS * east).alias("X"), (K0 * _RADIUS * north).alias("Y"))


def utm_to_latlon(df: DataFrame, zone: int | Column, hemisphere: str = "N") -> DataFrame:
    """Adds Longitude and Latitude from X and Y."""
    need(df, "abort", "X", "Y")
    columns = [c for c in df.columns if c not in ("Longitude", "Latitude")]
    north = F.col("Y") - (SOUTH if hemisphere == "S" else 0.0)
    df = df.withColumns({"__zone": F.lit(zone) if isinstance(zone, int) else zone, "__xi": north / (K0 * _RADIUS), "__eta": (F.col("X") - EASTING) / (K0 * _RADIUS)})
    xi, eta = F.col("__xi"), F.col("__eta")
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * F.col("__xi")) * F.cosh(2 * j * F.col("__eta"))
        eta = eta - b * F.cos(2 * j * F.col("__xi")) * F.sinh(2 * j * F.col("__eta"))
    df = df.withColumns({"__x": xi, "__e": eta})
    df = df.withColumns({"__chi": F.asin(F.sin("__x") / F.cosh("__e")), "__lam": F.atan2(F.sinh("__e"), F.cos("__x"))})
    # The conformal latitude is inverted by a fixed point that gains five digits a step.
    df = df.withColumn("__phi", F.col("__chi"))
    for _ in range(5):
        s = F.sin("__phi")
        df = df.withColumn("__phi", F.asin(F.tanh(F.atanh(F.sin("__chi")) + _E * F.atanh(_E * s))))
    return df.select(*columns, (F.degrees("__lam") + F.col("__zone") * 6 - 183).alias("Longitude"), F.degrees("__phi").alias("Latitude"))


def convert_coordinates(df: DataFrame, source: str = "latlon", to: str = "utm", zone: int | None = None) -> DataFrame:
    if source == to:
        return df
    if (source, to) == ("latlon", "utm"):
        return latlon_to_utm(df, zone)
    if (source, to) != ("utm", "latlon"):
        raise ValueError(f"no conversion from {source} to {to}")
    given = F.lit(zone) if zone is not None else F.col("UTM_Zone") if has(df, "UTM_Zone") else F.floor((F.avg("Longitude").over(order.whole(df)) + 180) / 6).cast("int") + 1
    return utm_to_latlon(df, given)


def rectangle(lon: Column, lat: Column, heading: Column, width: Column, length: Column) -> Column:
    """A closed ring of five (x, y) around the point, along the heading; sides of 0.1 m at least."""
    kx, ky = 1 / (111_320 * F.cos(F.radians(lat))), 1 / 110_540
    w, h, a = F.greatest(width, F.lit(0.1)) / 2, F.greatest(length, F.lit(0.1)) / 2, F.radians(heading)
    corner = lambda f, p: F.struct((lon + (f * F.sin(a) * h + p * F.cos(a) * w) * kx).alias("x"), (lat + (f * F.cos(a) * h - p * F.sin(a) * w) * ky).alias("y"))
    return F.array(*(corner(f, p) for f, p in ((1, 1), (1, -1), (-1, -1), (-1, 1), (1, 1))))


def wkt_polygon(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", F.transform(ring, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))), F.lit("))"))


def ring_area(ring: Column) -> Column:
    """Square metres of a small closed ring in degrees, by the shoelace formula on the local scale."""
    kx, ky = 111_320 * F.cos(F.radians(ring[0]["y"])), 110_540
    pairs = F.transform(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: (ring[i]["x"] - ring[0]["x"]) * (ring[i + 1]["y"] - ring[0]["y"]) - (ring[i + 1]["x"] - ring[0]["x"]) * (ring[i]["y"] - ring[0]["y"]))
    return F.abs(F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)) / 2 * kx * ky


def polygons(df: DataFrame) -> DataFrame:
    """Points as oriented rectangles (``geometry``) with metric and imperial columns; rows lacking a needed value go."""
    if not need(df, "warn", "Latitude", "Longitude", "Distance", "Swath"):
        return df.limit(0)
    if not has(df, "heading"):
        w = order.by_row(df)
        back = lambda c: F.coalesce(F.lag(c).over(w), F.col(c)) - F.col(c)
        df = df.withColumn("heading", F.coalesce(F.degrees(F.atan2(back("Longitude"), back("Latitude"))), F.lit(0.0)))
    df = polygon_sizes(df)
    if not has(df, "Yield_kg_ha") and has(df, "Flow"):
        df = df.withColumn("Yield_kg_ha", F.when(F.avg("Flow").over(order.whole(df)) > 100, F.col("Flow")))
    df = df.dropna(subset=["Longitude", "Latitude", "heading", "Swath_m", "Distance_m"])
    value = lambda c, kind="double": F.col(c) if has(df, c) else F.lit(None).cast(kind)
    ring = rectangle(F.col("Longitude"), F.col("Latitude"), F.col("heading"), F.col("Swath_m"), F.col("Distance_m"))
    out = {
        "Flow_kg_s": value("Flow") * LB, "Yield_kg_ha": value("Yield_kg_ha"), "Yield_kg_ha_wet": value("Yield_kg_ha_wet") if has(df, "Yield_kg_ha_wet") else value("Yield_kg_ha"), "Moisture_pct": value("Moisture"), "Swath_m": F.col("Swath_m"), "Distance_m": F.col("Distance_m"), "Heading_deg": F.col("heading"), "Altitude_m": value("Altitude") * 0.3048,
        "Flow_lbs_s": value("Flow"), "Swath_in": value("Swath"), "Distance_in": value("Distance"), "Altitude_ft": value("Altitude"), "GPS_Time": value("GPS_Time", "long"), "HeaderStatus": value("HeaderStatus", "int"), "Pass": value("Pass", "long"), "Longitude": F.col("Longitude"), "Latitude": F.col("Latitude"), "X_utm": value("X"), "Y_utm": value("Y"),
        "orig_row_id": value("orig_row_id", "long") if has(df, "orig_row_id") else value("row_id", "long"), "Variety": value("Variety", "string"), "GrainType": value("GrainType", "string"),
    }
    return df.select(*order.keys(df), ring.alias("geometry"), *(c.alias(n) for n, c in out.items()))


def points(df: DataFrame) -> DataFrame:
    """Points with a geometry and the columns they have."""
    need(df, "abort", "Longitude", "Latitude")
    return df.withColumn("geometry", F.struct(F.col("Longitude").alias("x"), F.col("Latitude").alias("y")))


def yield_summary(shapes: DataFrame) -> DataFrame:
    """Number, mean, spread and range of the yield, area in hectares and mass in kilograms, for each field."""
    area = ring_area(F.col("geometry")) / 10_000
    y = F.col("Yield_kg_ha")
    return shapes.groupBy(*order.keys(shapes)).agg(F.count("*").alias("n"), F.avg(y).alias("Yield_mean"), F.stddev_samp(y).alias("Yield_sd"), F.min(y).alias("Yield_min"), F.max(y).alias("Yield_max"), F.sum(area).alias("Area_ha"), F.sum(y * area).alias("Total_mass_kg"))


__all__ = ["convert_coordinates", "latlon_to_utm", "motion", "points", "polygons", "rectangle", "ring_area", "utm_to_latlon", "wkt_polygon", "yield_summary"]
