"""Hiding where a field lies and whose it is, and undoing it with a key."""

from __future__ import annotations

import json
import os
import random
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions.rcompat import has, need
from furrow.operators import order

SENSITIVE = ("Serial", "FieldID", "LoadID", "GPS_Time")
ENV = "YIELD_ANON_PASSWORD"
# Columns that may identify, how much, and what to do.
CATALOGUE = [
    ("Serial", "machine serial number", "high", "drop or hash"),
    ("FieldID", "field identifier", "high", "drop or anonymise"),
    ("LoadID", "load identifier", "medium", "drop"),
    ("GPS_Time", "GPS time stamp", "medium", "generalise or make relative"),
    ("Pass", "pass number", "low", "keep or generalise"),
    ("GrainType", "crop", "low", "keep"),
    ("Variety", "variety", "medium", "generalise or drop"),
    ("Machine", "machine type", "low", "keep"),
]
NAME_PATTERNS = ("serial", "fieldid", "loadid", "field_id", "load_id", "operator", "client", "farm", "owner", "grower", "machine", "device")


def sensitive_columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "column string, description string, sensitivity string, recommendation string")


def _names(system: str) -> tuple[str, str]:
    if system not in ("latlon", "utm"):
        raise ValueError("the coordinate system is latlon or utm")
    return ("Longitude", "Latitude") if system == "latlon" else ("X", "Y")


def anonymize_coordinates(df: DataFrame, system: str = "latlon", key_file: str | None = None, password: str | None = None, seed: int | None = None, zone: int | None = None) -> tuple[DataFrame, dict]:
    """Shifts all points so that a random reference row and a random offset vanish; returns them and the key."""
    x, y = _names(system)
    need(df, "abort", x, y)
    rng = random.Random(seed)
    span = 1.0 if system == "latlon" else 10_000.0
    # The row whose salted hash is the smallest is as random as one at a random place, and needs neither order nor memory.
    named = [*order.keys(df), *(["row_id"] if has(df, "row_id") else []), x, y]
    draw = F.xxhash64(F.lit(rng.getrandbits(62)), *named)
    n, at = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*"), F.min(F.struct(draw.alias("draw"), F.col(x).alias("x"), F.col(y).alias("y")))).first()
    if not n:
        raise ValueError("no coordinates to anonymise")
    at = at["x"], at["y"]
    dx, dy = at[0] + rng.uniform(-span, span), at[1] + rng.uniform(-span, span)
    key = {"version": 2, "system": system, "dx": dx, "dy": dy, "zone": zone, "n": n}
    if key_file:
        write_key(df.sparkSession, key, key_file, password)
    return df.withColumns({x: F.col(x) - dx, y: F.col(y) - dy}), key


def restore_coordinates(df: DataFrame, key: dict | None = None, key_file: str | None = None, password: str | None = None) -> DataFrame:
    key = key or read_key(df.sparkSession, key_file, password)
    x, y = _names(key["system"])
    need(df, "abort", x, y)
    return df.withColumns({x: F.col(x) + F.lit(key["dx"]), y: F.col(y) + F.lit(key["dy"])})


def write_key(spark: SparkSession, key: dict, file: str, password: str | None) -> None:
    """JSON; with a password AES-256-GCM under its SHA-256."""
    text = json.dumps(key)
    if password:
        sealed = spark.range(1).select(F.base64(F.aes_encrypt(F.lit(text), F.unhex(F.sha2(F.lit(password), 256)), F.lit("GCM")))).first()[0]
        text = json.dumps({"cipher": "aes-256-gcm", "data": sealed})
    Path(file).write_text(text)


def read_key(spark: SparkSession, file: str | None, password: str | None) -> dict:
    if not file or not Path(file).exists():
        raise FileNotFoundError(f"no key file {file}")
    found = json.loads(Path(file).read_text())
    if "cipher" not in found:
        return found
    if not password:
        raise ValueError("the key file needs a password")
    try:
        plain = spark.range(1).select(F.aes_decrypt(F.unbase64(F.lit(found["data"])), F.unhex(F.sha2(F.lit(password), 256)), F.lit("GCM")).cast("string")).first()[0]
    except Exception as wrong:
        raise ValueError("the password does not fit the key file") from wrong
    return json.loads(plain)


def verify_key_file(spark: SparkSession, file: str, password: str | None) -> bool:
    try:
        return {"system", "dx", "dy"} <= set(read_key(spark, file, password))
    except (ValueError, FileNotFoundError):
        return False


def security_report(key: dict, encrypted: bool) -> dict:
    """Level and the approximate shift in kilometres."""
    shift = (111.0 if key["system"] == "latlon" else 0.001) * (key["dx"] ** 2 + key["dy"] ** 2) ** 0.5
    return {"level": "high" if encrypted else "medium" if shift > 1 else "low", "shift_km": shift, "recommendations": [] if encrypted else ["encrypt the key file"]}


def remove_sensitive(df: DataFrame, columns: tuple[str, ...] = SENSITIVE, generalize: str | None = None, keep_temporal: bool = False) -> DataFrame:
    """Drops the columns; GPS_Time may stay as an hour or day (UTC), or as minutes since the field's first point."""
    if keep_temporal or generalize == "relative":
        w = order.whole(df)
        df = df.withColumn("Time_Relative_Min", (F.col("GPS_Time") - F.min("GPS_Time").over(w)) / 60)
    elif generalize in ("hour", "day"):
        pattern = "yyyy-MM-dd HH:00" if generalize == "hour" else "yyyy-MM-dd"
        stamp = F.to_utc_timestamp(F.timestamp_seconds("GPS_Time"), F.current_timezone())
        return df.withColumn("GPS_Time", F.date_format(stamp, pattern)).drop(*(c for c in columns if c != "GPS_Time"))
    return df.drop(*columns)


def get_password(env: str = ENV, file: str | None = None) -> str | None:
    return Path(file).read_text().strip() if file else os.environ.get(env)


def anonymize_yield_data(df: DataFrame, key_file: str | None = None, password: str | None = None, env: str = ENV, columns: tuple[str, ...] = SENSITIVE, system: str = "latlon") -> tuple[DataFrame, dict, dict]:
    password = password or get_password(env)
    if not password:
        raise ValueError(f"give a password or set {env}")
    moved, key = anonymize_coordinates(df, system, key_file, password)
    return remove_sensitive(moved, columns), key, security_report(key, encrypted=True)


def anonymize_data(df: DataFrame, types: str = "full", method: str = "translation", seed: int | None = None, dx: float | None = None, dy: float | None = None, angle: float | None = None, noise: float = 10, remove: tuple[str, ...] = ()) -> DataFrame:
    """Moves coordinates by translation, rotation about the field's centre, or noise, and drops identifying columns.

    Longitude and latitude follow X and Y, so that none gives the place away.
    """
    rng = random.Random(seed)
    if types in ("full", "coordinates"):
        dx = rng.uniform(-10_000, 10_000) if dx is None else dx
        dy = rng.uniform(-10_000, 10_000) if dy is None else dy
        angle = rng.uniform(0, 360) if angle is None else angle
        w, steps = order.whole(df), {}
        for pair, scale in ((("X", "Y"), 1.0), (("Longitude", "Latitude"), 1 / 111_320)):
            if not has(df, *pair):
                continue
            x, y = pair
            if method == "translation":
                steps |= {x: F.col(x) + dx * scale, y: F.col(y) + dy * scale}
            elif method == "rotation":
                cx, cy, a = F.avg(x).over(w), F.avg(y).over(w), F.radians(F.lit(angle))
                steps |= {x: cx + (F.col(x) - cx) * F.cos(a) - (F.col(y) - cy) * F.sin(a), y: cy + (F.col(x) - cx) * F.sin(a) + (F.col(y) - cy) * F.cos(a)}
            elif method == "noise":
                draw = lambda salt: (F.pmod(F.xxhash64("row_id", F.lit(salt), F.lit(seed or 0)), F.lit(1 << 30)) / float(1 << 30) * 2 - 1) * noise
                steps |= {x: F.col(x) + draw("x") * scale, y: F.col(y) + draw("y") * scale}
            else:
                raise ValueError(f"unknown method {method}")
        df = df.withColumns(steps)
    if types in ("full", "attributes"):
        keys = order.keys(df)
        df = df.drop(*(c for c in df.columns if c not in keys and (c in remove or any(p in c.lower() for p in NAME_PATTERNS))))
    return df


def aggregate_cells(df: DataFrame, size: float = 50) -> DataFrame:
    """Means on a coarse grid in place of points."""
    return df.groupBy(*order.keys(df), (F.floor(F.col("X") / size) * size).alias("cell_x"), (F.floor(F.col("Y") / size) * size).alias("cell_y")).agg(F.count("*").alias("n"), F.avg("Flow").alias("Flow"))


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Coordinates rounded so that points nearby become one place."""
    return df.withColumns({c: F.round(c, digits) for c in ("Longitude", "Latitude")})
