"""The driver's ``events`` table as yield points: back-and-forth passes of 100 points, 25 passes a field."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's text; DuckDB's differs in the quotes of Interval alone.
POINTS_SQL = """
SELECT event_id AS row_id,
       CAST(floor(event_id / 2500e0) AS BIGINT) AS field_id,
       CAST(floor(event_id / 100e0) AS BIGINT) + 1 AS Pass,
       435000e0 + 6e0 * floor(event_id / 100e0) + ((event_id * 37) % 11 - 5) * 5e-2
         - CASE WHEN CAST(floor(event_id / 100e0) AS BIGINT) % 10 = 9 THEN 4e0 ELSE 0e0 END
         + CASE WHEN event_id % 1999 = 1000 THEN 500e0 ELSE 0e0 END AS X,
       5262000e0 + 25e-1 * (CASE WHEN CAST(floor(event_id / 100e0) AS BIGINT) % 2 = 0
                                 THEN event_id % 100 ELSE 99 - event_id % 100 END)
         + ((event_id * 53) % 13 - 6) * 5e-2 AS Y,
       -6985e-2 + 8e-5 * floor(event_id / 100e0) AS Longitude,
       475e-1 + 225e-7 * (event_id % 100) AS Latitude,
       CASE WHEN event_id % 211 = 7 THEN NULL ELSE value / 4e0 END AS Flow,
       1704067200 + 2 * event_id AS GPS_Time,
       CASE WHEN event_id % 97 = 0 THEN 1 ELSE 2 END AS `Interval`,
       77e0 + (event_id * 7) % 30 AS Distance,
       240e0 AS Swath,
       CASE WHEN event_id % 173 = 5 THEN NULL
            WHEN event_id % 401 = 9 THEN 4e1
            ELSE 15e0 + ((event_id * 31) % 100) / 20e0 END AS Moisture,
       CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 33 WHEN 'purchase' THEN 33
                       WHEN 'signup' THEN 0 ELSE 99 END AS HeaderStatus,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_id % 8 END AS GPSStatus,
       CASE WHEN event_id % 40 = 0 THEN NULL ELSE ((event_id * 13) % 120) / 8e0 END AS DOP,
       61e0 + (event_id % 7) / 1e1 AS Altitude,
       concat('SN-', CAST(event_id % 3 AS STRING)) AS Serial,
       'F0:1' AS FieldID, 'L0:<1>' AS LoadID, 'Maïs' AS GrainType
FROM events
"""
POINTS_DUCKDB = POINTS_SQL.replace("`", '"').replace("AS STRING", "AS VARCHAR")


def yield_points(spark: SparkSession, sf_dir: str, fields: bool = True) -> DataFrame:
    """Yield points of many fields, or without ``field_id`` as one field.

    Dealt out by field, so that every window of a plan runs on that one exchange.
    """
    points = spark.sql(POINTS_SQL.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return points if fields else points.drop("field_id")
