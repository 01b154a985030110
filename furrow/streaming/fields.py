"""Cleaning field files as they arrive: a file stream whose batches run the batch pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from furrow.plans.cleaning import CleanResult, clean_yield


def clean_stream(points: DataFrame, sink: Callable[[CleanResult, int], None], checkpoint: str, **params) -> StreamingQuery:
    """Each micro-batch holds whole fields (one file a field); ``sink`` gets its result and the batch's number.

    A batch that is repeated after a failure comes with the same number, so a sink that
    overwrites by number writes exactly once.
    """

    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            sink(clean_yield(df, **params), number)

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream(spark: SparkSession, folder: str, schema: StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
