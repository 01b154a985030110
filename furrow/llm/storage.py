"""Reading tables and cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_own_dir: str | None = None
#: A written table needs the shuffle files of its job no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark broadcasts a table by its compressed size, which for sorted hashes is a tenth of what the driver then holds.
_FACTOR, COMPRESSION = "spark.sql.sources.fileCompressionFactor", 10.0
#: Bytes of rows that ``small`` may broadcast.
MAX_BROADCAST_BYTES = 32 << 20

_lock = threading.Lock()
_writers: dict[int, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where that is unset and Spark runs in one process.

    Raises ``ValueError`` on a cluster without the setting: executors would not see each other's files.
    """
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="furrow-")
    return _own_dir


@contextmanager
def _settings_of_writers(spark: SparkSession) -> Iterator[None]:
    """Shuffles end with the job, and tables count by their size in memory: holds the settings while any thread of the session writes, and puts back what they were after the last."""
    key = id(spark)
    with _lock:
        before = {_CLEANUP: spark.conf.get(_CLEANUP, "false"), _FACTOR: spark.conf.get(_FACTOR, "1.0")}
        held = _writers.setdefault(key, [0, before])
        held[0] += 1
        spark.conf.set(_CLEANUP, "true")
        spark.conf.set(_FACTOR, str(max(COMPRESSION, float(held[1][_FACTOR]))))
    try:
        yield
    finally:
        with _lock:
            held[0] -= 1
            if not held[0]:
                for name, value in _writers.pop(key)[1].items():
                    spark.conf.set(name, value)


class Scratch:
    """Tables of one operator call, written to the shared folder.

    ``keep`` writes a DataFrame and returns it as read back, so that later
    jobs neither recompute it nor depend on an executor's disk.  ``drop``
    deletes a table that no later plan reads.  What a result still reads stays
    until the application ends, when the whole folder goes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/furrow-{name}-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}
        atexit.register(self._remove)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        with _settings_of_writers(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(self.paths.pop(id(table))[1])

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _remove(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            with suppress(Py4JError, OSError):  # Spark may end first
                self._delete(self.root)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_crc(doc_id: Column | str) -> Column:
    """crc32 of the id as text; the folds of the labelled operators are remainders of it."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary"))


def small(df: DataFrame, size: int, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The table marked for broadcast if its counted bytes are within the limit; beyond it, for a merge join, so that Spark's own guess cannot broadcast it."""
    return F.broadcast(df) if size <= limit else df.hint("merge")
