"""Shared working folder of a run, and tables written there to cut lineage.

Every operator keeps intermediate tables in the folder that the cluster names in ``spark.checkpoint.dir``: all
executors and the driver see it, so a lost executor costs a re-read, not a recomputation of Python work.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Used only where the session names no folder and runs in one process (tests on one machine).
LOCAL_DEFAULT = "/tmp/checkpoints/tidemark"


class Work:
    """One run's folder below ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(LOCAL_DEFAULT)
            root = LOCAL_DEFAULT
        # Batches of whole texts: the session's own bound stays if it is lower.
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))
        self.spark, self.path = spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None, compression: str = "zstd") -> DataFrame:
        """Write ``df`` as Parquet and return a scan of what was written."""
        writer = df.write.option("compression", compression).mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str | None = None) -> None:
        """Remove one table, or the whole folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` hasn't, in whatever case: ``stem``, or that with underscores after it."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Rows of an Arrow batch: texts of this many rows are in a Python worker at a time.
BATCH_ROWS = 2000


def lean(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn``, after which a worker process gives freed memory back: workers stay alive between tasks, and idle ones add up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that Python objects of only so many texts live at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


#: Keys with more than max(HOT_ROWS, rows / HOT_KEYS) rows are joined by broadcast, so at most HOT_KEYS rows are broadcast.
HOT_ROWS, HOT_KEYS = 200, 5000


def join_sized(rows: DataFrame, facts: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``facts`` (unique in ``key``), whose column ``size`` is the number of rows with that key.

    The keys with the most rows are looked up in a broadcast table of at most HOT_KEYS rows, the others by a shuffle.
    """
    hot = F.col(size) > max(HOT_ROWS, total // HOT_KEYS)
    mark = fresh(rows.join(facts, key), "hot")
    large = facts.filter(hot).withColumn(mark, F.lit(True))
    first = rows.join(F.broadcast(large), key, "left")
    names = [c for c in first.columns if c != mark]
    rest = first.filter(F.col(mark).isNull()).select(*rows.columns).join(facts.filter(~hot), key, "left")
    return first.filter(F.col(mark)).select(*names).unionByName(rest.select(*names))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for data in b.column(0).to_pylist():
            own = np.frombuffer(data, np.float64)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])


def tree_sum(parts: DataFrame, work: Work, name: str, fan_in: int = 16) -> np.ndarray | None:
    """Sum of float64 vectors, one binary row for each task that had rows; the driver gets ``fan_in`` rows at most."""
    level, n = work.save(parts, f"{name}0"), 0
    count = level.count()
    while count > fan_in:
        n, count = n + 1, -(-count // fan_in)
        level = work.save(level.repartition(count).mapInArrow(lean(_summed), "sums binary"), f"{name}{n}")
    rows = [np.frombuffer(r[0], np.float64) for r in level.collect()]
    return sum(rows[1:], rows[0].copy()) if rows else None
