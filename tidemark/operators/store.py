"""Archives: upserts where the last write wins, scans, expiry, imports and deletes.

An archive is a Parquet folder ``db=<archive>/day=<day>`` of (name, ts, val, seq, batch), ts at interval starts; ``batch`` numbers writes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names
from ..functions.policies import Policy, includes, interval

IMPORTABLE = ("60s24h", "5m7d", "30m2y")


class TooManyErrors(Exception):
    pass


def last_writes(points: DataFrame, precision: int) -> DataFrame:
    """(name, ts, val, seq): of the points of a name and interval the one that came last."""
    return points.groupBy("name", interval(F.col("ts"), precision).alias("ts")).agg(F.max_by("val", "seq").alias("val"), F.max("seq").alias("seq"))


def upsert(archive: DataFrame | None, points: DataFrame, policy: Policy, now: int) -> DataFrame:
    """The archive after the points that are valid and not expired have been written to it."""
    ok = names.is_valid(F.col("name")) & (F.col("ts") > 0) & includes(F.col("ts"), policy, now)
    new = last_writes(points.filter(ok), policy.precision)
    return new if archive is None else last_writes(archive.select("name", "ts", "val", "seq").unionByName(new), policy.precision)


def expire(archive: DataFrame, policy: Policy, now: int) -> DataFrame:
    """What is still within the retention, by the points' own time."""
    return archive.filter(includes(F.col("ts"), policy, now))


class ArchiveTable:
    """An archive on disk. Only the days that new points touch are read and written again; scans prune by day and time."""

    def __init__(self, spark: SparkSession, path: str, policy: Policy) -> None:
        self.spark, self.path, self.policy = spark, f"{path.rstrip('/')}/db={policy.db}", policy
        self.schema = "name string, ts long, val double, seq long, batch long, day long"

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def write(self, points: DataFrame, now: int) -> None:
        """Upsert. A later write wins over all earlier ones, whatever their seq; within a write seq decides.

        Each write gets the number after the highest in the days that it touches, so it doesn't matter who writes, a stream or a bulk load.
        """
        day = F.floor(F.col("ts") / 86400).cast("long")
        new = upsert(None, points, self.policy, now).withColumn("batch", F.lit(0).cast("long")).withColumn("day", day)
        held = self.read()
        if held is not None:
            days = [r.day for r in new.select("day").distinct().collect()]  # as many as days in the batch
            held = held.filter(F.col("day").isin(days))
            number = held.agg(F.max("batch")).first()[0]
            both = held.unionByName(new.withColumn("batch", F.lit(-1 if number is None else number).cast("long") + 1))
            last = F.max_by(F.struct("val", "seq", "batch"), F.struct("batch", "seq")).alias("last")
            new = both.groupBy("name", "ts", "day").agg(last).select("name", "ts", "last.val", "last.seq", "last.batch", "day")
        staged = f"{self.path}.staged"
        ordered = new.repartition("day", F.pmod(F.xxhash64("name"), F.lit(16))).sortWithinPartitions("day", "name", "ts")
        ordered.write.mode("overwrite").partitionBy("day").parquet(staged)  # what is read below isn't what is being replaced
        again = self.spark.read.schema(self.schema).parquet(staged)
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def scan(self, name: str, start: int, end: int) -> DataFrame:
        return scan(self.read().filter(F.col("day").between(start // 86400, end // 86400)), name, start, end)

    def expire(self, now: int) -> None:
        """Drop whole days that have expired."""
        first = self.policy.interval(now - self.policy.retention) // 86400
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            place = status.getPath().getName()
            if place.startswith("day=") and int(place[4:]) < first:
                fs.delete(status.getPath(), True)


def scan(archive: DataFrame, name: str, start: int, end: int) -> DataFrame:
    """Points of one metric, both ends included."""
    return archive.filter((F.col("name") == name) & F.col("ts").between(start, end)).orderBy("ts")


def first_points(archive: DataFrame, start: int, end: int) -> DataFrame:
    """Each metric's earliest point from start to end."""
    own = archive.filter(F.col("ts").between(start, end))
    return own.groupBy("name").agg(F.min("ts").alias("ts"), F.min_by("val", "ts").alias("val"))


def import_lines(rows: DataFrame, policy: Policy, now: int, max_errors: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(points, counts) of text lines ``ts,value`` in column ``value`` for the metric in column ``name``.

    Times must be on the archive's grid. Counts: db, received, saved, errors, expired.
    """
    if policy.db not in IMPORTABLE:
        raise ValueError(f"{policy.db} can't be imported to")
    cells = F.split(F.trim("value"), ",")
    read = rows.select("name", F.expr("try_cast(split(trim(value), ',')[0] AS BIGINT)").alias("ts"), F.expr("try_cast(try_element_at(split(trim(value), ','), 2) AS DOUBLE)").alias("val"), (F.size(cells) == 2).alias("__two"))
    bad = ~F.col("__two") | F.col("ts").isNull() | F.col("val").isNull() | (F.pmod("ts", F.lit(policy.precision)) != 0)
    read = read.withColumn("state", F.when(F.coalesce(bad, F.lit(True)), "error").when(~includes(F.col("ts"), policy, now), "expired").otherwise("saved"))
    count = lambda s: F.count_if(F.col("state") == s).alias({"error": "errors"}.get(s, s))
    counts = read.agg(F.lit(policy.db).alias("db"), F.count(F.lit(1)).alias("received"), count("saved"), count("error"), count("expired"))
    if max_errors is not None and counts.first().errors > max_errors:
        raise TooManyErrors(f"more than {max_errors} bad lines")
    return read.filter("state = 'saved'").select("name", "ts", "val"), counts


def delete_at(archive: DataFrame, policy: Policy, ts: int) -> tuple[DataFrame, DataFrame]:
    """(what is left, number of points deleted) when all points of the interval of ``ts`` go."""
    gone = F.col("ts") == policy.interval(ts)
    return archive.filter(~gone), archive.filter(gone).agg(F.count(F.lit(1)).alias("deleted"))


def delete_points(archive: DataFrame, deleted: DataFrame) -> DataFrame:
    """The archive without the points of metrics in column ``name``."""
    return archive.join(deleted.select("name").distinct(), "name", "left_anti")
