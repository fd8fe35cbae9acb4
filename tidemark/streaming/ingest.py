"""Streaming ingest: sources, repeated points, 60-second slots, and a writer that stores and relays each batch.

The frames that batch operators take and give are the same here; what needs state is the repeated-point filter (``applyInPandasWithState``)
and the slots (watermarked windows). Slots in streaming drop late rows by the watermark of the batch before, so a row may be
accepted that the row-exact batch operator ``rules.recovery_late`` would drop; apply that operator in ``foreachBatch`` where it matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.policies import Policy
from ..operators import filters, relay, rules
from ..operators.store import ArchiveTable
from ..sources.binary import decode_envelopes
from ..sources.lines import parse_lines, points_of


def line_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Points (name, val, ts) of text files that arrive in a folder; ``store_and_relay`` numbers them within their batch."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    rows = reader.load(path)
    return points_of(parse_lines(rows))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Points of a line socket, for development."""
    rows = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return points_of(parse_lines(rows))


def envelope_files(spark: SparkSession, path: str) -> DataFrame:
    """name, val, ts, arrival of gzip records that arrive as files."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    parsed = parse_lines(decode_envelopes(rows)).filter("ok")
    return parsed.select("name", "val", "ts", F.floor(F.col("arrival_ms") / 1000).alias("arrival"))


def record_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """name, val, ts, arrival of the gzip records that ``relay.Sinks`` adds to a folder (``records:path``)."""
    reader = spark.readStream.schema("partition_key string, content binary")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    parsed = parse_lines(decode_envelopes(reader.parquet(path))).filter("ok")
    return parsed.select("name", "val", "ts", F.floor(F.col("arrival_ms") / 1000).alias("arrival"))


def _repeats(precision: int, ttl_ms: int | None) -> Callable:
    """Keeps a name's points whose interval isn't that of the point before; the state is the last interval."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        own = rows["ts"] - rows["ts"] % precision
        kept = rows[own != own.shift(fill_value=last)]
        state.update((int(own.iloc[-1]),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield kept[["name", "val", "ts", "seq"]]

    return run


def drop_repeated(points: DataFrame, precision: int = 60, ttl_minutes: int | None = 60) -> DataFrame:
    """Streaming form of ``filters.drop_repeated``; a name not seen for ``ttl_minutes`` is forgotten. Needs name, val, ts, seq."""
    ttl = ttl_minutes * 60_000 if ttl_minutes else None
    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    return points.groupBy("name").applyInPandasWithState(_repeats(precision, ttl), "name string, val double, ts long, seq long", "interval long", "append", timeout)


def slots(points: DataFrame, aggregation: Sequence[rules.Rule], max_slots: int = rules.RECOVERY_SLOTS) -> DataFrame:
    """(name, val, ts) of closed 60-second slots, as ``rules.aggregate`` gives them: event time, closed ``max_slots`` slots behind the latest."""
    name = F.col("name")
    results = F.array(*[
        F.when(name.rlike(r.pattern), F.struct(F.regexp_replace(name, r.pattern, r.replacement()).alias("agg"), F.lit(r.method).alias("method"), F.lit(not r.go_on).alias("stop")))
        for r in aggregation
    ])
    found = points.withColumn("found", F.filter(results, lambda x: x.isNotNull())).filter(F.size("found") > 0)
    last = F.array_position(F.transform("found", lambda x: x["stop"]), True).cast("int")
    rows = found.select("val", rules.lag_of(points).alias("lag"), F.timestamp_seconds(F.col("ts") - F.pmod("ts", F.lit(rules.SLOT))).alias("slot"), F.explode(F.when(last > 0, F.slice("found", F.lit(1), last)).otherwise(F.col("found"))).alias("r"))
    grouped = rows.withWatermark("slot", f"{max_slots * rules.SLOT} seconds").groupBy(F.window("slot", f"{rules.SLOT} seconds"), F.col("r.agg").alias("agg"), F.col("r.method").alias("method"))
    return rules.slot_values(grouped.agg(*rules.slot_sums()).withColumn("ts", F.unix_seconds(F.col("window.start"))))


def store_and_relay(archive: ArchiveTable, now: Callable[[], int], routes: Sequence[relay.Route] = (), sinks: relay.Sinks | None = None, audit: Callable[[DataFrame], None] | None = None,
                    allow: Sequence[str] = (), block: Sequence[str] = (), aggregation: Callable[[], Sequence[rules.Rule]] | None = None, precision: int | None = None, **limits) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: audit, filters, repeated points and lists, drop rules, then the store, then the relay. An upsert may be repeated safely.

    ``aggregation`` gives the rules that hold now (a reloaded file's, say): points that a drop rule takes aren't stored unless they are
    late for their slot; the slots themselves come from ``slots``, whose output goes to ``store_slots``. With ``precision``, a point whose
    interval is that of the one before it in the batch is dropped; ``drop_repeated`` does so across batches.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        if "seq" not in batch.columns:
            batch = batch.withColumn("seq", F.monotonically_increasing_id())
        batch.persist()
        try:
            if audit:
                audit(batch)
            good = filters.listed(batch.filter(filters.passes(now=now(), **limits)), allow, block)
            if precision:
                good = filters.drop_repeated(good, precision)
            if aggregation and (held := list(aggregation())):
                if "arrival" in good.columns:
                    good = good.withColumn("late", rules.live_late(F.col("ts"), F.col("arrival")))
                good = rules.forwarded(good, rules.match_rules(good.select("name").distinct(), held))
            _deliver(good, archive, now(), routes, sinks)
        finally:
            batch.unpersist()

    return run


def _deliver(points: DataFrame, archive: ArchiveTable, now: int, routes: Sequence[relay.Route], sinks: relay.Sinks | None) -> None:
    archive.write(points, now)
    if routes:
        (sinks or relay.Sinks()).write_all(relay.route(points, routes))


def store_slots(archive: ArchiveTable, now: Callable[[], int], routes: Sequence[relay.Route] = (), sinks: relay.Sinks | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for closed slots: they go to the store and the relay as they are, neither filtered nor aggregated again."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("seq", F.monotonically_increasing_id()).persist()
        try:
            _deliver(batch, archive, now(), routes, sinks)
        finally:
            batch.unpersist()

    return run
