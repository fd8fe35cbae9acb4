"""Queries over binary and text forms: events are encoded by Spark tasks and decoded again; and over logs, purges and staged files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import admin, filters, index, offline, relay, render, rollup
from ..sources import binary, formats, lines
from .base import NODES, NOW, POINTS, nodes, points
from .queries import query

#: Points in one binary record.
RECORD = 500


def _records(own: DataFrame, encode: Callable[[list[tuple]], bytes]) -> DataFrame:
    """Column content: ``RECORD`` points (name, val, ts) of a task in each binary record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, RECORD):
                rows = list(zip(*(c.to_pylist() for c in b.slice(at, RECORD).columns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([encode(rows)], pa.binary())], ["content"])

    return own.select("name", "val", "ts").mapInArrow(run, "content binary")


@query(f"WITH {POINTS} SELECT name, val, ts FROM p")
def pickle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.parse_pickles(_records(points(spark, sf_dir), binary.pickle_points)).filter("name is not null").select("name", "val", "ts")


@query(f"WITH {POINTS} SELECT name, val, ts, CAST({NOW} AS BIGINT) * 1000 + 7 AS arrival_ms FROM p")
def envelope_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(points(spark, sf_dir), lambda rows: binary.encode_envelope(rows, NOW * 1000 + 7))
    return lines.parse_lines(binary.decode_envelopes(records)).filter("ok").select("name", "val", "ts", "arrival_ms")


@query("SELECT event_id, props FROM events")
def event_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON in gzipped envelopes with headers, opened again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, props = (c.to_pylist() for c in b.columns)
            opened = formats.open_envelope(formats.event_envelope([f"{i} {p}" for i, p in zip(ids, props, strict=True)]))
            cut = [payload.split(" ", 1) for head, payload in opened if head["version"] == "1.0"]
            yield pa.RecordBatch.from_arrays([pa.array([int(i) for i, _ in cut], pa.int64()), pa.array([p for _, p in cut], pa.string())], ["event_id", "props"])

    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props").mapInArrow(run, "event_id long, props string")


_HOURS = "g AS (SELECT name, ts - ts % 3600 AS ts, arg_max(val, seq) AS val FROM p GROUP BY 1, 2)"


@query(f"WITH {POINTS}, {_HOURS} SELECT name, CAST(3600 AS BIGINT) AS precision, ts, val FROM g")
def archive_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each metric's hourly points as a fixed-size file, whose archive reaches over the table's whole time, read again."""
    hourly = rollup.rollup(points(spark, sf_dir), 3600, [("last", "*")])
    low, high = hourly.agg(F.min("ts"), F.max("ts")).first()
    size = (high - low) // 3600 + 1 if low is not None else 1
    held = hourly.groupBy("name").agg(F.collect_list(F.struct("ts", "val")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                content = binary.write_archive_file([(3600, size)], {3600: [(x["ts"], x["val"]) for x in own]})
                rows = [(name, precision, ts, val) for precision, _, ts, val in binary.archive_points(content)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["name", "precision", "ts", "val"])

    return held.mapInArrow(run, "name string, precision long, ts long, val double")


@query(f"WITH {NODES} SELECT CASE WHEN is_leaf THEN name || ' leaf ' || id || ' 60s24h,5m7d' ELSE name || ' inner' END AS value FROM n")
def index_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.index_lines(nodes(spark, sf_dir).withColumn("retentions", F.array(F.lit("60s24h"), F.lit("5m7d"))))


@query(f"WITH {NODES} SELECT '{{\"path\":\"' || name || '\",\"is_leaf\":' || is_leaf || '}}' AS value FROM n WHERE regexp_full_match(name, 'app\\.[^.]*\\.u1[^.]*')")
def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.metrics_json(render.find(nodes(spark, sf_dir), "app.*.u1*", NOW, max_series=None))


@query(f"WITH {NODES} SELECT name FROM n WHERE regexp_full_match(name, 'app\\.(click|view)\\.[^.]*9')")
def listmetrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.list_metrics(nodes(spark, sf_dir), "app.{click,view}.*9").select("name")


@query(f"WITH {NODES} SELECT name, is_leaf, id FROM n WHERE is_leaf AND id = 12")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.lookup(nodes(spark, sf_dir), metric_id=12).select("name", "is_leaf", "id")


@query(f"""WITH {NODES}, lost AS (SELECT name, string_split(name, '.')[1] || '.' || string_split(name, '.')[2] AS prefix FROM n WHERE is_leaf AND name NOT IN (SELECT name FROM p WHERE contains(name, '.view.') OR seq % 2 = 0 AND contains(name, '.click.')))
    SELECT DISTINCT prefix FROM lost WHERE prefix NOT IN (SELECT string_split(name, '.')[1] || '.' || string_split(name, '.')[2] FROM n WHERE is_leaf AND name NOT IN (SELECT name FROM lost))""")
def purge_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).filter("contains(name, '.view.') OR (seq % 2 = 0 AND contains(name, '.click.'))")
    return admin.orphan_prefixes(nodes(spark, sf_dir), [p], 2)


@query(f"""WITH {POINTS}, f AS (SELECT CASE seq % 3 WHEN 0 THEN '5m7d' WHEN 1 THEN '30m2y' ELSE 'else' END AS db, {NOW} - seq % 2000 AS last_write FROM p)
    SELECT db, last_write, count(*) AS files FROM f WHERE last_write + CASE db WHEN '5m7d' THEN 90 WHEN '30m2y' THEN 300 ELSE 1200 END <= {NOW} GROUP BY 1, 2""")
def staged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = F.when(F.col("seq") % 3 == 0, "5m7d").when(F.col("seq") % 3 == 1, "30m2y").otherwise("else")
    files = points(spark, sf_dir).select(db.alias("db"), (F.lit(NOW) - F.col("seq") % 2000).alias("last_write"))
    return rollup.eligible(files, NOW).groupBy("db", "last_write").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {NODES} SELECT CAST(id % 10 AS INTEGER) AS bucket, count(*) AS leaves FROM n WHERE is_leaf GROUP BY 1")
def staging_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter("is_leaf").groupBy(rollup.bucket(F.col("id")).alias("bucket")).agg(F.count(F.lit(1)).alias("leaves"))


@query("""SELECT CASE WHEN event_id % 5 = 0 THEN 'reset' ELSE 'timeout' END AS kind, CASE WHEN event_id % 5 = 0 THEN '' ELSE '/api/' || event_type END AS url, count(*) AS errors
    FROM events WHERE event_id % 5 < 2 GROUP BY 1, 2""")
def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.when(F.col("event_id") % 5 == 0, "upstream: Connection reset by peer").when(F.col("event_id") % 5 == 1, F.concat(F.lit("timed out, GET http://h:1/api/"), "event_type", F.lit("?u="), "user_id")).otherwise("ok")
    return offline.error_counts(e.select(line.alias("value")))


@query(f"WITH {POINTS} SELECT name, CAST(sum(seq) AS DOUBLE) AS val, CAST({NOW} AS BIGINT) AS ts FROM p WHERE seq % 100 < 60 GROUP BY name")
def log_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = points(spark, sf_dir).select("name", (F.lit(NOW) - F.col("seq") % 100).alias("ts"), F.concat(F.lit("took "), F.col("seq").cast("string")).alias("value"))
    return offline.last_minute_sum(own, NOW)


@query("SELECT event_type AS name, count(*) AS processes, CAST(sum(user_id % 8) AS DOUBLE) AS cpu, CAST(sum(event_id % 16) AS DOUBLE) AS memory FROM events GROUP BY 1")
def process_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return offline.process_stats(e.select(F.col("event_type").alias("name"), (F.col("user_id") % 8).cast("double").alias("cpu"), (F.col("event_id") % 16).cast("double").alias("memory")))


@query("""SELECT event_type AS query, CAST(sum(user_id % 900) AS BIGINT) AS series, CAST(sum(event_id % 7 + event_id % 11 + event_id % 13) > 5000 OR sum(user_id % 900) > 5000 AS BOOLEAN) AS logged,
    CAST(min(event_id % 7) AS BIGINT) AS min_wait_ms, CAST(max(event_id % 11) AS BIGINT) AS max_read_ms, CAST(sum(event_id % 13) AS BIGINT) AS sum_write_ms FROM events GROUP BY 1""")
def query_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    rows = e.select(F.col("event_type").alias("query"), (F.col("user_id") % 900).alias("series"), (i % 7).alias("wait_ms"), (i % 11).alias("read_ms"), (i % 13).alias("write_ms"))
    return render.query_stats(rows).select("query", "series", "logged", "min_wait_ms", "max_read_ms", "sum_write_ms")


@query("""WITH r AS (SELECT CAST(user_id % 3 + 200 AS INTEGER) AS status, CASE WHEN event_id % 50 = 0 THEN 0 ELSE (event_id * 7919) % 4001 END AS b FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY b) - 1 AS i, count(*) OVER (PARTITION BY status) AS n FROM r)
    SELECT status, count(*) AS requests, CAST(sum(b) AS BIGINT) AS total_bytes, sum(b) / count(*) AS mean_bytes, max(b) AS max_bytes, max(CASE WHEN i = floor(n * 95 / 100.0) THEN b END) AS p95, max(CASE WHEN i = floor(n * 99 / 100.0) THEN b END) AS p99 FROM k GROUP BY status""")
def log_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a proxy with a host in front and no time of service."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sent = F.when(F.col("event_id") % 50 == 0, "-").otherwise(((F.col("event_id") * 7919) % 4001).cast("string"))
    line = F.concat(F.lit('front:443 10.1.1.1 - someone [x] "POST /graph?t='), F.col("user_id").cast("string"), F.lit(' HTTP/1.1" '), (F.col("user_id") % 3 + 200).cast("string"), F.lit(" "), sent, F.lit(' "-" "agent"'))
    return offline.request_stats(offline.parse_requests(e.select(line.alias("value")), "mellon"), of="bytes")


def _proxied(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    referer = F.when(F.col("user_id") % 5 == 0, "-").otherwise(F.concat(F.lit("https://h/dashboard/db/board-"), (F.col("user_id") % 5).cast("string"), F.lit("?orgId=1")))
    i = F.col("event_id").cast("string")
    return e.select(F.concat(F.lit('10.1.1.1 - - [x] "GET /render HTTP/1.1" 200 17 "'), referer, F.lit('" "agent" "-" Len: '), i, F.lit(" Rtime: "), (F.col("event_id") % 8).cast("string"), F.lit(".125 Reqs: 1 UPSTR: 10.0.0.9:80 Cache: - POST-DATA: -")).alias("value"))


@query("SELECT 'board-' || (user_id % 5) AS dashboard, count(*) AS requests FROM events WHERE user_id % 5 > 0 GROUP BY 1")
def log_dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.dashboard_counts(offline.parse_requests(_proxied(spark, sf_dir), "nginx"))


@query("SELECT CAST(200 AS INTEGER) AS status, CAST(sum(event_id % 8 * 1000 + 125) AS DOUBLE) AS total_ms, CAST(sum(event_id) AS BIGINT) AS total_length FROM events")
def log_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.parse_requests(_proxied(spark, sf_dir), "nginx").groupBy("status").agg(F.sum("ms").alias("total_ms"), F.sum("length").alias("total_length"))


@query("""WITH s AS (SELECT 'q.' || event_type AS name, user_id % 97 AS v, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY name) AS n FROM s),
    g AS (SELECT name, count(*) AS c, max(v) AS hi, min(v) AS lo, max(CASE WHEN i = floor(n * 95 / 100.0) THEN v END) AS p95, max(ts) AS ts FROM k GROUP BY 1)
    SELECT name || '.count' AS name, CAST(c AS VARCHAR) AS value, ts FROM g UNION ALL SELECT name || '.max', hi || '.00', ts FROM g UNION ALL SELECT name || '.min', lo || '.00', ts FROM g UNION ALL SELECT name || '.p95', p95 || '.00', ts FROM g""")
def own_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact ones of the statistics; rounded means and deviations are tested by a fixture."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    samples = e.select(F.concat(F.lit("q."), "event_type").alias("name"), (F.col("user_id") % 97).cast("double").alias("val"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return formats.sample_statistics(samples).filter(F.substring_index("name", ".", -1).isin("count", "max", "min", "p95"))


@query(f"WITH {POINTS} SELECT name, val, ts, CAST({NOW} AS BIGINT) * 1000 AS arrival_ms FROM p")
def record_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in batches for a stream of gzip records, opened again."""
    batches = relay.envelope_batches(points(spark, sf_dir), 500, NOW * 1000)
    opened = binary.decode_envelopes(batches.select(binary.zipped("lines").alias("content")))
    return lines.parse_lines(opened).filter("ok").select("name", "val", "ts", "arrival_ms")


@query(f"WITH {POINTS} SELECT name, val, ts FROM p WHERE seq % 3 = 0")
def inner_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two points of three come under the name of an inner node and are dropped."""
    p = points(spark, sf_dir)
    name = F.when(F.col("seq") % 3 == 1, F.substring_index("name", ".", 2)).when(F.col("seq") % 3 == 2, F.lit("app")).otherwise(F.col("name"))
    return filters.drop_inner(p.withColumn("name", name), nodes(spark, sf_dir)).select("name", "val", "ts")


@query(f"""WITH {POINTS}, g AS (SELECT ts - ts % 3600 AS ts, arg_max(val, seq) AS val FROM p WHERE name = 'app.click.u7' GROUP BY 1), t AS (SELECT unnest(range({NOW - 20 * 86400}, {NOW} - {NOW} % 3600 + 3600, 3600)) AS ts)
    SELECT 'app.click.u7' AS name, t.ts, g.val FROM t LEFT JOIN g ON t.ts = g.ts WHERE t.ts >= {NOW - 20 * 86400} - {NOW - 20 * 86400} % 3600 + 3600""")
def file_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metric's hourly archive file as a dense series, its grid half open."""
    hourly = rollup.rollup(points(spark, sf_dir).filter("name = 'app.click.u7'"), 3600, [("last", "*")])
    return render.half_open(hourly, "app.click.u7", NOW - 20 * 86400, NOW, 3600, NOW, 30 * 86400)
