"""Points and trees that the registered queries start from, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import index

#: 2024-01-31 00:00:00 UTC: the time at which all queries ask.
NOW = 1706659200


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``app.<type>.u<user>`` for every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts")
    return e.select(F.concat(F.lit("app."), "event_type", F.lit(".u"), F.col("user_id").cast("string")).alias("name"), F.col("value").alias("val"), ts, F.col("event_id").alias("seq"))


POINTS = "p AS (SELECT 'app.' || event_type || '.u' || user_id AS name, value AS val, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq FROM events)"


def deep_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of six segments that the aggregation rule matches, with a time of arrival."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id")
    kind = F.when(u % 2 == 0, ".total").otherwise(".mean")
    name = F.concat(F.lit("plant"), (u % 5).cast("string"), F.lit(".line"), (u % 7).cast("string"), F.lit(".cell"), (u % 3).cast("string"), F.lit(".unit"), (u % 11).cast("string"), F.lit("."), "event_type", kind)
    ts = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select(name.alias("name"), F.col("value").alias("val"), ts.alias("ts"), F.col("event_id").alias("seq"), (ts + (F.col("event_id") * 7919) % 300).alias("arrival"))


DEEP = """d AS (SELECT 'plant' || (user_id % 5) || '.line' || (user_id % 7) || '.cell' || (user_id % 3) || '.unit' || (user_id % 11) || '.' || event_type || CASE WHEN user_id % 2 = 0 THEN '.total' ELSE '.mean' END AS name,
    value AS val, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) + (event_id * 7919) % 300 AS arrival FROM events)"""

RULE = "by_line.<line>.<plant>.<what> (60) = {method} <plant>.<line>.cell*.*.<<what>>"
RULE_SQL = r"'^([^.]+)\.([^.]+)\.cell[^.]*\.[^.]+\.(.+)$'"
AGG_SQL = rf"regexp_replace(name, {RULE_SQL}, 'by_line.\2.\1.\3')"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name tree of ``points``, leaves numbered in order of name from 2 on."""
    return index.nodes_of(index.assign_ids(points(spark, sf_dir).select("name"), 1))


NODES = f"""{POINTS}, l AS (SELECT name, 1 + row_number() OVER (ORDER BY name) AS id FROM (SELECT DISTINCT name FROM p)),
    n AS (SELECT name, true AS is_leaf, CAST(id AS BIGINT) AS id FROM l
          UNION ALL SELECT DISTINCT array_to_string(list_slice(string_split(name, '.'), 1, k), '.'), false, CAST(0 AS BIGINT) FROM l, (VALUES (1), (2)) AS v(k))"""


def fixed(value: Column) -> Column:
    """Four decimals, rounded so that sums in another order give the same."""
    return F.floor(value * F.lit(10000.0) + F.lit(0.500001)) / F.lit(10000.0)


def fixed_sql(value: str) -> str:
    return f"floor(({value}) * CAST(10000 AS DOUBLE) + CAST(0.500001 AS DOUBLE)) / CAST(10000 AS DOUBLE)"
