"""Queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names
from ..functions.policies import Policy, choose, interval, parse_policies
from ..operators import admin, filters, index, offline, relay, render, rollup, rules, store
from ..sources import dumps, lines
from .base import AGG_SQL, DEEP, NODES, NOW, POINTS, RULE, RULE_SQL, deep_points, fixed, fixed_sql, nodes, points

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
P60, P5, P30 = parse_policies()


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Sources and filters


@query(f"""WITH {POINTS}, t AS (SELECT seq, CASE WHEN seq % 97 = 0 THEN name || ' ' || ts WHEN seq % 89 = 0 THEN name || ' x' || seq || ' ' || ts WHEN seq % 83 = 0 THEN name || ' 1 2.5'
        ELSE '  ' || name || '   ' || seq || ' ' || ts END AS line FROM p),
    w AS (SELECT seq, list_filter(string_split(trim(line), ' '), lambda x: x <> '') AS w FROM t)
    SELECT seq, CASE WHEN ok THEN w[1] END AS name, CASE WHEN ok THEN try_cast(w[2] AS DOUBLE) END AS val, CASE WHEN ok THEN CAST(try_cast(w[3] AS INTEGER) AS BIGINT) ELSE -1 END AS ts, ok
    FROM (SELECT *, len(w) = 3 AND try_cast(w[2] AS DOUBLE) IS NOT NULL AND regexp_full_match(w[3], '[+-]?[0-9]+') AS ok FROM w)""")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, t = F.col("name"), F.col("seq").cast("string"), F.col("ts").cast("string")
    line = F.when(F.col("seq") % 97 == 0, F.concat_ws(" ", n, t)).when(F.col("seq") % 89 == 0, F.concat(n, F.lit(" x"), s, F.lit(" "), t)).when(F.col("seq") % 83 == 0, F.concat(n, F.lit(" 1 2.5"))).otherwise(F.concat(F.lit("  "), n, F.lit("   "), s, F.lit(" "), t))
    read = lines.parse_lines(points(spark, sf_dir).select("seq", line.alias("value")))
    return read.select("seq", *[F.when(F.col("ok"), F.col(c)).alias(c) for c in ("name", "val")], F.when(F.col("ok"), F.col("ts")).otherwise(-1).alias("ts"), "ok")


_ODD = "CASE seq % 7 WHEN 0 THEN name || '.' WHEN 1 THEN '.' || name WHEN 2 THEN replace(name, '.', '..') WHEN 3 THEN 'root.' || name WHEN 4 THEN name || ' a' WHEN 5 THEN name || ':=%-_' ELSE name END"


def _odd_name():
    n, k = F.col("name"), F.col("seq") % 7
    return (F.when(k == 0, F.concat(n, F.lit("."))).when(k == 1, F.concat(F.lit("."), n)).when(k == 2, F.replace(n, F.lit("."), F.lit(".."))).when(k == 3, F.concat(F.lit("root."), n))
            .when(k == 4, F.concat(n, F.lit(" a"))).when(k == 5, F.concat(n, F.lit(":=%-_"))).otherwise(n))


@query(f"WITH {POINTS} SELECT seq, name, regexp_full_match(name, '[A-Za-z0-9_:=%-]+(\\.[A-Za-z0-9_:=%-]+)*') AND NOT starts_with(name, 'root.') AS valid FROM (SELECT seq, {_ODD} AS name FROM p)")
def name_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = points(spark, sf_dir).select("seq", _odd_name().alias("name"))
    return odd.withColumn("valid", names.is_valid(F.col("name")))


_REASON = f"CASE WHEN NOT (regexp_full_match(name, '[A-Za-z0-9_:=%-]+(\\.[A-Za-z0-9_:=%-]+)*') AND NOT starts_with(name, 'root.')) OR ts <= 0 THEN 'invalid' WHEN length(name) > 18 THEN 'length' WHEN ts + 864000 < {NOW} - 432000 THEN 'age' WHEN ts > {NOW} - 86400 * 3 THEN 'future' END"


@query(f"WITH {POINTS}, o AS (SELECT seq, {_ODD} AS name, ts FROM p) SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS points, CAST(sum(ts) AS BIGINT) AS ts_sum FROM o GROUP BY 1")
def point_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = points(spark, sf_dir).withColumn("name", _odd_name())
    why = filters.reason(max_length=18, max_age=864000, max_future_age=86400 * 2, now=NOW - 86400 * 5)
    return odd.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("points"), F.sum("ts").alias("ts_sum"))


@query(f"WITH {POINTS}, b AS (SELECT *, lag(ts - ts % 3600, 1, 0) OVER (PARTITION BY name ORDER BY seq) AS before FROM p) SELECT name, val, ts, seq FROM b WHERE ts - ts % 3600 <> before")
def dup_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.drop_repeated(points(spark, sf_dir), 3600).select("name", "val", "ts", "seq")


@query(f"WITH {POINTS} SELECT name, count(*) AS points FROM p WHERE (regexp_matches(name, '^app\\.(click|view|purchase)') OR regexp_matches(name, 'u1')) AND NOT regexp_matches(name, '7$|u13') GROUP BY name")
def allow_block_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = filters.listed(points(spark, sf_dir), allow=[r"^app\.(click|view|purchase)", "u1"], block=["7$", "u13"])
    return kept.groupBy("name").agg(F.count(F.lit(1)).alias("points"))


@query(f"WITH {POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY ts - ts % 86400 ORDER BY ts, seq) AS k FROM p) SELECT seq, ts FROM r WHERE k <= 5")
def log_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.within_quota(points(spark, sf_dir), 5, 86400).select("seq", "ts")


# Aggregation across metrics


def _results(spark, sf_dir, method="custom1"):
    deep = deep_points(spark, sf_dir)
    return deep, rules.match_rules(deep.select("name").distinct(), rules.parse_rules(RULE.format(method=method)))


@query(f"""WITH {DEEP}, m AS (SELECT DISTINCT name FROM d)
    SELECT name, {AGG_SQL} AS agg, 'custom1' AS method, 0 AS rule FROM m WHERE regexp_matches(name, {RULE_SQL})""")
def agg_rules_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir)[1].select("name", "agg", "method", "rule")


_CHAIN = "all.<type> (60) c = sum app.<type>.*\nten.<type>.<user> (60) c drop = avg app.<type>.u1<user>\nsome.<user> (60) = sum app.*.<user>\nnever.<user> (60) = sum app.*.<user>"


@query(f"""WITH {POINTS}, m AS (SELECT DISTINCT name, string_split(name, '.') AS s FROM p)
    SELECT name, 'all.' || s[2] AS agg, 0 AS rule, false AS dropped FROM m
    UNION ALL SELECT name, 'ten.' || s[2] || '.' || substr(s[3], 3), 1, true FROM m WHERE starts_with(s[3], 'u1') AND length(s[3]) > 2
    UNION ALL SELECT name, 'some.' || s[3], 2, false FROM m""")
def agg_rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.match_rules(points(spark, sf_dir).select("name").distinct(), rules.parse_rules(_CHAIN))
    return found.select("name", "agg", "rule", "dropped")


def _slots(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        deep, found = _results(spark, sf_dir, method)
        out = rules.aggregate(deep, found)
        return out.select("name", "ts", fixed(F.col("val")).alias("val"))

    return run


for _method, _value in (("sum", "sum(val)"), ("avg", "avg(val)"), ("custom1", "CASE WHEN suffix(any_value(name), '.mean') THEN avg(val) ELSE sum(val) END")):
    QUERIES[f"agg_slots_{_method}"] = _slots(_method)
    ORACLE_SQL[f"agg_slots_{_method}"] = f"WITH {DEEP} SELECT {AGG_SQL} AS name, ts - ts % 60 AS ts, {fixed_sql(_value)} AS val FROM d GROUP BY 1, 2"

QUERIES["agg_slots_latency"] = _slots("latency")
ORACLE_SQL["agg_slots_latency"] = f"""WITH {DEEP}, a AS (SELECT {AGG_SQL} AS agg, ts - ts % 60 AS ts, arrival - ts AS lag FROM d),
    g AS (SELECT agg, ts, CAST(min(lag) AS DOUBLE) AS lo, CAST(max(lag) AS DOUBLE) AS hi, avg(lag) AS mean, CAST(count(*) AS DOUBLE) AS n FROM a GROUP BY 1, 2)
    SELECT agg || '.min' AS name, ts, {fixed_sql("lo")} AS val FROM g UNION ALL SELECT agg || '.max', ts, {fixed_sql("hi")} FROM g
    UNION ALL SELECT agg || '.mean', ts, {fixed_sql("mean")} FROM g UNION ALL SELECT agg || '.count', ts, {fixed_sql("n")} FROM g"""


@query(f"""WITH {DEEP} SELECT name, count(*) AS points FROM d WHERE NOT regexp_matches(name, '^plant[01]\\.line') OR arrival > ts - ts % 60 + 120 GROUP BY name""")
def agg_drop_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    deep = deep_points(spark, sf_dir).withColumn("late", rules.live_late(F.col("ts"), F.col("arrival")))
    found = rules.match_rules(deep.select("name").distinct(), rules.parse_rules("gone.<<m>> (60) drop = sum plant[01].line<<m>>"))
    return rules.forwarded(deep, found).groupBy("name").agg(F.count(F.lit(1)).alias("points"))


@query(f"WITH {DEEP} SELECT arrival > ts - ts % 60 + 120 AS late, count(*) AS points, CAST(sum(ts) AS BIGINT) AS ts_sum FROM d GROUP BY 1")
def agg_late_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = rules.live_late(F.col("ts"), F.col("arrival")).alias("late")
    return deep_points(spark, sf_dir).groupBy(late).agg(F.count(F.lit(1)).alias("points"), F.sum("ts").alias("ts_sum"))


_JITTER = "ts - (seq * 7919) % 3000"


@query(f"""WITH {POINTS}, j AS (SELECT name, seq, {_JITTER} AS ts FROM p),
    m AS (SELECT *, max(ts - ts % 60) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM j)
    SELECT seq, name, coalesce(ts - ts % 60 < reached - 180, false) AS late FROM m""")
def agg_late_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    jittered = points(spark, sf_dir).withColumn("ts", F.col("ts") - (F.col("seq") * 7919) % 3000)
    return rules.recovery_late(jittered).select("seq", "name", "late")


@query(f"""WITH {DEEP}, a AS (SELECT arrival - (ts - ts % 60) AS age FROM d WHERE arrival > ts - ts % 60 + 120)
    SELECT CASE WHEN age <= 125 THEN 'slot_closed' ELSE 'slot_expired' END AS reason, age // 60 AS age_minutes, count(*) AS points FROM a GROUP BY 1, 2""")
def late_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.late_report(deep_points(spark, sf_dir))


# Archives and roll-up


@query(f"WITH {POINTS} SELECT name, ts - ts % 60 AS ts, arg_max(val, seq) AS val, max(seq) AS seq FROM p WHERE ts - ts % 60 >= {NOW - 20 * 86400} GROUP BY 1, 2")
def archive_upsert_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(None, points(spark, sf_dir), Policy("60s:20d", 60, 20 * 86400), NOW)


@query(f"WITH {POINTS} SELECT name, ts - ts % 60 AS ts, arg_max(val, seq) AS val, max(seq) AS seq FROM p GROUP BY 1, 2")
def archive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to one archive give what one write gives."""
    p, policy = points(spark, sf_dir), Policy("60s:2y", 60, 730 * 86400)
    first = store.upsert(None, p.filter("seq % 3 <> 0"), policy, NOW)
    return store.upsert(first, p.filter("seq % 3 = 0"), policy, NOW)


@query(f"WITH {POINTS} SELECT a.db, count(*) AS points FROM p, (VALUES ('60s24h', 60, 86400), ('5m7d', 300, 604800), ('30m2y', 1800, 63072000)) AS a(db, step, keep) WHERE ts - ts % step >= {NOW} - keep - ({NOW} - keep) % step GROUP BY 1")
def archive_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    left = [store.expire(p, a, NOW).select(F.lit(a.db).alias("db")) for a in (P60, P5, P30)]
    return left[0].unionByName(left[1]).unionByName(left[2]).groupBy("db").agg(F.count(F.lit(1)).alias("points"))


_METHODS = [("sum", r"\.purchase\."), ("min", "u1$"), ("max", "u2$"), ("last", "u3"), ("avg", "*")]
_METHOD_SQL = "CASE WHEN regexp_matches(name, '\\.purchase\\.') THEN 'sum' WHEN regexp_matches(name, 'u1$') THEN 'min' WHEN regexp_matches(name, 'u2$') THEN 'max' WHEN regexp_matches(name, 'u3') THEN 'last' ELSE 'avg' END"


@query(f"WITH {POINTS} SELECT name, ts - ts % 300 AS ts, {fixed_sql('avg(val)')} AS val FROM p GROUP BY 1, 2")
def rollup_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup(points(spark, sf_dir), 300).select("name", "ts", fixed(F.col("val")).alias("val"))


@query(f"WITH {POINTS}, f AS (SELECT name, ts - ts % 300 AS ts, avg(val) AS val FROM p GROUP BY 1, 2) SELECT name, ts - ts % 1800 AS ts, {fixed_sql('avg(val)')} AS val FROM f GROUP BY 1, 2")
def rollup_30m_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.cascade(points(spark, sf_dir))["30m2y"].select("name", "ts", fixed(F.col("val")).alias("val"))


@query(f"""WITH {POINTS}, g AS (SELECT name, ts - ts % 86400 AS ts, sum(val) AS s, avg(val) AS a, min(val) AS lo, max(val) AS hi, arg_max(val, seq) AS l FROM p GROUP BY 1, 2)
    SELECT name, ts, {fixed_sql(f"CASE {_METHOD_SQL} WHEN 'sum' THEN s WHEN 'min' THEN lo WHEN 'max' THEN hi WHEN 'last' THEN l ELSE a END")} AS val FROM g""")
def rollup_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup(points(spark, sf_dir), 86400, _METHODS).select("name", "ts", fixed(F.col("val")).alias("val"))


@query(f"WITH {POINTS} SELECT name, ts - ts % 86400 AS ts, arg_max(val, seq) AS val FROM p GROUP BY 1, 2")
def rollup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup(points(spark, sf_dir), 86400, [("last", "*")]).select("name", "ts", "val")


@query(f"WITH {POINTS} SELECT name, ts - ts % 86400 AS ts, min(val) AS val FROM p GROUP BY 1, 2")
def rollup_last_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.rollup(points(spark, sf_dir), 86400, [("last", "*")], last_is_min=True).select("name", "ts", "val")


@query(f"""WITH {POINTS}, t AS (SELECT DISTINCT name, ts - ts % 3600 AS i FROM p WHERE seq % 50 = 0)
    SELECT p.name, t.i AS ts, {fixed_sql('avg(val)')} AS val FROM p JOIN t ON p.name = t.name AND p.ts - p.ts % 3600 = t.i GROUP BY 1, 2""")
def rollup_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return rollup.rolled_again(p, p.filter("seq % 50 = 0"), 3600).select("name", "ts", fixed(F.col("val")).alias("val"))


@query(f"""WITH {POINTS}, u AS (SELECT name, ts - ts % 3600 AS ts, arg_max(val, seq) AS val FROM p GROUP BY 1, 2)
    SELECT name, ts - ts % 86400 AS ts, {fixed_sql('avg(val)')} AS val FROM u GROUP BY 1, 2 HAVING count(*) / 24.0 >= 0.1""")
def archive_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = store.last_writes(points(spark, sf_dir), 3600)
    return rollup.propagate(hourly, 3600, 86400, 0.1).select("name", "ts", fixed(F.col("val")).alias("val"))


@query(f"""WITH {POINTS}, a AS (SELECT *, CASE WHEN {NOW} - ts <= 86400 THEN '60s24h' WHEN {NOW} - ts <= 604800 THEN '5m7d' WHEN {NOW} - ts <= 63072000 THEN '30m2y' END AS db,
        CASE WHEN {NOW} - ts <= 86400 THEN 60 WHEN {NOW} - ts <= 604800 THEN 300 ELSE 1800 END AS step FROM p)
    SELECT db, name, ts - ts % step AS ts, arg_max(val, seq) AS val FROM a WHERE db IS NOT NULL GROUP BY 1, 2, 3""")
def archive_bulk_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.bulk_place(points(spark, sf_dir), NOW)


@query(f"""WITH {POINTS}, r AS (SELECT seq, CASE WHEN seq % 5 = 0 THEN 'x,' || seq WHEN seq % 5 = 1 THEN CAST(ts AS VARCHAR) ELSE (ts - ts % 300) || ',' || seq END AS line, ts FROM p),
    s AS (SELECT CASE WHEN seq % 5 < 2 THEN 'error' WHEN ts - ts % 300 < {NOW - 604800} THEN 'expired' ELSE 'saved' END AS state FROM r)
    SELECT '5m7d' AS db, count(*) AS received, CAST(count(*) FILTER (state = 'saved') AS BIGINT) AS saved, CAST(count(*) FILTER (state = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (state = 'expired') AS BIGINT) AS expired FROM s""")
def import_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, t = F.col("seq").cast("string"), F.col("ts")
    line = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x,"), s)).when(F.col("seq") % 5 == 1, t.cast("string")).otherwise(F.concat((t - t % 300).cast("string"), F.lit(","), s))
    return store.import_lines(points(spark, sf_dir).select("name", line.alias("value")), P5, NOW)[1]


@query(f"WITH {POINTS} SELECT name, min(ts) AS ts, arg_min(val, ts) AS val FROM (SELECT name, ts, min(val) AS val FROM p WHERE ts BETWEEN {NOW - 10 * 86400} AND {NOW - 86400} GROUP BY 1, 2) GROUP BY name")
def first_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = points(spark, sf_dir).groupBy("name", "ts").agg(F.min("val").alias("val"))
    return store.first_points(unique, NOW - 10 * 86400, NOW - 86400)


@query(f"WITH {POINTS}, t AS (SELECT max(ts) - max(ts) % 3600 AS t FROM p) SELECT CAST(count(*) AS BIGINT) AS deleted FROM (SELECT DISTINCT name, ts - ts % 3600 AS i FROM p), t WHERE i = t")
def delete_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = store.last_writes(points(spark, sf_dir), 3600)
    last = hourly.agg(F.max("ts")).first()[0]
    return store.delete_at(hourly, Policy("60m:2y", 3600, 730 * 86400), last)[1]


@query(f"WITH {POINTS} SELECT name, ts, val FROM p WHERE name = 'app.click.u10' AND ts BETWEEN {NOW - 20 * 86400} AND {NOW}")
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.scan(points(spark, sf_dir), "app.click.u10", NOW - 20 * 86400, NOW).select("name", "ts", "val")


# Name tree


@query(f"WITH {NODES} SELECT name, is_leaf, id FROM n")
def name_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("name", "is_leaf", "id")


@query(f"WITH {POINTS}, o AS (SELECT DISTINCT name FROM p WHERE seq % 2 = 0) SELECT DISTINCT name FROM p WHERE name NOT IN (SELECT name FROM o)")
def new_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    known = index.nodes_of(index.assign_ids(p.filter("seq % 2 = 0").select("name"), 1))
    return index.new_names(p, known)


@query(f"""WITH {POINTS}, c AS (SELECT name, min(seq) AS seq FROM (SELECT CASE WHEN seq % 11 = 0 THEN regexp_replace(name, '\\.[^.]*$', '') WHEN seq % 13 = 0 THEN name || '.x' ELSE name END AS name, seq FROM p) GROUP BY 1)
    SELECT DISTINCT CASE WHEN a.seq < b.seq THEN b.name ELSE a.name END AS name FROM c a JOIN c b ON starts_with(b.name, a.name || '.')""")
def leaf_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("seq") % 11 == 0, names.parent(F.col("name"))).when(F.col("seq") % 13 == 0, F.concat("name", F.lit(".x"))).otherwise(F.col("name"))
    return index.leaf_conflicts(points(spark, sf_dir).select(changed.alias("name"), "seq"))


@query(f"WITH {POINTS} SELECT name, CAST(100 + row_number() OVER (ORDER BY name) AS BIGINT) AS id FROM (SELECT DISTINCT name FROM p)")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.assign_ids(points(spark, sf_dir), 100)


@query(f"WITH {NODES} SELECT name, id FROM n WHERE is_leaf AND id BETWEEN 20 AND 60")
def scan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.scan_ids(nodes(spark, sf_dir), 20, 60).select("name", "id")


@query(f"WITH {NODES} SELECT name, is_leaf FROM n WHERE regexp_full_match(name, 'app\\.[^.]*c[^.]*\\.u1[^.]*')")
def find_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.find(nodes(spark, sf_dir), "app.*c*.u1*").select("name", "is_leaf")


@query(f"WITH {NODES} SELECT name, is_leaf FROM n WHERE regexp_full_match(name, 'app\\.(click|v[^.]*)\\.u[12]3')")
def find_braces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.find(nodes(spark, sf_dir), "app.{click,v*}.u[12]3").select("name", "is_leaf")


@query(f"WITH {NODES} SELECT name AS path, is_leaf, CASE WHEN is_leaf THEN CAST({NOW - 730 * 86400} AS BIGINT) ELSE 0 END AS start, CASE WHEN is_leaf THEN CAST({NOW} AS BIGINT) ELSE 0 END AS \"end\" FROM n WHERE regexp_full_match(name, 'app\\.[^.]*')")
def find_inner_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.find(nodes(spark, sf_dir), "app.*", NOW)


@query(f"WITH {NODES} SELECT name, is_leaf FROM n WHERE regexp_full_match(name, 'app\\.click\\.[^.]+')")
def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.children(nodes(spark, sf_dir), "app.click").select("name", "is_leaf")


@query(f"WITH {NODES} SELECT name, is_leaf FROM n WHERE name <> 'app.click' AND NOT starts_with(name, 'app.click.')")
def delete_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.delete_subtree(nodes(spark, sf_dir), "app.click", recursive=True)[0].select("name", "is_leaf")


@query(f"""WITH {NODES}, x AS (SELECT name, is_leaf, string_split(name, '.') AS s FROM n), k AS (SELECT name FROM x WHERE s[3] IN ('u1', 'u12')),
    g AS (SELECT name, is_leaf FROM x WHERE len(s) >= 2 AND name NOT IN (SELECT name FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE starts_with(k.name, x.name || '.')))
    SELECT CAST(count(*) AS BIGINT) AS total_count, CAST(count(*) FILTER (is_leaf) AS BIGINT) AS leaf_count FROM g""")
def delete_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.delete_names(nodes(spark, sf_dir), "app.*", exclude=["u1", "u12"])[1]


@query(f"WITH {NODES} SELECT name, is_leaf FROM n WHERE NOT regexp_matches(name, '\\.click\\.u7$')")
def delete_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.delete_names(nodes(spark, sf_dir), "**.click.u7")[0].select("name", "is_leaf")


@query(f"""WITH {DEEP} SELECT string_split(name, '.')[1] AS namespace, CAST(count(*) FILTER (ts > {NOW - 86400 - 900} AND ts <= {NOW - 86400}) AS BIGINT) AS points, max(ts) AS last_ts, max(ts) <= {NOW - 86400 - 7200} AS removable
    FROM d WHERE ts <= {NOW - 86400} GROUP BY 1 HAVING count(*) FILTER (ts > {NOW - 86400 - 900} AND ts <= {NOW - 86400}) / 900.0 < 0.1""")
def namespaces_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.inactive_namespaces(deep_points(spark, sf_dir), NOW - 86400)


# Series


@query(f"SELECT h AS hours, CASE WHEN h <= 24 THEN '60s24h' WHEN h <= 168 THEN '5m7d' WHEN h <= 17520 THEN '30m2y' END AS db FROM (VALUES (1), (24), (25), (168), (169), (17520), (17521)) AS v(h)")
def pick_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(h, (p := choose([P60, P5, P30], NOW - 3600 * h, NOW, NOW)) and p.db) for h in (1, 24, 25, 168, 169, 17520, 17521)]
    return spark.createDataFrame(rows, "hours int, db string")


_FROM, _UNTIL = NOW - 6 * 86400, NOW - 3 * 86400


def _archives(spark, sf_dir):
    p = points(spark, sf_dir)
    return {"60s24h": store.last_writes(p, 60), "5m7d": rollup.rollup(p, 300), "30m2y": rollup.cascade(p)["30m2y"]}


@query(f"""WITH {NODES}, s AS (SELECT name FROM n WHERE is_leaf AND regexp_full_match(name, 'app\\.click\\.u1[^.]*')),
    f AS (SELECT name, ts - ts % 300 AS ts, avg(val) AS val FROM p GROUP BY 1, 2), g AS (SELECT name, unnest(generate_series({_FROM}, {_UNTIL}, 300)) AS ts FROM s)
    SELECT g.name, g.ts, {fixed_sql('f.val')} AS val FROM g LEFT JOIN f ON g.name = f.name AND g.ts = f.ts""")
def render_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = index.find(nodes(spark, sf_dir), "app.click.u1*", leaf_only=True)
    own = _archives(spark, sf_dir)["5m7d"]
    return render.dense(series, own, _FROM, _UNTIL, 300).select("name", "ts", fixed(F.col("val")).alias("val"))


@query(f"""WITH {NODES}, s AS (SELECT name FROM n WHERE is_leaf AND regexp_full_match(name, 'app\\.v[^.]*\\.u2[^.]*')),
    f AS (SELECT name, ts - ts % 300 AS ts, avg(val) AS val FROM p GROUP BY 1, 2), g AS (SELECT name, unnest(generate_series({_FROM}, {_UNTIL}, 300)) AS ts FROM s),
    x AS (SELECT g.name, g.ts, f.val FROM g LEFT JOIN f ON g.name = f.name AND g.ts = f.ts)
    SELECT name, CAST({_FROM} AS BIGINT) AS "start", CAST({_UNTIL} AS BIGINT) AS "end", CAST(300 AS BIGINT) AS step, CAST(count(*) AS BIGINT) AS points, CAST(count(val) AS BIGINT) AS known, {fixed_sql('sum(val)')} AS total FROM x GROUP BY name""")
def render_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = render.Query("app.v*.u2*", _FROM, _UNTIL, NOW)
    out = render.render(nodes(spark, sf_dir), _archives(spark, sf_dir), q)
    known = F.filter("values", lambda v: v.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v))
    return out.select("name", "start", "end", "step", F.size("values").cast("long").alias("points"), F.size(known).cast("long").alias("known"), fixed(total).alias("total"))


@query(f"SELECT h AS hours, CAST(CASE WHEN h <= 24 THEN (h - 1) * 60 WHEN h <= 168 THEN (h - 1) * 12 ELSE (h - 1) * 2 END * 7 AS BIGINT) AS points FROM (VALUES (2), (24), (100), (1000)) AS v(h)")
def estimate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(h, render.estimate_points(render.Query("x", NOW - 3600 * h, NOW - 3600, NOW), [P60, P5, P30], 7)) for h in (2, 24, 100, 1000)]
    return spark.createDataFrame(rows, "hours int, points long")


@query(f"WITH {NODES} SELECT name, true AS no_step, CAST(0 AS BIGINT) AS points FROM n WHERE is_leaf AND starts_with(name, 'app.click.')")
def render_no_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = render.Query("app.click.*", NOW - 900 * 86400, NOW, NOW)
    return render.render(nodes(spark, sf_dir), {}, q, max_series=None).select("name", F.col("step").isNull().alias("no_step"), F.size("values").cast("long").alias("points"))


# Exports and clean-up


@query(f"WITH {NODES} SELECT id, name FROM n WHERE is_leaf AND id >= 50 AND regexp_full_match(name, 'app.*u.') ORDER BY id LIMIT 40")
def dumpnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.dump_names(nodes(spark, sf_dir), "app*u?", start_id=50, count=40)


@query(f"WITH {NODES}, a AS (SELECT name, ts - ts % 60 AS ts, arg_max(val, seq) AS val FROM p GROUP BY 1, 2) SELECT n.id, n.name, a.ts, a.val FROM n JOIN a ON n.name = a.name WHERE n.is_leaf AND a.ts BETWEEN {NOW - 5 * 86400} AND {NOW} AND n.name LIKE '%click%'")
def dumplines(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = store.last_writes(points(spark, sf_dir), 60)
    return admin.dump_lines(nodes(spark, sf_dir), archive, NOW - 5 * 86400, NOW, "*click*")


@query(f"""WITH {NODES}, a AS (SELECT name, ts - ts % 86400 AS ts, CAST(count(*) AS BIGINT) AS val FROM p GROUP BY 1, 2), f AS (SELECT name, min(ts) AS first FROM a GROUP BY 1),
    k AS (SELECT a.name, a.ts, a.val, f.first, (a.ts - f.first) // 86400 AS i, lag((a.ts - f.first) // 86400, 1, -1) OVER (PARTITION BY a.name ORDER BY a.ts) AS j FROM a JOIN f ON a.name = f.name)
    SELECT n.id, k.name || '|' || first || '|86400|' || string_agg(CASE WHEN i = j + 1 THEN CAST(val AS VARCHAR) ELSE i || ':' || val END, ',' ORDER BY ts) AS line FROM k JOIN n ON n.name = k.name AND n.is_leaf GROUP BY n.id, k.name, first""")
def dumpseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = interval(F.col("ts"), 86400).alias("ts")
    daily = points(spark, sf_dir).groupBy("name", day).agg(F.count(F.lit(1)).cast("double").alias("val"))
    return admin.dump_series(nodes(spark, sf_dir), daily, Policy("1d:2y", 86400, 730 * 86400), 0, NOW)[0].select("id", "line")


@query(f"WITH {POINTS} SELECT name, ts - ts % 86400 AS ts, CAST(count(*) AS DOUBLE) AS val FROM p GROUP BY 1, 2")
def dumpseries_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = points(spark, sf_dir).groupBy("name", interval(F.col("ts"), 86400).alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("val"))
    return dumps.parse_series(dumps.series_lines(daily, 86400).withColumnRenamed("line", "value")).select("name", "ts", "val")


@query(f"WITH {NODES} SELECT name, id FROM n WHERE is_leaf AND name NOT IN (SELECT name FROM p WHERE ts >= {NOW - 4 * 86400})")
def cleanseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return admin.stale_series(nodes(spark, sf_dir), [p.filter("seq % 2 = 0"), p.filter("seq % 2 = 1")], NOW - 4 * 86400)


@query(f"WITH {NODES} SELECT name, ts, val FROM p WHERE name = (SELECT name FROM n WHERE is_leaf AND id = 7)")
def listpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.list_points(nodes(spark, sf_dir), points(spark, sf_dir), metric_id=7)


@query(f"WITH {NODES} SELECT name, id FROM n WHERE is_leaf AND NOT starts_with(name, 'app.click.') AND name NOT IN (SELECT name FROM p WHERE seq % 40 = 0)")
def orphan_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admin.orphans(nodes(spark, sf_dir), [points(spark, sf_dir).filter("seq % 40 = 0")], ["app.click."])


@query(f"WITH {POINTS} SELECT name || ' ' || CASE WHEN c % 100 = 0 THEN CAST(c // 100 AS VARCHAR) WHEN c % 10 = 0 THEN (c // 100) || '.' || (c // 10 % 10) ELSE (c // 100) || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') END || ' ' || ts AS value FROM (SELECT name, ts, CAST(round(val * 100) AS BIGINT) AS c FROM p)")
def point_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.point_lines(points(spark, sf_dir))


# Relay

_ROUTES = "click\\.=a:1,b:2,c:3|d:4\nu1[0-9]=e:5,f:6\n\\.view\\.=null:\nno destinations"
_HASH = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: (a * 31 + b) % 4294967296)"
_SIGNED = f"CASE WHEN {_HASH} >= 2147483648 THEN {_HASH} - 4294967296 ELSE {_HASH} END"


@query(f"WITH {POINTS}, m AS (SELECT DISTINCT name FROM p) SELECT name, CASE WHEN regexp_matches(name, 'click\\.') THEN 0 WHEN regexp_matches(name, 'u1[0-9]') THEN 1 WHEN regexp_matches(name, '\\.view\\.') THEN 2 ELSE -1 END AS route FROM m")
def route_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = points(spark, sf_dir).select("name").distinct()
    return distinct.withColumn("route", F.coalesce(relay.route_number(F.col("name"), relay.parse_routes(_ROUTES)), F.lit(-1)))


@query(f"""WITH {POINTS}, m AS (SELECT DISTINCT name FROM p), h AS (SELECT name, {_SIGNED} AS code FROM m), r AS (SELECT name, abs(code) AS code, CASE WHEN regexp_matches(name, 'click\\.') THEN 0 WHEN regexp_matches(name, 'u1[0-9]') THEN 1 WHEN regexp_matches(name, '\\.view\\.') THEN 2 END AS route FROM h),
    e AS (SELECT name, (['a:1', 'b:2', 'c:3'])[code % 3 + 1] AS destination FROM r WHERE route = 0 UNION ALL SELECT name, 'd:4' FROM r WHERE route = 0 UNION ALL SELECT name, (['e:5', 'f:6'])[code % 2 + 1] FROM r WHERE route = 1 UNION ALL SELECT name, 'null:' FROM r WHERE route = 2)
    SELECT e.destination, CAST(count(*) AS BIGINT) AS points FROM p JOIN e ON p.name = e.name GROUP BY 1""")
def replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relay.route(points(spark, sf_dir), relay.parse_routes(_ROUTES)).groupBy("destination").agg(F.count(F.lit(1)).alias("points"))


@query(f"WITH {POINTS}, m AS (SELECT DISTINCT name FROM p) SELECT name, {_SIGNED} AS code, CAST(abs({_SIGNED}) % 7 AS INTEGER) AS destination FROM m")
def hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = points(spark, sf_dir).select("name").distinct()
    return distinct.select("name", names.java_hash(F.col("name")).alias("code"), names.destination_of(F.col("name"), 7).alias("destination"))


# Replay


@query(f"WITH {DEEP} SELECT seq, name, ts, arrival * 1000 AS arrival_ms FROM d WHERE ts BETWEEN {_FROM} AND {_UNTIL}")
def gap_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.recovery import Gap, replay

    stream = deep_points(spark, sf_dir).withColumn("arrival_ms", F.col("arrival") * 1000)
    return replay(stream, Gap(_FROM * 1000 + 5, _UNTIL * 1000 + 59_999)).select("seq", "name", "ts", "arrival_ms")


# Reports


@query(f"WITH {DEEP} SELECT DISTINCT name FROM d")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.unique_names(relay.point_lines(deep_points(spark, sf_dir)))


def _distinct(spark, sf_dir):
    return deep_points(spark, sf_dir).select("name").distinct()


_PARTS = f"{DEEP}, m AS (SELECT name, string_split(name, '.') AS s FROM (SELECT DISTINCT name FROM d)), k AS (SELECT unnest(generate_series(1, 8)) AS k)"


@query(f"WITH {_PARTS} SELECT array_to_string(list_slice(s, 1, k), '.') AS prefix, CAST(k AS INTEGER) AS depth, CAST(count(DISTINCT s[k + 1]) AS BIGINT) AS children FROM m, k WHERE k < len(s) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 50")
def card_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.fan_out(_distinct(spark, sf_dir))


@query(f"""WITH {_PARTS}, c AS (SELECT k AS depth, array_to_string(list_slice(s, 1, k), '.') AS family, count(*) AS series FROM m, k WHERE k BETWEEN 3 AND 6 AND len(s) >= k GROUP BY 1, 2)
    SELECT CAST(depth AS INTEGER) AS depth, family, CAST(series AS BIGINT) AS series FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY series DESC, family) AS r FROM c) WHERE r <= 15""")
def card_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.families(_distinct(spark, sf_dir))


@query(f"WITH {_PARTS} SELECT CAST(k - 1 AS INTEGER) AS position, CAST(count(DISTINCT s[k]) AS BIGINT) AS distinct_values, count(DISTINCT s[k]) > 5 AS is_high FROM m, k WHERE k <= len(s) GROUP BY k")
def card_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.positions(_distinct(spark, sf_dir), high=5)


@query(f"""WITH {_PARTS}, h AS (SELECT k FROM m, k WHERE k <= len(s) GROUP BY k HAVING count(DISTINCT s[k]) > 5),
    c AS (SELECT h.k - 1 AS position, CASE WHEN h.k = 1 THEN '<root>' ELSE array_to_string(list_slice(s, 1, h.k - 1), '.') END AS parent, count(DISTINCT s[h.k]) AS children FROM m, h WHERE h.k <= len(s) GROUP BY 1, 2)
    SELECT CAST(position AS INTEGER) AS position, parent, CAST(children AS BIGINT) AS children FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY children DESC, parent) AS r FROM c) WHERE r <= 20""")
def card_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.drill_down(_distinct(spark, sf_dir), high=5)


_LAGS = f"{POINTS}, j AS (SELECT name, seq, {_JITTER} AS ts FROM p), g AS (SELECT *, greatest(coalesce(max(ts) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - ts, 0), 0) AS lag FROM j)"


def _jittered(spark, sf_dir):
    return points(spark, sf_dir).withColumn("ts", F.col("ts") - (F.col("seq") * 7919) % 3000)


@query(f"WITH {_LAGS} SELECT count(*) AS points, min(ts) AS min_ts, max(ts) AS max_ts, max(ts) - min(ts) AS span, CAST(count(*) FILTER (lag > 0) AS BIGINT) AS late_points, max(lag) AS max_lag FROM g")
def lag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.lag_report(_jittered(spark, sf_dir))


@query(f"WITH {_LAGS} SELECT seq, name, ts, lag FROM g WHERE lag > 0 ORDER BY lag DESC, seq LIMIT 20")
def worst_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.worst_lags(_jittered(spark, sf_dir))


@query("""WITH r AS (SELECT CASE WHEN event_id % 10 = 0 THEN 500 ELSE 200 END AS status, CAST((event_id * 7919) % 4001 AS DOUBLE) AS ms, user_id % 4 AS u FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY status) AS n FROM r)
    SELECT status, count(*) AS requests, sum(ms) AS total_ms, sum(ms) / count(*) AS mean_ms, max(ms) AS max_ms, max(CASE WHEN i = floor(n * 95 / 100.0) THEN ms END) AS p95, max(CASE WHEN i = floor(n * 99 / 100.0) THEN ms END) AS p99 FROM k GROUP BY status""")
def log_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.lit('10.0.0.1 - - [x] "GET /dashboard/db/d'), (F.col("user_id") % 4).cast("string"), F.lit('?a=1 HTTP/1.1" '), F.when(F.col("event_id") % 10 == 0, "500").otherwise("200"), F.lit(' 512 "-" "agent" '), ((F.col("event_id") * 7919) % 4001).cast("string"))
    return offline.request_stats(offline.parse_requests(e.select(line.alias("value"))))


@query(f"""WITH {DEEP}, g AS (SELECT string_split(name, '.')[1] AS namespace, count(*) AS points, max(arrival - ts) AS max_lag, list_sort(list(arrival - ts)) AS lags FROM d GROUP BY 1)
    SELECT namespace, points, max_lag, lags[CAST(floor(points * 50 / 100) AS BIGINT) + 1] AS p50, lags[CAST(floor(points * 95 / 100) AS BIGINT) + 1] AS p95, lags[CAST(floor(points * 99 / 100) AS BIGINT) + 1] AS p99 FROM g""")
def ingest_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline.ingest_latency(deep_points(spark, sf_dir), exact=True).select("namespace", "points", "max_lag", "p50", "p95", "p99")


@query(f"""WITH {POINTS}, a AS (SELECT name, ts - ts % 3600 AS ts, arg_max(val, seq) AS val FROM p WHERE seq % 3 <> 0 GROUP BY 1, 2), b AS (SELECT name, ts - ts % 3600 AS ts, arg_max(val, seq) AS val FROM p WHERE seq % 3 <> 1 GROUP BY 1, 2)
    SELECT coalesce(a.name, b.name) AS name, coalesce(a.ts, b.ts) AS ts, coalesce(b.val, a.val) AS val FROM a FULL JOIN b ON a.name = b.name AND a.ts = b.ts""")
def archive_file_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return offline.merge_archives(store.last_writes(p.filter("seq % 3 <> 0"), 3600), store.last_writes(p.filter("seq % 3 <> 1"), 3600))


@query(f"""WITH {POINTS}, a AS (SELECT name, ts - ts % 3600 AS ts, arg_max(val, seq) AS val FROM p WHERE seq % 3 <> 0 GROUP BY 1, 2), b AS (SELECT name, ts - ts % 3600 AS ts, arg_max(val, seq) AS val FROM p WHERE seq % 3 <> 1 GROUP BY 1, 2)
    SELECT coalesce(a.name, b.name) AS name, coalesce(a.ts, b.ts) AS ts, a.val AS a, b.val AS b FROM a FULL JOIN b ON a.name = b.name AND a.ts = b.ts WHERE a.val IS DISTINCT FROM b.val""")
def archive_file_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return offline.differences(store.last_writes(p.filter("seq % 3 <> 0"), 3600), store.last_writes(p.filter("seq % 3 <> 1"), 3600))


_SALES = "'sales.' || l_returnflag || '.' || l_linestatus || '.s' || l_suppkey || '.revenue'"


@query(f"SELECT {_SALES} AS name, CAST(floor(epoch(l_shipdate)) AS BIGINT) - CAST(floor(epoch(l_shipdate)) AS BIGINT) % 604800 AS ts, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem GROUP BY 1, 2")
def sales_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume: a weekly sum roll-up over lineitem."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.concat(F.lit("sales."), "l_returnflag", F.lit("."), "l_linestatus", F.lit(".s"), F.col("l_suppkey").cast("string"), F.lit(".revenue"))
    own = li.select(name.alias("name"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("val"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts"), F.col("l_orderkey").alias("seq"))
    return rollup.rollup(own, 604800, [("sum", "*")]).select("name", "ts", F.col("val").cast("long").alias("cents"))


def entry(spark: SparkSession) -> DataFrame:
    """Parse, filter, store, roll up, search, choose the archive, fill gaps."""
    sf_dir = "/root/testdata/sf0.001"
    text = relay.point_lines(points(spark, sf_dir)).withColumn("seq", F.monotonically_increasing_id())
    good = lines.points_of(lines.parse_lines(text)).filter(filters.passes(now=NOW))
    archives = {"60s24h": store.last_writes(good, 60), "5m7d": rollup.rollup(good, 300), "30m2y": rollup.cascade(good)["30m2y"]}
    return render.render(nodes(spark, sf_dir), archives, render.Query("app.*.u1*", _FROM, _UNTIL, NOW))


