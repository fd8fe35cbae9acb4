"""Reports over audit files and request logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import names, running
from ..functions.policies import Policy, parse_policies


def unique_names(lines: DataFrame) -> DataFrame:
    """Distinct first words of audit lines that have a second one."""
    return lines.filter(F.instr("value", " ") > 1).select(F.substring_index("value", " ", 1).alias("name")).distinct()


def fan_out(distinct: DataFrame, top: int = 50) -> DataFrame:
    """prefix, depth, children: the prefixes with the most different next segments."""
    at = F.explode(F.sequence(F.lit(1), F.col("__n") - 1)).alias("depth")
    parts = distinct.select("name", names.depth(F.col("name")).alias("__n")).filter("__n > 1").select("name", at)
    pairs = parts.select(names.prefix(F.col("name"), F.col("depth")).alias("prefix"), "depth", F.split("name", r"\.")[F.col("depth")].alias("child"))
    return pairs.groupBy("prefix", "depth").agg(F.count_distinct("child").alias("children")).orderBy(F.desc("children"), "prefix").limit(top)


def families(distinct: DataFrame, depths: Sequence[int] = (3, 4, 5, 6), top: int = 15) -> DataFrame:
    """depth, family, series: for each depth the first segments with the most names."""
    at = F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")
    rows = distinct.select("name", at).filter(names.depth(F.col("name")) >= F.col("depth"))
    counts = rows.groupBy("depth", names.prefix(F.col("name"), F.col("depth")).alias("family")).agg(F.count(F.lit(1)).alias("series"))
    place = F.row_number().over(Window.partitionBy("depth").orderBy(F.desc("series"), "family"))
    return counts.withColumn("place", place).filter(F.col("place") <= top).drop("place")


def positions(distinct: DataFrame, high: int = 500) -> DataFrame:
    """position, distinct_values, is_high: how many different segments stand at each position."""
    rows = distinct.select(F.posexplode(names.parts(F.col("name"))).alias("position", "segment"))
    counts = rows.groupBy("position").agg(F.count_distinct("segment").alias("distinct_values"))
    return counts.withColumn("is_high", F.col("distinct_values") > high)


def drill_down(distinct: DataFrame, high: int = 500, top: int = 20) -> DataFrame:
    """position, parent, children: for positions with many values, the parents that contribute the most."""
    flagged = positions(distinct, high).filter("is_high").select("position")
    rows = distinct.select("name", F.posexplode(names.parts(F.col("name"))).alias("position", "segment")).join(F.broadcast(flagged), "position")
    parent = F.when(F.col("position") == 0, F.lit("<root>")).otherwise(names.prefix(F.col("name"), F.col("position")))
    counts = rows.groupBy("position", parent.alias("parent")).agg(F.count_distinct("segment").alias("children"))
    place = F.row_number().over(Window.partitionBy("position").orderBy(F.desc("children"), "parent"))
    return counts.withColumn("place", place).filter(F.col("place") <= top).drop("place")


def with_lag(points: DataFrame, block: int = 4096) -> DataFrame:
    """Adds ``lag``: how far a point is behind the latest time that arrived before it (order of ``seq``); 0 if it isn't.

    The running maximum is taken within blocks of ``seq`` and then over the blocks' maxima.
    """
    own = points.withColumn("__block", F.floor(F.col("seq") / block))
    tops = own.groupBy("__block").agg(F.max("ts").alias("__top"))
    tops = running.before(tops, "__block", "__top", "max").withColumnRenamed("earlier", "__earlier")
    inner = F.max("ts").over(Window.partitionBy("__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    reached = F.greatest(F.col("__inner"), F.col("__earlier"))
    rows = own.join(tops, "__block").withColumn("__inner", inner)
    return rows.withColumn("lag", F.greatest(F.coalesce(reached - F.col("ts"), F.lit(0)), F.lit(0)).cast("long")).drop("__block", "__inner", "__earlier")


def lag_report(points: DataFrame) -> DataFrame:
    """One row: points, min_ts, max_ts, span, late_points, max_lag."""
    return with_lag(points).agg(F.count(F.lit(1)).alias("points"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), (F.max("ts") - F.min("ts")).alias("span"), F.count_if(F.col("lag") > 0).alias("late_points"), F.max("lag").alias("max_lag"))


def worst_lags(points: DataFrame, top: int = 20) -> DataFrame:
    return with_lag(points).filter("lag > 0").select("seq", "name", "ts", "lag").orderBy(F.desc("lag"), "seq").limit(top)


#: Request, status and bytes of a log line.
_REQUEST = r'"[A-Z]+ (\S+)[^"]*" (\d{3}) (\d+|-)'
#: Shapes of request logs: where the time stands and its milliseconds, and where the length of the request stands.
LOG_SHAPES = {
    "jetty": (r" (\d+)\s*$", 1.0, None),
    "nginx": (r"(?:Rtime: (?=\S+ )| (?=\S+\s*$))(\d+\.\d+)", 1000.0, r"Len: (\d+)"),
    "mellon": (None, 1.0, None),
}


def parse_requests(lines: DataFrame, shape: str = "jetty") -> DataFrame:
    """url, status, ms, dashboard, bytes, length of request-log lines (column value); lines of another shape are left out.

    ``ms`` and ``length`` are null where the shape has none.
    """
    when, scale, size = LOG_SHAPES[shape]
    cut = lambda pattern, k: F.nullif(F.regexp_extract("value", pattern, k), F.lit(""))
    rows = lines.filter(F.col("value").rlike(f"{_REQUEST}.*{when}" if when else _REQUEST))
    ms = cut(f"{_REQUEST}.*?{when}", 4).cast("double") * scale if when else F.lit(None).cast("double")
    length = cut(size, 1).cast("long") if size else F.lit(None).cast("long")
    sent = F.coalesce(F.nullif(cut(_REQUEST, 3), F.lit("-")).cast("long"), F.lit(0).cast("long"))  # "-" is no bytes
    return rows.select(cut(_REQUEST, 1).alias("url"), cut(_REQUEST, 2).cast("int").alias("status"), ms.alias("ms"), cut(r"/dashboard/(?:db/)?([^/?\s\"]+)", 1).alias("dashboard"), sent.alias("bytes"), length.alias("length"))


def dashboard_counts(requests: DataFrame) -> DataFrame:
    """dashboard, requests: how often each dashboard was asked for."""
    return requests.filter("dashboard is not null").groupBy("dashboard").agg(F.count(F.lit(1)).alias("requests"))


def nth_percentile(value: Column, percents: Sequence[int], rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each key the elements number int(n * p / 100), from 0, of its sorted values."""
    counts = rows.groupBy(*keys, value.alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    # Different values in ranges, so that no key comes together in one task: sums of ranges first, then within the range.
    ranged = counts.withColumn("__r", F.floor(F.log2(F.abs(F.col("__v").cast("double")) + 1) * F.when(F.col("__v") < 0, -64).otherwise(64)).cast("long"))
    ranges = ranged.groupBy(*keys, "__r").agg(F.sum("__c").alias("__rc"))
    by_range = Window.partitionBy(*keys).orderBy("__r")
    ranges = ranges.withColumn("__before", F.sum("__rc").over(by_range) - F.col("__rc")).withColumn("__n", F.sum("__rc").over(Window.partitionBy(*keys))).drop("__rc")
    upto = F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys, "__r").orderBy("__v"))
    placed = ranged.join(ranges, [*keys, "__r"]).withColumn("__upto", upto)
    at = lambda p: F.floor(F.col("__n") * p / 100)
    return placed.groupBy(*keys).agg(*[F.max(F.when((at(p) < F.col("__upto")) & (at(p) >= F.col("__upto") - F.col("__c")), F.col("__v"))).alias(f"p{p}") for p in percents])


def request_stats(requests: DataFrame, keys: Sequence[str] = ("status",), of: str = "ms") -> DataFrame:
    """requests, total, mean and maximum of column ``of`` (total_ms, mean_ms, max_ms, say), p95, p99 by keys; percentiles are elements of the sorted list."""
    count = F.count(F.lit(1))
    sums = requests.groupBy(*keys).agg(count.alias("requests"), F.sum(of).alias(f"total_{of}"), (F.sum(of) / count).alias(f"mean_{of}"), F.max(of).alias(f"max_{of}"))
    return sums.join(nth_percentile(F.col(of), (95, 99), requests.filter(F.col(of).isNotNull()), keys), list(keys), "left")


def error_counts(lines: DataFrame) -> DataFrame:
    """kind, url, errors: connection resets, and timeouts by URL without host and query."""
    kind = F.when(F.col("value").rlike("(?i)connection reset"), "reset").when(F.col("value").rlike("(?i)time[d]?\\s?-?out"), "timeout")
    url = F.regexp_replace(F.regexp_extract("value", r"(?:GET|POST|request:?)\s+\"?(?:https?://[^/\s]+)?(/[^\s?\"]*)", 1), r"^/api/datasources/proxy/\d+", "")
    return lines.withColumn("kind", kind).filter("kind is not null").groupBy("kind", F.when(F.col("kind") == "timeout", url).otherwise("").alias("url")).agg(F.count(F.lit(1)).alias("errors"))


def last_minute_sum(lines: DataFrame, now: int, pattern: str = r"(\d+(?:\.\d+)?)\s*$") -> DataFrame:
    """(name, val, ts): the sum of the numbers that log lines (ts, value, name) of the last minute hold."""
    own = lines.filter((F.col("ts") > now - 60) & (F.col("ts") <= now) & F.col("value").rlike(pattern))
    return own.groupBy("name").agg(F.sum(F.regexp_extract("value", pattern, 1).cast("double")).alias("val")).withColumn("ts", F.lit(now - now % 60).cast("long"))


def process_stats(processes: DataFrame) -> DataFrame:
    """count, cpu and memory of host processes (name, cpu, memory) by name."""
    return processes.groupBy("name").agg(F.count(F.lit(1)).alias("processes"), F.sum("cpu").alias("cpu"), F.sum("memory").alias("memory"))


def merge_archives(target: DataFrame, source: DataFrame) -> DataFrame:
    """Points of two archives of one metric; where both have one, the source's."""
    own = target.select("name", "ts", F.col("val").alias("__old"))
    return own.join(source.select("name", "ts", "val"), ["name", "ts"], "full").select("name", "ts", F.coalesce("val", "__old").alias("val"))


def differences(a: DataFrame, b: DataFrame, ignore_missing: bool = False) -> DataFrame:
    """name, ts, a, b where the values differ, or one is missing."""
    rows = a.select("name", "ts", F.col("val").alias("a")).join(b.select("name", "ts", F.col("val").alias("b")), ["name", "ts"], "inner" if ignore_missing else "full")
    return rows.filter(~F.col("a").eqNullSafe(F.col("b")))


def bulk_place(points: DataFrame, now: int, policies: Sequence[Policy] | None = None) -> DataFrame:
    """(db, name, ts, val): each point in the finest archive that reaches back to it; the last of equal intervals stays."""
    policies = list(policies or parse_policies())
    age = now - F.col("ts")
    db, precision = F.lit(None).cast("string"), F.lit(None).cast("long")
    for p in reversed(policies):
        db, precision = F.when(age <= p.retention, p.db).otherwise(db), F.when(age <= p.retention, p.precision).otherwise(precision)
    placed = points.withColumn("db", db).withColumn("__p", precision).filter("db is not null")
    return placed.groupBy("db", "name", (F.col("ts") - F.pmod("ts", "__p")).alias("ts")).agg(F.max_by("val", "seq").alias("val"))


def ingest_latency(points: DataFrame, percents: Sequence[float] = (0.5, 0.95, 0.99), exact: bool = False) -> DataFrame:
    """namespace, points, max_lag and percentiles of arrival - ts: approximate ones, or exact elements of the sorted lags."""
    lag = F.col("arrival") - F.col("ts")
    if exact:
        lags = points.select(names.namespace(F.col("name")).alias("namespace"), lag.alias("lag"))
        sums = lags.groupBy("namespace").agg(F.count(F.lit(1)).alias("points"), F.max("lag").alias("max_lag"))
        return sums.join(nth_percentile(F.col("lag"), [round(100 * p) for p in percents], lags, ["namespace"]), "namespace")
    rows = [F.percentile_approx(lag, p, 10_000).alias(f"p{round(100 * p)}") for p in percents]
    return points.groupBy(names.namespace(F.col("name")).alias("namespace")).agg(F.count(F.lit(1)).alias("points"), F.max(lag).alias("max_lag"), *rows)
