"""Series queries: archive choice, dense series with nulls for gaps, and guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import globs, names
from ..functions.policies import Policy, choose, parse_policies
from . import filters, index

MAX_POINTS, HEAVY_POINTS = (1 << 31) - 1, 14_400_000
SHORT_LIVED = ("60s24h", "60s30d", "5m7d")


class TooManyPoints(Exception):
    pass


class Blocked(Exception):
    pass


@dataclass(frozen=True)
class Query:
    pattern: str
    start: int
    until: int
    now: int


def pick(query: Query, policies: Sequence[Policy]) -> tuple[Policy, int, int] | None:
    """(archive, first and last interval), or None if no archive covers the range."""
    p = choose(list(policies), query.start, query.until, query.now)
    return p and (p, p.interval(query.start), p.interval(query.until))


def dense(series: DataFrame, points: DataFrame, start: int, until: int, step: int) -> DataFrame:
    """(name, ts, val) at every step from start to until for each name of ``series``; val is null in gaps.

    The grid of all series and steps meets the points by name and time. ``arrays`` gives the same values in one row a series.
    """
    own = points.filter(F.col("ts").between(start, until)).select("name", "ts", "val")
    grid = series.select("name", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(until).cast("long"), F.lit(step).cast("long"))).alias("ts"))
    return grid.join(own, ["name", "ts"], "left")


def arrays(series: DataFrame, points: DataFrame, start: int, until: int, step: int) -> DataFrame:
    """(name, start, end, step, values): one row a series, values an array with nulls in gaps.

    Each series' points become a map, from which the array is filled; the grid itself is never shuffled.
    """
    own = points.filter(F.col("ts").between(start, until)).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("ts", "val"))).alias("found"))
    at = F.sequence(F.lit(start).cast("long"), F.lit(until).cast("long"), F.lit(step).cast("long"))
    held = F.coalesce("found", F.create_map().cast("map<bigint,double>"))
    joined = series.select("name").distinct().join(own, "name", "left")
    return joined.select("name", F.lit(start).cast("long").alias("start"), F.lit(until).cast("long").alias("end"), F.lit(step).cast("long").alias("step"), F.transform(at, lambda t: held[t]).alias("values"))


def without_archive(series: DataFrame, query: Query) -> DataFrame:
    """What a query gets that no archive covers: no values, and no step."""
    return series.select("name", F.lit(query.start).cast("long").alias("start"), F.lit(query.until).cast("long").alias("end"), F.lit(None).cast("long").alias("step"), F.array().cast("array<double>").alias("values"))


def estimate_points(query: Query, policies: Sequence[Policy], series: int) -> int:
    """Points that a query is expected to return: for each series those of its archive, or of the coarsest that reaches back."""
    p = choose(list(policies), query.start, query.until, query.now)
    return series * p.max_points(query.start, query.until, query.now) if p else 0


def is_heavy(query: Query, policies: Sequence[Policy], series: int, threshold: int = HEAVY_POINTS) -> bool:
    """Whether a query belongs in the pool for heavy ones; one without an archive does."""
    return choose(list(policies), query.start, query.until, query.now) is None or estimate_points(query, policies, series) > threshold


def render(nodes: DataFrame, archives: Mapping[str, DataFrame], query: Query, policies: Sequence[Policy] | None = None, max_series: int | None = index.MAX_SERIES,
           max_points: int = MAX_POINTS, blocked: Sequence[str] = (), active: DataFrame | None = None) -> DataFrame:
    """Series of all valid leaves that the pattern matches. ``active`` (namespace): series of other namespaces are all gaps.

    More than ``max_series`` of them are an error; None, for batch jobs, sets no limit. Heavy queries run in the scheduler pool ``heavy``, others in ``main``.
    """
    if filters.query_blocked(query.pattern, blocked):
        raise Blocked(query.pattern)
    policies = list(policies or parse_policies())
    series = index.find(nodes, query.pattern, leaf_only=True, max_series=max_series)
    chosen = pick(query, policies)
    if chosen is None:
        return without_archive(series, query)
    policy, start, until = chosen
    count = series.count() if max_points < MAX_POINTS or globs.is_pattern(query.pattern) else 1
    if estimate_points(query, policies, count) > max_points:
        raise TooManyPoints(f"{query.pattern} would return more than {max_points} points")
    nodes.sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", "heavy" if is_heavy(query, policies, count) else "main")
    # The series' own condition on names goes to the archive, too, so that its scan reads only what can match.
    points = archives[policy.db].filter(globs.glob_matches(F.col("name"), query.pattern))
    if active is not None and policy.db in SHORT_LIVED:
        points = points.withColumn("namespace", names.namespace(F.col("name"))).join(active, "namespace", "left_semi")
    return arrays(series, points, start, until, policy.precision)


def find(nodes: DataFrame, pattern: str, now: int, policies: Sequence[Policy] | None = None, blocked: Sequence[str] = (), max_series: int | None = index.MAX_SERIES) -> DataFrame:
    """Search rows: path, is_leaf and the time for which a leaf has data (0 and 0 for inner nodes). ``max_series`` as in ``render``."""
    if filters.query_blocked(pattern, blocked):
        raise Blocked(pattern)
    longest = max(p.retention for p in policies or parse_policies())
    when = lambda v: F.when(F.col("is_leaf"), F.lit(v)).otherwise(0).cast("long")
    return index.find(nodes, pattern, max_series=max_series).select(F.col("name").alias("path"), "is_leaf", when(now - longest).alias("start"), when(now).alias("end"))


def trial(nodes: DataFrame, archives: Mapping[str, DataFrame], count: int, now: int, policies: Sequence[Policy] | None = None, seed: int | None = None) -> DataFrame:
    """A day's series of ``count`` leaves picked at random, up to a minute ago: one row of start, until, series, points (gaps included), values and names."""
    until = now - 60
    query = Query("", until - 24 * 3600 + 120, until, until)
    # Drawn once, as both sides of the join need the same ``count`` names.
    picked = nodes.sparkSession.createDataFrame([(r.name,) for r in index.random_metrics(nodes, count, seed).collect()], "name string")
    chosen = pick(query, list(policies or parse_policies()))
    if chosen is None:
        got = without_archive(picked, query)
    else:
        policy, start, end = chosen
        got = arrays(picked, archives[policy.db].join(F.broadcast(picked), "name", "left_semi"), start, end, policy.precision)
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    sums = got.agg(F.count(F.lit(1)).alias("series"), total(F.size("values"), "points"), total(F.size(F.array_compact("values")), "values"), F.sort_array(F.collect_list("name")).alias("names"))
    return sums.select(F.lit(query.start).cast("long").alias("start"), F.lit(query.until).cast("long").alias("until"), "series", "points", "values", "names")


def query_stats(timings: DataFrame) -> DataFrame:
    """Totals and extremes of (query, series, wait_ms, read_ms, write_ms) rows; slow above 5 s, wide above 5000 series."""
    rows = [f(c).alias(f"{n}_{c}") for c in ("wait_ms", "read_ms", "write_ms") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("sum", F.sum))]
    out = timings.groupBy("query").agg(F.sum("series").alias("series"), *rows)
    return out.withColumn("logged", (F.col("sum_wait_ms") + F.col("sum_read_ms") + F.col("sum_write_ms") > 5000) | (F.col("series") > 5000))


def half_open(points: DataFrame, name: str, start: int, until: int, step: int, now: int, retention: int) -> DataFrame:
    """Dense values of one fixed-size archive file: the grid begins one step after the interval of ``start`` and leaves out its end."""
    start, until = max(start, now - retention), min(until, now)
    low, high = start - start % step + step, until - until % step + step
    high = max(high, low + step)
    series = points.sparkSession.createDataFrame([(name,)], "name string")
    return dense(series, points, low, high - step, step)
