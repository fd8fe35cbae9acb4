"""Roll-up over time, from each archive to the next coarser one, by each metric's method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import config
from ..functions.policies import Policy, interval, parse_policies

METHODS = ("avg", "sum", "min", "max", "last")


def parse_methods(text: str) -> list[tuple[str, str]]:
    """(method, pattern) of lines ``method = pattern``, in order."""
    out = []
    for line in config.lines(text):
        method, _, pattern = line.partition("=")
        if method.strip().lower() not in METHODS:
            raise ValueError(f"unknown method: {line}")
        out.append((method.strip().lower(), pattern.strip()))
    return out


def method_of(name: Column, methods: Sequence[tuple[str, str]]) -> Column:
    """The method of the first pattern that is found in the name; avg if none is."""
    out = F.lit("avg")
    for method, pattern in reversed(methods):
        out = F.lit(method) if pattern == "*" else F.when(name.rlike(pattern), method).otherwise(out)
    return out


def rollup(points: DataFrame, precision: int, methods: Sequence[tuple[str, str]] = (), keys: Sequence[str] = ("name",), last_is_min: bool = False) -> DataFrame:
    """One row for each key and interval: (keys, ts, val, seq). Needs val, ts, seq; the result's seq is the latest of its points'.

    ``last_is_min`` gives what older stores return for the method last.
    """
    used = {m for m, _ in methods} | {"avg"}
    method = method_of(F.col("name"), methods) if methods else F.lit("avg")
    # An average weighs each of its interval's points alike. The method depends on the name alone, so it adds no groups.
    aggregates = {"avg": F.avg("val"), "sum": F.sum("val"), "min": F.min("val"), "max": F.max("val"), "last": F.min("val") if last_is_min else F.max_by("val", "seq")}
    groups = points.groupBy(*keys, *({"name"} - set(keys)), interval(F.col("ts"), precision).alias("ts"))
    rows = groups.agg(*[aggregates[m].alias(f"__{m}") for m in METHODS if m in used], F.max("seq").alias("seq")).withColumn("__method", method)
    value = F.col("__avg")
    for m in sorted(used - {"avg"}):
        value = F.when(F.col("__method") == m, F.col(f"__{m}")).otherwise(value)
    return rows.select(*keys, "ts", value.alias("val"), "seq")


def cascade(points: DataFrame, policies: Sequence[Policy] | None = None, methods: Sequence[tuple[str, str]] = (), **options) -> dict[str, DataFrame]:
    """A frame for each archive after the first, each rolled up from the one before it."""
    policies = list(policies or parse_policies())
    out, source = {}, points
    for p in policies[1:]:
        source = out[p.db] = rollup(source, p.precision, methods, **options)
    return out


def rolled_again(points: DataFrame, late: DataFrame, precision: int, methods: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The intervals that late points touch, rolled up from all their points; ``points`` holds the late ones, too."""
    touched = late.select("name", interval(F.col("ts"), precision).alias("__interval")).distinct()
    own = points.withColumn("__interval", interval(F.col("ts"), precision)).join(touched, ["name", "__interval"], "left_semi").drop("__interval")
    return rollup(own, precision, methods)


def eligible(files: DataFrame, now: int, idle: dict[str, int] | None = None) -> DataFrame:
    """Staged files (db, last_write) that have been idle long enough to be rolled up."""
    idle = {"5m7d": 90, "30m2y": 300} if idle is None else idle
    wait = F.lit(1200)
    for db, s in idle.items():
        wait = F.when(F.col("db") == db, s).otherwise(wait)
    return files.filter(F.col("last_write") + wait <= now)


def bucket(metric_id: Column, n: int = 10) -> Column:
    return F.pmod(metric_id, F.lit(n)).cast("int")


def propagate(points: DataFrame, fine: int, coarse: int, x_files_factor: float = 0.5, method: str = "avg") -> DataFrame:
    """Roll-up that needs a share of its points: (name, ts, val) where known / expected is at least ``x_files_factor``."""
    aggregates = {"avg": F.avg("val"), "sum": F.sum("val"), "min": F.min("val"), "max": F.max("val"), "last": F.max_by("val", "ts")}
    rows = points.dropDuplicates(["name", "ts"]).groupBy("name", interval(F.col("ts"), coarse).alias("ts")).agg(aggregates[method].alias("val"), F.count("val").alias("known"))
    return rows.filter(F.col("known") / F.lit(coarse // fine) >= x_files_factor).select("name", "ts", "val")
