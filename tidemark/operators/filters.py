"""Filters that points pass on their way in. All take and return frames of (name, val, ts, seq) and keep further columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import config, names
from ..functions.policies import interval

MAX_LENGTH, MAX_AGE, MAX_FUTURE_AGE = 300, -1, -1


def passes(max_length: int = MAX_LENGTH, max_age: int = MAX_AGE, max_future_age: int = MAX_FUTURE_AGE, now: int | None = None) -> Column:
    """Valid name and time, length, age and future age; limits of 0 or less are off."""
    ok = names.is_valid(F.col("name")) & (F.col("ts") > 0)
    if max_length > 0:
        ok = ok & (F.length("name") <= max_length)
    if max_age > 0:
        ok = ok & (F.col("ts") + max_age >= now)
    if max_future_age > 0:
        ok = ok & (F.col("ts") <= now + max_future_age)
    return ok


def reason(max_length: int = MAX_LENGTH, max_age: int = MAX_AGE, max_future_age: int = MAX_FUTURE_AGE, now: int | None = None) -> Column:
    """Why a point is dropped, by the first filter that drops it; null if it passes."""
    out = F.when(~names.is_valid(F.col("name")) | (F.col("ts") <= 0), "invalid")
    if max_length > 0:
        out = out.when(F.length("name") > max_length, "length")
    if max_age > 0:
        out = out.when(F.col("ts") + max_age < now, "age")
    if max_future_age > 0:
        out = out.when(F.col("ts") > now + max_future_age, "future")
    return out


def drop_repeated(points: DataFrame, precision: int = 60) -> DataFrame:
    """Drop a point whose interval is that of the point with the same name just before it in order of arrival.

    Before the first point of a name stands interval 0, so times below ``precision`` are repeats.
    """
    own = interval(F.col("ts"), precision)
    before = F.lag(own, 1, 0).over(Window.partitionBy("name").orderBy("seq"))
    return points.withColumn("__before", before).filter(F.col("__before") != own).drop("__before")


def listed(points: DataFrame, allow: Sequence[str] = (), block: Sequence[str] = ()) -> DataFrame:
    """Keep names in which an allow pattern is found (if there are any) and no block pattern is. The lists are independent."""
    ok = F.lit(True) if not allow else config.any_match(F.col("name"), allow)
    return points.filter(ok & ~config.any_match(F.col("name"), block) if block else ok)


def drop_inner(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Drop points whose name is an inner node of the name tree (columns name, is_leaf)."""
    return points.join(nodes.filter("NOT is_leaf").select("name"), "name", "left_anti")


def query_blocked(pattern: str, block: Sequence[str]) -> bool:
    """Whether a query's own text is on a block list."""
    import re

    return any(p in (".*", "*") or re.search(p, pattern) for p in block)


def within_quota(events: DataFrame, limit: int, period: int) -> DataFrame:
    """The first ``limit`` events of each period of seconds, by ts and seq."""
    row = F.row_number().over(Window.partitionBy(interval(F.col("ts"), period)).orderBy("ts", "seq"))
    return events.withColumn("__row", row).filter(F.col("__row") <= limit).drop("__row")
