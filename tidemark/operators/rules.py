"""Aggregation across metrics: rewrite rules, 60-second slots, late points.

A rule reads ``output (60) [drop] [c] = method input``. In the input a segment with ``<<field>>`` matches any text, one with ``<field>`` text
without dots, and ``*`` any segment or part of one; what fields match fills the output. Rules are tried in order; each that matches
gives a result, and the first one without ``c`` ends the search.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import config, running
from ..functions.policies import interval

METHODS = ("sum", "avg", "custom1", "latency")
SLOT, LIVE_LATE, LIVE_CLOSE, RECOVERY_SLOTS = 60, 120, 125, 3
_RULE = re.compile(r"(\S+)\s+\((\d+)\)\s+((?:drop\s+|c\s+)*)=\s*(\S+)\s+(\S+)\s*$")
_FIELD = re.compile(r"<<([^<>]+)>>|<([^<>]+)>")


@dataclass(frozen=True)
class Rule:
    output: str
    method: str
    pattern: str
    fields: tuple[str, ...]
    drop: bool
    go_on: bool

    def replacement(self) -> str:
        """The output with group references instead of fields."""
        return _FIELD.sub(lambda m: f"${self.fields.index(m[1] or m[2]) + 1}", self.output.replace("$", r"\$"))

    def apply(self, name: str) -> str | None:
        """The output for a name, on the driver."""
        m = re.fullmatch(self.pattern, name)
        return m and _FIELD.sub(lambda f: m[self.fields.index(f[1] or f[2]) + 1], self.output)


def _segment(text: str, fields: list[str]) -> str:
    if m := _FIELD.search(text):
        fields.append(m[1] or m[2])
        return text[: m.start()] + ("(.+)" if m[1] else "([^.]+)") + text[m.end() :]
    return "[^.]+" if text == "*" else text.replace("*", "[^.]*")


def parse_rule(line: str) -> Rule:
    m = _RULE.match(line)
    if not m:
        raise ValueError(f"not a rule: {line}")
    output, frequency, flags, method, source = m.groups()
    method = method.lower()
    if int(frequency) != SLOT or method not in METHODS:
        raise ValueError(f"only ({SLOT}) and the methods {', '.join(METHODS)} are known: {line}")
    fields: list[str] = []
    pattern = r"\.".join(_segment(s, fields) for s in _split(source))
    if unknown := {a or b for a, b in _FIELD.findall(output)} - set(fields):
        raise ValueError(f"fields {sorted(unknown)} aren't in the input: {line}")
    return Rule(output, method, f"^{pattern}$", tuple(fields), "drop" in flags.split(), "c" in flags.split())


def _split(source: str) -> list[str]:
    """Segments; dots within brackets or after a backslash don't separate."""
    return re.findall(r"(?:\\.|\[[^\]]*\]|[^.\\\[]|\[)+", source)


def parse_rules(text: str) -> list[Rule]:
    return [parse_rule(x) for x in config.lines(text)]


def match_rules(distinct: DataFrame, rules: list[Rule]) -> DataFrame:
    """name, agg, method, dropped, rule (number) for every result of every name in column ``name``.

    Run it on distinct names and join the results back: names are few beside points.
    """
    if not rules:
        return distinct.select("name", F.lit(None).cast("string").alias("agg"), F.lit("").alias("method"), F.lit(False).alias("dropped"), F.lit(0).alias("rule")).limit(0)
    name = F.col("name")
    results = F.array(*[
        F.when(name.rlike(r.pattern), F.struct(F.regexp_replace(name, r.pattern, r.replacement()).alias("agg"), F.lit(r.method).alias("method"), F.lit(r.drop).alias("dropped"), F.lit(i).alias("rule"), F.lit(not r.go_on).alias("stop")))
        for i, r in enumerate(rules)
    ])
    found = distinct.select("name", F.filter(results, lambda x: x.isNotNull()).alias("found")).filter(F.size("found") > 0)
    last = F.array_position(F.transform("found", lambda x: x["stop"]), True).cast("int")
    kept = F.when(last > 0, F.slice("found", F.lit(1), last)).otherwise(F.col("found"))
    return found.select("name", F.explode(kept).alias("r")).select("name", "r.agg", "r.method", "r.dropped", "r.rule")


def live_late(ts: Column, arrival: Column) -> Column:
    """Late for aggregation: more than two minutes after the start of its slot."""
    return arrival > interval(ts, SLOT) + LIVE_LATE


def recovery_late(points: DataFrame, max_slots: int = RECOVERY_SLOTS) -> DataFrame:
    """Adds ``late``: the slot lies more than ``max_slots`` slots before the latest slot that had arrived.

    The running maximum is taken within ranges of ``seq`` and across them, so no task gets all points.
    """
    slot = interval(F.col("ts"), SLOT)
    with_block = points.withColumn("__slot", slot).withColumn("__block", F.floor(F.col("seq") / 4096))
    tops = with_block.groupBy("__block").agg(F.max("__slot").alias("__top"))
    tops = running.before(tops, "__block", "__top", "max").withColumnRenamed("earlier", "__earlier")
    own = F.max("__slot").over(Window.partitionBy("__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    joined = with_block.join(tops, "__block").withColumn("__own", own)
    reached = F.coalesce(F.greatest("__own", "__earlier"), F.lit(-(1 << 62)))
    return joined.withColumn("late", F.col("__slot") < reached - SLOT * max_slots).drop("__slot", "__block", "__own", "__earlier")


def is_average(agg: Column) -> Column:
    """Whether CUSTOM1 takes the mean: by the end of the aggregate's name."""
    return agg.rlike("(mean|p95|min|max)$")


def aggregate(points: DataFrame, results: DataFrame) -> DataFrame:
    """name, val, ts of the closed slots of all aggregates; ``points`` has name, val, ts and, for latencies, arrival.

    ``results`` is what ``match_rules`` gives for the points' names. One shuffle; sums are combined before it.
    """
    rows = points.select("name", "val", "ts", lag_of(points).alias("lag")).join(F.broadcast(results) if _small(results) else results, "name")
    return slot_values(rows.groupBy("agg", "method", interval(F.col("ts"), SLOT).alias("ts")).agg(*slot_sums()))


def lag_of(points: DataFrame) -> Column:
    """Seconds from a point's time to its arrival; null where ``points`` has no arrival."""
    return (F.col("arrival") - F.col("ts")).cast("long") if "arrival" in points.columns else F.lit(None).cast("long")


def slot_sums() -> list[Column]:
    """What a slot keeps of its points' val and lag."""
    return [F.sum("val").alias("sum"), F.count("val").alias("count"), F.min("lag").alias("min"), F.max("lag").alias("max"), F.avg("lag").alias("mean")]


def slot_values(slots: DataFrame) -> DataFrame:
    """name, val, ts from agg, method, ts and ``slot_sums``: a latency gives four series, every other method one."""
    mean = F.when(F.col("count") > 0, F.col("sum") / F.col("count")).otherwise(0.0)
    value = F.when(F.col("method") == "sum", F.col("sum")).when(F.col("method") == "avg", mean).otherwise(F.when(is_average(F.col("agg")), mean).otherwise(F.col("sum")))
    four = F.array(*[F.struct(F.concat_ws(".", "agg", F.lit(k)).alias("name"), F.col(k).cast("double").alias("val")) for k in ("min", "max", "mean", "count")])
    one = F.array(F.struct(F.col("agg").alias("name"), value.cast("double").alias("val")))
    return slots.select(F.explode(F.when(F.col("method") == "latency", four).otherwise(one)).alias("s"), "ts").select("s.name", "s.val", "ts")


#: Rows up to which rule results are broadcast.
BROADCAST_ROWS = 200_000


def _small(results: DataFrame) -> bool:
    return results.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def forwarded(points: DataFrame, results: DataFrame) -> DataFrame:
    """Points that go on to storage: those that no drop rule matched, and late ones, which no rule saw (column ``late``)."""
    dropped = results.filter("dropped").select("name").distinct().withColumn("__dropped", F.lit(True))
    late = F.col("late") if "late" in points.columns else F.lit(False)
    return points.join(dropped, "name", "left").filter(F.col("__dropped").isNull() | late).drop("__dropped")


def late_report(points: DataFrame, now_column: str = "arrival") -> DataFrame:
    """Late points by age in minutes behind the end of their slot's time; ``reason`` is slot_closed while the slot could still be open."""
    age = F.col(now_column) - interval(F.col("ts"), SLOT)
    late = points.filter(live_late(F.col("ts"), F.col(now_column)))
    why = F.when(age <= LIVE_CLOSE, "slot_closed").otherwise("slot_expired")
    return late.groupBy(why.alias("reason"), F.floor(age / 60).cast("long").alias("age_minutes")).agg(F.count(F.lit(1)).alias("points"))
