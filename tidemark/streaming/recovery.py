"""Gaps: stretches of a stream that were missed, and their replay in order of arrival."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.shared import read_text, write_text

SLOT_MS = 60_000


@dataclass(frozen=True, order=True)
class Gap:
    start_ms: int
    end_ms: int
    recovered_ms: int | None = None


class GapTable:
    """Gaps in a file of any shared file system, ordered by start; replaced as a whole, so a reader sees the old table or the new one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def gaps(self) -> list[Gap]:
        return sorted(Gap(**g) for g in json.loads(read_text(self.spark, self.path) or "[]"))

    def save(self, gaps: list[Gap]) -> None:
        write_text(self.spark, self.path, json.dumps([asdict(g) for g in sorted(gaps)]))

    def add(self, gap: Gap) -> None:
        self.save([*self.gaps(), gap])

    def remove(self, gap: Gap) -> None:
        self.save([g for g in self.gaps() if (g.start_ms, g.end_ms) != (gap.start_ms, gap.end_ms)])

    def progress(self, gap: Gap, recovered_ms: int) -> None:
        self.save([replace(g, recovered_ms=recovered_ms) if (g.start_ms, g.end_ms) == (gap.start_ms, gap.end_ms) else g for g in self.gaps()])


class Checkpoint:
    """The minute up to which a stream has been processed, in a file of any shared file system; by default five minutes ago."""

    def __init__(self, spark: SparkSession, path: str, default_age_s: int = 300) -> None:
        self.spark, self.path, self.default_age_s = spark, path, default_age_s

    def write(self, ts_ms: int) -> None:
        write_text(self.spark, self.path, str(ts_ms - ts_ms % SLOT_MS))

    def read(self, now_ms: int) -> int:
        held = (read_text(self.spark, self.path) or "").strip()
        return int(held) if held.isdigit() else now_ms - 1000 * self.default_age_s


def register_gap(table: GapTable, checkpoint_ms: int, now_ms: int) -> Gap:
    """The stretch from the last gap's end, or the checkpoint, to two minutes from now."""
    known = table.gaps()
    gap = Gap(max(checkpoint_ms, known[-1].end_ms) if known else checkpoint_ms, now_ms + 120_000)
    table.add(gap)
    return gap


def replay(points: DataFrame, gap: Gap) -> DataFrame:
    """Points (name, val, ts, arrival_ms, seq) of a gap, in order of arrival; its ends are aligned to slots and included.

    Records after the first one whose earliest point lies behind the gap aren't read: see ``record`` if the frame has it.
    """
    start, end = (gap.start_ms - gap.start_ms % SLOT_MS) // 1000, (gap.end_ms - gap.end_ms % SLOT_MS) // 1000
    own = points.filter(F.col("ts").between(start, end))
    if "record" in points.columns:
        behind = points.groupBy("record").agg(F.min("arrival_ms").alias("arrival_ms"), F.min("ts").alias("first")).filter(F.col("first") > end)
        stop = behind.agg(F.min("arrival_ms")).first()[0]
        if stop is not None:
            own = own.filter(F.col("arrival_ms") < stop)
    return own.orderBy("arrival_ms", "seq")


def recover(table: GapTable, points: DataFrame, process: Callable[[DataFrame, Gap], int]) -> int:
    """Replay all gaps, one after another, from where each had come to. ``process`` returns the latest slot it has closed, in ms."""
    done = 0
    for gap in table.gaps():
        left = replace(gap, start_ms=gap.recovered_ms + SLOT_MS) if gap.recovered_ms is not None else gap
        if left.start_ms <= left.end_ms:
            table.progress(gap, process(replay(points, left), gap))
        table.remove(gap)
        done += 1
    return done
