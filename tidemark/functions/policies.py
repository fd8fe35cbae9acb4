"""Archives: a precision, a retention, and the arithmetic on intervals. Plain Python for constants, Columns for data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "y": 365 * 86400}
DEFAULT = "60s:24h,5m:7d,30m:2y"


def seconds(text: str) -> int:
    return int(text[:-1]) * _UNITS[text[-1]]


@dataclass(frozen=True)
class Policy:
    name: str
    precision: int
    retention: int

    @staticmethod
    def parse(text: str) -> Policy:
        precision, retention = text.strip().split(":")
        return Policy(text.strip(), seconds(precision), seconds(retention))

    @property
    def db(self) -> str:
        return self.name.replace(":", "")

    def interval(self, ts: int) -> int:
        return ts - ts % self.precision

    def includes(self, ts: int, now: int) -> bool:
        """False for what has expired; the future is included."""
        return self.interval(now - self.retention) <= self.interval(ts)

    def max_points(self, start: int, until: int, now: int) -> int:
        until, start = min(until, now), max(now - self.retention, start)
        return max(0, (until - start) // self.precision) if start <= until else 0


def parse_policies(text: str = DEFAULT) -> list[Policy]:
    return sorted((Policy.parse(x) for x in text.split(",")), key=lambda p: p.precision)


def choose(policies: list[Policy], start: int, until: int, now: int) -> Policy | None:
    """The finest archive that covers both ends."""
    return next((p for p in policies if p.includes(start, now) and p.includes(until, now)), None)


def coarser(policies: list[Policy], policy: Policy) -> Policy | None:
    return next((p for p in policies if p.precision > policy.precision), None)


def interval(ts: Column, precision: int) -> Column:
    return ts - F.pmod(ts, F.lit(precision))


def includes(ts: Column, policy: Policy, now: int) -> Column:
    return interval(ts, policy.precision) >= policy.interval(now - policy.retention)
