"""A datagram source for Structured Streaming, a load generator, and streams that follow a list of names."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..functions import config


class UdpLines(DataSource):
    """``spark.readStream.format("udp_lines").option("port", n)``: one row (value) for each line of a datagram.

    Datagrams can't be asked for again: a batch that fails is lost, as with any receiver of this kind.
    """

    @classmethod
    def name(cls) -> str:
        return "udp_lines"

    def schema(self) -> str:
        return "value string"

    def simpleStreamReader(self, schema) -> _UdpReader:
        return _UdpReader(int(self.options["port"]), self.options.get("host", "127.0.0.1"), int(self.options.get("maxlines", 100_000)), float(self.options.get("wait", 0.2)))


class _UdpReader(SimpleDataSourceStreamReader):
    def __init__(self, port: int, host: str, most: int, wait: float) -> None:
        self.port, self.host, self.most, self.wait = port, host, most, wait
        self.socket = None

    def initialOffset(self) -> dict:
        return {"lines": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.socket is None:
            self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
            self.socket.bind((self.host, self.port))
            self.socket.settimeout(self.wait)
        rows: list[tuple] = []
        until = time.monotonic() + self.wait
        while len(rows) < self.most and time.monotonic() < until:
            try:
                rows += [(x,) for x in self.socket.recv(65535).decode("utf-8", "replace").splitlines() if x.strip()]
            except TimeoutError:
                break
        return iter(rows), {"lines": start["lines"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(())


def generated_points(spark: SparkSession, metrics: int, minutes: int, start: int, plants: int = 3, lines: int = 5) -> DataFrame:
    """Synthetic points: each metric once a minute, with values that depend on the metric and the minute."""
    n = F.col("id")
    metric, minute = F.pmod(n, F.lit(metrics)), F.floor(n / metrics)
    name = F.format_string("plant%d.line%d.cell%d.m%d.total", F.pmod(metric, F.lit(plants)), F.pmod(metric, F.lit(lines)), F.pmod(metric, F.lit(7)), metric)
    value = (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 100).cast("double")
    return spark.range(metrics * minutes).select(name.alias("name"), value.alias("val"), (start + 60 * minute).cast("long").alias("ts"), F.col("id").alias("seq"))


class Streams:
    """Running queries that follow a list of names: those that are new are started, those that are gone are stopped."""

    def __init__(self, start: Callable[[str], StreamingQuery]) -> None:
        self.start, self.running = start, {}

    def follow(self, text: str) -> tuple[set[str], set[str]]:
        added, removed = config.changes(self.running, config.lines(text))
        for name in removed:
            self.running.pop(name).stop()
        for name in added:
            self.running[name] = self.start(name)
        return added, removed
