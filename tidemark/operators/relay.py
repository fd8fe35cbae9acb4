"""Routing of points to groups of destinations, and dealing within a group."""

from __future__ import annotations

import socket
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import config, names, running
from ..sources import binary


@dataclass(frozen=True)
class Route:
    pattern: str
    groups: tuple[tuple[str, ...], ...]


def parse_routes(text: str) -> list[Route]:
    """Lines ``pattern=group|group``, a group being ``destination,destination``; the last ``=`` divides, lines without one are skipped."""
    out = []
    for line in config.lines(text):
        pattern, found, groups = line.rpartition("=")
        if found:
            out.append(Route(pattern.strip(), tuple(tuple(d.strip() for d in g.split(",") if d.strip()) for g in groups.split("|") if g.strip())))
    return out


def route_number(name: Column, routes: Sequence[Route]) -> Column:
    """The first route whose pattern is found in the name; null for none."""
    out = F.lit(None).cast("int")
    for i in range(len(routes) - 1, -1, -1):
        hit = F.lit(True) if routes[i].pattern in (".*", "*") else name.rlike(routes[i].pattern)
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def route(points: DataFrame, routes: Sequence[Route]) -> DataFrame:
    """Points with ``route`` and ``destination``: one row for each group of their route. Points without a route are dropped.

    The destination within a group is that of the name's hash.
    """
    code = names.java_hash(F.col("name"))
    choice = F.array().cast("array<string>")
    for i, r in enumerate(routes):
        ends = F.array(*[F.element_at(F.array(*[F.lit(d) for d in g]), (F.pmod(F.abs(code), F.lit(len(g))) + 1).cast("int")) for g in r.groups]) if r.groups else F.array().cast("array<string>")
        choice = F.when(F.col("route") == i, ends).otherwise(choice)
    routed = points.withColumn("route", route_number(F.col("name"), routes)).filter("route is not null")
    return routed.withColumn("destination", F.explode(choice))


def round_robin(points: DataFrame, n: int, block: int = 1 << 16) -> DataFrame:
    """Adds ``turn``: the place of each point, in order of arrival (``seq``, unique), modulo n. Meant for one destination's batch.

    Points are numbered within blocks of ``seq``; only the blocks' sizes are summed in order.
    """
    own = points.withColumn("__block", F.floor(F.col("seq") / block))
    sizes = own.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
    sizes = running.before(sizes, "__block", "__n", "sum").select("__block", F.coalesce("earlier", F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__block").orderBy("seq")) - 1
    return own.withColumn("__place", place).join(sizes, "__block").withColumn("turn", F.pmod(F.col("__before") + F.col("__place"), F.lit(n)).cast("int")).drop("__block", "__place", "__before")


def point_lines(points: DataFrame, compat: bool = False) -> DataFrame:
    """Text ``name value ts`` of each point."""
    value = names.compat_value(F.col("val")) if compat else names.plain_value(F.col("val"))
    return points.select(F.concat_ws(" ", "name", value, F.col("ts").cast("string")).alias("value"))


class Sinks:
    """Writers by kind of destination: ``null:``, ``file:path``, ``records:path``, ``kinesis:stream``, ``service:host:port``, ``host:port``.

    Each gets (DataFrame of points, rest of the destination). More kinds can be registered.
    """

    def __init__(self, compat: bool = False, most: int = 500, clock: Callable[[], float] = time.time) -> None:
        self.compat, self.most, self.clock = compat, most, clock
        self.kinds: dict[str, Callable[[DataFrame, str], None]] = {"null": self._null, "file": self._file, "records": self._records, "service": self._service, "socket": self._socket}

    def register(self, kind: str, write: Callable[[DataFrame, str], None]) -> None:
        self.kinds[kind] = write

    def write(self, points: DataFrame, destination: str) -> None:
        kind, _, rest = destination.partition(":")
        if kind in self.kinds and kind != "socket":
            self.kinds[kind](points, rest)
        elif kind == "kinesis":
            raise ValueError("no writer is registered for kinesis")
        else:
            self._socket(points, destination)

    def write_all(self, routed: DataFrame) -> None:
        """Each destination's points to its writer; ``routed`` is read once for each destination, so cache it if it is costly."""
        for (destination,) in routed.select("destination").distinct().collect():
            self.write(routed.filter(F.col("destination") == destination), destination)

    def _null(self, points: DataFrame, rest: str) -> None:
        points.write.format("noop").mode("overwrite").save()

    def _file(self, points: DataFrame, rest: str) -> None:
        point_lines(points, self.compat).write.mode("overwrite").text(rest)

    def _records(self, points: DataFrame, rest: str) -> None:
        """Gzip records of up to ``most`` points, added to a folder that ``ingest.record_files`` reads as a stream."""
        rows = points if "seq" in points.columns else points.withColumn("seq", F.monotonically_increasing_id())
        batches = envelope_batches(rows, self.most, int(self.clock() * 1000))
        batches.select("partition_key", binary.zipped("lines").alias("content")).write.mode("append").parquet(rest)

    def _socket(self, points: DataFrame, rest: str) -> None:
        host, _, port = rest.rpartition(":")
        point_lines(points, self.compat).foreachPartition(_sender([(host, int(port))]))

    def _service(self, points: DataFrame, rest: str) -> None:
        """Pieces of each partition to the addresses of the service in turn; the name is looked up again for every batch."""
        host, _, port = rest.rpartition(":")
        ends = sorted({(a[4][0], int(port)) for a in socket.getaddrinfo(host, int(port), type=socket.SOCK_STREAM)})
        point_lines(points, self.compat).foreachPartition(_sender(ends))


#: Bytes of text sent at a time.
PIECE = 1 << 18


def _sender(ends: list[tuple[str, int]], tries: int = 3, most: int = PIECE) -> Callable:
    """Sends a partition in pieces of whole lines, each to the next address. A piece that fails goes to the one after it, so it may arrive twice."""

    def send(rows) -> None:
        from pyspark import TaskContext

        context, held = TaskContext.get(), {}
        turn = context.partitionId() if context else 0

        def deliver(data: bytes) -> None:
            nonlocal turn
            for k in range(tries):
                end, turn = ends[turn % len(ends)], turn + 1
                try:
                    if end not in held:
                        held[end] = socket.create_connection(end, timeout=10)
                    held[end].sendall(data)
                    return
                except OSError:
                    if end in held:
                        held.pop(end).close()
                    if k == tries - 1:
                        raise

        try:
            piece = bytearray()
            for r in rows:
                piece += r.value.encode() + b"\n"
                if len(piece) >= most:
                    deliver(bytes(piece))
                    piece.clear()
            if piece:
                deliver(bytes(piece))
        finally:
            for s in held.values():
                s.close()

    return send


def envelope_batches(points: DataFrame, most: int, arrival_ms: int) -> DataFrame:
    """Batches of up to ``most`` points as stream records: (partition_key, lines), the first line the arrival in milliseconds."""
    row = F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64("name"), F.lit(64))).orderBy("seq"))
    batched = points.withColumn("__p", F.pmod(F.xxhash64("name"), F.lit(64))).withColumn("__b", F.floor((row - 1) / most))
    text = F.concat_ws(" ", "name", names.plain_value(F.col("val")), F.col("ts").cast("string"))
    groups = batched.groupBy("__p", "__b").agg(F.array_sort(F.collect_list(F.struct("seq", text.alias("line")))).alias("rows"))
    joined = F.concat_ws("\n", F.lit(str(arrival_ms)), F.concat_ws("\n", F.transform("rows", lambda r: r["line"])))
    return groups.select(F.concat_ws("-", F.col("__p").cast("string"), F.col("__b").cast("string")).alias("partition_key"), joined.alias("lines"))
