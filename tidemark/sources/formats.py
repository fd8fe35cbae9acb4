"""Answers as text and bytes: JSON as columns; pickles and MessagePack encoded by tasks, whose pieces the driver passes on one by one."""

from __future__ import annotations

import gzip
import pickle
import struct
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions import names
from ..operators.offline import nth_percentile

_WITH_NULLS = {"ignoreNullFields": "false"}


def series_json(series: DataFrame) -> DataFrame:
    return series.select(F.to_json(F.struct("name", "start", "end", "step", "values"), _WITH_NULLS).alias("value"))


def metrics_json(found: DataFrame) -> DataFrame:
    return found.select(F.to_json(F.struct("path", "is_leaf"), _WITH_NULLS).alias("value"))


def _pieces(rows: DataFrame, encode: Callable[[dict], bytes]) -> Iterator[bytes]:
    """Encoded rows, an Arrow batch in each piece; the driver holds one partition's pieces at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(map(encode, b.to_pylist()))], pa.binary())], ["piece"])

    for r in rows.mapInArrow(run, "piece binary").toLocalIterator():
        yield bytes(r["piece"])


def _pickled(record: Callable[[dict], dict]) -> Callable[[dict], bytes]:
    """A row's part of a pickled list (protocol 2): the record without header and stop, then "append"."""
    return lambda row: pickle.dumps(record(row), protocol=2)[2:-1] + b"a"


def pickle_stream(rows: DataFrame, record: Callable[[dict], dict]) -> Iterator[bytes]:
    """A pickled list of records in pieces."""
    yield b"\x80\x02]"
    yield from _pieces(rows, _pickled(record))
    yield b"."


def _series_record(r: dict) -> dict:
    return {"name": r["name"], "start": r["start"], "end": r["end"], "step": r["step"], "values": r["values"]}


def _metric_record(r: dict) -> dict:
    return {"metric_path": r["path"], "isLeaf": r["is_leaf"], "intervals": [(r["start"], r["end"])]}


def series_pickle_stream(series: DataFrame) -> Iterator[bytes]:
    return pickle_stream(series, _series_record)


def series_pickle(series: DataFrame) -> bytes:
    return b"".join(series_pickle_stream(series))


def metrics_pickle(found: DataFrame) -> bytes:
    return b"".join(pickle_stream(found, _metric_record))


def msgpack(value) -> bytes:
    """MessagePack of None, booleans, integers, floats, texts, lists and dictionaries."""
    if value is None or value is False or value is True:
        return b"\xc0" if value is None else b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if 0 <= value < 128:
            return bytes([value])
        if -32 <= value < 0:
            return struct.pack("b", value)
        return b"\xd3" + struct.pack(">q", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        data = value.encode()
        n = len(data)
        head = bytes([0xA0 | n]) if n < 32 else b"\xd9" + bytes([n]) if n < 256 else b"\xda" + struct.pack(">H", n) if n < 65536 else b"\xdb" + struct.pack(">I", n)
        return head + data
    if isinstance(value, dict):
        n = len(value)
        head = bytes([0x80 | n]) if n < 16 else b"\xdf" + struct.pack(">I", n)
        return head + b"".join(msgpack(k) + msgpack(v) for k, v in value.items())
    return _list_head(len(value)) + b"".join(map(msgpack, value))


def _list_head(n: int) -> bytes:
    return bytes([0x90 | n]) if n < 16 else b"\xdd" + struct.pack(">I", n)


def msgpack_stream(rows: DataFrame, record: Callable[[dict], dict]) -> Iterator[bytes]:
    """A list of records in pieces; its length comes first, so the rows are counted before they are encoded."""
    yield _list_head(rows.count())
    yield from _pieces(rows, lambda row: msgpack(record(row)))


def series_msgpack_stream(series: DataFrame) -> Iterator[bytes]:
    return msgpack_stream(series, lambda r: {"start": r["start"], "end": r["end"], "step": r["step"], "name": r["name"], "pathExpression": r["name"], "values": r["values"]})


def series_msgpack(series: DataFrame) -> bytes:
    return b"".join(series_msgpack_stream(series))


def metrics_msgpack(found: DataFrame) -> bytes:
    return b"".join(msgpack_stream(found, lambda r: {"path": r["path"], "isLeaf": r["is_leaf"]}))


def event_envelope(events: Iterable[str], headers: dict[str, str] | None = None) -> bytes:
    """A batch of JSON events: headers and payload of each behind their lengths, all of it gzipped."""
    out = b""
    for e in events:
        head = "".join(f"{k}:{v}\n" for k, v in (headers or {"version": "1.0"}).items()).encode()
        body = e.encode()
        out += struct.pack(">II", len(head), len(body)) + head + body
    return gzip.compress(out, mtime=0)


def open_envelope(data: bytes) -> list[tuple[dict[str, str], str]]:
    data, at, out = gzip.decompress(data), 0, []
    while at < len(data):
        h, b = struct.unpack_from(">II", data, at)
        head = data[at + 8 : at + 8 + h].decode()
        out.append((dict(x.split(":", 1) for x in head.splitlines()), data[at + 8 + h : at + 8 + h + b].decode()))
        at += 8 + h + b
    return out


def own_metrics(progress: dict, prefix: str, ts: int) -> list[tuple[str, str, int]]:
    """(name, text of the value, seconds) for the numbers in a streaming query's progress report."""
    out = []

    def walk(path: str, value) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{path}.{k}", v)
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            out.append((path.replace(" ", "-"), f"{value:2.2f}" if isinstance(value, float) else str(value), ts))

    walk(prefix, progress)
    return out


def sample_statistics(samples: DataFrame, minute: int | None = None) -> DataFrame:
    """(name, value, ts) of samples (name, val, ts): count, max, mean, min, stddev, p95 under names that end in these words, and m1_rate.

    ``ts`` is the latest of a name's samples. Values are text with two decimals, counts whole numbers; white space in names becomes a dash.
    ``m1_rate`` is samples a second in the 60 seconds before ``minute``, by default before the latest sample of all.
    """
    named = samples.select(names.sanitize(F.col("name")).alias("name"), "val", "ts")
    minute = named.agg(F.max("ts")).first()[0] if minute is None else minute
    fits = F.count_if(F.col("ts") > F.lit(minute) - 60) / 60.0
    spread = F.coalesce(F.stddev("val"), F.lit(0.0))
    sums = named.groupBy("name").agg(F.count("val").alias("count"), F.max("val").alias("max"), F.avg("val").alias("mean"), F.min("val").alias("min"), spread.alias("stddev"), fits.alias("m1_rate"), F.max("ts").alias("ts"))
    own = sums.join(nth_percentile(F.col("val"), (95,), named.filter("val is not null"), ["name"]), "name", "left")
    text = lambda c: F.col(c).cast("string") if c == "count" else F.format_string("%.2f", F.col(c).cast("double"))
    each = F.explode(F.array(*[F.struct(F.concat_ws(".", "name", F.lit(c)).alias("name"), F.when(F.col(c).isNotNull(), text(c)).alias("value")) for c in ("count", "max", "mean", "min", "stddev", "p95", "m1_rate")]))
    return own.select(each.alias("s"), "ts").select("s.name", "s.value", "ts").filter("value is not null")


def index_lines(nodes: DataFrame) -> DataFrame:
    """Every record of the name tree as a line of text."""
    return nodes.select(F.concat_ws(" ", "name", F.when(F.col("is_leaf"), F.concat_ws(" ", F.lit("leaf"), F.col("id").cast("string"), F.array_join("retentions", ","))).otherwise("inner")).alias("value"))
