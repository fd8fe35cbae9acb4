"""Best-fit packing of documents into sequences of a fixed number of tokens, by hierarchical residual packing.

Each document is encoded and ends with an end id. Only a document longer than a sequence is cut, into whole sequences and, in
front of them, a first piece that may be shorter. Every task packs its pieces best-fit, the longest first, and emits bins that lack at most
``slack`` tokens. The underfull bins of ``fan_in`` tasks become the items of one task in the next round, each bin as one item of its
fill, until one task is left, or the next one would hold more than ``task_bins`` items.

Only (bin, fill) travels between rounds; texts, ids and pieces never do. A round's table says into which bin, and where in it, each of its items went;
at the end these tables are put together from the last to the first, and the pieces are joined with the outcome. Every round is a written table.

Where rounds end because of ``task_bins``, as many tasks as are left have packed up to that many items each; README has what that costs.

Defined results: a null or empty text is a document of the end id alone; a null doc_id stays null; repeated rows are
packed each on its own; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .tokens import encoder
from .work import Work, lean

LENGTH, END_ID, SLACK, FAN_IN, TASK_BINS = 1024, 2, 4, 8, 250_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED_SCHEMA = PIECE_SCHEMA + ", bin long, fill int, offset long, task int"
_PLACED = pa.schema([*_PIECE, ("bin", pa.int64()), ("fill", pa.int32()), ("offset", pa.int64()), ("task", pa.int32())])
ROUND_SCHEMA = "item long, bin long, fill int, offset long, task int"
_ROUND = pa.schema([("item", pa.int64()), ("bin", pa.int64()), ("fill", pa.int32()), ("offset", pa.int64()), ("task", pa.int32())])


def cut_lengths(total: int, length: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, and a shorter one in front if they don't divide it."""
    whole, rest = divmod(total, length)
    return ([rest] if rest else []) + [length] * whole


def _pieces(path: str, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(end_id).to_bytes(4, "little")
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows: list[tuple] = []
                for doc, ids in zip(part.column(0).to_pylist(), encoder(path).ids(part.column(1).to_pylist()), strict=True):
                    ids += end
                    start = 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, length)):
                        rows.append((doc, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                        start += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)

    return run


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin, its offset there, and the bins' fills. Sizes are 1 to ``capacity``."""
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    left: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin with r tokens left is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = some >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            at = room[r].pop()
            if not room[r]:
                some &= ~(1 << r)
        else:
            r, at = capacity, len(left)
            left.append(capacity)
        bins[i], offsets[i] = at, capacity - r
        left[at] = r - size
        if r > size:
            room[r - size].append(at)
            some |= 1 << (r - size)
    return bins, offsets, capacity - np.array(left, np.int64)


def _round(number: int, length: int, limit: int):
    """Packs a task's pieces (round 0: length, with the other columns of a piece) or bins (item, fill), ``limit`` at most at a time."""
    schema, size = (_ROUND, "fill") if number else (_PLACED, "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, first = TaskContext.get().partitionId(), 0

        def pack(table: pa.Table) -> tuple[pa.RecordBatch, int]:
            bins, offsets, full = best_fit(table.column(size).to_numpy(), length)
            made = {"bin": (number << 58) + (task << 34) + first + bins, "fill": full[bins], "offset": offsets, "task": np.full(len(bins), task)}
            columns = [pa.array(made[f.name], f.type) if f.name in made else table.column(f.name).combine_chunks() for f in schema]
            return pa.Table.from_arrays(columns, schema=schema).combine_chunks().to_batches()[0], len(full)

        held, rows = [], 0
        for b in batches:
            for at in range(0, b.num_rows, limit):
                part = b.slice(at, limit)
                if rows + part.num_rows > limit:
                    out, bins = pack(pa.Table.from_batches(held))
                    yield out
                    held, rows, first = [], 0, first + bins
                held.append(part)
                rows += part.num_rows
        if rows:
            yield pack(pa.Table.from_batches(held))[0]

    return run


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, slack: int = SLACK, fan_in: int = FAN_IN, task_bins: int = TASK_BINS, work: Work | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Reads columns doc_id and text."""
    work = work or Work(docs.sparkSession, "packing")
    pieces = work.save(docs.select("doc_id", "text").mapInArrow(lean(_pieces(tokenizer, length, end_id)), PIECE_SCHEMA), "pieces")
    placed = work.save(pieces.mapInArrow(lean(_round(0, length, task_bins)), PLACED_SCHEMA), "placed")
    done, rounds = F.col("fill") >= length - slack, []
    made = placed
    while True:
        underfull = made.filter("offset = 0").filter(~done)  # one row for each bin
        tasks, bins = underfull.agg(F.max("task") + 1, F.count(F.lit(1))).first()
        groups = max(-(-(tasks or 0) // fan_in), -(-bins // task_bins))
        if not bins or rounds and groups >= tasks:
            break
        group = (F.col("task") * groups / tasks).cast("int")
        items = underfull.select(F.col("bin").alias("item"), "fill", group.alias("group")).repartitionById(groups, F.col("group")).drop("group")
        made = work.save(items.mapInArrow(lean(_round(len(rounds) + 1, length, task_bins)), ROUND_SCHEMA), f"round{len(rounds) + 1}")
        rounds.append(made)
        if groups == 1:
            break
    if not rounds:
        return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    last = rounds[-1].select("item", F.col("bin").alias("sequence_id"), F.col("offset").alias("before"))
    for k in range(len(rounds) - 2, -1, -1):
        further = last.select(F.col("item").alias("bin"), "sequence_id", "before")
        last = rounds[k].join(further, "bin", "left").select("item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("before", F.lit(0))).alias("before"))
        last = work.save(last, f"resolved{k}")
    ready = placed.filter(done).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
    rest = placed.filter(~done).join(last.withColumnRenamed("item", "bin"), "bin")
    return ready.unionByName(rest.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.col("offset") + F.col("before")).alias("offset")))
