"""Removal of passages that occur more than once in a corpus, by Rabin-Karp hashes of all windows of ``size`` words.

Pass 1 hashes every window of every text. Map tasks work on blocks of some megabytes; within a block each distinct hash
is sent once, and further places of it are noted as repeated there and then, so a passage that fills a third of the corpus
costs one hash for each block. Hashes travel as binary rows, one for each block and hash range, with the gaps between
their places. A task owns some ranges, takes them one after another from rows sorted by range, counts their hashes, and returns to each block the places whose hash they met
in other blocks or that the block had repeated. There, overlapping windows merge into maximal intervals of words, kept by
document as (doc_id, hash of the text, intervals). Pass 2 joins these with the texts and removes the words.

Hashes have 64 bits. Owners know the leading ones from their range and get the other 56: with n windows and r ranges, the chance that
any two different windows are taken for one is below n * n / (r * 2 ** 57), and r grows with n.

Blocks are named by their content, hash ranges grow in number with the corpus, and both passes may run again in other
orders. The input must give the same rows each time it is read: give a table, not a computed frame.

Defined results: a null text has no words; texts of fewer than ``size`` words stay whole; repeated rows repeat all their
windows, so each loses every word that a window covers; a null doc_id stays null; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .words import Corpus, parts
from .work import Work, lean, shuffle_partitions, slices

SIZE = 35
#: Bytes of text for each hash range: some 1.2 million windows, 11 MB at their owner.
RANGE_BYTES = 8 << 20
#: Bytes sent of a hash: the low ones; its leading bits are those of the range.
SENT_BYTES = 7

_SENT = pa.schema([("owner", pa.int32()), ("block", pa.binary()), ("body", pa.binary()), ("gaps", pa.binary()), ("known", pa.binary()), ("header", pa.binary())])
SENT_SCHEMA = "owner int, block binary, body binary, gaps binary, known binary, header binary"
_PLACES = pa.schema([("block", pa.binary()), ("places", pa.binary()), ("header", pa.binary())])
PLACES_SCHEMA = "block binary, places binary, header binary"


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)


def _column(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _hash_windows(size: int, ranges: int):
    shift = np.uint64(64 - (ranges - 1).bit_length()) if ranges > 1 else None

    def block_rows(ids: list[int | None], texts: list[bytes]) -> list[tuple]:
        corpus = Corpus(texts)
        hashes, at = corpus.windows(size)
        if not len(hashes):
            return []
        order = np.argsort(hashes, kind="stable")  # sorted by range, too
        sorted_ = hashes[order]
        head = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
        again = at[order[~head]]
        multiple = np.diff(np.append(np.flatnonzero(head), len(order))) > 1
        value, place = sorted_[head], at[order[head]]
        owner = (value >> shift).astype(np.int64) if shift is not None else np.zeros(len(value), np.int64)
        within = np.lexsort((place, owner))
        value, place, multiple, owner = value[within], place[within], multiple[within], owner[within]
        edges = np.searchsorted(owner, np.arange(ranges + 1))
        keys = [text_key(t) for t in texts]
        block = hashlib.blake2b(np.array(keys, "<i8").tobytes() + repr(ids).encode(), digest_size=16).digest()
        table = np.array([[0 if i is None else i, i is None, k] for i, k in zip(ids, keys, strict=True)], "<i8")
        header = np.concatenate([[len(ids)], table.ravel(), corpus.first]).astype("<i8").tobytes()
        gaps = np.diff(place, prepend=0)
        first = edges[:-1][edges[:-1] < edges[1:]]
        gaps[first] = place[first]
        rows = [(int.from_bytes(block[:4], "big") % ranges, block, None, None, np.sort(again).astype("<i4").tobytes(), header)]
        for k in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[k], edges[k + 1])
            wide = gaps[s].astype("<u4" if gaps[s].max() > 0xFFFF else "<u2" if gaps[s].max() > 0xFF else "u1")
            rows.append((k, block, value[s].astype("<u8").view("u1").reshape(-1, 8)[:, :SENT_BYTES].tobytes(), wide.tobytes(), np.packbits(multiple[s]).tobytes(), None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, texts = part.column(0).to_pylist(), _column(part.column(1))
            for s, e in parts(texts):
                if rows := block_rows(ids[s:e], texts[s:e]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of the hashes that stand more than once, from rows sorted by range. Memory: the rows of one range."""
    held: list[tuple] = []
    at = None
    for b in batches:
        own = b.column("header").is_null()
        passing = b.filter(pc.invert(own))
        if passing.num_rows:
            yield pa.RecordBatch.from_arrays([passing.column("block"), passing.column("known"), passing.column("header")], schema=_PLACES)
        rest = b.filter(own)
        for owner, *row in zip(*(rest.column(c).to_pylist() for c in ("owner", "block", "body", "gaps", "known")), strict=True):
            if owner != at:
                yield from _count_range(held)
                at, held = owner, []
            held.append(row)
    yield from _count_range(held)


def _count_range(held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    bodies, gaps, known = [], [], []
    for _, body, gap, k in held:
        n = len(body) // SENT_BYTES
        whole = np.zeros((n, 8), np.uint8)
        whole[:, :SENT_BYTES] = np.frombuffer(body, np.uint8).reshape(n, SENT_BYTES)
        bodies.append(whole.view("<u8").ravel())
        gaps.append(np.cumsum(np.frombuffer(gap, f"<u{len(gap) // n}").astype(np.int64)).astype("<i4"))
        known.append(np.unpackbits(np.frombuffer(k, np.uint8), count=n).astype(bool))
    hashes, multiple = np.concatenate(bodies), np.concatenate(known)
    bodies.clear()
    order = np.argsort(hashes, kind="stable")
    sorted_ = hashes[order]
    same = sorted_[1:] == sorted_[:-1]
    multiple[order[1:][same]] = True
    multiple[order[:-1][same]] = True
    at, rows = 0, []
    for (name, *_), place in zip(held, gaps, strict=True):
        if (here := multiple[at : at + len(place)]).any():
            rows.append((name, place[here].tobytes(), None))
        at += len(place)
    for i in range(0, len(rows), 500):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 500], strict=True), _PLACES, strict=True)], schema=_PLACES)


def covered_runs(places: np.ndarray, size: int, first: int) -> np.ndarray:
    """Maximal intervals [start, end) of words, counted from ``first``, that windows at the sorted ``places`` cover."""
    breaks = np.flatnonzero(np.diff(places) > size)
    return np.stack([places[np.append(0, breaks + 1)], places[np.append(breaks, len(places) - 1)] + size], 1) - first


def _merge(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, places, header = None, [], None

        def close() -> list[tuple]:
            if header is None or not any(map(len, places)):
                return []
            head = np.frombuffer(header, "<i8")
            n = int(head[0])
            table, first = head[1 : 1 + 3 * n].reshape(n, 3), head[1 + 3 * n :]
            all_places = np.sort(np.frombuffer(b"".join(places), "<i4").astype(np.int64))
            edges = np.searchsorted(all_places, first)
            out = []
            for i in np.flatnonzero(np.diff(edges)).tolist():
                runs = covered_runs(all_places[edges[i] : edges[i + 1]], size, int(first[i]))
                doc, null, key = table[i].tolist()
                out.append((None if null else doc, key, runs.astype("<i4").tobytes()))
            return out

        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("runs", pa.binary())])
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for b in batches:
            for name, own, head in zip(*(b.column(c).to_pylist() for c in ("block", "places", "header")), strict=True):
                if name != at:
                    if rows := close():
                        yield make(rows)
                    at, places, header = name, [], None
                places.append(own)
                header = head or header
        if rows := close():
            yield make(rows)

    return run


def repeated_runs(docs: DataFrame, size: int = SIZE, work: Work | None = None) -> DataFrame:
    """doc_id, text_key, runs: for each document with repeated windows, the maximal intervals of words that they cover.

    ``runs`` are little-endian 32-bit pairs of start and end, in words. Documents equal in doc_id and text share a row.
    """
    spark = docs.sparkSession
    work = work or Work(spark, "substring")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, max(-(-total // RANGE_BYTES), shuffle_partitions(spark)) - 1).bit_length()
    tasks = min(ranges, 2 * shuffle_partitions(spark))
    sent = docs.select("doc_id", "text").mapInArrow(lean(_hash_windows(size, ranges)), SENT_SCHEMA)
    dealt = sent.repartitionById(tasks, F.floor(F.col("owner") * tasks / ranges).cast("int")).sortWithinPartitions("owner")
    places = dealt.mapInArrow(lean(_count), PLACES_SCHEMA)
    merged = places.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block").mapInArrow(lean(_merge(size)), "doc_id long, text_key long, runs binary")
    return work.save(merged.dropDuplicates(["doc_id", "text_key"]), "runs")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by their key, packed, since all of them are shuffled once."""
    codec = pa.Codec("zstd", 1)
    for b in slices(batches):
        texts = _column(b.column(1))
        packed = [codec.compress(t, asbytes=True) for t in texts]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary()), pa.array([len(t) for t in texts], pa.int64()), pa.array([text_key(t) for t in texts], pa.int64())], ["doc_id", "packed", "size", "text_key"])


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for part in slices(batches):
            kept, n_words, n_removed = [], [], []
            for packed, size, runs in zip(*(part.column(c).to_pylist() for c in ("packed", "size", "runs")), strict=True):
                words = codec.decompress(packed, size, asbytes=True).split()
                n_words.append(len(words))
                if runs is not None:
                    left, last = [], 0
                    for s, e in np.frombuffer(runs, "<i4").reshape(-1, 2).tolist():
                        left += words[last:s]
                        last = e
                    words = left + words[last:]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, with_text: bool = True, work: Work | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (the words left, joined by one space)."""
    runs = repeated_runs(docs, size, work).withColumnsRenamed({"doc_id": "run_id", "text_key": "run_key"})
    keyed = docs.select("doc_id", "text").mapInArrow(lean(_keys), "doc_id long, packed binary, size long, text_key long")
    # A merge join at every size: the runs grow with the corpus.
    joined = keyed.join(runs.hint("merge"), F.col("doc_id").eqNullSafe(F.col("run_id")) & (F.col("text_key") == F.col("run_key")), "left").select("doc_id", "packed", "size", "runs")
    return joined.mapInArrow(lean(_remove(with_text)), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
