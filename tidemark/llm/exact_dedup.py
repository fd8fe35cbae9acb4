"""Exact deduplication by an extendible-hash index kept in shared files.

Every text is normalised (A-Z lower-cased, nothing else) and hashed with SHA-256; the leading bits of the hash are its key.
A directory maps key prefixes to buckets: starting at a depth that gives every owner task some bucket, a bucket with more
than ``capacity`` distinct texts is split, doubling the directory whenever the bucket was already at global depth. The
directory is built from a histogram of at most ``2 ** max_bits`` counters, so the driver's share is bounded by a parameter.
Owner tasks each take a contiguous range of buckets, that is of keys. Rows reach them merged per map task (one row
for each distinct text a task saw), so a text that fills a third of the corpus costs its owner one row for each map task. The
owner sorts by key, chains texts whose keys collide, compares bytes, and writes its buckets to one shared file. The directory is written
beside the buckets, so that ``find_copies`` can look further texts up in the index of an earlier run.

Beyond ``capacity * 2 ** max_bits`` distinct texts buckets hold more than ``capacity``; results stay the same, as owners sort by key.

Defined results: a null text counts as empty; empty texts are equal to one another. Of equal texts the row with the
largest doc_id stays; a null doc_id is smaller than any other; of repeated rows with that doc_id one stays. Very long texts are
hashed and compared whole. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .work import Work, fresh, join_sized, lean, shuffle_partitions

#: Distinct texts in a bucket before it splits.
CAPACITY = 4096
#: Deepest directory: 2 ** MAX_BITS entries of 4 bytes on the driver and in each task.
MAX_BITS = 20
#: Bytes of distinct texts a map task merges before it passes them on.
MERGE_BYTES = 32 << 20
#: Groups above max(HOT_ROWS, rows / HOT_KEYS) rows are joined by broadcast: at most HOT_KEYS keys of some 60 bytes.
HOT_ROWS, HOT_KEYS = 200, 5000


def build_directory(histogram: dict[int, int], bits: int, capacity: int, start_depth: int = 0) -> np.ndarray:
    """Directory of an extendible hash: entry for each prefix of the global depth, holding its bucket's number.

    ``histogram`` counts distinct keys by their leading ``bits`` bits. Buckets are numbered in key order.
    """
    counts = np.zeros(1 << bits, np.int64)
    for prefix, n in histogram.items():
        counts[prefix] = n
    total = np.concatenate([[0], np.cumsum(counts)])
    depth = min(start_depth, bits)
    pending = [(depth, p) for p in range(1 << depth)]
    buckets: list[tuple[int, int]] = []
    while pending:
        local, prefix = pending.pop()
        width = bits - local
        held = total[(prefix + 1) << width] - total[prefix << width]
        if held > capacity and local < bits:
            depth = max(depth, local + 1)
            pending += [(local + 1, 2 * prefix), (local + 1, 2 * prefix + 1)]
        else:
            buckets.append((local, prefix))
    directory = np.zeros(1 << depth, np.int32)
    for number, (local, prefix) in enumerate(sorted(buckets, key=lambda b: b[1] << (bits - b[0]))):
        directory[prefix << (depth - local) : (prefix + 1) << (depth - local)] = number
    return directory


def _normalised(column: pa.Array) -> list[bytes]:
    lowered = pc.ascii_lower(pc.fill_null(column, ""))
    return lowered.cast(pa.large_binary() if pa.types.is_large_string(lowered.type) else pa.binary()).to_pylist()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sha(x).digest() for x in _normalised(b.column(1))], pa.binary())], ["doc_id", "sha"])


_ENTRY = pa.schema([("owner", pa.int32()), ("bucket", pa.int32()), ("key", pa.int64()), ("sha", pa.binary()), ("norm", pa.binary()), ("top_id", pa.int64()), ("n", pa.int64())])
ENTRY_SCHEMA = "owner int, bucket int, key long, sha binary, norm binary, top_id long, n long"
RECORD_SCHEMA = "bucket int, key long, chain int, sha binary, norm binary, keep_id long, group_size long"
_RECORD = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("chain", pa.int32()), ("sha", pa.binary()), ("norm", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _larger(a: int | None, b: int | None) -> int | None:
    return b if a is None or (b is not None and b > a) else a


def _entries(directory: np.ndarray, owners: int, key_bits: int):
    depth = len(directory).bit_length() - 1
    buckets = int(directory.max()) + 1

    def out(seen: dict[bytes, list]) -> pa.RecordBatch:
        shas = [hashlib.sha256(x).digest() for x in seen]
        keys = [int.from_bytes(s[:8], "big") >> (64 - key_bits) << (64 - key_bits) for s in shas]
        held = [int(directory[k >> (64 - depth)]) if depth else 0 for k in keys]
        top, n = zip(*seen.values(), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([h * owners // buckets for h in held], pa.int32()), pa.array(held, pa.int32()), pa.array([k - (1 << 63) for k in keys], pa.int64()), pa.array(shas, pa.binary()), pa.array(list(seen), pa.binary()), pa.array(top, pa.int64()), pa.array(n, pa.int64())], schema=_ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        size = 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), _normalised(b.column(1)), strict=True):
                if (e := seen.get(text)) is None:
                    seen[text] = [doc, 1]
                    size += len(text) + 100
                else:
                    e[0], e[1] = _larger(e[0], doc), e[1] + 1
                if size > MERGE_BYTES:
                    yield out(seen)
                    seen, size = {}, 0
        if seen:
            yield out(seen)

    return run


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of equal keys, from rows sorted by key. Memory: the texts of one key, and a batch."""
    done: list[tuple] = []
    size, at, chain = 0, None, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _RECORD, strict=True)], schema=_RECORD)

    for b in batches:
        for bucket, key, sha, norm, top, n in zip(*(b.column(c).to_pylist() for c in ("bucket", "key", "sha", "norm", "top_id", "n")), strict=True):
            if key != at:
                done += [(at_bucket, at, i, *e) for i, e in enumerate(chain)]
                size += sum(len(e[1]) for e in chain)
                at, at_bucket, chain = key, bucket, []
                if size > 16 << 20:
                    yield out()
                    done, size = [], 0
            for e in chain:
                if e[1] == norm:
                    e[2], e[3] = _larger(e[2], top), e[3] + n
                    break
            else:
                chain.append([sha, norm, top, n])
    done += [(at_bucket, at, i, *e) for i, e in enumerate(chain)] if chain else []
    if done:
        yield out()


def exact_groups(docs: DataFrame, capacity: int = CAPACITY, max_bits: int = MAX_BITS, key_bits: int = 64, work: Work | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Reads columns doc_id and text.

    The index stays in ``<work>/index`` (bucket, key, chain, sha, norm, keep_id, group_size), one file per owner task, sorted by
    key, its directory in ``<work>/directory`` (prefix, bucket, depth, key_bits). ``key_bits`` narrows the keys, so that tests can make them collide.
    """
    spark = docs.sparkSession
    work = work or Work(spark, "exact-dedup")
    docs = docs.select("doc_id", "text")
    hashed = docs.mapInArrow(lean(_digests), "doc_id long, sha binary")
    members = work.save(hashed.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("copies")), "members")
    owners = shuffle_partitions(spark)
    bits = min(max_bits, key_bits)
    head = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    histogram = members.select("sha").distinct().groupBy(F.shiftrightunsigned(head, 32 - bits).alias("prefix")).count()
    directory = build_directory({r[0]: r[1] for r in histogram.toLocalIterator()}, bits, capacity, min(bits, (owners - 1).bit_length()))
    entry = [pa.array(np.arange(len(directory), dtype=np.int32)), pa.array(directory), *(pa.array(np.full(len(directory), x, np.int32)) for x in (len(directory).bit_length() - 1, key_bits))]
    work.save(spark.createDataFrame(pa.Table.from_arrays(entry, ["prefix", "bucket", "depth", "key_bits"])).coalesce(1), "directory")
    entries = docs.mapInArrow(lean(_entries(directory, owners, key_bits)), ENTRY_SCHEMA)
    owned = entries.repartitionById(owners, F.col("owner")).sortWithinPartitions("key")
    index = work.save(owned.mapInArrow(lean(_own), RECORD_SCHEMA), "index").select("sha", "keep_id", "group_size").filter("group_size > 1")
    rows = members.agg(F.sum("copies")).first()[0] or 0
    hot = F.col("group_size") > max(HOT_ROWS, rows // HOT_KEYS)
    large, small = index.filter(hot), index.filter(~hot)
    marked = members.join(F.broadcast(large.withColumnsRenamed({"keep_id": "hot_id", "group_size": "hot_size"})), "sha", "left")
    found = marked.filter("hot_size is null").drop("hot_id", "hot_size").join(small, "sha", "left")
    found = found.unionByName(marked.filter("hot_size is not null").withColumnsRenamed({"hot_id": "keep_id", "hot_size": "group_size"}))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _probes(depth: int, key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas = [hashlib.sha256(x).digest() for x in _normalised(b.column(1))]
            keys = [int.from_bytes(s[:8], "big") >> (64 - key_bits) << (64 - key_bits) for s in shas]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.binary()), pa.array([k >> (64 - depth) if depth else 0 for k in keys], pa.int32()), pa.array([k - (1 << 63) for k in keys], pa.int64())], ["doc_id", "sha", "prefix", "key"])

    return run


def find_copies(docs: DataFrame, path: str, work: Work | None = None) -> DataFrame:
    """One row per document: doc_id, and keep_id and group_size of its text in the index that a run left in folder ``path``, null if it isn't there.

    Each distinct text is looked up once: the directory (of at most ``2 ** max_bits`` rows, so it may be broadcast) gives its bucket, the bucket's
    chain its entry, told apart by SHA-256.
    """
    spark = docs.sparkSession
    work = work or Work(spark, "exact-find")
    directory = spark.read.parquet(f"{path}/directory")
    depth, key_bits = directory.select("depth", "key_bits").first()
    probes = work.save(docs.select("doc_id", "text").mapInArrow(lean(_probes(depth, key_bits)), "doc_id long, sha binary, prefix int, key long"), "probes")
    distinct = probes.groupBy("prefix", "key", "sha").agg(F.count(F.lit(1)).alias("n"))
    held = spark.read.parquet(f"{path}/index").select("bucket", "key", "sha", "keep_id", "group_size")
    found = distinct.join(F.broadcast(directory.select("prefix", "bucket")), "prefix").join(held, ["bucket", "key", "sha"], "left")
    rows = join_sized(probes.select("doc_id", "sha"), found.select("sha", "n", "keep_id", "group_size"), "sha", "n", probes.count())
    return rows.select("doc_id", "keep_id", "group_size")


def drop_exact_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Of repeated rows that tie in doc_id and text, one stays.

    Where no doc_id repeats, doc_id alone names the rows; else doc_id and text do.
    """
    own, kept_id, kept_sha = (fresh(docs, x) for x in ("own_sha", "kept_id", "kept_sha"))
    kept = exact_groups(docs, **options).filter("kept").select(F.col("doc_id").alias(kept_id), F.unhex("text_sha256").alias(kept_sha))
    same_id = F.col("doc_id").eqNullSafe(F.col(kept_id))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.join(kept, same_id, "left_semi")
    hashed = docs.withColumn(own, F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce("text", F.lit(""))), "UTF-8"), 256)))
    joined = hashed.join(kept, same_id & (F.col(own) == F.col(kept_sha)), "left_semi")
    return joined.dropDuplicates(["doc_id", own]).select(*docs.columns)


def ascii_lower(column):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())
