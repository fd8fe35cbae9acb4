"""Token ids in a content-addressed store of chunks, with a recipe for each document and Merkle manifests.

Every document is encoded and ends with an end id. A rolling hash over ``WINDOW`` ids cuts its stream into chunks where the
hash's leading bits are zero, so equal passages give equal chunks wherever they stand; a chunk's name is the BLAKE2b digest
of its bytes. One shuffle brings chunks to the owner of their digest, where each is written once; map tasks
leave out chunks that they have sent before, so a common chunk costs each task one row. A recipe lists the digests and
lengths of a document's chunks and their Merkle root; recipes are written in ascending order of doc_id, a manifest with the
Merkle root of every recipe file beside them. Reading recomputes digests, roots and the manifest and fails where they differ.

The CRC-32 of a document is put together from those of its stored chunks: CRC-32 is linear, so a chunk's CRC is shifted by
the bytes after it, and the shifted CRCs are added (XOR) in Spark. No document needs to come together in one task.

Files: ``chunks`` (digest, payload: little-endian ids of 2 bytes, or 4 where the vocabulary needs them), ``recipes`` (doc_id, recipe, n_tokens,
refs: 16 bytes of digest and 4 of length for each chunk, root), ``manifest`` (part, documents, n_tokens, root).

Defined results: a null or empty text is a document of the end id alone; null doc_ids come first; repeated rows are stored
as documents of their own, in any order among themselves; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .tokens import encoder
from .work import HOT_KEYS, HOT_ROWS, Work, lean, shuffle_partitions

END_ID = 2
#: Ids under the rolling hash; least, mean and greatest length of a chunk in ids.
WINDOW, LEAST, MEAN, MOST = 16, 128, 512, 4096
DIGEST = 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Factors by which the hash of 1, 2, 4 and 8 ids is moved past as many ids.
_STEPS = [(1 << k, np.uint64(pow(int(_BASE), 1 << k, 1 << 64))) for k in range(WINDOW.bit_length() - 1)]
#: A cut may come after a window whose mixed hash is below this.
_BELOW = np.uint64(1 << 64 - (MEAN - 1).bit_length())


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; an odd node goes up as it is. No leaves: the digest of nothing."""
    level = [_digest(b"\0" + x) for x in leaves] or [_digest(b"")]
    while len(level) > 1:
        level = [_digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A pseudo-random 64-bit value for each residue of an id modulo 2**16."""
    x = np.arange(1 << 16, dtype=np.uint64) * _BASE + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids, the last of them its length."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    h = _values()[ids & 0xFFFF]
    for span, base in _STEPS:  # h[i] covers ids i .. i+2*span-1
        h = h[:-span] * base + h[span:]
    marks = np.flatnonzero((h ^ (h >> np.uint64(29))) * _BASE < _BELOW) + WINDOW
    ends, start = [], 0
    for m in marks.tolist():
        while m - start > MOST:
            start += MOST
            ends.append(start)
        if m - start >= LEAST:
            start = m
            ends.append(m)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return ends if start == n else [*ends, n]


_PART = pa.schema([("owner", pa.int32()), ("kind", pa.int32()), ("digest", pa.binary()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("n_tokens", pa.int64()), ("refs", pa.binary()), ("root", pa.binary())])
PART_SCHEMA = "owner int, kind int, digest binary, payload binary, doc_id long, tag long, n_tokens long, refs binary, root binary"
#: Digests that a task remembers having sent.
SENT = 500_000


def _encode(path: str, end_id: int, owners: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count, sent = TaskContext.get().partitionId(), 0, set()
        end, kind = int(end_id).to_bytes(4, "little"), "<u4" if wide else "<u2"
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, rows = b.slice(at, 500), []
                for doc, raw in zip(part.column(0).to_pylist(), encoder(path).ids(part.column(1).to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, "<u4")
                    small, start, refs, names = ids.astype(kind).tobytes(), 0, [], []
                    width = 4 if wide else 2
                    for stop in cut_points(ids):
                        payload = small[width * start : width * stop]
                        name = _digest(payload)
                        names.append(name)
                        refs.append(name + (stop - start).to_bytes(4, "little"))
                        start = stop
                        if name not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(name)
                            rows.append((int.from_bytes(name[:4], "big") * owners >> 32, 0, name, payload, None, None, None, None, None))
                    count += 1
                    rows.append(((count + task) % owners, 1, None, None, doc, (task << 40) + count, len(ids), b"".join(refs), merkle_root(names)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PART, strict=True)], schema=_PART)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest once, from rows sorted by digest; recipes pass."""
    last = None
    for b in batches:
        fresh = []
        for name in b.column("digest").to_pylist():
            fresh.append(name is None or name != last)
            last = name
        yield b.filter(pa.array(fresh, pa.bool_()))


@lru_cache(maxsize=1)
def _shifts() -> list[np.ndarray]:
    """Tables that append 2**k zero bytes to a CRC-32, by the four bytes of the CRC; k below 40."""
    one = np.zeros(32, np.uint32)
    for bit in range(32):
        one[bit] = zlib.crc32(b"\0", 1 << bit) ^ zlib.crc32(b"\0", 0)  # linear part of appending a zero byte
    tables = []
    for _ in range(40):
        table = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for value in range(256):
                for bit in range(8):
                    if value >> bit & 1:
                        table[byte, value] ^= one[8 * byte + bit]
        tables.append(table)
        one = _through(table, one)
    return tables


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def shift_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each CRC-32 adds to the CRC-32 of a stream in which ``after`` more bytes follow."""
    crc = crc.astype(np.uint32)
    for k, table in enumerate(_shifts()):
        if not (after >> k).any():
            break
        on = (after >> k & 1).astype(bool)
        crc[on] = _through(table, crc[on])
    return crc


def _chunk_facts(wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, payloads = b.column(0).to_pylist(), b.column(1).to_pylist()
            crcs = []
            for name, payload in zip(names, payloads, strict=True):
                if _digest(payload) != name:
                    raise ValueError(f"chunk {name.hex()} doesn't have its digest")
                crcs.append(zlib.crc32(payload if wide else np.frombuffer(payload, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) // (4 if wide else 2) for p in payloads], pa.int64()), pa.array(crcs, pa.int64())], ["digest", "stored", "crc"])

    return run


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, with the bytes after it; checks the recipe's root."""
    for b in batches:
        names, recipes, lengths, after = [], [], [], []
        for recipe, total, refs, root in zip(*(b.column(c).to_pylist() for c in ("recipe", "n_tokens", "refs", "root")), strict=True):
            own = [refs[i : i + DIGEST] for i in range(0, len(refs), DIGEST + 4)]
            if merkle_root(own) != root:
                raise ValueError(f"recipe {recipe} doesn't have its Merkle root")
            sizes = np.frombuffer(refs, "u1").reshape(-1, DIGEST + 4)[:, DIGEST:].copy().view("<u4").ravel().astype(np.int64)
            names += own
            recipes += [recipe] * len(own)
            lengths.append(sizes)
            after.append(4 * (total - np.cumsum(sizes)))
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(recipes, pa.int64()), pa.array(np.concatenate(lengths)), pa.array(np.concatenate(after))], ["digest", "recipe", "length", "after"])


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = shift_crc(b.column("crc").to_numpy(), b.column("after").to_numpy())
        yield pa.RecordBatch.from_arrays([b.column("recipe"), b.column("length"), pa.array(crc.astype(np.int64))], ["recipe", "length", "crc"])


def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merkle root of the recipes of one file, in their order."""
    roots: list[bytes] = []
    total, part = 0, None
    for b in batches:
        for recipe, n, root in zip(*(b.column(c).to_pylist() for c in ("recipe", "n_tokens", "root")), strict=True):
            part, total = recipe >> 33, total + n
            roots.append(root)
    if roots:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([len(roots)], pa.int64()), pa.array([total], pa.int64()), pa.array([merkle_root(roots)], pa.binary())], ["part", "documents", "n_tokens", "root"])


class TokenStore:
    """The files of a store, and what is read from them."""

    def __init__(self, chunks: DataFrame, recipes: DataFrame, manifest: DataFrame, wide: bool, work: Work) -> None:
        self.chunks, self.recipes, self.manifest, self.wide, self.work = chunks, recipes, manifest, wide, work
        self.reads = 0

    def documents(self) -> DataFrame:
        """From the files: doc_id, start, n_tokens, ids_crc32. Fails where a chunk or recipe isn't what its name says, or recipe files aren't those of the manifest."""
        spark = self.chunks.sparkSession
        self.reads += 1
        facts = self.work.save(self.chunks.mapInArrow(lean(_chunk_facts(self.wide)), "digest binary, stored long, crc long"), f"facts{self.reads}")
        refs = self.work.save(self.recipes.mapInArrow(lean(_references), "digest binary, recipe long, length long, after long"), f"refs{self.reads}")
        # Chunks that very many documents have: at most HOT_KEYS of them, looked up in a broadcast table.
        hot = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(HOT_ROWS, refs.count() // HOT_KEYS)).select("digest")
        hot_facts = F.broadcast(self.work.save(facts.join(F.broadcast(hot), "digest"), f"hot{self.reads}"))
        both = refs.join(hot_facts, "digest").unionByName(refs.join(hot_facts, "digest", "left_anti").join(facts, "digest"))
        found = both.filter("stored = length").select("recipe", "length", "after", "crc")
        crcs = found.mapInArrow(lean(_shifted), "recipe long, length long, crc long").groupBy("recipe").agg(F.bit_xor("crc").alias("crc"), F.sum("length").alias("found"))
        own = self.recipes.select("doc_id", "recipe", "n_tokens", F.shiftright("recipe", 33).alias("part"))
        now = self._roots()
        if now != sorted(map(tuple, self.manifest.collect())):
            raise ValueError("the recipe files aren't those of the manifest")
        before, starts = 0, []
        for part, _, n, _ in now:
            starts.append((part, before))
            before += n
        offsets = spark.createDataFrame(starts, "part long, before long")
        running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("recipe").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = own.withColumn("upto", running).join(F.broadcast(offsets), "part").select("doc_id", "recipe", "n_tokens", (F.col("before") + F.col("upto") - F.col("n_tokens")).alias("start"))
        whole = F.when(F.col("found") == F.col("n_tokens"), F.col("crc")).otherwise(F.raise_error(F.lit("a document's chunks are missing")).cast("long"))
        return placed.join(crcs, "recipe", "left").select("doc_id", "start", "n_tokens", whole.alias("ids_crc32"))

    def ids(self, doc_ids: DataFrame) -> DataFrame:
        """doc_id and ids (array of long) of the documents whose doc_id is in the column ``doc_id`` of the given frame."""
        wide = self.wide
        wanted = self.recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
        refs = wanted.mapInArrow(lean(_references), "digest binary, recipe long, length long, after long")
        rows = refs.join(self.chunks, "digest").groupBy("recipe").agg(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("place"), "payload"))).alias("parts"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = [np.frombuffer(b"".join(p["payload"] for p in parts), "<u4" if wide else "<u2").astype(np.int64) for parts in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tolist() for x in lists], pa.list_(pa.int64()))], ["recipe", "ids"])

        return rows.mapInArrow(lean(joined), "recipe long, ids array<long>").join(wanted.select("recipe", "doc_id"), "recipe").select("doc_id", "ids")

    def _roots(self) -> list[tuple]:
        """The manifest of the recipe files as they are now: a row for each file."""
        now = self.recipes.select("recipe", "n_tokens", "root").groupBy(F.shiftright("recipe", 33).alias("part")).applyInArrow(_manifest_group, "part long, documents long, n_tokens long, root binary")
        return sorted(map(tuple, now.collect()))

    def verify(self) -> bool:
        """True if the recipe files still have the roots of the manifest."""
        return self._roots() == sorted(map(tuple, self.manifest.collect()))


def _manifest_group(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(_manifest(iter(table.sort_by("recipe").to_batches()))))


def write_store(docs: DataFrame, tokenizer: str, end_id: int = END_ID, work: Work | None = None) -> TokenStore:
    """Encode and store columns doc_id and text of ``docs`` under the working folder; the texts are read and encoded once."""
    spark = docs.sparkSession
    work = work or Work(spark, "token-store")
    owners = shuffle_partitions(spark)
    wide = max(encoder(tokenizer).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) > 1 << 16
    parts = docs.select("doc_id", "text").mapInArrow(lean(_encode(tokenizer, end_id, owners, wide)), PART_SCHEMA)
    once = parts.repartitionById(owners, F.col("owner")).sortWithinPartitions("digest").mapInArrow(lean(_once), PART_SCHEMA).drop("owner")
    stored = work.save(once, "stored", compression="snappy")
    chunks = stored.filter("kind = 0").select("digest", "payload")
    ordered = stored.filter("kind = 1").select("doc_id", "tag", "n_tokens", "refs", "root").repartitionByRange(owners, "doc_id", "tag").sortWithinPartitions("doc_id", "tag")
    recipes = work.save(ordered.select("doc_id", F.monotonically_increasing_id().alias("recipe"), "n_tokens", "refs", "root"), "recipes")
    manifest = recipes.select("recipe", "n_tokens", "root").groupBy(F.shiftright("recipe", 33).alias("part")).applyInArrow(_manifest_group, "part long, documents long, n_tokens long, root binary")
    return TokenStore(chunks, recipes, work.save(manifest, "manifest"), wide, work)
