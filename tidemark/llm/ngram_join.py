"""Similarity join of documents on word n-grams (Jaccard), by MinHash banding and exact verification.

A document's n-grams are the windows of ``size`` words (runs of non-space bytes, A-Z lower-cased) as 64-bit hashes; a text of
fewer words, but at least one, is one n-gram. Documents with the same set are one node, with a weight; so copies are never
expanded. ``bands_for`` chooses the bands: of all band and row counts that find a pair at the threshold with the target
recall, the one with the most rows that needs at most ``HASHES`` hashes. Rows of (band hash, node) are shuffled on the band
hash; nodes that share a band hash are joined to its least node, and connected components of these candidate edges bound where
links can be.

Texts far below the threshold share band hashes now and then, and may chain into large components. Components above ``BLOCK`` nodes
are therefore split by prefixes, which loses no link: two sets of similarity t or more have
at least t of the larger one's n-grams in common, so whatever order all n-grams are put in, both have a common one among
their first n - ceil(t * n) + 1. The order is by rarity in some ``PROFILE`` sets of the component, drawn by hash; rare n-grams come first, so pages of one
template, which differ in what is rare, share no prefix n-gram and part. Nodes that share one stay together.

Within what is left every pair is verified on the full n-gram sets: components are cut into blocks of
nodes, each pair of blocks is one unit of work, and a unit returns counts and a spanning forest of its links, never
the pairs. A second run of connected components over the forests gives the classes.

Node ids are 64-bit hashes of sets: with n different sets, the chance that any two share one is below n * n / 2 ** 65. Rows are
told apart by doc_id and a 64-bit hash of the text where sets are fetched.

Bounds: ``PROFILE`` sets of a component decide the order of n-grams, for speed alone. Work grows with the square of the different
texts of a group whose texts share rare n-grams, as all their links are counted.

Defined results: null, empty and blank texts have no n-grams and no links, each is a class of its own; a document's class
is named by its least doc_id (null counts as the largest), and the row with it stays, one of them if it repeats. Repeated
rows are linked as copies. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import star_components
from .words import Corpus, mix, parts
from .work import Work, fresh, join_sized, lean, shuffle_partitions

SIZE, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9995, 128
#: Nodes of a component that are verified as they are; nodes of a block: a thirty-second of the component, but at least BLOCK and at most MOST_BLOCK.
BLOCK, MOST_BLOCK = 128, 2048
#: Sets of a component by which its n-grams are ordered, and nodes of a task that picks prefixes.
PROFILE, PREFIX_NODES = 256, 512


def bands_for(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= hashes, rows as many as can be."""
    best = (1, 1)
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(max(1 - recall, 1e-300)) / math.log1p(-p))
        if bands * rows > hashes:
            break
        best = (max(1, bands), rows)
    return best


def ngram_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of the texts, one after another, and where each text's begin."""
    corpus = Corpus(texts, lower=True)
    hashes, at = corpus.windows(size)
    of = np.searchsorted(corpus.first, at, side="right") - 1
    short = np.flatnonzero((corpus.counts > 0) & (corpus.counts < size))
    if len(short):
        whole = np.array([mix(np.array([int.from_bytes(hashlib.blake2b(corpus.words[corpus.first[i] : corpus.first[i + 1]].tobytes(), digest_size=8).digest(), "big")], np.uint64))[0] for i in short], np.uint64)
        hashes, of = np.concatenate([hashes, whole]), np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(texts) + 1))


def node_ids(hashes: np.ndarray, first: np.ndarray) -> list[int | None]:
    return [int.from_bytes(hashlib.blake2b(hashes[s:e].tobytes(), digest_size=8).digest(), "big", signed=True) if e > s else None for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def band_hashes(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash for each set and band; sets are not empty."""
    starts = first[:-1]
    out = np.zeros((len(starts), bands), np.uint64)
    multipliers = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(bands * rows):
        least = np.minimum.reduceat(mix_light(hashes * multipliers[2 * k] + multipliers[2 * k + 1]), starts)
        band = k // rows
        out[:, band] = mix(out[:, band] + least * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
    return out


def mix_light(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(32))


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _utf8(b.column("text"))
            for s, e in parts(texts):
                hashes, first = ngram_sets(texts[s:e], size)
                some = np.flatnonzero(np.diff(first))
                signs: list[bytes | None] = [None] * (e - s)
                if len(some):
                    # Sets that are empty take no room, so the starts of the others are enough.
                    table = band_hashes(hashes, np.append(first[some], len(hashes)), bands, rows).astype("<u8")
                    for i, row in zip(some.tolist(), table, strict=True):
                        signs[i] = row.tobytes()
                own = [b.column(c).slice(s, e - s) for c in ("doc_id", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(node_ids(hashes, first), pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "text_hash", "node", "bands"])

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        table = [np.frombuffer(x, "<i8") for x in b.column("bands").to_pylist()]
        if table:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(table)), pa.array(np.repeat(b.column("node").to_numpy(), len(table[0])))], ["band", "node"])


def _payloads(size: int):
    """Sets of the texts that are wanted: those that have the node they are wanted for, each once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts, wanted = _utf8(b.column("text")), b.column("node").to_pylist()
            for s, e in parts(texts):
                hashes, first = ngram_sets(texts[s:e], size)
                take = []
                for i, own in enumerate(node_ids(hashes, first)):
                    if own == wanted[s + i] and own not in seen:
                        seen.add(own)
                        take.append(i)
                if take:
                    grams = [hashes[first[i] : first[i + 1]].astype("<u8").tobytes() for i in take]
                    yield pa.RecordBatch.from_arrays([pa.array([wanted[s + i] for i in take], pa.int64()), pa.array(grams, pa.binary())], ["node", "grams"])

    return run


def prefix_size(n: int, threshold: float) -> int:
    """How many of n n-grams, the first in any one order, hold one in common with each set of at least this similarity."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def _profile(table: pa.Table) -> pa.Table:
    """Of some sets of a component, the n-grams that more than one has, and how many have them."""
    held = dict(zip(table.column("node").to_pylist(), table.column("grams").to_pylist(), strict=True))
    values, counts = np.unique(np.frombuffer(b"".join(held.values()), "<u8"), return_counts=True)
    return pa.table({"comp": pa.array([table.column("comp")[0].as_py()], pa.int64()), "values": pa.array([values[counts > 1].tobytes()], pa.binary()), "counts": pa.array([counts[counts > 1].astype("<i4").tobytes()], pa.binary())})


def _prefixes(threshold: float):
    """(comp, gram, node) for the prefix n-grams of the nodes of one component and chunk: by count in the profile, then by hash."""

    def run(nodes: pa.Table, profile: pa.Table) -> pa.Table:
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        if profile.num_rows:
            values, counts = (np.frombuffer(profile.column(c)[0].as_py(), kind) for c, kind in (("values", "<u8"), ("counts", "<i4")))
        out, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for node, data in zip(nodes.column("node").to_pylist(), nodes.column("grams").to_pylist(), strict=True):
            own = np.frombuffer(data, "<u8")
            rank = np.zeros(len(own), np.int32)
            if len(values):
                at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                rank = np.where(values[at] == own, counts[at], 0)
            out.append(own[np.lexsort((own, rank))[: prefix_size(len(own), threshold)]])
            of.append(np.full(len(out[-1]), node))
        grams = np.concatenate(out)
        comp = nodes.column("comp")[0].as_py() if nodes.num_rows else 0
        return pa.table({"comp": np.full(len(grams), comp, np.int64), "gram": grams.view(np.int64), "node": np.concatenate(of)})

    return run


def split_by_prefixes(sets: DataFrame, threshold: float, work: Work) -> DataFrame:
    """node, label of the nodes of ``sets`` (node, comp, m, grams) that share a prefix n-gram with another one of their component."""
    drawn = sets.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.ceil(F.col("m") / PROFILE)) == 0).select("comp", "m", "node", "grams")
    chunks = F.ceil(F.col("m") / PREFIX_NODES).cast("int")
    profiles = drawn.select("comp", "node", "grams").groupBy("comp").applyInArrow(_profile, "comp long, values binary, counts binary")
    spread = profiles.join(sets.groupBy("comp").agg(F.max("m").alias("m")), "comp").select("comp", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "values", "counts")
    dealt = sets.select("comp", F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"), "node", "grams")
    grams = dealt.groupBy("comp", "chunk").cogroup(spread.groupBy("comp", "chunk")).applyInArrow(_prefixes(threshold), "comp long, gram long, node long")
    postings = work.save(grams, "prefixes")
    heads = postings.groupBy("comp", "gram").agg(F.min("node").alias("root"), F.max("node").alias("last")).filter("root < last").drop("last")
    return star_components(postings.join(heads, ["comp", "gram"]).select("node", "root").distinct(), work, "prefix-classes")


def set_links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity is at least ``threshold``; the diagonal is False."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), sizes)
    counts = np.bincount(column)
    shared = counts[column] > 1
    row, column = row[shared], column[shared]
    number = np.cumsum(counts > 1) - 1
    column = number[column]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((n, n), np.float32)
    width = max(256, (8 << 20) // max(1, n))
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for k, (s, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if e > s:
            dense = np.zeros((n, width), np.float32)
            dense[row[s:e], column[s:e] - k * width] = 1
            both += dense @ dense.T
    both = both.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - both
    links = both >= threshold * union - 1e-9
    np.fill_diagonal(links, False)
    return links


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """(place, place of its root) for each place that has a link and isn't a root itself."""
    label = np.full(len(links), -1)
    for i in range(len(links)):
        if label[i] < 0 and links[i].any():
            label[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(links[front].any(axis=0) & (label < 0))
                label[front] = i
    return [(i, r) for i, r in enumerate(label.tolist()) if r >= 0 and r != i]


_FOUND = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _verify(threshold: float):
    """Counts and forests of units of work, from rows sorted by unit. Memory: the sets of one unit."""

    def unit(rows: list[tuple], crossing: bool) -> list[tuple]:
        held: dict[int, tuple] = {}
        for node, weight, mine, grams in rows:
            held.setdefault(node, (weight, mine, np.frombuffer(grams, "<u8")))
        nodes = sorted(held)
        if len(nodes) < 2:
            return []
        links = set_links([held[x][2] for x in nodes], threshold)
        if crossing:
            mine = np.array([held[x][1] for x in nodes])
            links &= mine[:, None] != mine[None, :]
        counts = links @ np.array([held[x][0] for x in nodes], np.int64)
        roots = dict(forest(links))
        return [(nodes[i], nodes[roots.get(i, i)], c) for i, c in enumerate(counts.tolist()) if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for b in batches:
            for comp, i, j, mine, node, weight, grams in zip(*(b.column(c).to_pylist() for c in ("comp", "i", "j", "mine", "node", "weight", "grams")), strict=True):
                if (comp, i, j) != at:
                    if rows and (found := unit(rows, at[1] != at[2])):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_FOUND)
                    at, rows = (comp, i, j), []
                rows.append((node, weight, mine, grams))
        if rows and (found := unit(rows, at[1] != at[2])):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], schema=_FOUND)

    return run


def similar_documents(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, work: Work | None = None) -> DataFrame:
    """One row per document: doc_id, node, class_id, n_links, kept. Reads columns doc_id and text.

    ``n_links`` counts the other documents whose similarity to this one is at least ``threshold``.
    """
    spark = docs.sparkSession
    work = work or Work(spark, "ngram-join")
    bands, rows = bands_for(threshold, recall, hashes)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    signed = work.save(docs.mapInArrow(lean(_signatures(size, bands, rows)), "doc_id long, text_hash long, node long, bands binary"), "signatures")
    members = work.save(signed.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("copies"), F.min("text_hash").alias("text_hash")), "members")
    total = members.agg(F.sum("copies")).first()[0] or 0
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    least = members.filter("node is not null").groupBy("node").agg(F.sum("copies").alias("weight"), F.min(order).alias("least"))
    nodes = work.save(least.select("node", "weight", F.col("least.doc_id").alias("least_id"), F.col("least.text_hash").alias("text_hash")), "nodes")

    postings = signed.filter("bands is not null").select("node", "bands").mapInArrow(lean(_postings), "band long, node long").distinct()
    heads = postings.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("last")).filter("root < last").drop("last")
    candidates = star_components(postings.join(heads, "band").select("node", "root"), work, "candidates")

    wanted = candidates.select("node").join(nodes, "node").select("node", F.col("least_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))).select("text", "node")
    sets = work.save(texts.mapInArrow(lean(_payloads(size)), "node long, grams binary"), "sets", compression="snappy")
    sized = work.save(_with_sizes(candidates, total), "sized")
    large = sized.filter(F.col("m") > BLOCK)
    parted = split_by_prefixes(sets.join(large.select("node", F.col("label").alias("comp"), "m"), "node").select("comp", "m", "node", "grams"), threshold, work)
    placed = work.save(sized.filter(F.col("m") <= BLOCK).unionByName(_with_sizes(parted, total)), "placed")

    block = F.least(F.greatest(F.ceil(F.col("m") / 32), F.lit(BLOCK)), F.lit(MOST_BLOCK))
    dealt = placed.join(nodes.select("node", "weight"), "node").select("node", "weight", F.col("label").alias("comp"), F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    mine = sets.join(dealt, "node").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = mine.select("comp", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "weight", "grams")
    # Units of one component are dealt out one by one, so that no task gets several of a large one before each has one.
    tasks, number = shuffle_partitions(spark), F.expr("j * (j + 1L) div 2 + i")
    sorted_units = units.repartitionById(tasks, F.pmod(F.xxhash64("comp") + number, F.lit(tasks)).cast("int")).sortWithinPartitions("comp", "i", "j")
    found = work.save(sorted_units.mapInArrow(lean(_verify(threshold)), "node long, root long, links long"), "found")

    classes = star_components(found.select("node", "root"), work, "classes")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = work.save(classes.join(counts, "node", "left").join(nodes.drop("text_hash"), "node"), "linked")
    own_order = F.struct(F.col("least_id").isNull().alias("none"), F.col("least_id").alias("id"), F.col("node").alias("node"))
    heads = linked.groupBy("label").agg(F.min(own_order).alias("head"), F.sum("weight").alias("class_size")).select("label", "class_size", F.col("head.id").alias("class_id"), F.col("head.node").alias("head_node"))
    of_class = join_sized(linked, heads, "label", "class_size", total)
    facts = nodes.filter("weight > 1").drop("text_hash").join(of_class.select("node", "links", "class_id", "head_node"), "node", "left")
    facts = facts.unionByName(of_class.filter("weight = 1").select("node", "weight", "least_id", "links", "class_id", "head_node"))
    facts = facts.select("node", "weight", "least_id", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("head_node").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("head_node", "node").alias("head_node"))
    joined = join_sized(members.drop("text_hash"), facts, "node", "weight", total).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    alone = F.col("weight").isNull()
    keeps = alone | ((F.col("node") == F.col("head_node")) & F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("copy") == 1))
    return joined.select("doc_id", "node", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 0).otherwise(F.col("links") + F.col("weight") - 1).cast("long").alias("n_links"), keeps.alias("kept"))


def _with_sizes(labels: DataFrame, total: int) -> DataFrame:
    """node, label, and m: the nodes of the label."""
    return join_sized(labels, labels.groupBy("label").agg(F.count(F.lit(1)).alias("m")), "label", "m", total)


def _keyed(size: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _utf8(b.column("text"))
            ids = [x for s, e in parts(texts) for x in node_ids(*ngram_sets(texts[s:e], size))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.int64())], [*b.schema.names, name])

    return run


def drop_near_copies(docs: DataFrame, size: int = SIZE, **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns, whatever they are called.

    Where no doc_id repeats, doc_id alone names the rows; else doc_id and n-gram set do, and texts without n-grams all stay.
    """
    own, kept_id, kept_node = (fresh(docs, x) for x in ("own_set", "kept_id", "kept_node"))
    kept = similar_documents(docs, size=size, **options).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("node").alias(kept_node))
    same_id = F.col("doc_id").eqNullSafe(F.col(kept_id))
    if docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return docs.join(kept, same_id, "left_semi")
    keyed = docs.mapInArrow(lean(_keyed(size, own)), T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    joined = keyed.join(kept, same_id & F.col(own).eqNullSafe(F.col(kept_node)), "left_semi")
    once = joined.filter(F.col(own).isNotNull()).dropDuplicates(["doc_id", own])
    return once.unionByName(joined.filter(F.col(own).isNull())).select(*docs.columns)
