"""Near-duplicate vectors by cosine: range search from medoids in a flat, robust-pruned graph built on overlapping cluster shards.

Vectors equal in label and in all components are one node with a weight, so copies are never expanded. Vectors are scaled by their
largest component, so that no norm overflows or underflows. A label's nodes of one dimension
are a group. Groups above ``SHARD`` nodes are dealt to cells by the nearest of their own centroids, which are fitted on a bounded sample; a cell above
``MOST_SHARD`` nodes is split by hash into parts, each of which is a shard.

Shards overlap: a node is a member of its own part and a visitor of all later parts of its cell and of every part of the ``overlap`` nearest earlier
cells that may hold a vector within the
threshold: by the triangle inequality the node must be within the threshold's angle of the cell's radius, and within the threshold's chord of the
cell's side of the plane between the two centroids. So a pair meets in one task at most. Visitors of a shard come in chunks of about ``MOST_SHARD``.

In each shard every node gets edges to a robust-pruned choice among its nearest nodes, to one among nodes at geometrically growing ranks (so
that no clump keeps all edges to itself), and a bounded number of edges back. The lists of a node from all its shards are united into one flat graph.
Each node is searched for in each of its shards: best first from the medoids of the shard with a bounded beam, then, from all that is within
the range, outwards as long as there is something new within it. Pairs found are verified in double precision. Tasks return counts, to both
ends of each link, and a spanning forest of the links, never pairs.

The result is audited against brute force for ``AUDITED`` nodes of all and ``AUDITED`` of those with links. If less than ``TARGET`` of their links is
found, the graph is built and searched again with twice the degree and beam and four times the overlap; if that isn't enough, the shards are compared exactly,
block by block, with every cell visited that the geometry can't rule out. If a count is too small even then, or ever too large, that is an error.

Bounds: ``SAMPLE`` vectors on the driver and ``MOST_CLUSTERS`` centroids in all, for speed alone; ``AUDITED`` for the audit; every vector is
indexed and searched for. Work within a shard grows with its size times the nodes within range of each other.

Defined results: rows with a null label and vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different dimensions don't link; repeated rows link as copies; a null vec_id is the largest; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import star_components
from .work import Work, join_sized, lean, slices

THRESHOLD = 0.98
SHARD, MOST_SHARD, SAMPLE, MOST_CLUSTERS = 1500, 4096, 20_000, 2000
AUDITED = 200
#: Edges of a node of either kind (near, further off, back) in a shard; nearest nodes they are chosen from; growth of the ranks; slack of pruning.
DEGREE, NEAREST, RANK_GROWTH, ALPHA = 12, 40, 1.4, 1.2
#: Nodes held best while searching; medoids of a shard; cells that a node visits besides its own; what is expanded below the threshold; queries at a time.
BEAM, MEDOIDS, OVERLAP, SLACK, QUERIES = 20, 8, 4, 0.005, 512
#: Audited recall below which the graph is built and searched again, and then the shards compared exactly.
TARGET = 0.999
#: Allowance for rounding where cells are ruled out.
ROUNDING = 1e-6
#: Cosines this near to the threshold may fall on either side in the audit, which sums in another order.
SURE = 1e-9


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes, vectors = [], []
        for v, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist(), strict=True):
            node = data = None
            if v and label is not None and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    node = int.from_bytes(hashlib.blake2b((x + 0.0).tobytes() + repr(label).encode(), digest_size=8).digest(), "big", signed=True)
                    data = np.ldexp(x + 0.0, -np.frexp(np.abs(x).max())[1]).tobytes()  # by a power of two, so nothing is rounded
            nodes.append(node)
            vectors.append(data)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label").cast(pa.string()), pa.array(nodes, pa.int64()), pa.array(vectors, pa.binary())], ["vec_id", "label", "node", "vector"])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        of = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    return centres


def _groups(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each group of a batch: its name, the places of its rows, and its unit vectors."""
    places: dict[str, list[int]] = {}
    for i, group in enumerate(b.column("group").to_pylist()):
        places.setdefault(group, []).append(i)
    data = b.column("vector").to_pylist()
    for group, at in places.items():
        yield group, np.array(at), _unit(np.stack([np.frombuffer(data[i]) for i in at]))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


_HOMES = "node long, weight long, group string, vector binary, cell int, split boolean, angle double"


def _home(centroids: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, split, angles = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, bool), np.zeros(b.num_rows)
            for group, at, x in _groups(b):
                if (centres := centroids.get(group)) is not None:
                    cosines = x @ centres.T
                    cells[at], split[at], angles[at] = cosines.argmax(1), True, _angles(cosines.max(1))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("node", "weight", "group", "vector")), pa.array(cells), pa.array(split), pa.array(angles)], ["node", "weight", "group", "vector", "cell", "split", "angle"])

    return run


class _Layout:
    """Of the groups of more than one part: centroids, and for each cell its radius and number of parts."""

    def __init__(self, centroids: dict[str, np.ndarray], cells: list[tuple[str, int, int, float]]) -> None:
        self.centroids, self.parts, self.radius = centroids, {}, {}
        for group, cell, size, radius in cells:
            if group not in self.parts:
                k = len(centroids[group]) if group in centroids else 1
                self.parts[group], self.radius[group] = np.zeros(k, np.int64), np.full(k, -np.inf)
            self.parts[group][cell], self.radius[group][cell] = -(-size // MOST_SHARD), radius

    def visited(self, group: str, x: np.ndarray, home: np.ndarray, threshold: float, overlap: int | None) -> np.ndarray:
        """For each unit vector and cell: may an earlier cell than its own hold a vector within the threshold of it, and is it one of the ``overlap`` nearest?"""
        centres = self.centroids[group]
        cosines = x @ centres.T
        near = _angles(cosines) <= self.radius[group] + np.arccos(threshold) + ROUNDING
        apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
        near &= cosines - cosines[np.arange(len(x)), home][:, None] >= -np.sqrt(2 - 2 * threshold) * apart[home] - ROUNDING
        near &= np.arange(len(centres)) < home[:, None]
        if overlap is not None and overlap < len(centres):
            held = np.where(near, cosines, -2)
            near &= held >= -np.partition(-held, overlap - 1, axis=1)[:, overlap - 1 : overlap]
        return near


MEMBER, AGAIN, VISITOR = 0, 1, 2


def _deal(layout: _Layout, chunks: dict[str, int], threshold: float, counting: bool, overlap: int | None):
    """A row for each shard that a node is a member or a visitor of. Members are dealt to each chunk of visitors, to the further ones as ``AGAIN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            for group, at, x in _groups(b):
                parts = layout.parts.get(group, np.ones(1, np.int64))
                home, node = b.column("cell").to_numpy()[at], b.column("node").to_numpy()[at]
                own = node % parts[home]
                of, cell = np.nonzero(layout.visited(group, x, home, threshold, overlap)) if group in layout.centroids else (np.zeros(0, int), np.zeros(0, int))
                visits: list[list[int]] = [[] for _ in at]
                for i, c in zip(of.tolist(), cell.tolist(), strict=True):
                    visits[i].append(c)
                rows: list[tuple[int, str, int]] = []
                for i, (h, p, n) in enumerate(zip(home.tolist(), own.tolist(), node.tolist(), strict=True)):
                    place, key = int(at[i]), f"{h}/{p}/{group}"
                    rows += [(place, f"{c}/{key}", AGAIN if c else MEMBER) for c in range(chunks.get(key, 1))]
                    keys = [f"{h}/{q}/{group}" for q in range(p + 1, parts[h])] + [f"{c}/{q}/{group}" for c in visits[i] for q in range(parts[c])]
                    rows += [(place, key if counting else f"{(n >> 20) % chunks.get(key, 1)}/{key}", VISITOR) for key in keys]
                    if len(rows) >= 5000:
                        yield _dealt(b, rows, counting)
                        rows = []
                if rows:
                    yield _dealt(b, rows, counting)

    return run


def _dealt(b: pa.RecordBatch, rows: list[tuple[int, str, int]], counting: bool) -> pa.RecordBatch:
    place, shard, role = zip(*rows, strict=True)
    if counting:
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), pa.array(role, pa.int32())], ["shard", "role"])
    own = b.select(["node", "weight", "vector"]).take(pa.array(place, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.string()), pa.array(role, pa.int32()), *own.columns], ["shard", "role", "node", "weight", "vector"])


def _join(parent: np.ndarray, nodes: np.ndarray) -> None:
    """Make one tree of the trees of ``nodes``; the least root stays."""
    roots = parent[nodes]
    while not np.array_equal(up := parent[roots], roots):
        roots = up
    parent[roots] = parent[nodes] = roots.min()


def _prune(x: np.ndarray, choice: np.ndarray, cosines: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: of each row's candidates, the nearest is kept and those go that are nearer to it than, by ``ALPHA``, to the row's node; and so on."""
    between = 2 - 2 * np.einsum("bkd,bjd->bkj", x[choice], x[choice], optimize=True)
    own, rows = 2 - 2 * cosines, np.arange(len(choice))
    open_, kept = np.ones(choice.shape, bool), np.full((len(choice), degree), -1)
    for k in range(min(degree, choice.shape[1])):
        at = np.where(open_, own, np.inf).argmin(1)
        some = open_[rows, at]
        kept[some, k] = choice[rows, at][some]
        open_ &= ALPHA**2 * between[rows, at] > own
        open_[rows, at] = False
        if not open_.any():
            break
    return kept


def build_edges(x: np.ndarray, degree: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) among unit vectors, three times ``degree`` at most from each."""
    n = len(x)
    nearest, rank, further = min(NEAREST, n - 1), float(NEAREST), []
    while (rank := rank * RANK_GROWTH) < n:
        further.append(int(rank))
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, n, rows):
        cosines = x[s : s + rows] @ x.T
        own = np.arange(s, min(n, s + rows))
        cosines[own - s, own] = 2
        order = np.argpartition(-cosines, [0, *({nearest} - {n}), *further], axis=1)
        for choice in (order[:, 1 : nearest + 1], order[:, further]):
            if choice.shape[1]:
                kept = _prune(x, choice, np.take_along_axis(cosines, choice, 1), degree)
                some = kept >= 0
                starts.append(np.repeat(own, some.sum(1)))
                ends.append(kept[some])
    a, b = np.concatenate(starts), np.concatenate(ends)
    order = np.lexsort((-(x[a] * x[b]).sum(1), b))
    first = np.searchsorted(b[order], np.arange(n))
    back = order[np.arange(len(order)) - first[b[order]] < degree]
    return np.concatenate([a, b[back]]), np.concatenate([b, a[back]])


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def _build(degree: int):
    """node, neighbours: the edges of one shard."""

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        if len(nodes) < 2:
            return pa.table({"node": pa.array([], pa.int64()), "neighbours": pa.array([], pa.list_(pa.int64()))})
        a, b = build_edges(_unit(_vectors(table.column("vector"))), degree)
        a, b = np.unique(np.stack([a, b]), axis=1)
        first = np.searchsorted(a, np.arange(len(nodes) + 1))
        return pa.table({"node": nodes, "neighbours": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(nodes[b]))})

    return run


def _lists(nodes: np.ndarray, neighbours: pa.ChunkedArray) -> np.ndarray:
    """A row of places for each node: its neighbours that are in this shard, and -1."""
    flat = neighbours.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.diff(flat.offsets.to_numpy())
    ids, of = flat.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), sizes)
    order = np.argsort(nodes)
    at = np.minimum(np.searchsorted(nodes, ids, sorter=order), len(nodes) - 1)
    here = nodes[order[at]] == ids
    of, to = of[here], order[at][here]
    first = np.searchsorted(of, np.arange(len(nodes)))
    out = np.full((len(nodes), max(1, np.bincount(of, minlength=1).max())), -1)
    out[of, np.arange(len(of)) - first[of]] = to
    return out


def medoids(x: np.ndarray, count: int) -> np.ndarray:
    """Places of the vectors that are nearest to the centroids of the shard's clusters."""
    some = x[np.linspace(0, len(x) - 1, min(len(x), 1024)).astype(int)]
    return np.unique((fit_centroids(some, count, 4) @ x.T).argmax(1))


def range_search(x: np.ndarray, lists: np.ndarray, starts: np.ndarray, queries: np.ndarray, least: float, beam: int, expand: int = 1 << 14) -> np.ndarray:
    """For each query and node: was the node found with a cosine of at least ``least``?"""
    n, q = len(x), x[queries]
    rows = np.arange(len(q))[:, None]
    seen = np.zeros((len(q), n), bool)
    seen[:, starts] = True
    best = np.broadcast_to(starts, (len(q), len(starts))).copy()
    cosines = q @ x[starts].T
    done = np.zeros(best.shape, bool)
    found = np.zeros((len(q), n), bool)
    np.put_along_axis(found, best, cosines >= least, 1)
    while len(active := np.flatnonzero((~done).any(1))):
        at = np.where(done[active], -3, cosines[active]).argmax(1)
        done[active, at] = True
        near = lists[best[active, at]]
        new = (near >= 0) & ~seen[active[:, None], near]
        own = np.where(new, np.einsum("qd,qrd->qr", q[active], x[near], optimize=True), -3.0)
        of, k = np.nonzero(new)
        seen[active[of], near[of, k]] = True
        found[active[of], near[of, k]] = own[of, k] >= least
        wide = np.full((len(q), near.shape[1]), -3.0)
        wide[active] = own
        places = np.zeros(wide.shape, best.dtype)
        places[active] = near
        all_cosines, all_best, all_done = (np.concatenate(p, 1) for p in ((cosines, wide), (best, places), (done, wide < -2)))
        top = np.argpartition(-all_cosines, min(beam, all_cosines.shape[1]) - 1, axis=1)[:, :beam]
        cosines, best, done = all_cosines[rows, top], all_best[rows, top], all_done[rows, top]
    of, at = np.nonzero(found)
    while len(of):
        next_ = []
        for s in range(0, len(of), expand):
            near, query = lists[at[s : s + expand]], of[s : s + expand, None]
            i, k = np.nonzero((near >= 0) & ~seen[query, near])
            key = np.unique(query[i, 0] * n + near[i, k])
            a, b = key // n, key % n
            seen[a, b] = True
            within = np.einsum("pd,pd->p", q[a], x[b]) >= least
            found[a[within], b[within]] = True
            next_.append(key[within])
        key = np.concatenate(next_)
        of, at = key // n, key % n
    return found


def _search(threshold: float, beam: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("role")
        nodes, weight, role = (table.column(c).to_numpy() for c in ("node", "weight", "role"))
        raw = _vectors(table.column("vector"))
        norms = np.sqrt((raw * raw).sum(1))
        n, members, inner = len(nodes), int((role != VISITOR).sum()), bool((role == MEMBER).any())
        x, lists = _unit(raw), _lists(nodes, table.column("neighbours"))
        starts, links = medoids(x, MEDOIDS), np.zeros((n, n), bool)
        for s in range(0, n, QUERIES):
            links[s : s + QUERIES] = range_search(x, lists, starts, np.arange(s, min(n, s + QUERIES)), threshold - SLACK, beam)
        links |= links.T
        links[members:, members:] = False
        if not inner:
            links[:members, :members] = False
        parent, counts, weights = np.arange(n), np.zeros(n, np.int64), weight.astype(np.int64)
        for i in np.flatnonzero(links[:members].any(1)).tolist():
            to = np.flatnonzero(links[i, i + 1 :]) + i + 1
            to = to[raw[to] @ raw[i] / (norms[to] * norms[i]) >= threshold]
            if len(to):
                counts[i] += weights[to].sum()
                counts[to] += weights[i]
                _join(parent, np.append(to, i))
        return _forest(nodes, parent, counts)

    return run


def _forest(nodes: np.ndarray, parent: np.ndarray, counts: np.ndarray) -> pa.Table:
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    out = np.flatnonzero(counts > 0)
    return pa.table({"node": nodes[out], "root": nodes[parent[out]], "links": counts[out].astype(np.int64)})


def _compare(threshold: float, rows: int = 256):
    """The exact way: all pairs of one shard that may count there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("role")
        nodes, weight, role = (table.column(c).to_numpy() for c in ("node", "weight", "role"))
        raw = _vectors(table.column("vector"))
        norms = np.sqrt((raw * raw).sum(1))
        n, members, inner = len(nodes), int((role != VISITOR).sum()), bool((role == MEMBER).any())
        parent, counts, weights = np.arange(n), np.zeros(n), weight.astype(np.float64)
        for s in range(0, members, rows):
            e = min(s + rows, members)
            first = s if inner else members
            found = (raw[s:e] @ raw[first:].T) / (norms[s:e, None] * norms[first:]) >= threshold
            if inner:  # each pair once
                found[:, : e - s] &= np.tri(e - s, dtype=bool).T & ~np.eye(e - s, dtype=bool)
            linked = np.flatnonzero(found.any(1))
            if len(linked):
                links = found.astype(np.float64)
                counts[s:e] += links @ weights[first:]
                counts[first:] += weights[s:e] @ links
                for i in linked:
                    _join(parent, np.append(np.flatnonzero(found[i]) + first, s + i))
        return _forest(nodes, parent, counts)

    return run


def _audit(queries: list[tuple[int, str, bytes]], threshold: float):
    stacks: dict[str, list] = {}
    for node, group, data in queries:
        stacks.setdefault(group, []).append((node, np.frombuffer(data)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            node, weight = b.column("node").to_numpy(), b.column("weight").to_numpy()
            for group, at, x in _groups(b):
                own = stacks.get(group, [])
                for k in range(0, len(own), 64):
                    cosines = _unit(np.stack([q for _, q in own[k : k + 64]])) @ x.T
                    for (n, _), row in zip(own[k : k + 64], cosines, strict=True):
                        w = np.where(node[at] == n, 0, weight[at])
                        total[n] = total.get(n, 0) + np.array([w[row >= threshold + SURE].sum(), w[row >= threshold - SURE].sum()])
        if total:
            least, most = np.stack(list(total.values())).T
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(least.astype(np.int64)), pa.array(most.astype(np.int64))], ["node", "least", "most"])

    return run


def audit_recall(nodes: DataFrame, found: DataFrame, threshold: float, audited: int = AUDITED) -> tuple[float, bool]:
    """Links found over links there are, by brute force against all nodes; and whether all counts are right. Raises where a count is too large.

    Audited are the ``audited`` nodes of least hash, and as many of those that have links, as most nodes may have none.
    """
    facts = nodes.select("node", "group", "vector")
    some = facts.orderBy(F.xxhash64("node"), "node").limit(audited).collect()
    linked = found.select("node").distinct().orderBy(F.xxhash64("node"), "node").limit(audited)
    sample = list({r.node: (r.node, r.group, bytes(r.vector)) for r in some + facts.join(F.broadcast(linked), "node").collect()}.values())
    if not sample:
        return 1.0, True
    brute = nodes.select("node", "weight", "group", "vector").mapInArrow(lean(_audit(sample, threshold)), "node long, least long, most long")
    true = {r[0]: (r[1], r[2]) for r in brute.groupBy("node").agg(F.sum("least"), F.sum("most")).collect()}
    have = dict(found.filter(F.col("node").isin([s[0] for s in sample])).groupBy("node").agg(F.sum("links")).collect())
    if over := sum(have.get(n, 0) > most for n, (_, most) in true.items()):
        raise RuntimeError(f"{over} of {len(true)} audited vectors have more links than by brute force")
    total = sum(least for least, _ in true.values())
    recall = sum(min(least, have.get(n, 0)) for n, (least, _) in true.items()) / total if total else 1.0
    return recall, all(have.get(n, 0) >= least for n, (least, _) in true.items())


class VectorLinks:
    """``rows``: vec_id, n_links, component_id, kept; ``recall``: as audited, of each attempt; the last one's rows are returned."""

    def __init__(self, rows: DataFrame, recalls: list[float]) -> None:
        self.rows, self.recalls, self.recall = rows, recalls, recalls[-1]


def _centroids(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Centroids of the groups above ``SHARD`` nodes, the largest first, as many as fit their size; a group without any is one cell."""
    large = {r[0]: r[1] for r in nodes.groupBy("group").count().filter(F.col("count") > SHARD).orderBy(F.desc("count"), "group").limit(MOST_CLUSTERS // 2).collect()}
    if not large:
        return {}
    wanted = F.broadcast(nodes.sparkSession.createDataFrame([(g,) for g in large], "group string"))
    sample: dict[str, list] = {}
    for r in nodes.select("node", "group", "vector").join(wanted, "group").orderBy("node").limit(SAMPLE).collect():
        sample.setdefault(r.group, []).append(np.frombuffer(r.vector))
    total, out = sum(large.values()), {}
    for group, rows in sample.items():
        k = min(-(-large[group] // SHARD), max(2, MOST_CLUSTERS * large[group] // total), len(rows))
        if k > 1:
            out[group] = _unit(fit_centroids(_unit(np.stack(rows)), k))
    return out


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD, work: Work | None = None) -> VectorLinks:
    """Links of columns vec_id, embedding and label."""
    work = work or Work(vectors.sparkSession, "vector-links")
    parsed = work.save(vectors.select("vec_id", "embedding", "label").mapInArrow(lean(_nodes), "vec_id long, label string, node long, vector binary"), "parsed")
    members = work.save(parsed.groupBy("vec_id", "node").agg(F.count(F.lit(1)).alias("copies")), "members")
    least = F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"))
    facts = members.filter("node is not null").groupBy("node").agg(F.sum("copies").alias("weight"), F.min(least).alias("least"))
    firsts = parsed.filter("node is not null").groupBy("node").agg(F.max("label").alias("label"), F.max("vector").alias("vector"))
    group = F.concat_ws("/", (F.length("vector") / 8).cast("long").cast("string"), "label").alias("group")
    nodes = work.save(facts.join(firsts, "node").select("node", "weight", F.col("least.id").alias("least_id"), "label", "vector", group), "nodes")

    centroids = _centroids(nodes)
    homes = work.save(nodes.mapInArrow(lean(_home(centroids)), _HOMES), "homes")
    cells = homes.groupBy("group", "cell", "split").agg(F.count(F.lit(1)).alias("m"), F.max("angle").alias("radius"))
    layout = _Layout(centroids, [(r.group, r.cell, r.m, r.radius) for r in cells.filter(F.col("split") | (F.col("m") > MOST_SHARD)).collect()])
    recalls: list[float] = []
    for attempt, (degree, beam, overlap) in enumerate(((DEGREE, BEAM, OVERLAP), (2 * DEGREE, 2 * BEAM, 4 * OVERLAP), (None, None, None))):
        visitors = homes.mapInArrow(lean(_deal(layout, {}, threshold, True, overlap)), "shard string, role int").filter(F.col("role") == VISITOR)
        chunks = {r[0]: -(-r[1] // MOST_SHARD) for r in visitors.groupBy("shard").count().filter(F.col("count") > MOST_SHARD).collect()}
        dealt = homes.mapInArrow(lean(_deal(layout, chunks, threshold, False, overlap)), "shard string, role int, node long, weight long, vector binary")
        if degree:
            dealt = work.save(dealt, f"dealt{attempt}")
            lists = dealt.groupBy("shard").applyInArrow(_build(degree), "node long, neighbours array<long>")
            flat = work.save(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), f"graph{attempt}")
            joined = dealt.join(flat, "node", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<long>")))
            links = joined.groupBy("shard").applyInArrow(_search(threshold, beam), "node long, root long, links long")
        else:
            links = dealt.groupBy("shard").applyInArrow(_compare(threshold), "node long, root long, links long")
        found = work.save(links, f"found{attempt}")
        recall, right = audit_recall(nodes, found, threshold)
        recalls.append(recall)
        if right or degree and recall >= TARGET:
            break
    else:
        raise RuntimeError(f"links of audited vectors differ from brute force; recall {recalls}")

    classes = star_components(found.select("node", "root"), work, "classes")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = work.save(classes.join(counts, "node", "left").join(nodes.select("node", "weight", "least_id"), "node"), "linked")
    heads = linked.groupBy("label").agg(F.min("least_id").alias("component_id"), F.sum("weight").alias("size"))
    total = members.agg(F.sum("copies")).first()[0] or 0
    of_class = join_sized(linked, heads, "label", "size", total).select("node", "weight", "links", "component_id")
    alone = nodes.filter("weight > 1").join(of_class.select("node"), "node", "left_anti").select("node", "weight", F.lit(0).cast("long").alias("links"), F.col("least_id").alias("component_id"))
    facts = of_class.unionByName(alone)
    joined = join_sized(members, facts, "node", "weight", total).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    component = F.when(F.col("weight").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    links = F.when(F.col("weight").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long")
    rows = joined.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    return VectorLinks(rows, recalls)
