"""The name tree: leaves with ids, their inner nodes, search by glob, and deletes.

A node table has name, is_leaf, id (0 for inner nodes), retentions. Inner nodes are the proper prefixes of leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import globs, names, shared
from ..functions.policies import DEFAULT

MAX_SERIES, ROOT_ID = 30_000, 1


class TooManyMetrics(Exception):
    pass


def nodes_of(leaves: DataFrame, retentions: str = DEFAULT) -> DataFrame:
    """The node table of leaves (name, id)."""
    archives = F.array(*[F.lit(x) for x in retentions.split(",")])
    leaf = leaves.select("name", F.lit(True).alias("is_leaf"), F.col("id").cast("long").alias("id"), archives.alias("retentions"))
    inner = leaves.select(F.explode(names.ancestors(F.col("name"))).alias("name")).distinct()
    return leaf.unionByName(inner.select("name", F.lit(False).alias("is_leaf"), F.lit(0).cast("long").alias("id"), F.array().cast("array<string>").alias("retentions")))


def new_names(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Valid names of points that aren't in the tree."""
    return points.filter(names.is_valid(F.col("name"))).select("name").distinct().join(nodes.select("name"), "name", "left_anti")


def leaf_conflicts(candidates: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Names that can't be leaves: one of their prefixes is a leaf or an earlier candidate, or they are themselves a prefix.

    ``candidates`` has name and seq; of two candidates in conflict the one that came first is created.
    """
    ahead = candidates.groupBy("name").agg(F.min("seq").alias("seq"))
    known = ahead
    if nodes is not None:
        known = known.unionByName(nodes.filter("is_leaf").select("name", F.lit(-1).cast("long").alias("seq")))
    known = known.groupBy("name").agg(F.min("seq").alias("seq"))
    up = ahead.select("name", "seq", F.explode(names.ancestors(F.col("name"))).alias("above"))
    owners = known.select(F.col("name").alias("above"), F.col("seq").alias("above_seq"))
    pairs = up.join(owners, "above")
    below = pairs.filter("above_seq < seq").select("name")
    over = pairs.filter("above_seq > seq").select(F.col("above").alias("name"))
    out = below.unionByName(over)
    if nodes is not None:
        out = out.unionByName(ahead.join(nodes.filter("NOT is_leaf"), "name", "left_semi").select("name"))
    return out.distinct()


def assign_ids(new: DataFrame, highest: int) -> DataFrame:
    """(name, id) with ids from ``highest`` + 1 on, in order of name.

    Names are numbered within ranges and the ranges' sizes are summed, so no task numbers all of them. Ranges depend on a sample, so the
    names are written with their places before the sizes are taken.
    """
    n = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = new.select("name").distinct().repartitionByRange(n, "name").sortWithinPartitions("name")
    placed = ordered.select("name", F.monotonically_increasing_id().alias("__at"))
    placed = shared.checkpointed(placed.select("name", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__row")))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # a row for each partition
    return placed.join(F.broadcast(starts), "__part").select("name", (F.col("__before") + F.col("__row") + highest + 1).alias("id"))


def create(nodes: DataFrame, points: DataFrame, retentions: str = DEFAULT) -> DataFrame:
    """The node table after the new names of points (name, seq) have been created; names in conflict are left out."""
    new = new_names(points, nodes)
    candidates = points.join(new, "name", "left_semi").groupBy("name").agg(F.min("seq").alias("seq"))
    good = candidates.join(leaf_conflicts(candidates, nodes), "name", "left_anti")
    highest = nodes.agg(F.max("id")).first()[0] or ROOT_ID
    leaves = nodes.filter("is_leaf").select("name", "id").unionByName(assign_ids(good, max(highest, ROOT_ID)))
    return nodes_of(leaves, retentions)


def lookup(nodes: DataFrame, name: str | None = None, metric_id: int | None = None) -> DataFrame:
    return nodes.filter(F.col("name") == name) if name is not None else nodes.filter((F.col("id") == metric_id) & F.col("is_leaf"))


def scan_ids(nodes: DataFrame, start: int, end: int) -> DataFrame:
    return nodes.filter(F.col("is_leaf") & F.col("id").between(start, end)).orderBy("id")


def find(nodes: DataFrame, pattern: str, leaf_only: bool = False, skip_invalid: bool = True, max_series: int | None = MAX_SERIES) -> DataFrame:
    """Nodes that a glob matches. More than ``max_series`` of them are an error, unless the pattern has one segment."""
    out = nodes.filter(globs.glob_matches(F.col("name"), pattern))
    if leaf_only:
        out = out.filter("is_leaf")
    if skip_invalid:
        out = out.filter(names.is_valid(F.col("name")))
    if max_series is not None and len(globs.split_pattern(pattern)) > 1 and out.limit(max_series + 1).count() > max_series:
        raise TooManyMetrics(f"more than {max_series} metrics match {pattern}")
    return out


def children(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """Direct children of a node, or the top level."""
    if name is None:
        return nodes.filter(F.instr("name", ".") == 0)
    return nodes.filter(F.col("name").startswith(name + ".") & (names.depth(F.col("name")) == len(name.split(".")) + 1))


def random_metrics(nodes: DataFrame, n: int = 1, seed: int | None = None) -> DataFrame:
    return nodes.filter("is_leaf").orderBy(F.rand(seed)).limit(n)


def subtree(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter((F.col("name") == name) | F.col("name").startswith(name + "."))


def delete_subtree(nodes: DataFrame, name: str, recursive: bool = False, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes that are left, nodes deleted). An inner node needs ``recursive``; inner nodes without leaves go, too."""
    gone = subtree(nodes, name)
    if not recursive and not gone.filter("NOT is_leaf").isEmpty():
        raise ValueError(f"{name} has nodes below it")
    left = nodes if dry_run else nodes.join(gone.select("name"), "name", "left_anti")
    return left, gone


def suffix_matches(nodes: DataFrame, segments: Sequence[str]) -> DataFrame:
    """Nodes whose last segments are the given ones, without those below another such node."""
    n = len(segments)
    own = names.parts(F.col("name"))
    hit = nodes.filter((F.size(own) >= n) & (F.slice(own, F.size(own) - n + 1, F.lit(n)) == F.array(*[F.lit(s) for s in segments])))
    above = hit.select("name", F.explode(names.ancestors(F.col("name"))).alias("above"))
    nested = above.join(hit.select(F.col("name").alias("above")), "above", "left_semi").select("name").distinct()
    return hit.join(nested, "name", "left_anti")


def delete_names(nodes: DataFrame, pattern: str, exclude: Sequence[str] = (), dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes that are left, one row total_count, leaf_count) for a glob, or for ``**.a.b``: all subtrees that end in these segments.

    A child named in ``exclude`` stays with all below it, and so do its ancestors. Points stay in the archives.
    """
    roots = suffix_matches(nodes, pattern[3:].split(".")) if pattern.startswith("**.") else find(nodes, pattern, skip_invalid=False, max_series=None)
    roots = roots.select(F.col("name").alias("root"))
    up = nodes.select("name", "is_leaf", F.explode(F.array_union(names.ancestors(F.col("name")), F.array("name"))).alias("root"))
    below = up.join(roots, "root").select("name", "is_leaf", "root")
    deep = F.slice(names.parts(F.col("name")), names.depth(F.col("root")) + 1, names.depth(F.col("name")))
    kept = F.arrays_overlap(deep, F.array(*[F.lit(e) for e in exclude])) if exclude else F.lit(False)
    below = below.withColumn("kept", F.coalesce(kept, F.lit(False)))
    stays = below.filter("kept").select("root", F.explode(names.ancestors(F.col("name"))).alias("name")).distinct()
    gone = below.filter("NOT kept").join(stays, ["root", "name"], "left_anti").select("name", "is_leaf").distinct()
    counts = gone.agg(F.count(F.lit(1)).alias("total_count"), F.count_if("is_leaf").alias("leaf_count"))
    return (nodes if dry_run else nodes.join(gone.select("name"), "name", "left_anti")), counts


def inactive_namespaces(points: DataFrame, now: int, window: int = 900, rate: float = 0.1, grace: int = 7200) -> DataFrame:
    """namespace, points, last_ts, removable: namespaces with fewer than ``rate`` points a second in the last ``window`` seconds."""
    recent = F.count_if((F.col("ts") > now - window) & (F.col("ts") <= now))
    own = points.filter(F.col("ts") <= now).groupBy(names.namespace(F.col("name")).alias("namespace")).agg(recent.alias("points"), F.max("ts").alias("last_ts"))
    return own.filter(F.col("points") / window < rate).withColumn("removable", F.col("last_ts") <= now - grace)


def merged_keys(*changed: DataFrame) -> DataFrame:
    """The sorted union of keys that changed, for read-only copies."""
    out = changed[0].select("name")
    for c in changed[1:]:
        out = out.unionByName(c.select("name"))
    return out.distinct().orderBy("name")
