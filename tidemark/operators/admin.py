"""Exports, listings and clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import globs, names
from ..functions.policies import Policy
from ..sources.dumps import series_lines
from . import index, store


def list_metrics(nodes: DataFrame, pattern: str) -> DataFrame:
    """All nodes that a glob matches, invalid names too, without a limit."""
    return index.find(nodes, pattern, skip_invalid=False, max_series=None)


def dump_names(nodes: DataFrame, wildcard: str = "*", start_id: int = 0, start_name: str | None = None, count: int | None = None) -> DataFrame:
    """(id, name) of leaves in order of id, from an id or a name on."""
    leaves = nodes.filter(F.col("is_leaf") & globs.wildcard_matches(F.col("name"), wildcard))
    if start_name is not None:
        row = index.lookup(nodes, name=start_name).first()
        start_id = row.id if row else 0
    out = leaves.filter(F.col("id") >= start_id).select("id", "name").orderBy("id")
    return out.limit(count) if count is not None else out


def dump_lines(nodes: DataFrame, archive: DataFrame, start: int, end: int, wildcard: str = "*", start_name: str | None = None) -> DataFrame:
    """(id, name, ts, val) of points from start to end, both included, by id and time, from a name on."""
    leaves = dump_names(nodes, wildcard, start_name=start_name)
    return leaves.join(archive.filter(F.col("ts").between(start, end)).select("name", "ts", "val"), "name").select("id", "name", "ts", "val").orderBy("id", "ts")


def dump_series(nodes: DataFrame, archive: DataFrame, policy: Policy, start: int, end: int, wildcard: str = "*", cursor: int = 0, count: int | None = None) -> tuple[DataFrame, int | None]:
    """((id, line) of metrics with points, by id; the id at which the next page begins, or None)."""
    leaves = dump_names(nodes, wildcard, start_id=cursor)
    points = leaves.join(archive.filter(F.col("ts").between(start, end)).select("name", "ts", "val"), "name")
    lines = series_lines(points, policy.precision, keys=("id", "name")).orderBy("id")
    if count is None:
        return lines, None
    following = lines.limit(count + 1).select("id").collect()
    return lines.limit(count), following[count].id if len(following) > count else None


def stale_series(nodes: DataFrame, archives: Mapping[str, DataFrame] | Sequence[DataFrame], since: int, count: int | None = None) -> DataFrame:
    """Leaves with an invalid name, or without any point since a time in any archive. Delete them with ``store.delete_points``."""
    frames = list(archives.values()) if isinstance(archives, Mapping) else list(archives)
    leaves = nodes.filter("is_leaf")
    live = leaves.filter(names.is_valid(F.col("name")))
    for a in frames:
        live_names = a.filter(F.col("ts") >= since).select("name").distinct()
        live = live.join(live_names, "name", "left_anti")
    out = live.select("name", "id").unionByName(leaves.filter(~names.is_valid(F.col("name"))).select("name", "id"))
    return out.orderBy("id").limit(count) if count is not None else out


class NoSuchMetric(Exception):
    pass


def list_points(nodes: DataFrame, archive: DataFrame, name: str | None = None, metric_id: int | None = None) -> DataFrame:
    """All points of a leaf, in order of time."""
    row = index.lookup(nodes, name, metric_id).filter("is_leaf").select("name").first()
    if row is None:
        raise NoSuchMetric(str(name if name is not None else metric_id))
    return archive.filter(F.col("name") == row["name"]).select("name", "ts", "val").orderBy("ts")


def all_below(nodes: DataFrame, name: str) -> DataFrame:
    """A node and all below it, each before its children."""
    return index.subtree(nodes, name).select("name").orderBy(names.parts(F.col("name")))


def delete_time(archive: DataFrame, policy: Policy, ts: int) -> tuple[DataFrame, DataFrame]:
    return store.delete_at(archive, policy, ts)


def orphans(nodes: DataFrame, archives: Sequence[DataFrame], skip_prefixes: Sequence[str] = ()) -> DataFrame:
    """Leaves (name, id) without a point in any archive, but for those below the given prefixes."""
    out = nodes.filter("is_leaf")
    for p in skip_prefixes:
        out = out.filter(~F.col("name").startswith(p))
    for a in archives:
        out = out.join(a.select("name").distinct(), "name", "left_anti")
    return out.select("name", "id")


def orphan_prefixes(nodes: DataFrame, archives: Sequence[DataFrame], segments: int) -> DataFrame:
    """The first segments of orphans, distinct, where nothing else lies below them: what can be purged as a whole."""
    cut = names.prefix(F.col("name"), segments)
    lost = orphans(nodes, archives).select("name", cut.alias("prefix"))
    alive = nodes.filter("is_leaf").join(lost.select("name"), "name", "left_anti").select(cut.alias("prefix")).distinct()
    return lost.select("prefix").distinct().join(alive, "prefix", "left_anti")


def parent_leaves(nodes: DataFrame) -> DataFrame:
    """Leaves that are also a prefix of another leaf."""
    leaves = nodes.filter("is_leaf")
    above = leaves.select(F.explode(names.ancestors(F.col("name"))).alias("name")).distinct()
    return leaves.join(above, "name", "left_semi").select("name", "id")
