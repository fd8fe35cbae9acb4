"""Connected components of an edge table, by hooking and contraction; every round is a written table.

A round hooks each node to the least of its neighbours and itself, follows that hook once more, and replaces the ends of all
edges by what they are hooked to; equal edges and loops go, so later rounds work on ever fewer edges. The hooks of all rounds
are put together at the end, from the last and smallest to the first. Hubs are met by partial aggregation and by splitting skewed joins;
no component comes together in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .work import Work, join_sized


def components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """From columns a, b (long, not null): node, label, where label is the least node that can be reached. Loops are ignored."""
    pairs = edges.filter("a <> b").select("a", "b")
    now = work.save(pairs.union(pairs.select("b", "a")).distinct(), f"{name}-edges0")
    hooks: list[DataFrame] = []
    while not now.isEmpty():
        n = len(hooks)
        near = work.save(now.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), f"{name}-near{n}")
        further = near.select(F.col("a").alias("to"), F.col("to").alias("further"))
        hooked = work.save(near.join(further, "to").select("a", F.col("further").alias("to")), f"{name}-hooks{n}")
        hooks.append(hooked)
        one = now.join(hooked.withColumnRenamed("to", "x"), "a").select("x", "b")
        two = one.join(hooked.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").filter("x <> y")
        now = work.save(two.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{name}-edges{n + 1}")
    if not hooks:
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = hooks.pop()
    while hooks:
        last = labels.select(F.col("a").alias("to"), F.col("to").alias("last"))
        labels = work.save(hooks.pop().join(last, "to", "left").select("a", F.coalesce("last", "to").alias("to")), f"{name}-labels{len(hooks)}")
    return labels.select(F.col("a").alias("node"), F.col("to").alias("label"))


def star_components(stars: DataFrame, work: Work, name: str) -> DataFrame:
    """From columns node, root: node, label. Each node has few different roots, and each root has a row of its own, as node and root.

    Nodes are settled on their least root first; only the different pairs of roots that some node brings together go through rounds.
    """
    held = work.save(stars.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots")), f"{name}-stars")
    first = held.select("node", F.col("roots")[0].alias("first"))
    several = held.filter("size(roots) > 1").select("roots").distinct()
    between = several.select(F.explode(F.expr("slice(roots, 2, size(roots) - 1)")).alias("a"), F.col("roots")[0].alias("b"))
    settled = components(between, work, name)
    sizes = first.groupBy("first").agg(F.count(F.lit(1)).alias("size"))
    facts = sizes.join(settled.withColumnRenamed("node", "first"), "first", "left")
    joined = join_sized(first, facts, "first", "size", held.count())
    return work.save(joined.select("node", F.coalesce("label", "first").alias("label")), f"{name}-labels")
