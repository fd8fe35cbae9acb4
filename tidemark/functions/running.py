"""Running sums and maxima over numbered blocks, without one task for all blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Blocks that one task sees in order; the last step has a row for each GROUP blocks.
GROUP = 1 << 16


def before(blocks: DataFrame, key: str, value: str, kind: str, group: int = GROUP) -> DataFrame:
    """``key`` (a long, unique) and ``earlier``: the ``kind`` (max or sum) of ``value`` over all rows with a smaller key; null for the first.

    Within groups of neighbouring keys first, then over the groups: with blocks of 4096 points, 2 ** 40 points are 4096 groups.
    """
    how = {"max": F.max, "sum": F.sum}[kind]
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    own = blocks.select(F.col(key), F.col(value).alias("own"), F.floor(F.col(key) / group).alias("group"))
    groups = own.groupBy("group").agg(how("own").alias("whole")).select("group", how("whole").over(ahead(Window.orderBy("group"))).alias("above"))
    inner = own.withColumn("inner", how("own").over(ahead(Window.partitionBy("group").orderBy(key))))
    both = F.greatest("above", "inner") if kind == "max" else F.coalesce(F.col("above") + F.col("inner"), "above", "inner")
    return inner.join(groups, "group").select(key, both.alias("earlier"))
