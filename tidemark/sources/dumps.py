"""Series as text: ``name|start|step|v,v,index:v``. An index, in steps from the start, stands only after a hole."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import names


def series_lines(points: DataFrame, step: int, keys: Sequence[str] = ("name",), compat: bool = False) -> DataFrame:
    """(keys, line): one line for each series of points (keys, ts, val)."""
    own = Window.partitionBy(*keys).orderBy("ts")
    first = F.min("ts").over(Window.partitionBy(*keys))
    at = F.floor((F.col("ts") - first + step - 1) / step).cast("long")
    rows = points.withColumn("__first", first).withColumn("__at", at).withColumn("__before", F.lag("__at", 1, -1).over(own))
    value = names.compat_value(F.col("val")) if compat else names.plain_value(F.col("val"))
    cell = F.when(F.col("__at") == F.col("__before") + 1, value).otherwise(F.concat(F.col("__at").cast("string"), F.lit(":"), value))
    lists = rows.withColumn("__cell", cell).groupBy(*keys, F.col("__first")).agg(F.array_sort(F.collect_list(F.struct("ts", "__cell"))).alias("__cells"))
    line = F.concat_ws("|", F.col("name"), F.col("__first").cast("string"), F.lit(str(step)), F.array_join(F.transform("__cells", lambda c: c["__cell"]), ","))
    return lists.select(*keys, line.alias("line"))


def parse_series(lines: DataFrame, column: str = "value") -> DataFrame:
    """(name, val, ts) of series lines; blank ones and those that begin with ``ignore.`` are skipped."""
    rows = lines.filter((F.trim(column) != "") & ~F.trim(column).startswith("ignore.")).select(F.split(F.trim(column), r"\|").alias("p")).filter(F.size("p") == 4)
    cells = F.transform(F.split(F.col("p")[3], ","), lambda c: F.split(c, ":"))
    empty = F.array().cast("array<struct<at:bigint,val:double>>")

    def add(state, cell):
        at = F.when(F.size(cell) == 2, cell[0].cast("long")).otherwise(state["next"])
        value = F.element_at(cell, -1).cast("double")
        return F.struct((at + 1).alias("next"), F.concat(state["rows"], F.array(F.struct(at.alias("at"), value.alias("val")))).alias("rows"))

    found = F.aggregate(cells, F.struct(F.lit(0).cast("long").alias("next"), empty.alias("rows")), add, lambda s: s["rows"])
    out = rows.select(F.col("p")[0].alias("name"), F.col("p")[1].cast("long").alias("start"), F.col("p")[2].cast("long").alias("step"), F.explode(found).alias("r"))
    return out.select("name", F.col("r.val").alias("val"), (F.col("start") + F.col("step") * F.col("r.at")).alias("ts"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return parse_series(spark.read.text(path))
