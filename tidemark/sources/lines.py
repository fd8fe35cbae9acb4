"""Points as text lines ``name value seconds``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "name string, val double, ts long, seq long"


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Adds name, val, ts and ``ok``: three words divided by spaces, a double and a 32-bit integer. Other lines have ok false."""
    words = F.filter(F.split(F.trim(F.regexp_replace(column, r"[\r\n]+", "")), " "), lambda w: w != "")
    split = lines.withColumn("__words", words)
    rows = split.withColumns({
        "name": F.try_element_at("__words", F.lit(1)),
        "val": F.expr("try_cast(try_element_at(__words, 2) AS DOUBLE)"),
        "ts": F.expr("try_cast(try_element_at(__words, 3) AS INT)").cast("long"),
    })
    ok = (F.size("__words") == 3) & F.col("val").isNotNull() & F.col("ts").isNotNull()
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("__words")


def points_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter("ok").select("name", "val", "ts", *[c for c in ("seq",) if c in parsed.columns])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Points of text files (also .gz), seq in the order of files and lines."""
    rows = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    return points_of(parse_lines(rows))


def counts(parsed: DataFrame) -> DataFrame:
    """received and invalid lines."""
    return parsed.agg(F.count(F.lit(1)).alias("received"), F.count_if(~F.col("ok")).alias("invalid"))
