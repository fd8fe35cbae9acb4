"""Storage that the driver and all executors share: reliable checkpoints, and small texts that are replaced as a whole."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs in one process.
LOCAL_DEFAULT = "/tmp/checkpoints/tidemark"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir`` and read from there, so that it is the same each time it is read."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or LOCAL_DEFAULT)
    return df.checkpoint()


def _place(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file on any file system that Spark reads, or None if there is none."""
    place = _place(spark, path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a file by renaming a new one over it, so that a reader sees the old text or the new one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, place = _place(spark, f"{path}.new"), _place(spark, path)
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.getFileSystem(conf).getUri(), conf).rename(new, place, how)
