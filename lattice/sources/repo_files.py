"""Source trees as tables: raw_files(rel, size, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "rel string, size long, content binary"


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below ``root``, a path that Spark can read, hidden ones included. Contents are read where they are used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    prefix = root.rstrip("/") + "/"
    at = F.locate(prefix, F.col("path"))
    rel = F.substring(F.col("path"), at + len(prefix), F.length("path"))
    return files.select(rel.alias("rel"), F.col("length").alias("size"), "content")


def from_texts(spark: SparkSession, texts: dict[str, str | None]) -> DataFrame:
    """raw_files of a small tree in memory; a null text is a file that can't be read."""
    rows = [(rel, len(t.encode()) if t is not None else 0, t.encode() if t is not None else None) for rel, t in texts.items()]
    return spark.createDataFrame([(r, s, bytearray(c) if c is not None else None) for r, s, c in rows], RAW)
