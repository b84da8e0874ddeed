"""File events as a stream: the newest fingerprint of each path, kept as one snapshot for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bounds import first_by

EVENT = "path string, content_hash string, version long"


def latest(before: DataFrame, events: DataFrame) -> DataFrame:
    """path, content_hash and version after ``events``: the highest version of each path; a null hash deletes it. Equal
    versions keep the lesser hash, so that a batch that comes twice changes nothing."""
    both = before.select("path", "content_hash", "version").unionByName(events.select("path", "content_hash", "version"))
    return first_by(both, ["path"], [-F.col("version"), F.col("content_hash")])


def follow(stream: DataFrame, folder: str, checkpoint: str):
    """Starts the query that keeps ``folder``/batch=N up to date with a stream of EVENT rows. Deleted paths stay as rows
    with a null hash, as older events may still come. A batch that is run again writes the same folder again."""

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{folder}/batch={n - 1}") if n else spark.createDataFrame([], EVENT)
        latest(before, batch).write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
