"""What the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..session import BATCH_ROWS, python_ready, shared_dir, ship

__all__ = ["BATCH_ROWS", "Forest", "cleaned", "cut", "lower_ascii", "python_ready", "sent", "shared_dir", "shared_path", "spread_join", "table"]

#: Spark then deletes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """DataFrames that are made and computed inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once and cuts its lineage, by a checkpoint in the shared folder; the shuffle files behind it go then."""
    with cleaned(df.sparkSession):
        return session.cut(df.select("*"))  # a DataFrame keeps the setting that it was made with


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    """A-Z lower-cased, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Ids up to which they are broadcast.
BROADCAST_IDS = 2_000_000


def sent(ids: DataFrame) -> DataFrame:
    """Ids as a table that is broadcast if it was counted to be small enough; else it is joined by a shuffle."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Rows of one key beyond which a join deals them to several tasks.
HOT_ROWS = 20_000


def spread_join(big: DataFrame, small: DataFrame, key: str, hot_rows: int = HOT_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Inner join on ``key``, where ``small`` has a key once. Keys with more than hot_rows rows in ``big`` are dealt to several tasks,
    and their row of ``small`` goes to each. Such keys are counted (unless ``counts`` has key and count of each key): of n rows they are n / hot_rows at most."""
    counts = big.groupBy(key).count() if counts is None else counts
    hot = cut(counts.filter(F.col("count") > hot_rows).select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("__parts")))
    if hot.isEmpty():
        return big.join(small, key)
    rest = [c for c in big.columns if c != key]
    hot = hot.withColumnRenamed(key, "__hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot
    parts, is_hot = F.coalesce("__parts", F.lit(1)), F.col(key) == F.col("__hot")
    left = big.join(hot, is_hot, "left").withColumn("__part", F.pmod(F.xxhash64(*rest) if rest else F.lit(0).cast("long"), parts).cast("int")).drop("__parts", "__hot")
    right = small.join(hot, is_hot, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts", "__hot")
    return left.join(right, [key, "__part"]).drop("__part")


class Forest:
    """Sets of numbers that are joined; the least of a set is its root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def add(self) -> int:
        self.up.append(len(self.up))
        return len(self.up) - 1

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y
