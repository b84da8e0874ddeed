"""Differences between two states."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Cells of the table up to which the longest common subsequence is taken.
LCS_CELLS = 1_000_000


def fingerprint_diff(before: DataFrame, after: DataFrame, key: str, print_: str) -> DataFrame:
    """status of each key: added, removed, modified or unchanged."""
    a, b = before.select(key, F.col(print_).alias("before"), F.lit(True).alias("in_a")), after.select(key, F.col(print_).alias("after"), F.lit(True).alias("in_b"))
    status = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, "before", "after", status.alias("status"))


def renames(removed: DataFrame, added: DataFrame, key: str, print_: str) -> DataFrame:
    """old and new key of content that is unique on both sides."""
    one = lambda df, name: df.groupBy(F.col(print_).alias("__h")).agg(F.min(key).alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")
    return one(removed, "old").join(one(added, "new"), "__h").select("old", "new")


def affected_targets(before: DataFrame, after: DataFrame) -> DataFrame:
    """added and removed sources (target, source, distinct on each side) of the targets where there are any."""
    both = before.withColumn("a", F.lit(1)).join(after.withColumn("b", F.lit(1)), ["target", "source"], "full_outer")
    return both.groupBy("target").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed")).filter("added + removed > 0")


def diff_lines(before: list[str], after: list[str]) -> list[tuple[str, int, str]]:
    """(side, line from 1, text) of what was removed and added. Equal ends are set aside; the middle is compared by a longest
    common subsequence if its table is small enough, else all of it counts as changed."""
    lo = 0
    while lo < len(before) and lo < len(after) and before[lo] == after[lo]:
        lo += 1
    end = 0
    while end < len(before) - lo and end < len(after) - lo and before[-1 - end] == after[-1 - end]:
        end += 1
    a, b = before[lo : len(before) - end], after[lo : len(after) - end]
    kept_a, kept_b = set(), set()
    if len(a) * len(b) <= LCS_CELLS:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                kept_a.add(i)
                kept_b.add(j)
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    return [("removed", lo + i + 1, x) for i, x in enumerate(a) if i not in kept_a] + [("added", lo + j + 1, x) for j, x in enumerate(b) if j not in kept_b]


def line_deltas(pairs: DataFrame) -> DataFrame:
    """rel, side, line and text of the lines that differ between before and after (texts; null: no lines) of each rel."""
    ship(pairs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for rel, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                lines = [x.split("\n") if x is not None else [] for x in (before, after)]
                out.extend((rel, *row) for row in diff_lines(*lines))
            rels, sides, numbers, texts = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(rels, pa.string()), pa.array(sides, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=["rel", "side", "line", "text"])

    return pairs.select("rel", "before", "after").mapInArrow(made, "rel string, side string, line int, text string")
