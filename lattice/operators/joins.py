"""Joins by prefix, pattern and range, as equi-joins wherever one side can be spread over keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, glob_regex
from .bounds import first_by
from .tries import glob_kinds, matches

#: Rows up to which a side is broadcast, after it was counted.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; the count stops there."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def longest_prefix(items: DataFrame, path: str, key: list[str], prefixes: DataFrame, prefix: str) -> DataFrame:
    """Each item with the longest of the prefixes that is one of its path's ancestors or itself, else null. Ancestors are
    spread over rows and joined by equality, so neither side is scanned for each row of the other."""
    spread = items.select(*key, F.explode(ancestors(F.col(path))).alias(prefix))
    found = spread.join(prefixes.select(prefix).distinct(), prefix)
    best = found.groupBy(*key).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return items.join(best, key, "left")


def glob_join(items: DataFrame, path: str, rules: DataFrame, glob: str) -> DataFrame:
    """Items with each rule whose glob matches. Globs are walked as a trie (``tries``), so there may be any number; only those with a ``**`` inside a segment,
    which no trie of segments can hold, are tried one by one."""
    spanning = F.rlike(F.col(glob), F.lit(r"[^/]\*\*|\*\*[^/]"))
    met = matches(items, path, rules.filter(~spanning).select(F.col(glob).alias("pattern")), glob_kinds(F.col("pattern")))
    walked = items.join(met.select(path, F.col("pattern").alias("__glob")), path).join(rules, F.col("__glob") == F.col(glob)).drop("__glob")
    rest = small(rules.filter(spanning).withColumn("__regex", glob_regex(F.col(glob))))
    tried = items.join(rest, F.rlike(F.col(path), F.col("__regex"))).drop("__regex")
    return walked.select(*items.columns, *rules.columns).unionByName(tried.select(*items.columns, *rules.columns))


def range_join(points: DataFrame, point: Column, ranges: DataFrame, low: Column, high: Column, width: int, on: list[str] | None = None) -> DataFrame:
    """Points within [low, high] of a range, all integers: both sides meet in buckets of ``width``, so that it is an
    equi-join. A range falls into (high - low) / width + 2 buckets at most."""
    p = points.withColumn("__bucket", F.floor(point / width))
    r = ranges.withColumn("__low", low).withColumn("__high", high).withColumn("__bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    joined = p.withColumn("__point", point).join(r, ["__bucket", *(on or [])])
    return joined.filter((F.col("__point") >= F.col("__low")) & (F.col("__point") <= F.col("__high"))).drop("__bucket", "__low", "__high", "__point")


def ranked_lookup(items: DataFrame, key: list[str], candidates: DataFrame, target: str, existing: DataFrame, existing_key: str) -> DataFrame:
    """Each item with the first of its candidates (key, rank, target) that exists, else null."""
    found = candidates.join(existing.select(F.col(existing_key).alias(target)).distinct(), target)
    return items.join(first_by(found.select(*key, "rank", target), key, [F.col("rank"), F.col(target)]).drop("rank"), key, "left")
