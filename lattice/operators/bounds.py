"""Ranking, deduplication, and limits that account for what they hide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under ``order``, as one aggregation: it combines before the shuffle, unlike a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def precedence_dedupe(df: DataFrame, keys: list[str], precedence: list[Column], ties: list[str]) -> DataFrame:
    """The row of the highest precedence for each key; of equals the first under ``ties``. Precedences are numbers."""
    return first_by(df, keys, [*[-p for p in precedence], *[F.col(t) for t in ties]])


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with position (from 1), and observed, shown and hidden of the group. A larger k
    keeps a smaller one's rows."""
    w = Window.partitionBy(*group)
    counted = df.withColumn("position", F.row_number().over(w.orderBy(*order))).withColumn("observed", F.count("*").over(w))
    shown = F.least(F.col("observed"), F.lit(k).cast("long"))
    return counted.filter(F.col("position") <= k).withColumn("shown", shown).withColumn("hidden", F.col("observed") - shown)


def round_robin(df: DataFrame, bucket: list[str], order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows, one of each bucket in turn; buckets go by their first row. Within a bucket only its first
    ``limit`` rows are ranked against the others, as no more can be shown."""
    keys = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    ranked = df.withColumn("__key", F.struct(*keys))
    w = Window.partitionBy(*bucket)
    ranked = ranked.withColumn("turn", F.row_number().over(w.orderBy("__key"))).filter(F.col("turn") <= limit).withColumn("__first", F.min("__key").over(w))
    return ranked.orderBy("turn", "__first").limit(limit).drop("__key", "__first")


def canonical_edges(edges: DataFrame, type_priority: Column) -> DataFrame:
    """Edges without repetitions of (from, to, type, evidence), each with its canonical sort key as columns."""
    kept = first_by(edges.withColumn("priority", type_priority), ["from", "to", "type", "evidence"], [F.col("priority")])
    return kept


def group_examples(df: DataFrame, group: list[str], example: str, shown: int = 5) -> DataFrame:
    """count, the first examples in order, and how many are hidden, of each group's distinct examples. Each task keeps
    only its first ones, so that a large group is never gathered."""
    distinct = df.select(*group, example).distinct()
    counts = distinct.groupBy(*group).agg(F.count("*").alias("count"))
    firsts = distinct.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(example))).filter(F.col("__n") <= shown).groupBy(*group).agg(F.sort_array(F.collect_list(example)).alias("examples"))
    return counts.join(firsts, group).withColumn("hidden", F.col("count") - F.size("examples"))


def shared_budget(rows: DataFrame, scope: list[str], group: list[str], order: list[Column], precedence: Column, budget: int) -> DataFrame:
    """Of each scope the first ``budget`` rows, taken from its groups in turns, with position (from 0).

    Groups take turns by falling ``precedence`` (an aggregate of a group's rows), then by name; a group that has run out is passed over, so that what it leaves goes to
    the others. Every group's share is computed from the sizes of all groups of its scope: a level that as many full rounds reach, and one row
    more for the first groups that have more. No scope is sorted as a whole: rows are ranked within groups, to the budget at most, which
    Spark applies before the shuffle, too.
    """
    sizes = rows.groupBy(*scope, *group).agg(F.count("*").alias("__n"), precedence.alias("__p"))
    by_size = Window.partitionBy(*scope).orderBy("__n", *group)
    turns = Window.partitionBy(*scope).orderBy(F.desc("__p"), *group)
    everyone = Window.partitionBy(*scope)
    below = F.sum("__n").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    # with the smaller groups taken whole, how many rows each of the others can have
    left = F.floor((F.lit(budget) - F.coalesce(below, F.lit(0))) / (F.count("*").over(everyone) - F.row_number().over(by_size) + 1))
    levelled = sizes.withColumn("__left", left)
    # the first group that doesn't fit gives the level; those after it in size have at least as many rows
    first = F.min_by(F.col("__left"), F.struct(F.col("__n"), *[F.col(g) for g in group]))
    short = levelled.filter(F.col("__left") < F.col("__n")).groupBy(*scope).agg(first.alias("__level"))
    quota = levelled.join(short, scope, "left").withColumn("__level", F.coalesce("__level", F.lit(budget))).withColumn("__turn", F.row_number().over(turns))
    full = F.least("__n", "__level")
    quota = quota.withColumn("__rest", F.lit(budget) - F.sum(full).over(everyone))
    more = (F.col("__n") > F.col("__level")).cast("int")
    quota = quota.withColumn("__more", F.sum(more).over(turns.rowsBetween(Window.unboundedPreceding, 0)))
    share = full + F.when((F.col("__n") > F.col("__level")) & (F.col("__more") <= F.col("__rest")), 1).otherwise(0)
    quota = quota.select(*scope, *group, share.alias("__share"), "__turn")
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*scope, *group).orderBy(*order))).filter(F.col("__k") <= budget)
    kept = ranked.join(quota, [*scope, *group]).filter(F.col("__k") <= F.col("__share"))
    position = F.row_number().over(Window.partitionBy(*scope).orderBy("__k", "__turn")) - 1
    return kept.withColumn("position", position).drop("__k", "__share", "__turn")
