"""Settings that configurations inherit along chains of ``extends``, by pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A string, or a comment of either kind. Strings come first, so that what looks like a comment in one is kept.
_COMMENT = r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*(?s:.*?)\*/'
_TRAILING = r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])'


def plain_json(text: Column) -> Column:
    """JSON with comments and trailing commas as plain JSON."""
    return F.regexp_replace(F.regexp_replace(text, _COMMENT, "$1"), _TRAILING, "$1")


def inherited(nodes: DataFrame) -> DataFrame:
    """node, settings, length and cyclic. nodes: node, parent (null, or one that there is none of: the end), settings (a map).

    A key has the value of the nearest node of the chain that sets it. In each round every node takes over what the node at its pointer has
    gathered and then points where that one points: chains of n nodes take log2(n) rounds, each a join on the pointer. length counts the nodes above. A node
    on a cycle or behind one is cyclic and keeps what the chain sets, nearest first. Of a repeated node one row counts, the least by parent.
    """
    one = nodes.groupBy("node").agg(F.min_by(F.struct("parent", "settings"), F.coalesce("parent", F.lit(""))).alias("x")).select("node", "x.parent", F.coalesce("x.settings", F.create_map().cast("map<string,string>")).alias("settings"))
    known = one.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    now = one.join(known, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("at"), "settings", F.when(F.col("there"), 1).otherwise(0).cast("long").alias("length"))
    now = cut(now)
    total, covered = now.count(), 1
    while True:
        # a chain without a cycle has fewer steps than there are nodes
        if covered > total or now.filter("at IS NOT NULL").isEmpty():
            break
        above = now.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("settings").alias("theirs"), F.col("length").alias("more"))
        met = now.join(above, "at", "left")
        own = F.coalesce("theirs", F.create_map().cast("map<string,string>"))
        kept = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys("settings"), k))
        now = cut(met.select("node", F.col("next").alias("at"), F.map_concat("settings", kept).alias("settings"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")))
        covered *= 2
    cyclic = F.col("at").isNotNull()
    return now.select("node", "settings", F.when(~cyclic, F.col("length")).alias("length"), cyclic.alias("cyclic"))
