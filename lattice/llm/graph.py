"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of each node of ``edges`` (a, b) but the roots themselves.

    Each round ends in a checkpoint. Edges go to their larger or smaller end's least neighbour until nothing changes;
    rounds grow with the logarithm of a component's size. Least neighbours are aggregated before they are shuffled; a
    node with very many neighbours is only split by the join on it.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    for _ in range(ROUNDS):
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        # large star: every larger neighbour of a node goes to the node's least neighbour, or to the node itself
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a")
        now = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
    raise RuntimeError("components did not settle")


def rooted(keys: DataFrame, roots: DataFrame | None, node: str) -> DataFrame:
    """keys with the root of each node: itself, where it isn't connected with any other."""
    if roots is None:
        return keys.withColumn("root", F.col(node))
    return keys.join(roots.select(F.col("node").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))


def with_heads(placed: DataFrame, node: str, turn: int) -> DataFrame:
    """x, y, once each: every node (with key and root) and a head of its key, another one in each turn, that it isn't connected with."""
    heads = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.min_by(F.struct(F.col(node).alias("y"), "root"), F.xxhash64(node, F.lit(turn))).alias("head"))
    heads = heads.filter("a <> b").select("key", F.col("head.y").alias("y"), F.col("head.root").alias("y_root"))
    return placed.join(heads, "key").filter("root <> y_root").select(F.col(node).alias("x"), "y").distinct()


def tiles(placed: DataFrame, node: str, most_rows: int, most: int) -> DataFrame:
    """key, node, root, side, i and j: the tiles (i, j) in which nodes of a key meet all that they aren't connected with. placed:
    key, node, root and n (the node's size). The nodes of a key that have its most frequent root meet all others, these meet each other,
    too; a side has some most_rows nodes, and some ``most`` of their sizes."""
    per_root = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = per_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1").select("key", "main")
    open_ = cut(placed.join(main, "key").withColumn("is_main", F.col("root") == F.col("main")).drop("main"))
    sizes = open_.groupBy("key").agg(*[F.ceil(F.greatest(F.lit(1), F.sum(F.when(F.col("is_main") == flag, 1).otherwise(0)) / most_rows, F.sum(F.when(F.col("is_main") == flag, F.col("n")).otherwise(0)) / most)).cast("int").alias(name) for flag, name in ((True, "mains"), (False, "others"))])
    dealt = open_.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64(node), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    # of others with others, i <= j; of others with the main ones, j from `others` on
    with_others, with_mains = F.sequence(F.lit(0), F.col("others") - 1), F.sequence(F.col("others"), F.col("others") + F.col("mains") - 1)
    meets = F.when(F.col("is_main"), F.transform(with_others, lambda i: F.struct(i.alias("i"), (F.col("others") + F.col("own")).alias("j")))).otherwise(
        F.concat(F.transform(with_others, lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j"))), F.transform(with_mains, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))))
    )
    side = F.when(F.col("is_main"), F.col("others") + F.col("own")).otherwise(F.col("own")).alias("side")
    return dealt.select("key", node, "root", F.explode(meets).alias("tile"), side).select("key", node, "root", "side", "tile.i", "tile.j")
