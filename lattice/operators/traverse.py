"""Bounded traversals. Each level is a join and a distinct; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .joins import small


def bfs_depths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """node and its least depth from ``seeds`` (node) along ``edges`` (src, dst), up to ``depth``.

    Edges and each level are written down once (a checkpoint), so that a level is one join and the plan doesn't grow with
    the depth. A level is distinct and without nodes reached before, so cycles and hubs never multiply rows; the walk ends
    with the first empty level."""
    return depths(cut(edges.select("src", "dst").distinct()), seeds, depth)


def depths(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """The same along edges that are distinct and written down already. A level that was counted to be small is broadcast, so that
    the edges stay where they are."""
    level = cut(seeds.select("node").distinct())
    reached = level.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = small(level).join(links, level["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        level = cut(step.join(reached, "node", "left_anti"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level.withColumn("depth", F.lit(d)))
    return reached


def cone_edges(edges: DataFrame, depths: DataFrame) -> DataFrame:
    """Edges that leave reached nodes: direct ones are high, deeper ones medium with the depth as evidence."""
    out = edges.join(depths, edges["src"] == depths["node"]).drop("node")
    return out.withColumn("strength", F.when(F.col("depth") == 0, "high").otherwise("medium")).withColumn("evidence", F.when(F.col("depth") == 0, "direct").otherwise(F.concat(F.lit("via depth "), F.col("depth"))))


def simple_paths(edges: DataFrame, depth: int) -> DataFrame:
    """path (array of nodes) and length of all paths without a repeated node, of up to ``depth`` edges. The number of paths
    grows with the fan-out to the power of the depth: bound the fan-out first."""
    links = edges.select("src", "dst").filter("src <> dst").distinct()
    level = links.select(F.array("src", "dst").alias("path"))
    found = level.withColumn("length", F.lit(1))
    for n in range(2, depth + 1):
        level = level.join(links, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        found = found.unionByName(level.withColumn("length", F.lit(n)))
    return found


def reachable(edges: DataFrame, depth: int) -> DataFrame:
    """src and dst of every pair that at most ``depth`` edges connect, by doubling: paths of 1, 2, 4, ... edges."""
    found, covered = edges.select("src", "dst").distinct(), 1
    while covered < depth:
        step = min(covered, depth - covered)
        more = found if step == covered else reachable(edges, step)
        joined = found.alias("a").join(more.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src"), F.col("b.dst"))
        found, covered = found.unionByName(joined).distinct(), covered + step
    return found


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes``."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


#: Pairs that one task counts, about.
PAIRS_PER_TASK = 4_000_000


def shared_between(rows: DataFrame, between: str, end: str) -> DataFrame:
    """a, b (a < b) and shared: of each pair of ends how many nodes ``between`` both are connected with; rows may repeat.

    Pairs are never shuffled. The ends of a node are gathered once; each of them goes, with the ends after it as one array, to the task of its
    own, which counts all its pairs. There are as many tasks as the number of pairs asks for."""
    ends = cut(rows.filter(F.col(between).isNotNull() & F.col(end).isNotNull()).groupBy(between).agg(F.sort_array(F.collect_set(end)).alias("ends")).filter(F.size("ends") > 1).select("ends"))
    n = F.size("ends").cast("long")
    pairs = ends.agg(F.sum(n * (n - 1) / 2)).first()[0] or 0
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(pairs // PAIRS_PER_TASK))
    each = ends.select("ends", F.posexplode("ends").alias("i", "a")).filter(F.col("i") + 1 < F.size("ends"))
    each = each.select("a", F.expr("slice(ends, i + 2, size(ends))").alias("after")).repartition(tasks, "a")
    return each.select("a", F.explode("after").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))
