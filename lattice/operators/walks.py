"""Walks from many seeds at once, each within its own budget, and levels of graphs without cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def budgeted_walk(edges: DataFrame, seeds: DataFrame, nodes: int = 128, depth: int = 6) -> DataFrame:
    """seed, node, depth and position (from 0) of what a breadth-first walk from each seed visits: at most ``nodes`` nodes each, ``depth`` steps away.

    edges: src, dst, rank (the order in which a node's edges are followed; ties by dst); seeds: seed, node. A level is visited in the order in which
    its nodes are met first: by the position of the node that leads there, then by rank. Where a level has more nodes than a seed's budget, the
    first ones stay; ``unfollowed`` counts what is left. All seeds take a step together: a step is one join and one shuffle by seed, and what a
    seed meets in it is bounded. Of a node with very many edges a walk needs the first 2 x nodes at most, as no more than
    ``nodes`` of them can be visited already, so a hub doesn't multiply the rows. Repeated edges count once, with their least rank.
    """
    own = Window.partitionBy("src").orderBy("rank", "dst")
    links = edges.groupBy("src", "dst").agg(F.min("rank").alias("rank"))
    links = cut(links.withColumn("__n", F.row_number().over(own)).filter(F.col("__n") <= 2 * nodes).select("src", "dst", F.col("__n").alias("rank")))
    # a node's place is one number: its depth, then the position of the node that leads there, then the rank of the edge
    fan = 2 * nodes + 1
    level_places = nodes * fan
    position = F.row_number().over(Window.partitionBy("seed").orderBy("place", "node")) - 1
    ranked = lambda rows: cut(rows.withColumn("position", position).filter(F.col("position") < nodes).select("seed", "node", F.floor(F.col("place") / level_places).cast("int").alias("depth"), "position"))
    visited = ranked(seeds.select("seed", "node").distinct().withColumn("place", F.lit(0).cast("long")))
    for d in range(1, depth + 1):
        level = visited.filter(F.col("depth") == d - 1)
        if level.isEmpty():
            break
        at = lambda column: F.lit(level_places).cast("long") * F.col("depth") + column
        came = level.join(links, level["node"] == links["src"]).select("seed", F.col("dst").alias("node"), (at(F.col("position") * fan) + F.lit(level_places) + F.col("rank")).alias("place"))
        # what a seed has visited stands before what it meets now, so that one ranking keeps the places of the one and gives the other its own
        rows = visited.select("seed", "node", at(F.col("position")).alias("place")).unionByName(came)
        visited = ranked(rows.repartition("seed").groupBy("seed", "node").agg(F.min("place").alias("place")))
    return visited


def unfollowed(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """seed, visited, followed and unfollowed: of each walk its nodes, the edges between them, and the edges that leave them."""
    links = edges.select("src", "dst").distinct()
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    led = visited.join(links, visited["node"] == links["src"]).select("seed", F.col("dst").alias("node"), none.alias("here"), one.alias("edges"))
    rows = visited.select("seed", "node", one.alias("here"), none.alias("edges")).unionByName(led)
    nodes = rows.repartition("seed").groupBy("seed", "node").agg(F.max("here").alias("here"), F.sum("edges").alias("edges"))
    followed = F.sum(F.col("here") * F.col("edges"))
    return nodes.groupBy("seed").agg(F.sum("here").alias("visited"), followed.alias("followed"), (F.sum("edges") - followed).alias("unfollowed"))


def levels(nodes: DataFrame, needs: DataFrame, rounds: int = 1000) -> DataFrame:
    """scope, node and level: how many steps a node has to wait, in a graph for each scope; null for nodes on a cycle or behind one.

    nodes: scope, node; needs: scope, node, needed (entries that name no node of the scope are ignored, repeated ones count once). Nodes that
    wait for nothing are peeled off, what waits for them has its count of open needs lowered, and so on: a round joins
    only the nodes that the round before has peeled off. Rounds are as many as the longest chain has nodes.
    """
    known = nodes.select("scope", "node").distinct()
    links = needs.select("scope", "node", "needed").distinct().join(known, ["scope", "node"], "left_semi")
    links = cut(links.join(known.withColumnRenamed("node", "needed"), ["scope", "needed"], "left_semi"))
    counts = links.groupBy("scope", "node").agg(F.count("*").alias("open"))
    waiting = cut(known.join(counts, ["scope", "node"], "left").withColumn("open", F.coalesce("open", F.lit(0))))
    done = None
    for k in range(rounds):
        ready = cut(waiting.filter("open = 0").select("scope", "node", F.lit(k).alias("level")))
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        lowered = ready.select("scope", F.col("node").alias("needed")).join(links, ["scope", "needed"]).groupBy("scope", "node").agg(F.count("*").alias("less"))
        rest = waiting.filter("open > 0").join(lowered, ["scope", "node"], "left")
        waiting = cut(rest.select("scope", "node", (F.col("open") - F.coalesce("less", F.lit(0))).alias("open")))
    else:
        raise RuntimeError(f"levels did not end within {rounds} rounds")
    stuck = waiting.filter("open > 0").select("scope", "node", F.lit(None).cast("int").alias("level"))
    return stuck if done is None else done.unionByName(stuck)
