"""Patterns of paths as a trie that is a table, walked segment by segment with equi-joins.

A state of the trie is a prefix of patterns; transitions (state, kind, segment, next) are rows, so there may be any number of patterns, and a path meets
only those that begin as it does. Kinds of segments: ``literal`` (equal), ``part`` (a glob within the segment), ``any`` (one segment), ``rest`` (any
number of segments, also none, or at least one for ``some``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from ..session import cut

#: The more specific kind comes first when patterns compete.
_RANK = {"literal": "0", "part": "1", "any": "2", "some": "3", "rest": "4"}
_SEGMENTS = "array<struct<kind:string,segment:string>>"


def segments(path: Column) -> Column:
    """The segments of a path between slashes; a slash at its begin or end makes none."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def route_kinds(pattern: Column) -> Column:
    """Segments of a route with their kinds: ``:x``, ``{x}``, ``[x]`` and ``<x>`` are any, ``[...x]`` and ``*x`` some, ``[[...x]]`` and ``**`` rest; groups in round
    brackets are no segments."""
    kind = lambda s: (
        F.when(s.rlike(r"^\[\[\.\.\..*\]\]$|^\*\*$"), "rest").when(s.rlike(r"^\[\.\.\..*\]$|^\*."), "some").when(s.rlike(r"^:|^\{.*\}$|^\[.*\]$|^<.*>$|^\*$"), "any").otherwise("literal")
    )
    return F.transform(F.filter(segments(pattern), lambda s: ~s.rlike(r"^\(.*\)$")), lambda s: F.struct(kind(s).alias("kind"), s.alias("segment")))


def glob_kinds(pattern: Column) -> Column:
    """Segments of a glob with their kinds: ``**`` is rest (at the end, some), ``*`` any, other wildcards within a segment part."""
    parts = segments(pattern)
    kind = lambda s, i: F.when((s == "**") & (i == F.size(parts) - 1), "some").when(s == "**", "rest").when(s == "*", "any").when(s.rlike(r"[*?]"), "part").otherwise("literal")
    return F.transform(parts, lambda s, i: F.struct(kind(s, i).alias("kind"), s.alias("segment")))


def build(patterns: DataFrame, kinds: Column) -> tuple[DataFrame, DataFrame, int]:
    """Transitions (state, kind, segment, next, rank), ends (state, pattern) and the greatest number of segments. patterns: pattern; kinds: the expression that
    gives its segments. A state is the digest of the segments that lead to it; what differs in the name of a parameter is the same state."""
    rows = patterns.select("pattern").distinct().withColumn("s", kinds.cast(_SEGMENTS))
    named = F.transform("s", lambda x: F.concat(x["kind"], F.lit("\u0001"), F.when(x["kind"].isin("literal", "part"), x["segment"]).otherwise("")))
    rows = cut(rows.withColumn("named", named))
    state = lambda n: F.md5(F.array_join(F.slice("named", F.lit(1), n), "\u0002"))
    steps = rows.select("named", "s", F.explode(F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1)))).alias("n")).filter(F.col("n") <= F.size("s"))
    x = F.get("s", F.col("n") - 1)
    rank = F.coalesce(*[F.when(x["kind"] == k, v) for k, v in _RANK.items()])
    moves = steps.select(state(F.col("n") - 1).alias("state"), x["kind"].alias("kind"), F.when(x["kind"].isin("literal", "part"), x["segment"]).alias("segment"), state(F.col("n")).alias("next"), rank.alias("rank")).distinct()
    ends = rows.select(state(F.size("s")).alias("state"), "pattern")
    return cut(moves), cut(ends), rows.agg(F.coalesce(F.max(F.size("s")), F.lit(0))).first()[0]


def matches(paths: DataFrame, path: str, patterns: DataFrame, kinds: Column) -> DataFrame:
    """path, pattern and rank of every pattern that a path fits; among a path's patterns the one with the least rank is the most specific. paths and
    patterns (pattern) count once each; null ones fit nothing.

    Paths walk together: a round takes each one's next segment to the states that it may lead to. A path is in a state once, with its least rank, so a
    round has at most as many rows as pairs of a path and a state that it fits so far. Ranks are digits, one for each segment of the path.
    """
    moves, ends, _ = build(patterns.filter("pattern IS NOT NULL"), kinds)
    literal = moves.filter("kind = 'literal'").select("state", F.col("segment").alias("now"), "next", F.col("rank").alias("digit"))
    part = moves.filter("kind = 'part'").select("state", glob_regex(F.col("segment")).alias("regex"), "next", F.col("rank").alias("digit"))
    any_ = moves.filter("kind IN ('any', 'some', 'rest')").select("state", "next", F.col("rank").alias("digit"))
    # a state behind some or rest keeps what follows
    stays = moves.filter("kind IN ('some', 'rest')").select(F.col("next").alias("state"), "next", F.col("rank").alias("digit")).distinct()
    skips = moves.filter("kind = 'rest'").select("state", "next")
    has_parts, has_skips = not part.isEmpty(), not skips.isEmpty()
    root = F.md5(F.lit(""))
    now = paths.select(path).filter(F.col(path).isNotNull()).distinct().select(path, segments(F.col(path)).alias("s"), root.alias("state"), F.lit("").alias("rank"))

    def closed(rows: DataFrame) -> DataFrame:
        """Where a rest takes no segment, the state behind it is reached, too."""
        rows = cut(rows)
        new = rows
        while has_skips:
            new = cut(new.join(skips, "state").select(path, "s", F.col("next").alias("state"), "rank").join(rows.select(path, "state"), [path, "state"], "left_anti").distinct())
            if new.isEmpty():
                break
            rows = cut(rows.unionByName(new))
        return rows

    found, k = None, 0
    while True:
        now = closed(now)
        over = now.filter(F.size("s") == k).select(path, "state", "rank").join(ends, "state").select(path, "pattern", "rank")
        found = over if found is None else found.unionByName(over)
        left = now.filter(F.size("s") > k).withColumn("now", F.get("s", F.lit(k)))
        if left.isEmpty():
            return found.groupBy(path, "pattern").agg(F.min("rank").alias("rank"))
        step = left.join(literal, ["state", "now"]).select(path, "s", "next", "rank", "digit")
        step = step.unionByName(left.join(any_.unionByName(stays), "state").select(path, "s", "next", "rank", "digit"))
        if has_parts:
            step = step.unionByName(left.join(part, "state").filter(F.rlike("now", F.col("regex"))).select(path, "s", "next", "rank", "digit"))
        now = step.groupBy(path, "s", F.col("next").alias("state")).agg(F.min(F.concat("rank", "digit")).alias("rank"))
        k += 1


def most_specific(paths: DataFrame, path: str, patterns: DataFrame, kinds: Column) -> DataFrame:
    """Each path with the most specific pattern that it fits, else null; of equally specific ones the least by name."""
    best = matches(paths, path, patterns, kinds).groupBy(path).agg(F.min_by("pattern", F.struct("rank", "pattern")).alias("pattern"))
    return paths.join(best, path, "left")
