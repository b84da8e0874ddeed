"""Brackets that belong together, and the innermost of nested ranges, for files of any size.

The depth at a place is a prefix sum of openings and closings. It is made in two steps, sums of chunks of a file first, so that no file has to go through
one task. At one depth openings and closings take turns, so the partner of an opening is the next closing of its depth: mostly in its own chunk;
what a chunk leaves over (one opening and one closing of each depth) is matched in a second, small pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Lines of a chunk, and places of a line in ``at``.
CHUNK_LINES, LINE_PLACES = 2000, 1 << 20
OPENING, CLOSING = "{([", "})]"


def marks(lines: DataFrame) -> DataFrame:
    """rel, chunk, at, kind (the opening bracket), step (1 or -1) and before (the sign before it in its line) of the brackets in the code of lines. at grows with line
    and column; a line number is at / LINE_PLACES."""
    some = lines.filter(F.col("code").rlike(r"[{}()\[\]]")).select("rel", "line_no", "code")
    placed = F.transform(F.split("code", ""), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    found = some.select("rel", "line_no", "code", F.explode(F.filter(placed, lambda s: s["x"].isin(*OPENING, *CLOSING))).alias("s"))
    before = F.substring(F.rtrim(F.substring("code", F.lit(1), F.col("s.i"))), -1, 1)
    opens = F.col("s.x").isin(*OPENING)
    kind = F.when(opens, F.col("s.x")).otherwise(F.translate(F.col("s.x"), CLOSING, OPENING))
    return found.select("rel", _chunk(F.col("line_no")).alias("chunk"), _at(F.col("line_no"), F.col("s.i")).alias("at"), kind.alias("kind"), F.when(opens, 1).otherwise(-1).alias("step"), before.alias("before"))


def _chunk(line):
    return F.floor(line / CHUNK_LINES)


def _at(line, column):
    return line.cast("long") * LINE_PLACES + column


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, chunk, at, step) with depth: after an opening, before a closing, and at any other place (step 0)."""
    sums = rows.groupBy(*keys, "chunk").agg(F.sum("step").alias("__sum"))
    base = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    upto = Window.partitionBy(*keys, "chunk").orderBy("at", F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    depth = F.col("__base") + F.sum("step").over(upto) + F.when(F.col("step") < 0, 1).otherwise(0)
    return rows.join(base, [*keys, "chunk"]).withColumn("depth", depth.cast("int")).drop("__base")


def matched(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, open_at, close_at and depth of the brackets in rows (keys, chunk, at, step: 1 opens, -1 closes). One that nothing closes has a null close_at,
    one that nothing opened a null open_at. Brackets of different keys don't see each other."""
    deep = placed(rows, keys)
    in_chunk = Window.partitionBy(*keys, "depth", "chunk").orderBy("at")
    near = deep.withColumn("__next", F.when(F.col("step") == 1, F.lead("at").over(in_chunk))).withColumn("__first", F.lag("at").over(in_chunk).isNull())
    pairs = near.filter("step = 1 AND __next IS NOT NULL").select(*keys, F.col("at").alias("open_at"), F.col("__next").alias("close_at"), "depth")
    rest = near.filter("(step = 1 AND __next IS NULL) OR (step = -1 AND __first)")
    across = Window.partitionBy(*keys, "depth").orderBy("at")
    far = rest.withColumn("__to", F.lead("at").over(across)).withColumn("__came", F.lag("step").over(across))
    opened = far.filter("step = 1").select(*keys, F.col("at").alias("open_at"), F.col("__to").alias("close_at"), "depth")
    strays = far.filter("step = -1 AND (__came IS NULL OR __came = -1)").select(*keys, F.lit(None).cast("long").alias("open_at"), F.col("at").alias("close_at"), "depth")
    return pairs.unionByName(opened).unionByName(strays)


def innermost(points: DataFrame, ranges: DataFrame, chunk_lines: int = CHUNK_LINES) -> DataFrame:
    """points (rel, line) with scope_start and scope_end of the innermost range (rel, line_start, line_end) that holds the line, else null.

    Ranges of a file are nested or apart, and no two begin and end alike; a range holds its first and its last line. Each range and each line is a
    mark in one sweep, so the work doesn't grow with how many lines a range has."""
    at = lambda line, k: line.cast("long") * 4 + k
    of = lambda line: F.floor(line / chunk_lines).alias("chunk")
    none = F.lit(None).cast("int")
    spans = cut(ranges.select("rel", "line_start", "line_end").distinct())
    # where several ranges begin on a line the longest is the outermost
    opens = spans.select("rel", of(F.col("line_start")), at(F.col("line_start"), 0).alias("at"), F.lit(1).alias("step"), (-F.col("line_end").cast("long")).alias("wide"), none.alias("line"), "line_start", "line_end")
    closes = spans.select("rel", of(F.col("line_end")), at(F.col("line_end"), 3).alias("at"), F.lit(-1).alias("step"), (-F.col("line_start").cast("long")).alias("wide"), none.alias("line"), none.alias("line_start"), none.alias("line_end"))
    asked = points.select("rel", of(F.col("line")), at(F.col("line"), 1).alias("at"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("wide"), F.col("line").cast("int").alias("line"), none.alias("line_start"), none.alias("line_end")).distinct()
    rows = cut(opens.unionByName(closes).unionByName(asked))
    sums = rows.groupBy("rel", "chunk").agg(F.sum("step").alias("__sum"))
    base = sums.withColumn("__base", F.coalesce(F.sum("__sum").over(Window.partitionBy("rel").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")
    upto = Window.partitionBy("rel", "chunk").orderBy("at", "wide").rowsBetween(Window.unboundedPreceding, 0)
    deep = rows.join(base, ["rel", "chunk"]).withColumn("depth", F.col("__base") + F.sum("step").over(upto)).filter("step >= 0")
    deep = cut(deep)
    # the last range that has opened at this depth; one of an earlier chunk is handed on once for each chunk
    mine = F.when(F.col("step") == 1, F.struct("line_start", "line_end"))
    inner = Window.partitionBy("rel", "depth", "chunk").orderBy("at", "wide").rowsBetween(Window.unboundedPreceding, 0)
    here = deep.withColumn("__here", F.last(mine, ignorenulls=True).over(inner))
    lasts = deep.filter("step = 1").groupBy("rel", "depth", "chunk").agg(F.max_by(F.struct("line_start", "line_end"), F.struct("at", "wide")).alias("__last"))
    wanted = deep.select("rel", "depth", "chunk").distinct().join(lasts, ["rel", "depth", "chunk"], "left")
    earlier = wanted.withColumn("__earlier", F.last("__last", ignorenulls=True).over(Window.partitionBy("rel", "depth").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))).drop("__last")
    scope = F.when(F.col("depth") > 0, F.coalesce("__here", "__earlier"))
    found = here.filter("step = 0").join(earlier, ["rel", "depth", "chunk"]).select("rel", "line", scope.alias("s"))
    return points.join(found.select("rel", "line", F.col("s.line_start").alias("scope_start"), F.col("s.line_end").alias("scope_end")), ["rel", "line"], "left")


def with_ends(starts: DataFrame, lines: DataFrame) -> DataFrame:
    """starts (rel, language, line_start, indent, ...) with line_end: where the declaration that begins there ends.

    In languages with braces it ends with the partner of its body's brace: the first one at the declaration's own depth of round and square brackets
    that doesn't follow a colon or question mark; a line that ends with a semicolon at that depth before any body ends it, too. Where there is neither, it is its first
    line; where nothing closes the body, the file's last. In Python it ends with the last line that isn't blank before one that is indented no deeper; lines that
    begin inside brackets don't count.
    """
    starts, brackets = cut(starts), cut(marks(lines))
    last = lines.groupBy("rel").agg(F.max("line_no").alias("__last"))
    # round and square brackets give each place its depth; braces, ends of lines and starts are asked about it
    ends = lines.filter(F.rtrim("code").endswith(";")).select("rel", _chunk(F.col("line_no")).alias("chunk"), _at(F.col("line_no"), F.lit(LINE_PLACES - 2)).alias("at"), F.lit(0).alias("step"), F.lit("end").alias("what"))
    begun = starts.filter("language <> 'python'").select("rel", _chunk(F.col("line_start")).alias("chunk"), _at(F.col("line_start"), F.lit(-1)).alias("at"), F.lit(0).alias("step"), F.lit("start").alias("what"))
    bodies = brackets.filter("kind = '{' AND step = 1").select("rel", "chunk", "at", F.lit(0).alias("step"), F.when(F.col("before").isin(":", "?"), "other").otherwise("body").alias("what"))
    round_ = brackets.filter("kind <> '{'").select("rel", "chunk", "at", "step", F.lit("bracket").alias("what"))
    deep = placed(round_.unionByName(ends).unionByName(begun).unionByName(bodies), ["rel"]).filter("what IN ('start', 'end', 'body')")
    later = Window.partitionBy("rel", "depth").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("what") != "start", F.struct("at", "what"))
    first = deep.withColumn("e", F.last(event, ignorenulls=True).over(later)).filter("what = 'start'").select("rel", F.floor((F.col("at") + 1) / LINE_PLACES).cast("int").alias("line_start"), "e.at", "e.what")
    pairs = matched(brackets.filter("kind = '{'").select("rel", "chunk", "at", "step"), ["rel"]).filter("open_at IS NOT NULL").select("rel", F.col("open_at").alias("at"), "close_at")
    line_of = lambda x: F.floor(x / LINE_PLACES).cast("int")
    braced = first.join(pairs, ["rel", "at"], "left").join(last, "rel")
    end = F.when(F.col("what") == "end", line_of(F.col("at"))).when(F.col("what") == "body", F.coalesce(line_of(F.col("close_at")), F.col("__last"))).otherwise(F.col("line_start"))
    braced = braced.select("rel", "line_start", end.alias("line_end"))
    return starts.join(braced.unionByName(_indented(starts, lines, last, round_)), ["rel", "line_start"], "left").withColumn("line_end", F.coalesce("line_end", "line_start"))


def _indented(starts: DataFrame, lines: DataFrame, last: DataFrame, round_: DataFrame) -> DataFrame:
    """rel, line_start and line_end of the Python ones. A line ends what is indented as deep as it or deeper, so each start looks for the next line of each
    indentation that its file has, up to its own."""
    python = lines.filter("language = 'python'").select("rel", "line_no", "code")
    full = python.filter(F.trim("code") != "").select("rel", _chunk(F.col("line_no")).alias("chunk"), _at(F.col("line_no"), F.lit(-1)).alias("at"), F.lit(0).alias("step"), "line_no", F.length(F.regexp_extract("code", r"^(\s*)", 1)).alias("indent"))
    inside = placed(full.unionByName(round_.join(python.select("rel").distinct(), "rel", "left_semi").drop("what").withColumns({"line_no": F.lit(None).cast("int"), "indent": F.lit(None).cast("int")})), ["rel"]).filter("line_no IS NOT NULL")
    outer = inside.filter("depth <= 0").select("rel", "line_no", "indent")
    mine = starts.filter("language = 'python'").select("rel", "line_start", F.col("indent").alias("own"))
    asked = mine.join(outer.select("rel", "indent").distinct(), "rel").filter("indent <= own").select("rel", "indent", F.col("line_start").alias("line_no"), F.lit(True).alias("asks"))
    down = Window.partitionBy("rel", "indent").orderBy(F.desc("line_no"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    rows = asked.unionByName(outer.select("rel", "indent", "line_no", F.lit(False).alias("asks")))
    nexts = rows.withColumn("n", F.min(F.when(~F.col("asks"), F.col("line_no"))).over(down)).filter("asks").groupBy("rel", F.col("line_no").alias("line_start")).agg(F.min("n").alias("next"))
    # the last line with code before that one
    upto = Window.partitionBy("rel").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = inside.select("rel", "line_no").withColumn("prior", F.last("line_no").over(upto)).select("rel", F.col("line_no").alias("next"), "prior")
    final = inside.groupBy("rel").agg(F.max("line_no").alias("final"))
    end = F.greatest("line_start", F.coalesce("prior", "final", "line_start"))
    return nexts.join(before, ["rel", "next"], "left").join(final, "rel", "left").select("rel", "line_start", end.cast("int").alias("line_end"))
