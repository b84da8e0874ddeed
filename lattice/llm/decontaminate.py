"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item's windows (``window`` successive words, or the whole of a shorter item) are sets of shingles of ``SHINGLE`` words. One pass
over the documents finds every occurrence of any of these shingles and so their exact counts, by which a window's shingles
are ordered. For full containment the necessary prefix is the rarest shingle alone: only its occurrences are joined
to windows, and a window one of whose shingles nowhere occurs is gone at once. Where the window would begin before or
end after the document, the occurrence is dropped. What is left is verified exactly: the words at the candidate's place are
taken from the text and joined with the windows by the words themselves. Digests only propose. Items are joined last, once for each
document and window.

DataFrame functions do all the work. Of documents with candidates the texts are shuffled, of all others only occurrences of
shingles that some item has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii, sent, table

WINDOW = 10
SHINGLE = 4
#: What stands between words; A-Z are lower-cased afterwards, word by word.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of benchmark shingles up to which they are broadcast, after they were counted; beyond, they are joined by shuffles.
BROADCAST_ROWS = 1_000_000


def _raw_words(text: Column) -> Column:
    return F.filter(F.split(text, _BETWEEN), lambda w: w != "")


def words_of(text: Column) -> Column:
    return F.transform(_raw_words(text), lower_ascii)


def _zipped(a: str, b: str, step: int) -> Column:
    left = F.greatest(F.size(b) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), left), F.slice(b, F.lit(step + 1), left), lambda x, y: F.xxhash64(x, y))


def with_shingles(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Replaces the column ``words`` by d1 to d4, as far as ``sizes`` need them: digests of the successive words at each place. Each
    is a projection of its own, so that it is computed once."""
    rest = [c for c in df.columns if c != "words"]
    top = max(sizes)
    df = df.select(*rest, F.transform("words", lambda w: F.xxhash64(lower_ascii(w))).alias("d1"))
    if top >= 2:
        df = df.select(*df.columns, _zipped("d1", "d1", 1).alias("d2"))
    if 3 in sizes:
        df = df.select(*df.columns, _zipped("d2", "d1", 2).alias("d3"))
    if top >= 4:
        df = df.select(*df.columns, _zipped("d2", "d2", 2).alias("d4"))
    return df.select(*rest, *[f"d{s}" for s in sizes])


def windows_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Each distinct window: w (its words, joined by blanks, which no word holds), n, s (words of a shingle); and w and item of all
    that hold it."""
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("words")).filter(F.size("words") > 0)
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))
    each = items.select("item", "words", F.explode(starts).alias("start")).select("item", F.array_join(F.slice("words", F.col("start"), F.lit(window)), " ").alias("w"))
    held = cut(each.distinct())
    size = F.size(F.split("w", " "))
    return cut(held.select("w").distinct().select("w", size.alias("n"), F.least(size, F.lit(SHINGLE)).alias("s"))), held


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The id, text_digest (xxhash64 of the text), n_words, n_hit (words inside an occurring window), n_items (whose windows
    occur) and items (their ids as strings, sorted), of every document row.

    A null text has no words; an item without words has no windows, and items with a null id are left out. Rows are judged
    each by its own text, repeated or not: a row is known by its id and its text's digest. Other columns are ignored.
    Either table may be empty.
    """
    text = F.col(text_col).cast("string")
    name = F.concat(F.when(F.col("id").isNull(), "-").otherwise("+"), F.coalesce(F.col("id").cast("string"), F.lit("")))  # null ids are one, too
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.coalesce(text, F.lit("")).alias("text")).withColumn("k", name)
    windows, held = windows_of(benchmark, item_col, item_text_col, window)
    sizes = sorted(r["s"] for r in windows.select("s").distinct().collect())  # at most SHINGLE numbers
    counted = rows.select("id", "k", "t", F.size(_raw_words(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    if sizes:
        hits = cut(occurrences(rows.select("k", "t", "text"), windows, sizes))
        # words in the union of the spans: their places, each once
        places = F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda x: F.sequence(x["start"], x["start"] + x["n"] - 1)))
        covered = hits.select("k", "t", "start", "n").groupBy("k", "t").agg(F.size(F.array_distinct(places)).cast("long").alias("hit"))
        found = hits.select("k", "t", "w").distinct().join(held, "w").select("k", "t", "item").distinct().groupBy("k", "t").agg(F.array_sort(F.collect_list("item")).alias("items"))
        judged = counted.join(covered, ["k", "t"], "left").join(found, ["k", "t"], "left")
    else:
        judged = counted.select("*", F.lit(0).cast("long").alias("hit"), none.alias("items"))
    items = F.coalesce("items", none)
    return judged.select(F.col("id").alias(id_col), F.col("t").alias("text_digest"), "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def occurrences(rows: DataFrame, windows: DataFrame, sizes: list[int]) -> DataFrame:
    """k, t, start (place from 0), n and w: every occurrence of a window in rows (k, t, text), once for each k and text."""
    digests = with_shingles(windows.select("w", "n", "s", F.split("w", " ").alias("words")), sizes)
    own = F.coalesce(*[F.when(F.col("s") == s, F.col(f"d{s}")) for s in sizes])
    shingles = cut(digests.select("w", "n", "s", F.posexplode(own).alias("offset", "h")))
    known = _bounded(shingles.select("s", "h").distinct(), BROADCAST_ROWS)
    split = rows.select("k", "t", _raw_words(F.col("text")).alias("words"))
    placed = with_shingles(split.select("k", "t", F.size("words").alias("n_words"), "words"), sizes)
    found = None
    for s in sizes:
        # outer: else a filter on the array's size is inferred and pushed to the scan, where the array is computed many times
        one = placed.select("k", "t", "n_words", F.lit(s).alias("s"), F.posexplode_outer(f"d{s}").alias("pos", "h")).join(known.filter(F.col("s") == s).drop("s"), "h", "left_semi")
        found = one if found is None else found.unionByName(one)
    found = cut(found.select("k", "t", "n_words", "s", "h", "pos"))
    # order by rarity; a shingle that never occurs rules its windows out
    counts = found.groupBy("s", "h").agg(F.count("*").alias("rarity"))
    ordered = shingles.join(counts, ["s", "h"], "left").withColumn("rarity", F.coalesce("rarity", F.lit(0)))
    prefix = ordered.groupBy("w").agg(F.min_by(F.struct("s", "h", "offset", "n"), F.struct("rarity", "h", "offset")).alias("x"), F.min("rarity").alias("rarity"))
    # windows with one prefix, place in it and length propose the same
    prefix = _bounded(cut(prefix.filter(F.col("rarity") > 0).select("x.*").distinct()), BROADCAST_ROWS // 10)
    start = F.col("pos") - F.col("offset")
    # positional and length bounds
    fits = found.join(prefix, ["s", "h"]).filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
    per_doc = cut(fits.select("k", "t", start.alias("start"), "n").groupBy("k", "t").agg(F.collect_set(F.struct("start", "n")).alias("at")))
    # containment: the very words at each candidate's place
    texts = rows.join(sent(per_doc.select("k", "t")), ["k", "t"], "left_semi").join(per_doc, ["k", "t"]).select("k", "t", "at", words_of(F.col("text")).alias("words"))
    there = F.transform("at", lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n"), F.array_join(F.slice("words", x["start"] + 1, x["n"]), " ").alias("w")))
    spans = texts.select("k", "t", there.alias("at")).select("k", "t", F.explode("at").alias("x")).select("k", "t", "x.start", "x.n", "x.w")
    return spans.distinct().join(_bounded(windows.select("w"), BROADCAST_ROWS), "w", "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS words FROM documents
), items AS (
  SELECT item_id, {_WORDS} AS words FROM benchmark
), item_windows AS (
  SELECT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT r, n, i, array_to_string(words[i:i + n - 1], ' ') AS win
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, sizes WHERE len(words) >= n)
), hits AS (
  SELECT d.r, d.i, d.n, w.item_id FROM doc_windows d JOIN item_windows w ON d.n = w.n AND d.win = w.win
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), held AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN held USING (r)
"""
