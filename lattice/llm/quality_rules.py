"""Quality rules in a bitmask ledger.

Every rule is evaluated once for each document: the ledger holds its measurements and one number whose bits say which
rules failed. Policies are versioned sets of rules, kept as masks; applying one is a bitwise and, and what a policy
would keep without one of its rules comes from one aggregation of the ledger. DataFrame functions do all the work, and measuring
shuffles nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


def _rules() -> dict[str, Column]:
    """Rules by name, in the order of their bits; each is true of a document that fails. New rules go to the end, so that
    ledgers stay valid."""
    n, word_chars, symbols, dup, repeat, lines = (F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines"))
    return {
        "few_words": n < 20,
        "repeated_words": 100 * repeat > 30 * n,
        "short_words": word_chars < 2 * n,
        "long_words": word_chars > 20 * n,
        "symbols": 2 * symbols > n,
        "repeated_lines": 2 * dup > F.greatest(lines, F.lit(1)),
    }


BASE = ("few_words", "repeated_words")
#: Version: rules whose failure drops a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "short_words", "long_words", "symbols", "repeated_lines"),
}
CURRENT = "v1"


def mask(policy: str) -> int:
    names = list(_rules())
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _neighbours(df: DataFrame, name: str, of: str, step: int) -> DataFrame:
    """Adds digests of each element of column ``of`` and the one ``step`` after it; of n elements, n - step are left. In a
    projection of its own, so that each step is computed once."""
    left = F.greatest(F.size(of) - step, F.lit(0))
    return df.select(*[c for c in df.columns if c != of], F.zip_with(F.slice(of, F.lit(1), left), F.slice(of, F.lit(step + 1), left), lambda a, b: F.xxhash64(a, b)).alias(name))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words, word_chars, n_symbols, n_text_lines (with a word), n_dup_lines and n_repeat_words, all long.

    A null text has no words. Every row gives a row, repeated or not; other columns are ignored. Windows are compared by
    64-bit digests within one document.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    parts = rows.select("id", words.alias("words"), lines.alias("lines"), (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).alias("n_symbols"))
    counted = parts.select(
        "id",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        "n_symbols",
        F.size("lines").alias("n_text_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("ones"),
    )
    # a window of 8 words is digested in three steps of doubling
    counted = _neighbours(_neighbours(_neighbours(counted, "twos", "ones", 1), "fours", "twos", 2), "windows", "fours", 4)
    # Only where some window occurs twice are windows ordered by digest and place to find which.
    some = F.size(F.array_distinct("windows")) < F.size("windows")
    nothing = F.array().cast("array<struct<h:bigint,p:int>>")
    placed = counted.withColumn("placed", F.when(some, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).otherwise(nothing))
    n = F.size("placed")
    same = F.zip_with(F.slice("placed", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("placed", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: F.when(x["h"] == y["h"], F.array(x["p"], y["p"])))
    starts = placed.drop("windows").withColumn("starts", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull())))))
    m = F.size("starts")
    gaps = F.zip_with(F.slice("starts", F.lit(1), F.greatest(m - 1, F.lit(0))), F.slice("starts", F.lit(2), F.greatest(m - 1, F.lit(0))), lambda x, y: F.least(y - x, F.lit(WINDOW)))
    repeat = F.when(m > 0, F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0)
    names = ("n_words", "word_chars", "n_symbols", "n_text_lines", "n_dup_lines")
    return starts.select(F.col("id").alias(id_col), *[F.col(c).cast("long").alias(c) for c in names], repeat.cast("long").alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What measure() gives, and failed: bit k is set if the k-th rule failed."""
    bits = [F.when(rule, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, rule in enumerate(_rules().values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, id_col, text_col).withColumn("failed", total)


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """``book`` with kept: whether no rule of the policy failed. An older ledger can be judged by a newer policy."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) == 0)


def ablations(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_only (that it alone drops: kept without it) and n_kept without it.
    One aggregation by failure bits, as many groups as there are combinations of failures, then sums of those."""
    names = list(_rules())
    m = mask(policy)
    groups = book.groupBy(F.col("failed").bitwiseAND(F.lit(m).cast("long")).alias("f")).agg(F.count("*").alias("n"))
    rules = book.sparkSession.createDataFrame([(r, 1 << names.index(r)) for r in POLICIES[policy]], "rule string, bit long")
    f, bit, n = F.col("f"), F.col("bit"), F.col("n")
    paired = groups.withColumn("r", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))).select("f", "n", "r.rule", "r.bit")
    zero = F.lit(0).cast("long")
    sums = paired.groupBy("rule").agg(
        F.sum(F.when(f.bitwiseAND(bit) != 0, n).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(f == bit, n).otherwise(zero)).alias("n_only"),
        F.sum(F.when((f == bit) | (f == 0), n).otherwise(zero)).alias("n_kept"),
    )
    return rules.select("rule").join(sums, "rule", "left").select("rule", *[F.coalesce(c, zero).alias(c) for c in ("n_failed", "n_only", "n_kept")])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(mask("base")).cast("long")) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))


SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), split AS (
  SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM base
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)
), twice AS (
  SELECT r, unnest(range(i, i + 8)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY r
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_text_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN repeats USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 2 * n_symbols > n_words OR 2 * n_dup_lines > greatest(n_text_lines, 1)) AS kept
FROM m
"""
