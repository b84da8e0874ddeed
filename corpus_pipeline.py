"""A corpus pipeline of five training-data operators.

``STAGES`` lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame, which the caller
writes as Parquet and reads again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import bpe_automaton, decontaminate, language_id, line_dedup, minhash_dedup
from lattice.llm.common import sent, shared_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REST = COLUMNS[1:]
#: Similarity (percent) of near-duplicates; op5's own is higher.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told: a text without letters, or null, goes. Where the decision is not ambiguous, lang becomes
    the language that was found."""
    model = language_id.learned(docs)
    judged = language_id.identify(docs, model, keep=REST)
    # where nothing could be learned, nothing can be rejected but what has no letter
    kept = judged.filter(F.col("lang_pred") != language_id.UNDETERMINED) if model.languages else judged.filter(F.col("text").rlike(r"\p{L}"))
    told = F.when(~F.col("ambiguous"), F.col("lang_pred")).otherwise(F.col("lang")) if model.languages else F.col("lang")
    return kept.withColumn("lang", told).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes frequent lines out of all documents but the largest that holds them; every document stays."""
    return line_dedup.dedup_lines(docs, keep=("lang", "source")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the least id. Rows with a null id stay; of rows of one id those
    go whose own text is in a group with a lesser id."""
    return _without(docs, minhash_dedup.near_duplicates(docs, percent=NEAR_PERCENT, keep_digest=True).filter(~F.col("kept")))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows that ``rows`` names by doc_id (null or not) and text_digest (xxhash64 of the text). Rows of one id
    with other texts stay."""
    gone = sent(rows.select(F.col("doc_id").isNull().alias("__null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.col("text_digest").alias("__t")).distinct())
    named = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("__null"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__id"), F.xxhash64(F.col("text").cast("string")).alias("__t"))
    return named.join(gone, ["__null", "__id", "__t"], "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, each row by its own text, also without an id."""
    judged = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, judged.filter("n_hit > 0"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the token ids and of the text decoded from them."""
    return bpe_automaton.digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the written result of the one before, in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
