"""Operators that SQL can express, against DuckDB on small fixtures of hard rows and on a driver table."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lattice.llm import chat_format, decontaminate, fill_in_middle, line_dedup, quality_rules, url_filter

P = "one two three four five six seven eight nine ten eleven twelve"
DOCS = [
    (1, f"Intro. {P.upper()} tail\n  The Same Line, over twenty chars  \nx", "a"),
    (2, "the same line, OVER twenty chars\nshort\nshort\n\t\n", "a"),
    (3, "\tthe same line, over twenty chars\nlast É line of the third one\n", "b"),
    (4, "a b c d e f g h a b c d e f g h i " * 3 + "# $$ | é", "b"),
    (5, None, None),
    (6, "", "c"),
    (7, "only ten eleven", "c"),
    (8, P + " " + P, "c"),
    (8, P + " " + P, "c"),
    (9, "\n\n", "c"),
    (10, "last É line of the third one\r\nLAST É LINE of the third one", "c"),
    (11, "last É line of the third one", "c"),
    (12, " ".join(f"w{i}" for i in range(30_000)) + " " + P, "c"),
    (13, " ten eleven\x00twelve thirteen", "c"),
]
ITEMS = [(1, P), (2, "ten eleven"), (3, None), (4, ""), (5, "... !!"), (6, P + " thirteen"), (7, "zz zz"), (None, "intro one")]


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def expected(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.sql(sql)
    order = sorted(range(len(got.columns)), key=lambda i: got.columns[i])
    return sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, s, 1, 2, "w") for i, t, s in DOCS], "doc_id long, text string, source string, n_words int, hits int, words string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs.write.parquet(f"{d}/documents.parquet")
    items.write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_line_dedup(spark, tables):
    d, docs, _ = tables
    one_each = docs.dropDuplicates(["doc_id"])  # the SQL knows rows by their ids
    got = line_dedup.dedup_lines(one_each).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    assert rows(got) == expected(line_dedup.SQL, documents=one_each)
    sharded = line_dedup.dedup_lines(one_each, task_lines=2, shard_keys=2).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    assert rows(sharded) == rows(got)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    twice = docs.unionByName(docs)
    assert sum(r["n_dropped"] for r in line_dedup.dedup_lines(twice).collect()) == 2 * sum(r["n_dropped"] for r in line_dedup.dedup_lines(docs).collect())


def test_perfect_hash_is_minimal():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 5000):
        a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for _ in range(2))
        h = line_dedup.PerfectHash.load(line_dedup.PerfectHash.build(a, b).dump())
        assert sorted(h.places(a, b).tolist()) == list(range(n))


def test_quality_rules(spark, tables):
    d, docs, _ = tables
    assert rows(quality_rules.query(spark, d)) == expected(quality_rules.SQL, documents=docs)
    book = quality_rules.ledger(docs)
    kept = quality_rules.apply_policy(book).filter("kept").count()
    by_rule = {r["rule"]: r for r in quality_rules.ablations(book).collect()}
    assert all(r["n_kept"] == kept + r["n_only"] for r in by_rule.values())
    assert quality_rules.ledger(docs.limit(0)).count() == 0
    assert quality_rules.ablations(book.limit(0)).count() == len(quality_rules.POLICIES[quality_rules.CURRENT])


def test_decontaminate(spark, tables):
    d, docs, items = tables
    assert rows(decontaminate.query(spark, d)) == expected(decontaminate.SQL.replace("FROM benchmark", "FROM benchmark WHERE item_id IS NOT NULL"), documents=docs, benchmark=items)
    for some_docs, some_items in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.filter("item_id = 5"))):
        got = decontaminate.contamination(some_docs, some_items)
        assert got.filter("n_hit > 0").count() == 0 and got.count() == some_docs.count()
    null_id = spark.createDataFrame([(None, P), (None, "x")], "doc_id long, text string")
    assert sorted(r["n_hit"] for r in decontaminate.contamination(null_id, items).collect()) == [0, 12]


def test_colliding_digests_only_propose(spark, tables, monkeypatch):
    d, docs, items = tables
    want = rows(decontaminate.query(spark, d))
    exact = decontaminate.with_shingles

    def coarse(df, sizes):
        out = exact(df, sizes)
        for s in sizes:
            out = out.withColumn(f"d{s}", F.transform(f"d{s}", lambda x: F.pmod(x, F.lit(5003))))
        return out

    monkeypatch.setattr(decontaminate, "with_shingles", coarse)
    assert rows(decontaminate.query(spark, d)) == want


@pytest.mark.parametrize("module", [chat_format, url_filter, line_dedup, quality_rules, decontaminate, fill_in_middle])
def test_driver_table(spark, sf, module):
    names = ("documents", "benchmark", "pages", "conversations")
    assert rows(module.query(spark, sf)) == expected(module.SQL, **{n: spark.read.parquet(f"{sf}/{n}.parquet") for n in names})
