import corpus_pipeline as m
from lattice.llm import bpe_automaton


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    clean = docs.filter("lang = 'en'").first()["text"]
    # two near copies with no line in common, so that line dedup, which comes first, leaves both as they are
    words = " ".join(f"the word {i} of that" for i in range(60))
    more = [(10_001, None, "en", "s", 0), (10_002, "123 456", "en", "s", 7), (10_003, clean + " " + passage, "en", "s", 9), (10_004, words, "en", "s", 9), (10_005, words + " end", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    seen = []
    for k, (name, stage) in enumerate(m.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == list(m.COLUMNS)
    assert not seen[0] & {10_001, 10_002} and 10_003 in seen[0]
    assert seen[1] == seen[0]
    assert len(seen[2]) < len(seen[1]) and 10_004 in seen[2] and 10_005 not in seen[2]
    assert 10_003 not in seen[3] and seen[4] == seen[3]
    assert len(seen[3]) > 0.6 * len(seen[0])


def test_run_is_the_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in m.STAGES:
        docs = stage(spark, docs, sf)
    assert {tuple(r) for r in m.run(spark, sf).collect()} == {tuple(r) for r in docs.collect()}
    assert bpe_automaton.vocabulary_path()


def test_near_duplicates_from_80_percent(spark, sf):
    words = [f"w{k}" for k in range(220)]
    changed = ["new" if k in (40, 80, 120, 160) else w for k, w in enumerate(words)]  # 196 of 236 shingles: 0.83
    other = ["new" if k in (30, 60, 90, 120, 150, 180) else w for k, w in enumerate([f"v{k}" for k in range(220)])]  # 186 of 246: 0.76
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(f"v{k}" for k in range(220))), (4, " ".join(other))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in m.drop_near_duplicates(spark, docs, sf).collect()} == {1, 3, 4}


def test_rows_are_judged_by_their_own_text(spark, sf):
    passage = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [(None, passage), (None, "some other text"), (1, passage), (1, "a clean text"), (2, "a clean text"), (None, None), (3, "1 2")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in m.drop_contaminated(spark, docs, sf).collect()), key=repr)
    assert got == sorted([(None, "some other text"), (1, "a clean text"), (2, "a clean text"), (None, None), (3, "1 2")], key=repr)
    got = sorted(((r["doc_id"], r["text"]) for r in m.drop_near_duplicates(spark, docs, sf).collect()), key=repr)
    assert got == sorted([r for r in rows if r != (2, "a clean text")], key=repr)
    assert {r["doc_id"] for r in m.identify_language(spark, docs, sf).collect()} == {None, 1, 2}
    empty = docs.limit(0)
    for _, stage in m.STAGES:
        assert stage(spark, empty, sf).count() == 0
