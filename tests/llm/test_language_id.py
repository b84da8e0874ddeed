import numpy as np

from lattice.llm import language_id as m


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = m.codewords(n)
        assert code.shape[0] == n
        apart = (code.shape[1] - code @ code.T) / 2
        np.fill_diagonal(apart, code.shape[1])
        assert apart.min() >= (1 if n < 4 else code.shape[1] / 5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = m.query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_labels_and_ids_are_no_input(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = m.learned(docs)
    some = docs.filter(m.held_out())
    one = {r["doc_id"]: r["lang_pred"] for r in m.identify(some, model).collect()}
    other = {-r["doc_id"]: r["lang_pred"] for r in m.identify(some.selectExpr("-doc_id AS doc_id", "text", "'xx' AS lang"), model).collect()}
    assert one == other


def test_rows(spark):
    rows = [(i, "the and of this that " * 3 if i % 2 else "der die und das ist " * 3, "en" if i % 2 else "de", 1.0) for i in range(40)]
    rows += [(100, None, "en", 1.0), (101, "123 !!", "de", 1.0), (102, "", None, 1.0), (102, "", None, 1.0), (None, "the and", None, 1.0), (103, "der und " * 400_000, None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = m.fit(df)
    assert model.languages == ("de", "en")
    got = {r["doc_id"]: r for r in m.identify(df, model).collect()}
    assert {got[k]["lang_pred"] for k in (100, 101, 102)} == {"und"}
    assert got[103]["lang_pred"] == "de" and got[1]["lang_pred"] == "en" and got[None]["lang_pred"] == "en"
    empty = df.limit(0)
    assert m.fit(empty).languages == () and m.identify(empty, model).count() == 0
    assert {r["lang_pred"] for r in m.identify(df, m.fit(empty)).collect()} == {"und"}
    assert m.fit(df.filter("lang = 'en'")).predict("abc")[0] == "en"


def test_ambiguity_is_flagged(spark):
    rows = [(i, "aaa bbb " * 5 if i % 2 else "ccc ddd " * 5, "x" if i % 2 else "y") for i in range(20)]
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert not model.predict("aaa bbb aaa")[2]
    assert model.predict("aaa bbb ccc ddd")[2]


def test_letters_and_bounds(spark):
    assert not any(m.has_letter(x) for x in ("½ ²", "①②", "1 _", "", None)) and m.has_letter("1é")
    rows = [(i % 7, f"w{i % 40} abc " * 3, f"l{i % 40:02d}") for i in range(4000)]
    small = m.Settings(rows=50, languages=30)
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), small)
    assert len(model.languages) == 30 and model.languages[-1] == "l29"


def test_codewords_of_very_many_languages():
    s = m.Settings()
    assert s.languages == s.rows  # no language is left out as long as the sample has a row for it
    code = m.codewords(1000)
    apart = (code.shape[1] - code @ code.T) / 2 + code.shape[1] * np.eye(1000)
    assert apart.min() >= 10
