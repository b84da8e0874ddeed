from lattice.llm import url_filter as m

URLS = [
    ("http://a.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
    ("http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
    ("https://badexample.com/en/7", "badexample.com", "/en/7", "com/en/", "block"),
    ("http://x.net/de/8", "x.net", "/de/8", "net/de/", "allow"),
    ("http://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"),
    ("http://xcom/en/", "xcom", "/en/", None, "allow"),
    ("http://org", "org", "", None, "allow"),
    ("http://org#/es/", "org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://com/en/", "com", "/en/", "com/en/", "block"),
]


def test_verdicts(spark):
    rows = [(i, u, "host", 1) for i, (u, *_) in enumerate(URLS)] + [(0, URLS[0][0], "again", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    got = sorted(tuple(r) for r in m.filter_urls(df).collect() if True)
    want = sorted([(i, *rest) for i, (_, *rest) in enumerate(URLS)] + [(0, *URLS[0][1:])])
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert [r["verdict"] for r in m.filter_urls(df, rules=()).collect()] == ["allow"]
    assert m.filter_urls(df.limit(0)).count() == 0


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(m, "digest", lambda key: 7)
    m.DigestArray.write([("block", "a", "/"), ("allow", "b", "/"), ("block", "a", "/x")], str(tmp_path / "rules"))
    array = m.DigestArray(str(tmp_path / "rules"))
    places = array.find(["a\0/", "b\0/", "a\0/x", "c\0/"]).tolist()
    assert sorted(places[:3]) == [0, 1, 2] and places[3] == -1
    assert [int(array.blocks[p]) for p in places[:3]] == [1, 0, 1]


def test_hosts_of_rules_are_lowered_as_those_of_urls(spark):
    df = spark.createDataFrame([(1, "http://www.É.Com/x"), (2, "http://" + "a." * 50_000 + "b.c/x/y"), (3, "http://b.c/x")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in m.filter_urls(df, rules=[("block", "É.COM", "/"), ("block", "b.c", "/x/")]).collect()}
    assert got == {1: ("É.com/", "block"), 2: ("b.c/x/", "block"), 3: (None, "allow")}
