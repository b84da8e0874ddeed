from pyspark.sql import functions as F

from lattice.functions import text as T
from lattice.operators import bounds, certify, delta, joins, traverse


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_paths(spark):
    for path, want in {"a/./b//c": "a/b/c", "a/../b": "b", "../x": "x", "./": ".", "a\\b": "a/b", "": "."}.items():
        assert value(spark, T.normalized_path(F.lit(path))) == want
    for route, want in {"/a/b/?x=1#y": "/a/b", "/": "/", "//x": None, "a": None, "/a/${x}": None}.items():
        assert value(spark, T.normalized_route(F.lit(route))) == want
    assert value(spark, T.path_tokens(F.lit("src/My-File_name.test.ts"))) == ["src", "my", "file", "name", "test", "ts"]
    assert value(spark, T.ancestors(F.lit("a/b/c"))) == ["a/b/c", "a/b", "a", "."]
    assert [value(spark, T.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb", "\n")] == [0, 1, 1, 2, 1]


def test_globs(spark):
    cases = [("src/**", "src/a/b.ts", True), ("src/*.ts", "src/a/b.ts", False), ("src/*.ts", "src/b.ts", True), ("**/b.ts", "b.ts", True), ("**/b.ts", "x/y/b.ts", True), ("a+b/?.c", "a+b/x.c", True), ("a.ts", "axts", False)]
    for glob, path, want in cases:
        assert value(spark, F.rlike(F.lit(path), T.glob_regex(F.lit(glob)))) is want, (glob, path)


def test_bounds_account_for_what_they_hide(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "g string, x int")
    for k in (1, 3, 9):
        got = bounds.top_k(df, ["g"], [F.col("x")], k).collect()
        assert all(r["shown"] + r["hidden"] == r["observed"] for r in got)
    small, large = (rows(bounds.top_k(df, ["g"], [F.col("x")], k), "g", "x") for k in (2, 4))
    assert set(small) <= set(large)
    assert rows(bounds.round_robin(df, ["g"], [F.col("x")], 3), "g", "x") == [("a", 0), ("a", 1), ("b", 1)]
    assert rows(bounds.precedence_dedupe(df.withColumn("p", F.col("x") % 3), ["g"], [F.col("p")], ["x"]), "g", "x") == [("a", 2), ("b", 1)]
    assert [(r["g"], r["examples"], r["hidden"]) for r in bounds.group_examples(df, ["g"], "x", 2).orderBy("g").collect()] == [("a", [0, 1], 5), ("b", [1], 0)]


def test_traversals(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("a", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(traverse.bfs_depths(edges, seeds, 2)) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(traverse.bfs_depths(edges, seeds, 9)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    paths = {tuple(r["path"]) for r in traverse.simple_paths(edges, 3).collect()}
    assert ("a", "b", "c", "d") in paths and all(len(set(p)) == len(p) for p in paths)
    assert ("a", "d") in rows(traverse.reachable(edges, 3)) and ("a", "d") not in rows(traverse.reachable(edges, 2))
    assert rows(traverse.induced(edges, spark.createDataFrame([("a",), ("b",)], "node string")), "src", "dst") == [("a", "a"), ("a", "b")]


def test_joins(spark):
    items = spark.createDataFrame([(1, "a/b/c.ts"), (2, "ab/c.ts"), (3, "z")], "id int, path string")
    prefixes = spark.createDataFrame([("a",), ("a/b",), ("a/b",)], "prefix string")
    assert [(r["id"], r["prefix"]) for r in joins.longest_prefix(items, "path", ["id"], prefixes, "prefix").orderBy("id").collect()] == [(1, "a/b"), (2, None), (3, None)]
    points = spark.createDataFrame([(i,) for i in range(0, 100, 7)], "p int")
    ranges = spark.createDataFrame([("r", 5, 40), ("s", 40, 42), ("t", 7, 7)], "name string, lo int, hi int")
    got = rows(joins.range_join(points, F.col("p"), ranges, F.col("lo"), F.col("hi"), 8), "p", "name")
    assert got == sorted((p, n) for p in range(0, 100, 7) for n, lo, hi in (("r", 5, 40), ("s", 40, 42), ("t", 7, 7)) if lo <= p <= hi)


def test_certainty(spark):
    df = spark.createDataFrame([(2, 5, 3), (0, 5, 5), (0, 5, 3)], "n long, e long, v long").select(*certify.count_fact(F.col("n"), F.col("e"), F.col("v")))
    assert [tuple(r) for r in df.collect()] == [("counted", 2, 2), ("proven_zero", 0, 0), ("unknown", None, 0)]
    none = F.array().cast("array<string>")
    assert tuple(value(spark, certify.closure(F.lit(True), none))) == ("closed", [])
    assert tuple(value(spark, certify.closure(F.lit(True), F.array(F.lit("x"))))) == ("open", ["x"])
    assert tuple(value(spark, certify.closure(F.lit(False), none))) == ("open", ["unclassified_coverage_gap"])
    h = certify.horizons(spark.range(7).withColumn("g", F.col("id") % 2), ["g"], 3, "ls .").orderBy("g").collect()
    assert [(r["observed"], r["shown"], r["hidden"], r["expand"]) for r in h] == [(4, 3, 1, "ls . --limit 4"), (3, 3, 0, None)]


def test_differences(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), ("n", None)], "k string, h string")
    b = spark.createDataFrame([("x", "1"), ("y", "9"), ("w", "3"), ("n", None)], "k string, h string")
    assert rows(delta.fingerprint_diff(a, b, "k", "h"), "k", "status") == [("n", "unchanged"), ("w", "added"), ("x", "unchanged"), ("y", "modified"), ("z", "removed")]
    assert rows(delta.renames(a.filter("k = 'z'"), b.filter("k = 'w'"), "k", "h")) == [("z", "w")]
    t = lambda *x: spark.createDataFrame(list(x), "target string, source string")
    assert rows(delta.affected_targets(t(("p", "1"), ("q", "1")), t(("p", "2"), ("q", "1")))) == [("p", 1, 1)]
