import numpy as np

from lattice.llm import minhash_dedup as m
from lattice.llm.graph import components
from lattice.llm.shingles import shingle_digests, shingle_set, word_digests


def plain(rows):
    """Shingle sets, links and components by comparing all pairs."""
    sets, up = {}, {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text in rows:
        w = [x for x in (text or "").translate(lower).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        up[i] = i

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def variants(rng, n):
    words = [f"w{k}" for k in range(4000)]
    base = [list(rng.choice(words, 150)) for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(base[i % 4])
        for _ in range(int(rng.integers(0, 7))):
            w[int(rng.integers(0, len(w)))] = str(rng.choice(words))
        rows.append((i, " ".join(w)))
    return rows


def test_same_as_all_pairs(spark):
    rows = variants(np.random.default_rng(3), 160)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "One  TWO"), (1005, "É x"), (1006, "é x"), (1007, "one two three four five"), (1008, rows[0][1])]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n string, component_id int")
    got = {r[0]: tuple(r)[1:] for r in m.near_duplicates(df).collect()}
    assert got == plain(rows)


def test_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_DOCUMENTS", 7)
    rows = variants(np.random.default_rng(4), 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in m.near_duplicates(df).collect()} == plain(rows)


def test_rows(spark):
    long = " ".join(f"x{i}" for i in range(120_000))
    df = spark.createDataFrame([(1, long), (2, long + " end"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    got = sorted(m.near_duplicates(df).collect(), key=repr)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False), (3, 3, True), (None, None, True)} and len(got) == 5
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_pruning_bounds():
    need = m.least_matches(85, 1e-6)
    assert list(need) == list(range(m.BATCH, m._N + 1, m.BATCH))
    rng = np.random.default_rng(0)
    for n, least in need.items():
        assert 0 < least < n
        assert (rng.binomial(n, 0.85, 200_000) < least).mean() < 1e-4


def test_driver_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert {r[0]: tuple(r)[1:] for r in m.near_duplicates(docs).collect()} == plain([tuple(r) for r in docs.collect()])


def test_exact_links_both_ways():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 60, 400).astype(np.uint64))
    sets = [np.sort(rng.choice(pool, int(rng.integers(300, 390)), replace=False)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)) for a, b in ((sets[x].tolist(), sets[y].tolist()) for x, y in zip(i, j))]
    assert m.exact_links(sets, sets, i, j, 80).tolist() == want
    assert m.exact_links(sets, sets, i[:50], j[:50], 80).tolist() == want[:50]


def test_shingles():
    assert len(word_digests("a B\x0bc")) == 3 and word_digests("").size == 0
    assert (word_digests("AB É") == word_digests("ab É")).all() and (word_digests("é") != word_digests("É")).all()
    assert len(shingle_digests(word_digests("a b c"), 5)) == 1 and shingle_set(None, 5).size == 0
    text = "word " * 300_000 + "x" * 3_000_000
    assert len(word_digests(text)) == 300_001 and len(np.unique(word_digests(text))) == 2


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
