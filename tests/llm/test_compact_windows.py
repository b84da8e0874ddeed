import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattice.llm import compact_windows as m
from lattice.llm import shingles
from lattice.llm.shingles import mixed


def test_windows_cover_each_subsequence_once():
    rng = np.random.default_rng(1)
    for h in (rng.permutation(60), rng.integers(0, 6, 60), np.ones(60, int)):
        h = h.astype(np.uint64)
        windows = list(zip(*(v.tolist() for v in m.compact_windows(h, 5))))
        for i in range(60):
            for j in range(i + 4, 60):
                held = [w for w in windows if w[0] <= i <= w[1] <= j <= w[2]]
                assert len(held) == 1 and held[0][1] == i + int(h[i : j + 1].argmin())
    assert not len(m.compact_windows(h[:4], 5)[0]) and not len(m.compact_windows(h[:0], 5)[0])


def test_windows_of_one_word_over_and_over():
    began = time.time()
    m.text_keys([np.full(1_000_000, 77, np.uint64)], 21)
    assert time.time() - began < 60  # by the square it would be hours


def test_joint_windows_are_all_signatures():
    rng = np.random.default_rng(2)
    x = mixed(rng.integers(0, 30, 200).astype(np.uint64))
    seen = {}
    for i in range(200 - 45):
        key = np.full(1, 1, dtype=np.uint64)
        for f in range(m.ROWS):
            h = mixed(x[i : i + 46] ^ np.uint64((f + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) | np.uint64(1)
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + h.min())
        seen[i] = int(key.view(np.int64)[0])
    key, _, start, until = m.joint_windows(x, 46)
    assert {i: int(k) for k, a, b in zip(key, start, until) for i in range(a, b + 1)} == seen


def test_two_functions_refine_each_other(monkeypatch):
    monkeypatch.setattr(m, "ROWS", 2)
    test_joint_windows_are_all_signatures()


def test_texts_of_a_batch_have_their_own_keys():
    rng = np.random.default_rng(3)
    texts = [mixed(rng.integers(0, 50, n).astype(np.uint64)) for n in (90, 0, 20, 21, 300)]
    k, of, p = m.text_keys(texts, 21)
    for i, t in enumerate(texts):
        alone = m.text_keys([t], 21)
        assert sorted(zip(k[of == i].tolist(), p[of == i].tolist())) == sorted(zip(alone[0].tolist(), alone[2].tolist()))
    assert set(of.tolist()) == {0, 3, 4}


def corpus():
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(3000)]
    new = lambda n: [str(x) for x in rng.choice(words, n)]
    shared, near = new(60), new(120)
    changed = list(near)
    for k in (30, 90):
        changed[k] = "changed"
    rows = {
        1: new(100) + shared + new(40),
        2: new(10) + shared + new(200),
        3: shared,
        4: new(300),
        5: new(50) + near + new(50),
        6: new(80) + changed + new(5),
        7: new(30) + shared[:44] + new(30),
        8: new(20),
        9: new(70),
        10: None,
    }
    # 41 of 51 shingles of two windows of 50 words, as if the 46th word of 50 were changed
    rows[13] = new(30) + shared[:45] + new(30)
    rows[11] = rows[9]
    rows[12] = rows[8]
    return {k: " ".join(v) if v is not None else None for k, v in rows.items()}


def test_repeated_passages(spark):
    texts = corpus()
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, place string")
    got = {r["doc_id"]: r for r in m.substring_duplicates(df).collect()}
    assert {k for k, r in got.items() if r["repeated"]} == {1, 2, 3, 5, 6, 9, 11, 13} == {i for pair in brute({k: v for k, v in texts.items() if v}) for i in pair}
    assert [got[k]["n_repeated"] for k in (1, 2, 3)] == [60, 60, 60]
    assert 115 <= got[5]["n_repeated"] <= 125 and got[9]["n_repeated"] == got[11]["n_repeated"] == 70
    assert {got[k]["class_id"] for k in (1, 2, 3, 13)} == {1} and got[13]["n_repeated"] == 45 and {got[k]["class_id"] for k in (5, 6)} == {5} and got[11]["class_id"] == 9
    assert got[10]["n_words"] == 0 and got[7]["class_id"] == 7 and got[12]["class_id"] == 12
    spans = {(r["doc"], r["word_from"], r["word_to"]) for r in m.repeated_passages(df).collect()}
    assert {(2, 10, 69), (1, 100, 159), (3, 0, 59)} <= spans


def test_rows(spark):
    assert m.substring_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = " ".join(f"x{i}" for i in range(30_000))
    df = spark.createDataFrame([(None, text), (1, text), (2, text + " y"), (2, text + " y")], "doc_id long, text string")
    got = sorted(m.substring_duplicates(df).collect(), key=repr)
    assert len(got) == 4 and {(r["doc_id"], r["repeated"]) for r in got} == {(None, False), (1, True), (2, True)}


def brute(texts):
    """Ids of texts that share a passage of exactly 50 words (46 shingles) with 80 percent in common, by all windows."""
    sets = {i: [frozenset(tuple(w[k : k + 5]) for k in range(o, o + 46)) for o in range(len(w) - 49)] for i, w in ((i, t.split()) for i, t in texts.items())}
    ids = sorted(sets)
    return {(b, a) for a in ids for b in ids if a < b and any(5 * len(p & q) >= 4 * len(p | q) for p in sets[a] for q in sets[b])}


def test_all_members_of_a_signature_meet(spark):
    rng = np.random.default_rng(11)
    new = lambda n: [str(x) for x in rng.integers(0, 1 << 40, n)]
    phrase, left, right = new(30), new(10), new(10)
    texts = {k: new(60) + phrase + new(60) for k in (5, 20, 40, 50)} | {k: new(60) + left + phrase + right + new(60) for k in (10, 30)}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_repeated"], r["class_id"]) for r in m.substring_duplicates(df).collect()}
    assert got == {5: (0, 5), 10: (50, 10), 20: (0, 20), 30: (50, 10), 40: (0, 40), 50: (0, 50)}


def test_tiles_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(m, "TILE_STRETCHES", 2)
    test_all_members_of_a_signature_meet(spark)


def variants(rng):
    """Texts that share a passage with one word changed, put in or left out, each in words of its own; and what only looks so."""
    new = lambda n: [str(x) for x in rng.integers(0, 1 << 40, n)]
    p, texts = new(55), []
    for _ in range(14):
        q, at = list(p), int(rng.integers(0, 55))
        q[at : at + int(rng.integers(0, 2))] = new(int(rng.integers(0, 2)))
        texts.append(new(int(rng.integers(0, 60))) + q + new(int(rng.integers(0, 60))))
    texts += [new(40) + p[:30] + new(40) for _ in range(3)] + [new(40) + p[20:50] + new(10) for _ in range(2)] + [new(80), p]
    return [" ".join(x) for x in texts]


@pytest.mark.parametrize("seed", range(6))
def test_groups_of_variants_in_any_order_of_ids(spark, seed):
    """All pairs of 50-word passages by brute force: no link is lost, whichever text has the least id."""
    rng = np.random.default_rng(seed)
    texts = variants(rng)
    ids = rng.permutation(len(texts)) + 1
    texts = dict(zip(ids.tolist(), texts))
    links = brute(texts)
    root = {i: i for i in texts}
    for _ in texts:
        for x, y in links:
            root[x] = root[y] = min(root[x], root[y])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in m.substring_duplicates(df).collect()}
    assert {i for i in texts if got[i]["repeated"]} == {i for pair in links for i in pair}
    assert {i: got[i]["class_id"] for i in texts} == root


def test_repeated_ids_and_periodic_texts(spark):
    rng = np.random.default_rng(21)
    new = lambda n: " ".join(str(x) for x in rng.integers(0, 1 << 40, n))
    a, b = new(80), new(80)
    one = " ".join(["again"] * 20_000)
    rows = [(3, a), (5, a), (5, b), (7, b + " end"), (8, new(9) + " " + b[: len(b) // 2]), (9, one), (10, one + " again again"), (11, one + " x"), (12, new(50) + " " + a + " " + a)]
    got = {}
    for r in m.substring_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["n_words"], r["n_repeated"], r["class_id"]))
    assert got[3] == [(80, 80, 3)] and sorted(got[5]) == [(80, 80, 3)] * 2 and got[7] == [(81, 80, 3)] and got[8][0][1] == 0
    assert [got[k][0][1:] for k in (9, 10, 11)] == [(20_000, 9), (20_002, 9), (20_000, 9)] and got[12] == [(210, 160, 3)]
    # a passage twice in one document only is no repetition
    alone = m.substring_duplicates(spark.createDataFrame([(1, a + " " + new(60) + " " + a), (2, new(70))], "doc_id long, text string")).collect()
    assert not any(r["repeated"] for r in alone)


def test_every_place_of_a_passage():
    rng = np.random.default_rng(12)
    p, filler = (mixed(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (50, 80))
    shingles = lambda w: m.shingle_digests(w, 5)
    changed = p.copy()
    changed[24] = 1
    for first in (p, changed):
        y = shingles(np.concatenate([first, filler, p]))
        for a, b, flip in ((shingles(p), y, False), (y, shingles(p), True)):
            spans = {s[2:] + s[:2] if flip else s for s in m.passages(a, b, 46, 80)}
            assert {s[2:] for s in spans} == {(0, 45), (130, 175)}


def test_recall_of_near_passages(spark):
    assert m.shared_run(46, 80) == 21 and m.shared_run(46, 100) == 46
    rng = np.random.default_rng(13)
    new = lambda n: [str(x) for x in rng.integers(0, 1 << 40, n)]
    texts = {}
    for k in range(400):
        p = new(int(rng.integers(50, 61)))
        q, at = list(p), int(rng.integers(0, len(p)))
        q[at : at + int(rng.integers(0, 2))] = new(1)  # one word changed or put in
        texts[2 * k], texts[2 * k + 1] = " ".join(new(20) + p + new(20)), " ".join(new(30) + q + new(10))
    want = {(2 * k + 1, 2 * k) for k in range(400) if brute({i: texts[i] for i in (2 * k, 2 * k + 1)})}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    classes = {r["doc_id"]: r["class_id"] for r in m.substring_duplicates(df).collect()}
    assert len(want) > 250 and want <= {(b, a) for b, a in classes.items() if a != b}


def linked(x, y):
    """Whether two texts (lists of words) have a verified passage, each with blanks for what the other one hasn't."""
    a, b = (m.shingle_digests(mixed(np.array(w, np.uint64)), 5).astype(np.uint32) for w in (x, y))
    held = [np.where(np.isin(s, t), s, np.uint32(0)) for s, t in ((a, b), (b, a))]
    one, two = ([m.filled(s[i:j], k) for i, j in m.stretches(s, 46, 80)] for k, s in enumerate(held))
    return any(m.passages(s, t, 46, 80) for s in one for t in two)


def brute_link(x, y):
    return bool(brute({i: " ".join(map(str, w)) for i, w in enumerate((x, y))}))


@pytest.mark.parametrize("n", [50, 51, 52, 60])
def test_one_word_changed_at_every_place(n):
    rng = np.random.default_rng(n)
    new = lambda k: rng.integers(0, 1 << 40, k).tolist()
    for at in range(n):
        p = new(n)
        q = [*p[:at], 7, *p[at + 1 :]]
        assert brute_link(new(20) + p + new(20), new(30) + q + new(10))
        assert linked(new(20) + p + new(20), new(30) + q + new(10)) and linked(p, q) and linked(p + new(9), new(9) + q)


def test_phrases_that_repeat():
    rng = np.random.default_rng(5)
    new = lambda k: rng.integers(0, 1 << 40, k).tolist()
    want, got = [], []
    for _ in range(250):
        phrase, texts = new(int(rng.integers(3, 10))), []
        for _ in range(2):
            w = []
            while len(w) < int(rng.integers(110, 141)):
                w += phrase + (new(int(rng.integers(1, 3))) if rng.random() < 0.35 else [])
            texts.append(w)
        want.append(brute_link(*texts))
        got.append(linked(*texts))
    for _ in range(150):
        p, phrase = new(int(rng.integers(50, 61))), new(int(rng.integers(3, 10)))
        i = int(rng.integers(0, 30))
        p[i:i] = phrase * int(rng.integers(1, 4))
        q, at = list(p), int(rng.integers(0, len(p)))
        q[at : at + int(rng.integers(0, 2))] = new(int(rng.integers(0, 2)))
        want.append(brute_link(p + new(5), new(5) + q))
        got.append(linked(p + new(5), new(5) + q))
    assert sum(want) > 100 and all(g for w, g in zip(want, got) if w)


def test_windows_slid_along_a_diagonal():
    rng = np.random.default_rng(6)
    for _ in range(40):
        x, y = (mixed(rng.integers(0, 12, int(rng.integers(46, 90))).astype(np.uint64)) for _ in range(2))
        one, two, d = m.Indexed(x, 21), m.Indexed(y, 21), int(rng.integers(-8, 9))
        percent = int(rng.integers(70, 101))
        want = set()
        for s in range(max(0, d), min(len(x), len(y) + d) - 9):
            a, b = set(x[s : s + 10].tolist()), set(y[s - d : s - d + 10].tolist())
            if 100 * len(a & b) >= percent * len(a | b):
                want |= {k for k in range(s, s + 10) if x[k] in b}
        spans = m._slid(m.Common(one, two), d, 0, len(x), 10, percent)
        got = {k for x0, x1, _, _ in spans for k in range(x0, x1 + 1)}
        assert want <= got and bool(want) == bool(got)


def test_texts_of_one_word_with_others_between():
    rng = np.random.default_rng(8)
    x, y = np.full(5_000, 3, np.uint64), np.full(4_000, 3, np.uint64)
    x[::137] = rng.integers(4, 1 << 40, len(x[::137]))
    began = time.time()
    spans = m.passages(m.shingle_digests(mixed(x), 5), m.shingle_digests(mixed(y), 5), 46, 80)
    covered = np.zeros(len(x), bool)
    for x0, x1, _, _ in spans:
        covered[x0 : x1 + 1] = True
    # all but the others, and the four shingles before each, is covered
    assert covered.sum() >= len(x) - 5 * len(x[::137]) - 4 and time.time() - began < 100


def test_passages_whose_first_or_last_word_differs(spark):
    rng = np.random.default_rng(9)
    new = lambda n: [str(x) for x in rng.integers(0, 1 << 40, n)]
    texts = {}
    for k, at in enumerate([0, 1, 2, 4, 25, 45, 46, 48, 49] * 3):
        p = new(50)
        q = [*p[:at], "other", *p[at + 1 :]]
        texts[2 * k], texts[2 * k + 1] = " ".join(new(20) + p + new(20)), " ".join(new(k % 12) + q + new(11 - k % 12))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["repeated"]) for r in m.substring_duplicates(df).collect()}
    assert got == {i: (i - i % 2, True) for i in texts}


def phrased(rng, n):
    """A text that repeats a phrase, with stray words."""
    phrase, w = rng.integers(0, 1 << 40, int(rng.integers(3, 12))).tolist(), []
    while len(w) < n:
        w += phrase + (rng.integers(0, 1 << 40, int(rng.integers(1, 9))).tolist() if rng.random() < 0.4 else [])
    return w


def test_no_window_of_texts_that_repeat_is_lost():
    rng = np.random.default_rng(15)
    pairs = []
    for _ in range(60):
        x = phrased(rng, int(rng.integers(60, 160)))
        y = [w if rng.random() < 0.97 else 5 for w in x]
        at = int(rng.integers(0, 40))
        pairs.append(tuple(m.shingle_digests(mixed(np.array(w, np.uint64)), 5) for w in (x, y[at:] + y[:at] + y[at:])))
    together = m.aligned(pairs, 46, 80)
    assert together == [m.passages(x, y, 46, 80) for x, y in pairs]
    similar = 0
    for (x, y), spans in zip(pairs, together):
        if not np.isin(m.run_digests(x, 21), m.run_digests(y, 21)).any():
            continue
        covered = set()
        for x0, x1, _, _ in spans:
            covered.update(range(x0, x1 + 1))
        of_y = [set(y[j : j + 46].tolist()) for j in range(len(y) - 45)]
        for i in range(len(x) - 45):
            held = set(x[i : i + 46].tolist())
            places = [[k for k in range(i, i + 46) if x[k] in v] for v in of_y if 5 * len(held & v) >= 4 * len(held | v)]
            similar += bool(places)
            assert not places or any(covered.issuperset(range(p[0], p[-1] + 1)) for p in places)
    assert similar > 1000


def test_no_shuffle_files_are_left(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")
    before = files()
    got = m.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and got.count() == 7


def test_a_frequent_key_is_told_once_a_pack():
    n = 5000
    got = m.packed(np.full(n, 7), np.arange(n), np.arange(n, dtype=np.int32), np.zeros(n, bool), 8).to_pylist()
    assert sum(len(r["keys"]) // 8 for r in got) == 1 and sum(len(r["docs"]) // 8 for r in got if r["kind"] == m._KNOWN) == n


def test_values_that_documents_share(spark):
    rng = np.random.default_rng(5)
    key, doc, value = rng.integers(0, 900, 1200), rng.integers(0, 90, 1200), rng.integers(0, 50, 1200).astype(np.int32)
    of = {}
    for k, d in zip(key.tolist(), doc.tolist()):
        of.setdefault(k, set()).add(d)
    want = {}
    for k, d, v in zip(key.tolist(), doc.tolist(), value.tolist()):
        if len(of[k]) > 1:
            want.setdefault(d, set()).add(v)
    parts = [(key[a : a + 100], doc[a : a + 100], value[a : a + 100], np.zeros(100, bool)) for a in range(0, 1200, 100)]
    rows = [r for p in parts for r in m.packed(*p, 5).to_pylist()]
    df = spark.createDataFrame([(r["bucket"], r["kind"], bytearray(r["keys"]), bytearray(r["docs"]), bytearray(r["values"])) for r in rows], m._PACK)
    got = {r["doc"]: np.frombuffer(r["values"], np.int32).tolist() for r in m.shared_values(df, 5, "<i8", "<i4").collect()}
    assert got == {d: sorted(v) for d, v in want.items()}


def test_words_are_counted_as_words_are_read(monkeypatch):
    texts = ["", None, "a", " a", "a ", "é b\x0bc d", "\n\n", "x" * 30, "a b " * 20]
    for step in (1 << 20, 7):
        monkeypatch.setattr(shingles, "STEP", step)
        got = shingles.word_counts(*shingles.flat(pa.array(texts, pa.string())))
        assert got.tolist() == [len(shingles.word_digests(t or "")) for t in texts]
