"""Hard negatives against brute force, with rows that take no part, ties, copies, and lists that are split and pruned."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattice.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, anchors, k=5, percent=80):
    rows = {i: (label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows}
    out = []
    for a in anchors:
        label, q = rows[a]
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in rows.items() if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fit = [(n, i) for n, i, other in scored if other != label and percent * -s <= 100 * -n <= 100 * -s]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit[:k], 1)]
    return sorted(out)


def mined(spark, rows, anchors, **settings):
    df = hn.quantised(spark.createDataFrame(rows, SCHEMA))
    got = hn.mine(df, df.filter(F.col("vec_id").isin([int(a) for a in anchors])), **settings)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def clustered(seed, n, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    at = rng.integers(0, 6, n)
    x = (centres[at] + 0.15 * rng.normal(size=(n, dim))).astype(np.float32)
    label = np.where(rng.random(n) < 0.7, at % 3, rng.integers(0, 3, n))
    x[: n // 3] = x[0]  # a third of all rows is one vector
    return [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_same_as_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(hn, "ROWS_PER_LIST", 12)
    rows = clustered(seed, 240)
    anchors = [0, 1, 100, 150, 200, 239]
    assert mined(spark, [(*r, 0) for r in rows], anchors, part_bytes=300) == brute(rows, anchors)


def test_rows_that_take_no_part(spark):
    good = [(i, [1.0 + i % 3, 0.5 * i, -1.0], i % 2) for i in range(1, 12)]
    bad = [(100, None, 1), (101, [1.0, None, 0.0], 1), (102, [float("nan")] * 3, 0), (103, [float("inf"), 0.0, 0.0], 0), (104, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (105, [], 1), (106, [9.0, 9.0], 1), (107, [3e38, 0.0, 0.0], 1)]
    anchors = [1, 2, 3, 101, 104, 106]
    assert mined(spark, [(*r, 7) for r in good + bad], anchors) == brute(good, [1, 2, 3])
    # repeated rows count once, and so does a repeated id
    twice = good + good + [(5, [99.0, 99.0, 99.0], 1)]
    least = {i: min((r for r in twice if r[0] == i), key=lambda r: (r[2], r[1])) for i, _, _ in twice}
    assert mined(spark, [(*r, 7) for r in twice], [1, 2, 3]) == brute(list(least.values()), [1, 2, 3])


def test_empty_and_alone(spark):
    assert mined(spark, [], []) == []
    assert mined(spark, [(1, [1.0], 1, 0)], [1]) == []
    assert mined(spark, [(1, [1.0], 1, 0), (2, [1.0], 1, 0)], [1, 2]) == []


def test_scores_beyond_53_bits():
    a = np.array([[3_000_000_001, 7], [5, -3]], dtype=np.int64) // np.array([[2], [1]])
    assert (hn.products(a, a) == np.array([[int(x) * int(z) + int(y) * int(w) for z, w in a] for x, y in a])).all()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    rows = np.concatenate([c + rng.integers(-9, 9, (50, 4)) for c in rng.integers(-300, 300, (8, 4))])
    centres = hn.centroids_of(rows, 8)
    near, far = hn.nearest(rows, centres)
    radii = np.array([far[near == c].max(initial=0) for c in range(len(centres))])
    index = hn.Index(None, centres, radii, np.bincount(near, minlength=len(centres)))
    most, least = index.bounds(rows[:20])
    scores = rows[:20] @ rows.T
    assert (scores <= most[:, near]).all() and (scores >= least[:, near]).all()
    fifth = np.sort(scores, axis=1)[:, -5]
    assert (most < fifth[:, None]).sum() > 20  # lists that need no visit


def test_driver_table(spark, sf):
    from test_sql_operators import expected, rows

    assert rows(hn.query(spark, sf)) == expected(hn.SQL, embeddings=spark.read.parquet(f"{sf}/embeddings.parquet"))
