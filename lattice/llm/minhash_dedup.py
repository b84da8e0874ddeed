"""Near-duplicate documents by MinHash and sequential Bayesian verification.

Documents with equal shingle sets are one class from the start. Signatures of class representatives are cut into bands; those
that share a band are candidates, and what candidates connect is a cluster, which only says who may have to be
compared. Clusters are dealt into blocks of bounded size, and each pair of blocks is one task: signatures are compared
batch by batch, and a pair goes as soon as the posterior probability, under a uniform prior, that its similarity
reaches the threshold is below the chosen miss probability. Survivors are verified exactly on their full sets. From a
block pair only a spanning forest of its links comes back, so no group gives rise to all its pairs as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, cut, python_ready, sent, table
from .graph import components
from .shingles import mixed, shingle_set

WORDS = 5
#: Links: PERCENT * |union| <= 100 * |intersection|.
PERCENT = 85
#: A pair exactly at the threshold shares no band with a probability of (1 - 0.85 ** ROWS) ** BANDS = 8e-7.
BANDS, ROWS = 24, 5
#: Hashes of a batch, and the probability of missing a link that a batch may cost.
BATCH, MISS = 24, 1e-6
#: Documents and shingles of a block, at most, on average.
BLOCK_DOCUMENTS, BLOCK_SHINGLES = 384, 1_000_000
_N = BANDS * ROWS
_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 32, size=_N, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, size=_N, dtype=np.uint64).astype(np.uint32)[:, None]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set that isn't empty."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)[None, :]
    out = np.full(_N, (1 << 32) - 1, dtype=np.uint32)
    for at in range(0, x.shape[1], 2048):
        np.minimum(out, (x[:, at : at + 2048] * _A + _B).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(ROWS):
        key = mixed(key ^ parts[:, k])
    return key.view(np.int64)


def least_matches(percent: int, miss: float) -> dict[int, int]:
    """For each number of compared hashes: the least matches that leave the posterior P(J >= percent / 100) at miss."""
    t, out = percent / 100, {}
    for n in range(BATCH, _N + 1, BATCH):
        # with a uniform prior the posterior is Beta(m + 1, n - m + 1); its tail is a sum of binomial terms
        terms = [comb(n + 1, j) * t**j * (1 - t) ** (n + 1 - j) for j in range(n + 2)]
        tail = np.cumsum(terms)  # tail[m] = P(J >= t | m of n match)
        out[n] = int(np.argmax(tail >= miss))
    return out


def exact_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray], rows: np.ndarray, cols: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs (rows[k] of a, cols[k] of b) are links, on the full sets."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    if len(rows) < 400:
        common = np.array([len(np.intersect1d(sets_a[i], sets_b[j], assume_unique=True)) for i, j in zip(rows.tolist(), cols.tolist())], dtype=np.int64)
    else:
        # counts of common shingles of all pairs, by products of incidence matrices of some shingles at a time
        use_a, use_b = np.unique(rows), np.unique(cols)
        flat_a, flat_b = np.concatenate([sets_a[i] for i in use_a]), np.concatenate([sets_b[j] for j in use_b])
        of_a, of_b = np.repeat(np.arange(len(use_a)), size_a[use_a]), np.repeat(np.arange(len(use_b)), size_b[use_b])
        shared = np.intersect1d(flat_a, flat_b)
        at_a, at_b = (np.minimum(np.searchsorted(shared, f), max(len(shared) - 1, 0)) for f in (flat_a, flat_b))
        in_a, in_b = ((shared[at] == f if len(shared) else np.zeros(len(f), bool)) for at, f in ((at_a, flat_a), (at_b, flat_b)))
        total = np.zeros((len(use_a), len(use_b)), dtype=np.float32)
        for lo in range(0, len(shared), 4096):
            some = []
            for at, keep, of, n in ((at_a, in_a, of_a, len(use_a)), (at_b, in_b, of_b, len(use_b))):
                here = keep & (at >= lo) & (at < lo + 4096)
                m = np.zeros((n, 4096), dtype=np.float32)
                m[of[here], at[here] - lo] = 1
                some.append(m)
            total += some[0] @ some[1].T
        common = total[np.searchsorted(use_a, rows), np.searchsorted(use_b, cols)].astype(np.int64)
    return 100 * common >= percent * (size_a[rows] + size_b[cols] - common)


def block_links(sig_a: np.ndarray, sig_b: np.ndarray, sets_a: list[np.ndarray], sets_b: list[np.ndarray], same: bool, percent: int, miss: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between the documents of two blocks, or of one with itself (same)."""
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    need, found, forest = least_matches(percent, miss), [], Forest(len(sets_a) + len(sets_b))
    for lo in range(0, len(sets_a), 128):
        a = sig_a[lo : lo + 128]
        # candidates: a band in common, and sizes that allow the threshold
        fits = 100 * np.minimum(size_a[lo : lo + 128, None], size_b[None, :]) >= percent * np.maximum(size_a[lo : lo + 128, None], size_b[None, :])
        if same:
            fits &= np.arange(len(sets_b))[None, :] > np.arange(lo, lo + len(a))[:, None]
        banded = np.zeros_like(fits)
        for k in range(0, _N, ROWS):
            hit = a[:, k, None] == sig_b[None, :, k]
            for r in range(k + 1, k + ROWS):
                hit &= a[:, r, None] == sig_b[None, :, r]
            banded |= hit
        rows, cols = np.nonzero(banded & fits)
        matches = np.zeros(len(rows), dtype=np.int32)
        for n in range(BATCH, _N + 1, BATCH):
            for at in range(0, len(rows), 1 << 16):
                part = slice(at, at + (1 << 16))
                matches[part] += (a[rows[part], n - BATCH : n] == sig_b[cols[part], n - BATCH : n]).sum(axis=1, dtype=np.int32)
            live = matches >= need[n]
            rows, cols, matches = rows[live], cols[live], matches[live]
        # the most similar first; of pairs that earlier links connect, nothing more can be learned
        order = np.argsort(-matches, kind="stable")
        rows, cols = rows[order] + lo, cols[order]
        offset = 0 if same else len(sets_a)
        at, step = 0, 256
        while at < len(rows):
            part = [(i, j) for i, j in zip(rows[at : at + step].tolist(), cols[at : at + step].tolist()) if forest.root(i) != forest.root(j + offset)]
            at, step = at + step, min(step * 4, 1 << 15)
            if part:
                i, j = np.array(part).T
                for x, y in zip(i[good := exact_links(sets_a, sets_b, i, j, percent)].tolist(), j[good].tolist()):
                    if forest.join(x, y + offset):
                        found.append((x, y))
    return found


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc, n (size of its set), d (digest of the set), bands, sig and t (hash of the text)."""

    def made(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n, digests, bands, sigs = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s) if len(s) else None
                sigs.append(None if sig is None else sig.tobytes())
                bands.append(None if sig is None else band_keys(sig))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary()), batch.column(2)], names=["doc", "n", "d", "bands", "sig", "t"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("t")).mapInArrow(made, "doc long, n long, d binary, bands array<long>, sig binary, t long")


def links(reps: DataFrame, texts: DataFrame, words: int, percent: int, miss: float) -> DataFrame:
    """a, b: links that connect what all links of the representatives connect. reps: doc, n, bands, sig; texts: doc, text."""
    banded = reps.select("doc", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc").alias("least"), F.count("*").alias("c")).filter("c > 1").select("key", "least")
    clusters = components(banded.join(shared, "key").select(F.col("doc").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct())
    members = cut(clusters.select(F.col("node").alias("doc"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("doc"), F.col("root").alias("cluster")).distinct()).join(reps.select("doc", "n", "sig"), "doc"))
    sizes = members.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    blocks = sizes.select("cluster", F.ceil(F.greatest(F.col("c") / BLOCK_DOCUMENTS, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))

    def sets(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [shingle_set(t, words).tobytes() for t in batch.column("text").to_pylist()]
            columns = {c: batch.column(c) for c in ("doc", "cluster", "blocks", "sig")}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(found, pa.binary())], names=[*columns, "shingles"])

    # texts of representatives in clusters only
    placed = members.select("doc", "cluster", "sig").join(blocks, "cluster")
    needed = texts.join(sent(placed.select("doc").distinct()), "doc", "left_semi")
    full = needed.join(placed, "doc").mapInArrow(sets, "doc long, cluster long, blocks int, sig binary, shingles binary")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select(F.col("cluster"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "sig", "shingles")

    def compared(got: pa.Table) -> pa.Table:
        i, j = got.column("i")[0].as_py(), got.column("j")[0].as_py()
        own, docs = got.column("own").to_numpy(), got.column("doc").to_numpy()
        order = np.argsort(docs, kind="stable")
        sigs, raw = got.column("sig").to_pylist(), got.column("shingles").to_pylist()
        sides = []
        for side in (i, j):
            at = [k for k in order.tolist() if own[k] == side]
            sides.append((docs[at], np.array([np.frombuffer(sigs[k], np.uint32) for k in at], dtype=np.uint32).reshape(-1, _N), [np.frombuffer(raw[k], np.uint64) for k in at]))
        (da, sa, fa), (db, sb, fb) = sides
        found = block_links(sa, sb, fa, fb, i == j, percent, miss)
        return pa.table({"a": pa.array([int(da[x]) for x, _ in found], pa.int64()), "b": pa.array([int(db[y]) for _, y in found], pa.int64())})

    return pairs.groupBy("cluster", "i", "j").applyInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, miss: float = MISS, keep_digest: bool = False) -> DataFrame:
    """Of every document row: the id (as a long), n_shingles, component_id and kept (the id is the component's); with keep_digest
    text_digest (xxhash64 of the text), too.

    A text of fewer than ``words`` words has its whole sequence as its one shingle. Null texts and texts without words
    have an empty set, are linked with nothing and are their own component. Ids should be unique; rows that repeat one
    each belong to their own text's component. Rows with a null id have no component (null) and are kept. Other columns
    are ignored; an empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    all_ = cut(sketches(docs, id_col, text_col, words))
    named = all_.filter(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = named.groupBy("d").agg(F.min("doc").alias("rep"))
    marked = cut(named.select("doc", "n", "d", "t").join(classes, "d").select("doc", "n", "d", "t", "rep"))
    # equal sets have equal signatures: the representative's row has them
    reps = all_.join(marked.filter("doc = rep").select("doc", "d").distinct(), ["doc", "d"], "left_semi").select("doc", "n", "bands", "sig").dropDuplicates(["doc"])
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    roots = components(links(reps, texts, words, percent, miss))
    joined = marked.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("doc", "n", "t", F.coalesce("root", "rep").alias("component"))
    rest = all_.filter(F.col("doc").isNull() | (F.col("n") == 0)).select("doc", "n", "t", F.col("doc").alias("component"))
    out = joined.unionByName(rest)
    digest = [F.col("t").alias("text_digest")] if keep_digest else []
    return out.select(F.col("doc").alias(id_col), *digest, F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

