"""Hard-negative mining over k-means inverted lists.

Centroids are learned from a bounded sample, but every row goes to the list of its nearest one, and each list has its stored radius: the
greatest distance of a row from the centroid. By Cauchy-Schwarz no row of a list scores more than ``q.c + |q| r`` with an anchor q, nor less
than ``q.c - |q| r``. An anchor visits lists by falling bound, passes over those that lie outside all of its score windows, and stops
where the bound falls strictly below the k-th best score that it has. Visits go in waves, each of them one join of (list, part) keys:
the first has the most promising lists, later ones more and more, and what is known after one wave prunes the next, so that results are exact.

Lists are packed in parts of bounded size, so a list that has a third of all rows is many rows of the table; anchors are packed
in blocks. A task meets one part and one block at a time and scores them by one matrix product; the best k of each (anchor, window)
are then merged by a window whose limit Spark applies before the shuffle, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, python_ready, table

#: Rows of the sample that centroids are learned from, lists at most, rows for each list, rounds of learning.
SAMPLE, MOST_LISTS, ROWS_PER_LIST, ROUNDS = 20_000, 2048, 256, 8
#: Bytes of a part's vectors, anchors of a block, scores that are held at a time.
PART_BYTES, BLOCK, SCORES = 1 << 19, 1024, 1 << 20
#: Lists of the first wave, and how many times as many each following one has.
FIRST, GROWTH = 4, 16
LARGEST_SQUARE = float(1 << 62)
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_ROW = "vec_id long, label long, vector array<long>"


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """vec_id, label, vector: rows that take part, each component x as floor(scale * x).

    Rows with a null id, label or vector, without components, or with a null or non-finite component take no part; nor do rows whose
    scores may need more than 64 bits (a norm of 2^31 or more), and rows of another length than the most frequent one (of equally frequent
    ones, the greatest). Of a repeated id only the row with the least label and vector takes part.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("x")).filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0")
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 40))))
    rows = rows.withColumn("q", F.transform("x", lambda v: F.floor(F.lit(scale) * v).cast("double")))
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v)
    rows = cut(rows.filter(square < LARGEST_SQUARE).select("vec_id", "label", F.transform("q", lambda v: v.cast("long")).alias("vector")))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(2).collect()
    if len(sizes) > 1:
        rows = rows.filter(F.size("vector") == sizes[0]["n"])
    again = cut(rows.groupBy("vec_id").count().filter("count > 1").select("vec_id"))
    if again.isEmpty():
        return rows
    one = rows.join(again, "vec_id").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return rows.join(again, "vec_id", "left_anti").unionByName(one.select("vec_id", "r.label", "r.vector"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def centroids_of(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most n centroids, by Lloyd's rounds over the sample; they start at rows spread over the distinct ones."""
    rows = np.unique(sample.astype(float), axis=0)
    at = np.random.default_rng(0).permutation(len(rows))[: max(1, n)]
    centres = rows[at]
    for _ in range(rounds):
        near = nearest(rows, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance from it."""
    out, far = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows))
    half = (centres**2).sum(axis=1) / 2
    step = max(1, SCORES // max(1, len(centres)))
    for i in range(0, len(rows), step):
        x = rows[i : i + step].astype(float)
        out[i : i + step] = np.argmax(x @ centres.T - half, axis=1)
        far[i : i + step] = np.sqrt(((x - centres[out[i : i + step]]) ** 2).sum(axis=1))
    return out, far


def dump(vectors: np.ndarray) -> bytes:
    """Integers in as few bytes each as they need; the first byte says how many."""
    least, most = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= least and most <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + np.ascontiguousarray(vectors, dtype=kind).tobytes()


def load(raw: bytes, n: int) -> np.ndarray:
    """The n rows that were dumped."""
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).reshape(n, -1)


class Index:
    """The lists: ``parts`` has a row for each part (list, part, ids, labels, vectors); centroids, radii and numbers of parts are bounded."""

    def __init__(self, parts: DataFrame, centres: np.ndarray, radii: np.ndarray, n_parts: np.ndarray):
        self.parts, self.centres, self.radii, self.n_parts = parts, centres, radii, n_parts

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least that a row of each list can score with each anchor."""
        q = anchors.astype(float)
        middle, reach = q @ self.centres.T, np.sqrt((q**2).sum(axis=1))[:, None] * self.radii[None, :]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6  # of rounding
        return middle + reach + slack, middle - reach - slack


def build_index(rows: DataFrame, part_bytes: int = PART_BYTES, most_lists: int = MOST_LISTS) -> Index:
    """Lists of all ``rows``; only the centroids are learned from a sample of SAMPLE rows, chosen by the hash of their ids."""
    spark = rows.sparkSession
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column("vector").combine_chunks()
    sample = matrix(taken)
    if not len(sample):
        return Index(spark.createDataFrame([], "list int, part int, ids binary, labels binary, vectors binary"), np.zeros((0, 0)), np.zeros(0), np.zeros(0, dtype=int))
    n_lists = min(most_lists, max(1, rows.count() // ROWS_PER_LIST))
    centres = centroids_of(sample, n_lists)
    part_rows = max(16, part_bytes // (2 * sample.shape[1]))

    def listed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                near, far = nearest(matrix(batch.column(2)), centres)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()), pa.array(far)], names=["vec_id", "label", "vector", "list", "far"])

    assigned = cut(rows.mapInArrow(listed, _ROW + ", list int, far double"))
    radii, n_parts = np.zeros(len(centres)), np.zeros(len(centres), dtype=int)
    for r in assigned.groupBy("list").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # one row for each list
        radii[r["list"]], n_parts[r["list"]] = r["far"], -(-r["n"] // part_rows)

    def numbered(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            ids, lists = batch.column(0).to_numpy().astype(np.uint64), batch.column(3).to_numpy()
            with np.errstate(over="ignore"):
                mixed = (ids * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = (mixed % np.maximum(n_parts[lists], 1).astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(part)], names=["vec_id", "label", "vector", "list", "part"])

    def packed(got: pa.Table) -> pa.Table:
        order = np.argsort(got.column("vec_id").to_numpy(), kind="stable")
        binary = lambda x: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
        vectors = matrix(got.column("vector").combine_chunks())[order]
        return pa.table({"list": got.column("list")[:1], "part": got.column("part")[:1], "ids": binary(got.column("vec_id").to_numpy()[order]), "labels": binary(got.column("label").to_numpy()[order]), "vectors": pa.array([dump(vectors)], pa.binary())})

    parts = assigned.mapInArrow(numbered, _ROW + ", list int, part int").groupBy("list", "part").applyInArrow(packed, "list int, part int, ids binary, labels binary, vectors binary")
    return Index(cut(parts), centres, radii, n_parts)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b."""
    x, y = a.astype(float), b.astype(float)
    if np.sqrt((x**2).sum(axis=1).max(initial=0) * (y**2).sum(axis=1).max(initial=0)) < float(1 << 52):
        return (x @ y.T).astype(np.int64)  # no partial sum needs more than 53 bits
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, floors: np.ndarray, tops: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the first k of each row among those that are allowed and between floors and tops. Columns are in the order of ids."""
    ok = allowed & (scores >= floors[:, None]) & (scores <= tops[:, None])
    if ok.shape[1] > k and ok.sum() > 4 * k * len(ok):
        least = np.partition(np.where(ok, scores, _LOW), ok.shape[1] - k, axis=1)[:, ok.shape[1] - k]
        ok &= scores >= least[:, None]
    r, c = np.nonzero(ok)
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def search(index: Index, requests: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, window, score, vec_id and rank (from 1): the first k rows of each anchor and window, by falling score and then rising id.

    ``requests`` has anchor (id), label, vector and windows (array of struct window int, low long, high long). Rows have the anchor's own label but
    not its id (``same``) or another label, and score from low to high.
    """
    spark = requests.sparkSession
    schema = "anchor long, window int, score long, vec_id long"
    found = spark.createDataFrame([], schema + ", rank int")
    n_lists, begin, wave = len(index.centres), 0, FIRST
    n_blocks = max(1, -(-requests.count() // BLOCK))
    requests = cut(requests.repartition(n_blocks, F.xxhash64("anchor")))
    own = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    try:
        while begin < n_lists:
            end = min(n_lists, begin + wave)
            # a block is packed by Arrow batches; a task later reads few of its large rows at a time
            spark.conf.set(key, str(BLOCK))
            visits = cut(_asking(requests, found if begin else None, k).coalesce(n_blocks).mapInArrow(_visits(index, begin, end), _VISIT))
            begin, wave = end, wave * GROWTH
            if visits.isEmpty():
                continue
            spark.conf.set(key, "8")
            met = visits.join(index.parts, ["list", "part"]).select("ids", "labels", "vectors", "anchors", "names", "floors", "tops", "own_labels", "own_vectors")
            new = met.mapInArrow(_scores(k, same), schema).unionByName(found.select("anchor", "window", "score", "vec_id"))
            found = cut(new.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k))
    finally:
        spark.conf.set(key, old)
    return found


def _asking(requests: DataFrame, found: DataFrame | None, k: int) -> DataFrame:
    """requests with their windows' names, floors (the least score that still counts) and tops."""
    kth = F.array().cast("array<struct<window:int,score:long>>")
    if found is not None:
        known = found.filter(F.col("rank") == k).groupBy("anchor").agg(F.collect_list(F.struct("window", "score")).alias("kth"))
        requests, kth = requests.join(known, "anchor", "left"), F.col("kth")
    floor = lambda w: F.greatest(w["low"], F.get(F.filter(kth, lambda x: x["window"] == w["window"]), F.lit(0))["score"])
    columns = [F.transform("windows", f).alias(name) for name, f in (("names", lambda w: w["window"]), ("floors", floor), ("tops", lambda w: w["high"]))]
    return requests.select("anchor", "label", "vector", *columns).filter(F.size("windows") > 0)


_VISIT = "list int, part int, anchors binary, names binary, floors binary, tops binary, own_labels binary, own_vectors binary"


def _visits(index: Index, begin: int, end: int):
    """Blocks of anchors for each part of each list that is in the wave and open to them."""
    centres, radii, n_parts = index.centres, index.radii, index.n_parts

    def visits(batches: Iterator[pa.RecordBatch]):
        lists = Index(None, centres, radii, n_parts)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, vectors = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            counts = np.diff(batch.column(3).offsets.to_numpy())
            names, floors, tops = (batch.column(i).flatten().to_numpy() for i in (3, 4, 5))
            of = np.repeat(np.arange(len(ids)), counts)  # the anchor of each window
            most, least = lists.bounds(vectors)
            place = np.empty(most.shape, dtype=np.int64)
            np.put_along_axis(place, np.argsort(-most, axis=1, kind="stable"), np.arange(most.shape[1])[None, :], axis=1)
            for c in np.nonzero(n_parts > 0)[0].tolist():
                wave = (place[:, c] >= begin) & (place[:, c] < end)
                # strictly below the k-th score or the window: closed
                open_ = wave[of] & (most[of, c] >= floors) & (least[of, c] <= tops)
                if not open_.any():
                    continue
                mine = of[open_]
                once = mine[firsts(mine)]
                row = [*[x.tobytes() for x in (ids[mine], names[open_].astype(np.int64), floors[open_], tops[open_], labels[once])], dump(vectors[once])]
                n = int(n_parts[c])
                for at in range(0, n, 64):
                    parts = list(range(at, min(n, at + 64)))
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(parts), pa.int32()), pa.array(parts, pa.int32()), *[pa.array([x] * len(parts), pa.binary()) for x in row]], names=[x.split()[0] for x in _VISIT.split(", ")])

    return visits


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=bool)


def _scores(k: int, same: bool):
    def scored(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(j)[i].as_py() for j in range(9)]
                ids, labels, anchors, names, floors, tops, own_labels = (np.frombuffer(raw[j], dtype=np.int64) for j in (0, 1, 3, 4, 5, 6, 7))
                vectors, own = load(raw[2], len(ids)), load(raw[8], len(own_labels))
                of = np.cumsum(firsts(anchors)) - 1  # windows of one anchor follow each other
                step = max(1, SCORES // max(1, len(ids)))
                for lo in range(0, len(anchors), step):
                    at = slice(lo, lo + step)
                    mine = of[at]
                    scores = products(own[mine[0] : mine[-1] + 1], vectors)[mine - mine[0]]
                    alike = own_labels[mine][:, None] == labels[None, :]
                    allowed = alike & (anchors[at][:, None] != ids[None, :]) if same else ~alike
                    r, c = best_of(scores, ids, allowed, floors[at], tops[at], k)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors[at][r]), pa.array(names[at][r], pa.int32()), pa.array(scores[r, c]), pa.array(ids[c])], names=["anchor", "window", "score", "vec_id"])

    return scored


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 5, least_percent: int = 80, **index_settings) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor and each of its first n_positives rows of the
    same label, the first n_negatives rows of other labels that score from least_percent of the positive's score to all of it.

    rows and anchors: vec_id, label, vector as ``quantised`` gives them; both are read more than once. Scores are integers, so both ends count in; of a negative positive score no
    row can be in the window. Fewer rows are returned where there are fewer; ties go to smaller ids. Empty tables give no rows.
    """
    python_ready(rows.sparkSession, rows=4096)
    index = build_index(rows, **index_settings)
    asked = cut(anchors.select(F.col("vec_id").alias("anchor"), "label", "vector"))
    any_score = F.array(F.struct(F.lit(0).alias("window"), F.lit(_LOW).cast("long").alias("low"), F.lit(_HIGH).cast("long").alias("high")))
    positives = search(index, asked.withColumn("windows", any_score), n_positives, same=True)
    # in integers, 80 p <= 100 s is s >= ceil(p * 80 / 100)
    low = F.expr(f"cast(ceil(cast(score AS decimal(20, 0)) * {least_percent} / 100) AS long)")
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("window"), low.alias("low"), F.col("score").alias("high")))).alias("windows"))
    negatives = search(index, asked.join(windows, "anchor"), n_negatives, same=False)
    named = positives.select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["anchor", "window"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")))
    return mine(rows, rows.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
