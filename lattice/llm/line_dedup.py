"""Line dedup with a sharded minimal perfect hash.

Lines are known by 128-bit digests of their keys. All distinct digests go into shards, and each shard becomes a minimal perfect hash
with arrays in its order: fingerprints (64 bits of the digest that the hash itself doesn't rest on alone) and counts of
documents; for counts that reach the threshold there is the largest document, too. Documents' lines then probe the arrays: they stream past
their shard, which lies before them in the same sorted partition, and are dealt to several tasks where a shard has many. Only what is
to be dropped comes back to the texts.

A shard's hash is a cascade of bit arrays: each key that falls alone on a bit of a level takes that bit, the others go on
to the next level. The rank of a key's bit among all set bits is its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, python_ready, table

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: Keys that a shard is meant to hold.
SHARD_KEYS = 1 << 16
#: Lines of a shard that one task takes; more are dealt to several, each with a copy of the arrays.
TASK_LINES = 1 << 20
_GAMMA, _LEVELS = 1.7, 40
_SQUARES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(2 * level + 1) + (b ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys, given as two arrays of unsigned 64-bit integers."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        self.starts = np.concatenate([[0], np.cumsum([int(_SQUARES[x].sum()) for x in levels], dtype=np.int64)]) if levels else np.zeros(1, dtype=np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(_SQUARES[x], dtype=np.int64)[:-1]]) if len(x) else np.zeros(0, np.int64) for x in levels]

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels, sizes = [], []
        while len(a):
            if len(levels) == _LEVELS:
                raise ValueError("keys aren't distinct")
            size = max(8, int(len(a) * _GAMMA) + 7 & ~7)
            at = (_mixed(a, b, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            rest = ~alone[at]
            a, b = a[rest], b[rest]
        return cls(levels, sizes)

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each key. One that was not built in gets -1 or the place of another."""
        out, left = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for k, (bits, size) in enumerate(zip(self.levels, self.sizes)):
            if not len(left):
                break
            at = (_mixed(a[left], b[left], k) % np.uint64(size)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            here = (bits[byte] >> bit & 1).astype(bool)
            below = _SQUARES[bits[byte] & ((np.uint16(1) << bit) - 1).astype(np.uint8)]
            out[left[here]] = (self.starts[k] + self.ranks[k][byte] + below)[here]
            left = left[~here]
        return out

    def dump(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], dtype="<i8").tobytes() + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        sizes = np.frombuffer(raw, "<i8", n, 8).tolist()
        levels, at = [], 8 + 8 * n
        for size in sizes:
            levels.append(np.frombuffer(raw, np.uint8, size // 8, at))
            at += size // 8
        return cls(levels, sizes)


class Shard:
    """Fingerprints and counts of a shard's lines, in the order of its perfect hash, and the largest documents of frequent ones."""

    COLUMNS = ("hash", "prints", "counts", "often", "last")

    def __init__(self, row):
        self.hash = PerfectHash.load(row["hash"])
        self.prints, self.counts = np.frombuffer(row["prints"], "<u8"), np.frombuffer(row["counts"], "<u4")
        self.often, self.last = np.frombuffer(row["often"], "<i4"), np.frombuffer(row["last"], "<i8")

    @staticmethod
    def row(a: np.ndarray, b: np.ndarray, count: np.ndarray, last: np.ndarray, min_documents: int) -> dict[str, bytes]:
        made = PerfectHash.build(a, b)
        at = made.places(a, b)
        prints, counts, lasts = np.empty_like(b), np.empty(len(b), "<u4"), np.empty_like(last)
        prints[at], counts[at], lasts[at] = b, np.minimum(count, (1 << 32) - 1), last
        often = np.flatnonzero(counts >= min_documents)
        return dict(zip(Shard.COLUMNS, (made.dump(), prints.astype("<u8").tobytes(), counts.tobytes(), often.astype("<i4").tobytes(), lasts[often].astype("<i8").tobytes())))

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each key, 0 if the shard doesn't have it, and the largest document of those that are frequent."""
        at = self.hash.places(a, b)
        safe = np.where(at >= 0, at, 0)
        count = np.where((at >= 0) & (self.prints[safe] == b), self.counts[safe], 0) if len(self.prints) else np.zeros(len(a), "<u4")
        k = np.minimum(np.searchsorted(self.often, safe), max(len(self.often) - 1, 0))
        return count, self.last[k] if len(self.last) else np.zeros(len(a), np.int64)


def key_digest(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Of a line's key: the line stripped, with A-Z lower-cased. None if it has fewer than min_chars code points."""
    key = line.strip(SPACE)
    return xxhash.xxh3_128_digest(key.encode("utf-8").lower()) if len(key) >= min_chars else None


def _digests(lines: list[str], min_chars: int) -> tuple[list[int], np.ndarray]:
    at, raw = [], []
    for i, line in enumerate(lines):
        d = key_digest(line, min_chars)
        if d is not None:
            at.append(i)
            raw.append(d)
    return at, np.frombuffer(b"".join(raw), dtype="<u8").reshape(-1, 2)


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """a, b (digest) and doc, once for each document row and key."""

    def keys(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            parts, ids = [np.zeros((0, 2), dtype="<u8")], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, found = _digests((text or "").split("\n"), min_chars)
                found = np.unique(found, axis=0) if len(found) > 1 else found
                parts.append(found)
                ids.extend([doc] * len(found))
            both = np.concatenate(parts).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], names=["a", "b", "doc"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(keys, "a long, b long, doc long")


def counts_of(keys: DataFrame) -> DataFrame:
    """a, b, n (documents) and last (the largest of them) of each distinct key. The first step spreads a frequent key's documents over all
    tasks, the second adds up counts."""
    once = keys.groupBy("a", "b", "doc").agg(F.lit(1).alias("one"))
    return once.groupBy("a", "b").agg(F.count("one").alias("n"), F.max("doc").alias("last"))


def build_index(counts: DataFrame, n_shards: int, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """One row for each shard: shard and its arrays (binary)."""

    def built(got: pa.Table) -> pa.Table:
        a, b = (got.column(c).to_numpy().astype("<i8").view("<u8") for c in ("a", "b"))
        made = Shard.row(a, b, got.column("n").to_numpy(), got.column("last").to_numpy().astype("<i8"), min_documents)
        return pa.table({"shard": [got.column("shard")[0].as_py()], **{k: pa.array([v], pa.binary()) for k, v in made.items()}})

    schema = "shard long, " + ", ".join(f"{c} binary" for c in Shard.COLUMNS)
    # only null ids give no last document; they are less than all others
    named = counts.withColumn("last", F.coalesce("last", F.lit(-(1 << 63)).cast("long")))
    return named.withColumn("shard", F.pmod("b", F.lit(n_shards)).cast("long")).groupBy("shard").applyInArrow(built, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, shard_keys: int = SHARD_KEYS, task_lines: int = TASK_LINES) -> DataFrame:
    """The id and the columns ``keep`` as they are, text without the dropped lines, n_lines (before) and n_dropped. ``keep`` may not name one
    of the latter three.

    Lines are split at \\n; a null or empty text is one empty line, and its text is empty. A key found in min_documents
    different ids loses all its lines but those in the largest of these ids. Rows of one id count as one document, and each
    keeps or drops its own lines; null ids count as one document, less than all others. Ids are compared as longs. Other
    columns are ignored; an empty table gives no rows. The distinct lines' digests with their counts are written down.
    """
    if set(keep) & {"text", "n_lines", "n_dropped"}:
        raise ValueError("keep names a column of the result")
    python_ready(docs.sparkSession)
    counts = cut(counts_of(line_keys(docs, id_col, text_col, min_chars)))
    n_shards = max(1, -(-counts.count() // shard_keys))
    index = cut(build_index(counts, n_shards, min_documents))
    # lines that each shard has to expect: one for each document of a key
    load = counts.groupBy(F.pmod("b", F.lit(n_shards)).cast("long").alias("shard")).agg(F.ceil(F.sum("n") / task_lines).cast("int").alias("parts"))
    drops = _drops(line_keys(docs, id_col, text_col, min_chars), index, load.filter("parts > 1"), n_shards, min_documents)
    gathered = drops.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("__drops")).withColumnRenamed("doc", "__doc")
    return _without(docs.join(gathered, F.col(id_col).cast("long").eqNullSafe(F.col("__doc")), "left"), id_col, text_col, keep, min_chars)


def _without(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...], min_chars: int) -> DataFrame:
    """docs has the keys that are to go in __drops."""
    kept = list(dict.fromkeys([id_col, *keep]))
    n = len(kept)

    def lines_dropped(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out, sizes, counts = [], [], []
            for text, gone in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist()):
                lines = (text or "").split("\n")
                sizes.append(len(lines))
                drop = set()
                if gone:
                    keys = {(x["a"], x["b"]) for x in gone}
                    at, found = _digests(lines, min_chars)
                    drop = {i for i, k in zip(at, found.view("<i8").tolist()) if tuple(k) in keys}
                counts.append(len(drop))
                out.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text or "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=[*kept, "text", "n_lines", "n_dropped"])

    rows = docs.select(*[F.col(c) for c in kept], F.col(text_col).cast("string").alias("__text"), "__drops")
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(lines_dropped, f"{fields}, text string, n_lines long, n_dropped long")


def _drops(keys: DataFrame, index: DataFrame, load: DataFrame, n_shards: int, min_documents: int) -> DataFrame:
    """doc, a, b of all lines to be dropped, found at the shards. Each part of a shard's lines meets a copy of its arrays
    and streams past them. load: the parts (more than one) of shards with many lines; never more rows than there are shards."""
    spark = keys.sparkSession
    blank = [F.lit(None).cast("binary").alias(c) for c in Shard.COLUMNS]
    load = F.broadcast(load)
    shard, parts = F.pmod("b", F.lit(n_shards)).cast("long").alias("shard"), F.coalesce("parts", F.lit(1))
    lines = keys.select(shard, "a", "b", "doc").join(load, "shard", "left").select("shard", F.pmod(F.xxhash64("doc"), parts).cast("int").alias("part"), F.lit(1).alias("kind"), "a", "b", "doc", *blank)
    arrays = index.join(load, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("a", "b", "doc")], *Shard.COLUMNS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    met = lines.unionByName(arrays).repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "kind")

    def probed(batches: Iterator[pa.RecordBatch]):
        shard, at = None, None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            cuts = [0, *(np.nonzero((np.diff(place, axis=0) != 0).any(axis=1))[0] + 1).tolist(), len(place)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if place[lo, 2] == 0:
                    at = tuple(place[lo, :2])
                    shard = Shard({c: batch.column(6 + i)[lo].as_py() for i, c in enumerate(Shard.COLUMNS)})
                elif at == tuple(place[lo, :2]):
                    part = batch.slice(lo, hi - lo).select(["a", "b", "doc"])
                    a, b = (part.column(c).to_numpy().view("<u8") for c in ("a", "b"))
                    count, last = shard.probe(a, b)
                    doc = part.column("doc")
                    same = doc.is_valid().to_numpy(zero_copy_only=False) & (doc.fill_null(0).to_numpy() == last)
                    yield part.filter(pa.array((count >= min_documents) & ~same))

    return met.mapInArrow(probed, "a long, b long, doc long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), frequent AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, i, line, (last IS NOT NULL AND last <> doc_id) AS gone FROM lines LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
