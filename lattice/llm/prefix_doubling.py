"""Exact removal of long byte strings that an earlier document has, by distributed prefix doubling.

A byte goes if a string of ``length`` bytes (50) that covers it starts in a document with a smaller id, too. To find such strings each position would
get the rank of the string that starts there, for growing lengths, by sorting pairs at an offset; a position whose rank no other document shares drops out before
the next sort. Most positions must never get to a sort, so three exact steps go before it, each of which keeps what may be shared:

1. Every string of 50 bytes names one of its half-long grams, the one with the least hash. Equal strings name the same gram at the
   same offset, so strings whose gram no other document names are out. Grams travel to buckets as packed arrays, a gram once for each batch of documents.
2. Positions that follow each other and are left form stretches, cut at grams that content chooses. Of equal stretches
   only the one in the smallest document goes on; all positions of the others are settled.
3. The same for pieces, the positions of a stretch that name one gram from one side of it; three quarters of all their strings are the same bytes.
   Pieces for which no other document has these are settled, too.

What is left is sorted by pairs of halves. All these meet in buckets as packed arrays; what is equal within a batch is settled before the shuffle, so that
strings that very many documents have are no hot spot.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cleaned, python_ready, shared_path, table
from .shingles import flat, mixed

LENGTH = 50
#: Bytes of a text that are looked at at once, less than 2^20.
STEP = 1 << 17
#: Grams of a batch of documents, and of a bucket.
BATCH_GRAMS, BUCKET_GRAMS = 1 << 20, 1 << 18
#: Bits of a gram's hash that travel; the bucket has others.
KEY_BITS = 40
#: One in so many grams ends a stretch.
STRETCH = 8
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_PLACE = (1 << 20) - 1


def gram_hashes(b: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each ``size`` bytes, made from hashes of doubled lengths."""
    now, n, out, done = b.astype(_U) + _U(1), 1, None, 0
    with np.errstate(over="ignore"):
        while size:
            if size & 1:
                if out is None:
                    out, done = now, n
                else:
                    m = len(b) - (done + n) + 1
                    out, done = out[:m] * _U(pow(_BASE, n, 1 << 64)) + now[done : done + m], done + n
            size >>= 1
            if size:
                m = len(b) - 2 * n + 1
                now, n = now[:m] * _U(pow(_BASE, n, 1 << 64)) + now[n : n + m], 2 * n
        out ^= out >> _U(29)
        out *= _U(0xBF58476D1CE4E5B9)
        out ^= out >> _U(32)
    return out


def hashes_at(data: np.ndarray, size: int, *places: np.ndarray) -> list[np.ndarray]:
    """The hashes of ``size`` bytes at places, which ascend."""
    out = [np.zeros(len(at), _U) for at in places]
    for lo in range(0, max(0, len(data) - size + 1), STEP):
        h = gram_hashes(data[lo : lo + STEP + size - 1], size)
        for at, hashes in zip(places, out):
            i, j = np.searchsorted(at, (lo, lo + len(h)))
            hashes[i:j] = h[at[i:j] - lo]
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values that follow each other."""
    k = 1
    while 2 * k <= n:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


def half_of(length: int) -> int:
    return (length + 1) // 2


def named_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, first, last, gram, named: the runs of places whose strings of ``length`` bytes name the same gram, its hash and its place. owner is the value
    that holds the place, places count from the beginning of data.

    A string names the gram of half its length that has the least upper hash bits, of equal ones the leftmost. Bytes are looked at in steps;
    a run that a step ends is two runs.
    """
    half, out = half_of(length), []
    for lo in range(0, max(0, len(data) - length + 1), STEP):
        b = data[lo : lo + STEP + length - 1]
        h = gram_hashes(b, half)
        named = sliding_min((h & ~_U(_PLACE)) | np.arange(len(h), dtype=_U), length - half + 1) & _U(_PLACE)
        new = np.concatenate([[True], named[1:] != named[:-1]])
        begins = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, lo + len(named))]
        new[begins - lo] = True
        first = np.nonzero(new)[0]
        owner = np.searchsorted(offsets, first + lo, side="right") - 1
        last = np.minimum(np.append(first[1:], len(named)) - 1, offsets[owner + 1] - length - lo)  # no string crosses into the next value
        fits = last >= first
        place = named[first[fits]].astype(np.int64)
        out.append((owner[fits], first[fits] + lo, last[fits] + lo, h[place], place + lo))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (*[np.zeros(0, np.int64)] * 3, np.zeros(0, _U), np.zeros(0, np.int64))


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def shared_grams(texts: DataFrame, n_buckets: int, length: int = LENGTH) -> DataFrame:
    """doc and key: the grams that documents name and another document names, too (and by chance others). texts: doc, text, which may be null."""

    def named(batches: Iterator[pa.RecordBatch]):
        keys, docs, size = [], [], 0
        for batch in batches:
            owner, _, _, gram, _ = named_runs(*flat(batch.column(1)), length)
            keys.append(gram)
            docs.append(batch.column(0).to_numpy()[owner])
            size += len(gram)
            if size >= BATCH_GRAMS:
                yield _asked(np.concatenate(keys), np.concatenate(docs), n_buckets)
                keys, docs, size = [], [], 0
        if size:
            yield _asked(np.concatenate(keys), np.concatenate(docs), n_buckets)

    def answered(got: pa.Table) -> pa.Table:
        keys, docs, kinds = [], [], []
        for row in got.to_pylist():
            few = np.frombuffer(row["keys"], dtype=np.uint8).reshape(-1, KEY_BITS // 8)
            keys.append(np.pad(few, ((0, 0), (0, 8 - KEY_BITS // 8))).view("<i8").ravel())
            docs.append(np.frombuffer(row["docs"], dtype="<i8"))
            kinds.append(np.full(len(few), row["kind"]))
        keys, docs, kinds = np.concatenate(keys), np.concatenate(docs), np.concatenate(kinds)
        known = kinds == _KNOWN
        order = np.lexsort((docs[~known], keys[~known]))
        k, d, several = keys[~known][order], docs[~known][order], kinds[~known][order] == _SEVERAL
        start, end = ends_of(k)
        shared = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)) | np.logical_or.reduceat(several, start) if len(k) else np.zeros(0, dtype=bool)
        many = np.repeat(shared, end - start) & ~several
        return pa.table({"doc": pa.array(np.concatenate([d[many], docs[known]]), pa.int64()), "key": pa.array(np.concatenate([k[many], keys[known]]), pa.int64())})

    return texts.mapInArrow(named, "bucket int, kind int, keys binary, docs binary").groupBy("bucket").applyInArrow(answered, "doc long, key long")


#: A gram that one document of a batch names; one that several name (for other batches to meet); and each of these several documents.
_ONE, _SEVERAL, _KNOWN = range(3)


def ends_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0]
    return start, np.append(start[1:], len(x))


def _asked(grams: np.ndarray, docs: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """A batch's rows for the buckets. Documents that know that they share a gram don't ask; they go to any bucket, so that a gram that very many
    documents name is no hot spot."""
    order = np.lexsort((docs, grams))
    grams, docs = grams[order], docs[order]
    once = np.concatenate([[True], (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])])
    grams, docs = grams[once], docs[once]
    start, end = ends_of(grams)
    several = docs[start] != docs[end - 1]
    own = np.repeat(several, end - start)
    bucket = (grams >> _U(KEY_BITS)) % _U(n_buckets)
    rows = []
    for kind, at, to in ((_ONE, start[~several], bucket), (_SEVERAL, start[several], bucket), (_KNOWN, np.nonzero(own)[0], docs.view(_U) % _U(n_buckets))):
        at = at[np.argsort(to[at], kind="stable")]
        few = np.ascontiguousarray(grams[at]).view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
        rows += [(int(to[at[lo]]), kind, _bytes(few[lo:hi]), _bytes(docs[at[lo:hi]])) for lo, hi in zip(*ends_of(to[at]))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "kind", "keys", "docs"])


class Scratch:
    """Tables in the shared folder, until they are no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, name: str, made: Callable[[], DataFrame], drop: tuple[str, ...] = ()) -> DataFrame:
        """What ``made`` gives, written and read again; then the tables ``drop`` go. The shuffle files behind it go as soon as it is written, or, where
        Spark can't do that, when the driver's JVM has collected its garbage, which is asked for (therefore a function makes the DataFrame)."""
        path = self.paths[name] = shared_path(self.spark, name)
        with cleaned(self.spark):
            made().write.option("compression", "zstd").parquet(path)
        jvm = self.spark.sparkContext._jvm
        for old in drop:
            place = jvm.org.apache.hadoop.fs.Path(self.paths.pop(old))
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        gc.collect()
        jvm.System.gc()
        return self.spark.read.parquet(path)


#: Columns of runs of positions: the place (document, digest of its text, first position, number of positions), the run's key of 128 bits and the hash of
#: the bytes that all its strings share. body has the bytes of its strings, start is where they begin there.
COLUMNS = {"doc": "<i8", "t": "<i8", "at": "<i4", "n": "<i4", "a": "<u8", "b": "<u8", "known": "<u8"}
PLACE = ("doc", "t", "at", "n")
PACK = ", ".join(["bucket int, kind int, size int", *[f"`{c}` binary" for c in COLUMNS], "body binary"])
_NAMES = ["bucket", "kind", "size", *COLUMNS, "body"]
#: Bytes and runs of a batch, and of a pack that is written down.
RUN_BYTES, BATCH_RUNS, PACK_BYTES, PACK_RUNS = 1 << 23, 1 << 19, 1 << 16, 1 << 9
#: Rows of texts or packs of which runs are made at once.
AT_ONCE = 16
#: Bytes of texts, of stretches and of pieces for which there is a bucket.
TEXT_BUCKET, STRETCH_BUCKET, PIECE_BUCKET = 1 << 23, 1 << 21, 1 << 21
#: Runs that go as a whole; that go on; that go on if another document shares what is known of them; and what is known to be shared.
_GONE, _OPEN, _ASKS, _SHARED = range(4)
Runs = dict[str, np.ndarray]


def taken(runs: Runs, at: np.ndarray, names: tuple[str, ...] | None = None) -> Runs:
    """Some runs (indices or a mask), with some columns."""
    return {c: x[at] for c, x in runs.items() if names is None or c in names}


def joined(parts: list[Runs]) -> Runs:
    return {c: np.concatenate([x[c] for x in parts]) for c in parts[0]}


def gathered(data: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of data from each start on, one after another, and where each begins."""
    begins = np.cumsum(sizes) - sizes
    out = np.empty(sizes.sum(), np.uint8)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + STEP)))
        at, end = begins[lo], begins[hi - 1] + sizes[hi - 1]
        out[at:end] = data[np.repeat(start[lo:hi] - begins[lo:hi], sizes[lo:hi]) + np.arange(at, end)]
        lo = hi
    return out, begins


def packs(kind: int, to: np.ndarray, runs: Runs, body: np.ndarray | None, length: int) -> list[tuple]:
    """A row for each value of to, which has the runs of that value as packed columns."""
    order = np.argsort(to, kind="stable")
    to, runs = to[order], taken(runs, order)
    out = []
    for lo, hi in zip(*ends_of(to)):
        raw = b"" if body is None else gathered(body, runs["start"][lo:hi], runs["n"][lo:hi].astype(np.int64) + (length - 1))[0].tobytes()
        out.append((int(to[lo]), kind, len(raw), *[_bytes(runs[c][lo:hi].astype(x, copy=False)) if c in runs else b"" for c, x in COLUMNS.items()], raw))
    return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32()] * 3 + [pa.binary()] * (len(COLUMNS) + 1)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * len(types), types)], names=_NAMES)


def unpacked(got: pa.Table, kind: int, length: int) -> tuple[Runs, np.ndarray]:
    """The runs of a kind, and their bytes."""
    got = got.filter(pa.array(got.column("kind").to_numpy() == kind))
    column = lambda c: flat(pa.concat_arrays(got.column(c).chunks) if got.num_rows else pa.array([], pa.binary()))[0]
    runs = {c: column(c).view(x) for c, x in COLUMNS.items()}
    sizes = runs["n"].astype(np.int64) + (length - 1)
    count = max(map(len, runs.values()))
    return {c: x for c, x in runs.items() if len(x) == count} | {"start": np.cumsum(sizes) - sizes}, column("body")


def firsts(runs: Runs) -> np.ndarray:
    """Which runs are in the smallest document of those that have the same key."""
    order = np.lexsort((runs["doc"], runs["b"], runs["a"]))
    a, b, doc = (runs[c][order] for c in ("a", "b", "doc"))
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    out = np.zeros(len(a), dtype=bool)
    out[order] = doc == doc[new][np.cumsum(new) - 1]
    return out


def several(runs: Runs) -> np.ndarray:
    """Which runs have a known that a run of another document has, too."""
    order = np.lexsort((runs["doc"], runs["known"]))
    start, end = ends_of(runs["known"][order])
    doc, out = runs["doc"][order], np.zeros(len(order), dtype=bool)
    out[order] = np.repeat(doc[start] != doc[end - 1], end - start)
    return out


def asking(runs: Runs, body: np.ndarray | None, n_buckets: int, length: int) -> pa.RecordBatch:
    """A batch's rows for the buckets. Of equal runs only those of the batch's smallest document ask, and runs that know that what they know is shared
    tell it once and go on by their own keys, so that bytes that very many documents have are no hot spot."""
    n = _U(n_buckets)
    by_key = lambda x: mixed(x["a"] + x["b"] * _U(_BASE)) % n
    first = firsts(runs)
    gone, runs = taken(runs, ~first, PLACE), taken(runs, first)
    rows = packs(_GONE, gone["doc"].view(_U) % n, gone, None, length)
    if "known" not in runs:
        return batch_of(rows + packs(_OPEN, by_key(runs), runs, body, length))
    shared = several(runs)
    asks, open_ = taken(runs, ~shared), taken(runs, shared)
    told = np.unique(open_.pop("known"))
    rows += packs(_SHARED, told % n, {"known": told}, None, length)
    return batch_of(rows + packs(_ASKS, asks["known"] % n, asks, body, length) + packs(_OPEN, by_key(open_), open_, body, length))


def settled(packed: DataFrame, length: int) -> DataFrame:
    """What buckets answer, in packs: runs that an equal run of a smaller document has settled are gone; those left are open, if they have bytes."""

    def answered(got: pa.Table) -> pa.Table:
        told, _ = unpacked(got, _SHARED, length)
        gone, _ = unpacked(got, _GONE, length)
        left, away, bodies = [], [taken(gone, slice(None), PLACE)], []
        for kind in (_ASKS, _OPEN):
            runs, body = unpacked(got, kind, length)
            if len(runs["doc"]):
                left.append(taken(runs, slice(None), (*PLACE, "a", "b")) | {"known": runs.get("known", np.zeros(len(runs["doc"]), _U)), "start": runs["start"] + sum(map(len, bodies)), "open": np.full(len(runs["doc"]), kind == _OPEN)})
                bodies.append(body)
        rows = []
        if left:
            runs, body = joined(left), np.concatenate(bodies)
            first = firsts(runs)
            away.append(taken(runs, ~first, PLACE))
            runs = taken(runs, first)
            asks = np.nonzero(~runs["open"])[0]
            runs["open"][asks] = several(taken(runs, asks)) | np.isin(runs["known"][asks], told["known"])
            runs = taken(runs, runs["open"], (*PLACE, "start"))
            if len(body):
                sizes = np.cumsum(runs["n"].astype(np.int64) + (length - 1))
                rows += packs(_OPEN, sizes // PACK_BYTES + np.arange(len(sizes)) // PACK_RUNS, runs, body, length)
        away = joined(away)
        rows += packs(_GONE, np.arange(len(away["doc"])) // (8 * PACK_RUNS), away, None, length)
        return pa.Table.from_batches([batch_of(rows)])

    return packed.groupBy("bucket").applyInArrow(answered, PACK)


def in_batches(batches: Iterator[pa.RecordBatch], made: Callable[[pa.RecordBatch], tuple[Runs, np.ndarray | None]], n_buckets: int, length: int) -> Iterator[pa.RecordBatch]:
    """``asking`` for the runs that are made of each few rows, many at once."""
    runs, bodies, count, size = [], [], 0, 0
    for few in (batch.slice(i, AT_ONCE) for batch in batches for i in range(0, batch.num_rows, AT_ONCE)):
        some, body = made(few)
        if not len(some["doc"]):
            continue
        if body is not None:
            body, some["start"] = gathered(body, some["start"], some["n"].astype(np.int64) + (length - 1))
            some["start"] += size
            bodies.append(body)
            size += len(body)
        runs.append(some)
        count += len(some["doc"])
        if size >= RUN_BYTES or count >= BATCH_RUNS:
            yield asking(joined(runs), np.concatenate(bodies) if bodies else None, n_buckets, length)
            runs, bodies, count, size = [], [], 0, 0
    if count:
        yield asking(joined(runs), np.concatenate(bodies) if bodies else None, n_buckets, length)


def buckets_of(packed: DataFrame, bucket: int) -> int:
    return 1 + (packed.filter(F.col("kind") == _OPEN).agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // bucket


def stretches(texts: DataFrame, shared: DataFrame, n_buckets: int, length: int = LENGTH) -> DataFrame:
    """Packs of the stretches of positions whose gram is shared, a stretch that several documents have in the smallest. texts: doc, t, text; shared: doc, keys."""

    def cut_out(batch: pa.RecordBatch) -> tuple[Runs, np.ndarray]:
        data, offsets = flat(batch.column(2))
        owner, first, last, gram, _ = named_runs(data, offsets, length)
        keys = batch.column(3)
        known = _of_owner(keys.flatten().to_numpy(), np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy()))
        ours = np.isin(_of_owner((gram & _U((1 << KEY_BITS) - 1)).astype(np.int64), owner), known)
        owner, first, last, gram = owner[ours], first[ours], last[ours], gram[ours]
        ends = (gram >> _U(24)) % _U(STRETCH) == 0
        begins = np.concatenate([[True], ends[:-1] | (first[1:] != last[:-1] + 1)])[: len(first)]
        lo, hi, of = first[begins], last[np.append(begins[1:], True)[: len(first)]], owner[begins]
        raw = data.tobytes()
        digests = b"".join(hashlib.md5(raw[i:j], usedforsecurity=False).digest() for i, j in zip(lo.tolist(), (hi + length).tolist()))
        a, b = np.frombuffer(digests, dtype="<u8").reshape(-1, 2).T
        doc, t = (batch.column(i).to_numpy()[of] for i in (0, 1))
        return {"doc": doc, "t": t, "at": (lo - offsets[of]).astype(np.int32), "n": (hi - lo + 1).astype(np.int32), "a": a, "b": b, "start": lo}, data

    met = texts.join(shared, "doc").select("doc", "t", "text", "keys")
    return settled(met.mapInArrow(lambda batches: in_batches(batches, cut_out, n_buckets, length), PACK), length)


def _of_owner(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """One number for a key of a document; others may have it by chance."""
    with np.errstate(over="ignore"):
        return mixed(keys.astype(_U) + owner.astype(_U) * _U(_BASE))


def in_pieces(runs: Runs, data: np.ndarray, length: int) -> Runs:
    """The pieces of stretches: positions that name one gram, apart those that begin far before it and those near it. All strings of the former
    have so many bytes before the gram, too, and those of the latter so many after it, that three quarters of their length are known."""
    half, far = half_of(length), (length - half_of(length) + 1) // 2
    offsets = np.append(runs["start"], len(data))
    owner, first, last, _, named = named_runs(data, offsets, length)
    sides = []
    for lo, hi, at, size in ((first, np.minimum(last, named - far), named - far, half + far), (np.maximum(first, named - far + 1), last, named, length - far + 1)):
        has = hi >= lo
        sides.append((lo[has], hi[has], owner[has], hashes_at(data, size, at[has])[0]))
    # the halves of the first string and of the last one have all bytes of a piece
    halves, out = iter(hashes_at(data, half, *[x for lo, hi, _, _ in sides for x in (lo, lo + (length - half), hi, hi + (length - half))])), []
    for lo, hi, of, known in sides:
        with np.errstate(over="ignore"):
            a, b = (mixed(next(halves) + mixed(next(halves)) * _U(_BASE)) for _ in range(2))
            a += (hi - lo).astype(_U)
        place = {"doc": runs["doc"][of], "t": runs["t"][of], "at": (runs["at"][of] + (lo - offsets[of])).astype(np.int32), "n": (hi - lo + 1).astype(np.int32)}
        out.append(place | {"a": a, "b": b, "known": known, "start": lo})
    return joined(out)


def pieces(heads: DataFrame, n_buckets: int, length: int = LENGTH) -> DataFrame:
    """Packs of the pieces of which another document has three quarters of the strings and whose text is another one."""

    def split(batch: pa.RecordBatch) -> tuple[Runs, np.ndarray]:
        runs, data = unpacked(pa.Table.from_batches([batch]), _OPEN, length)
        return in_pieces(runs, data, length), data

    return settled(heads.filter(F.col("kind") == _OPEN).mapInArrow(lambda batches: in_batches(batches, split, n_buckets, length), PACK), length)


def positions(open_: DataFrame, n_buckets: int, length: int = LENGTH) -> DataFrame:
    """Packs of the positions of pieces whose string a smaller document has. Their key is the pair of their halves."""
    half = half_of(length)

    def halves(batch: pa.RecordBatch) -> tuple[Runs, None]:
        runs, data = unpacked(pa.Table.from_batches([batch]), _OPEN, length)
        n = runs["n"].astype(np.int64)
        owner = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        at = runs["start"][owner] + j
        a, b = hashes_at(data, half, at, at + (length - half))
        return {"doc": runs["doc"][owner], "t": runs["t"][owner], "at": (runs["at"][owner] + j).astype(np.int32), "n": np.ones(len(j), np.int32), "a": a, "b": b}, None

    return settled(open_.filter(F.col("kind") == _OPEN).mapInArrow(lambda batches: in_batches(batches, halves, n_buckets, length), PACK), length)


def merged(runs: Runs, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, t, first, last: the bytes that runs' strings cover, as spans that don't touch, in order."""
    order = np.lexsort((runs["at"], runs["t"], runs["doc"]))
    doc, t, first, n = (runs[c][order] for c in PLACE)
    first = first.astype(np.int64)
    new = np.append(True, (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]))[: len(doc)]
    shift = np.cumsum(new) << 33  # so that a text's spans end before the next text's
    end = np.maximum.accumulate(first + n + (length - 1) + shift) if len(doc) else first
    start = np.nonzero(np.append(True, first[1:] + shift[1:] > end[:-1])[: len(doc)])[0]
    return doc[start], t[start], first[start], (end - shift)[np.append(start[1:], len(doc)) - 1 if len(doc) else start] - 1


def spans_of(packed: DataFrame, n_buckets: int, length: int = LENGTH) -> DataFrame:
    """doc, t and spans: what the runs that are gone cover."""

    def dealt(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            doc, t, first, last = merged(unpacked(pa.Table.from_batches([batch]), _GONE, length)[0], length)
            # as runs again: a span has length - 1 positions less than bytes
            runs = {"doc": doc, "t": t, "at": first, "n": last - first - (length - 2)}
            yield batch_of(packs(_GONE, doc.view(_U) % _U(n_buckets), runs, None, length))

    def all_of(got: pa.Table) -> pa.Table:
        doc, t, first, last = merged(unpacked(got, _GONE, length)[0], length)
        start = np.nonzero(np.append(True, (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]))[: len(doc)])[0]
        spans = pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)), pa.int32()), pa.StructArray.from_arrays([pa.array(first), pa.array(last)], names=["first", "last"]))
        return pa.table({"doc": pa.array(doc[start], pa.int64()), "t": pa.array(t[start], pa.int64()), "spans": spans})

    return packed.filter(F.col("kind") == _GONE).mapInArrow(dealt, PACK).groupBy("bucket").applyInArrow(all_of, "doc long, t long, spans array<struct<first:long,last:long>>")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc, t and spans (array of struct first, last): bytes that a string of ``length`` bytes covers which starts in a smaller document. docs: doc
    (long), t (digest of the text), text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scratch = Scratch(docs.sparkSession)
    n_buckets, n_texts = max(1, 4 * size // length // BUCKET_GRAMS), 1 + size // TEXT_BUCKET
    shared = scratch.table("grams", lambda: shared_grams(docs.select("doc", "text"), n_buckets, length).groupBy("doc").agg(F.collect_list("key").alias("keys")))
    heads = scratch.table("stretches", lambda: stretches(docs, shared, n_texts, length), drop=("grams",))
    open_ = scratch.table("pieces", lambda: pieces(heads, buckets_of(heads, STRETCH_BUCKET), length))
    hits = scratch.table("positions", lambda: positions(open_, buckets_of(open_, PIECE_BUCKET), length))
    gone = heads.unionByName(open_).unionByName(hits)
    return scratch.table("spans", lambda: spans_of(gone, n_texts, length), drop=("stretches", "pieces", "positions"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), length: int = LENGTH) -> DataFrame:
    """One row for each row: the id and ``keep`` as they are, kept (the bytes that remain, which may end within a character), n_bytes, n_removed and
    n_spans (maximal removed runs). ``keep`` may not name one of the latter four.

    Texts are UTF-8 bytes, null is empty. Ids are compared as longs; rows of one id are one document, so they do not remove each other's strings; null ids
    are one document, less than all others. Strings are judged on the input. Matches never cross rows. Other columns are ignored, an empty table
    gives no rows.
    """
    if set(keep) & {"kept", "n_bytes", "n_removed", "n_spans"}:
        raise ValueError("keep names a column of the result")
    if length < 2:
        raise ValueError("length must be at least 2")
    python_ready(docs.sparkSession)
    kept = list(dict.fromkeys([id_col, *keep]))
    text = F.col(text_col).cast("string")
    named = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(kept)], F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc"), F.xxhash64(text).alias("t"), text.alias("text"))
    gathered = repeated_spans(named.filter(F.octet_length("text") >= length).select("doc", "t", "text"), length)
    n = len(kept)

    def removed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            data, offsets = flat(batch.column(n))
            for i, spans in enumerate(batch.column(n + 1)):
                raw = data[offsets[i] : offsets[i + 1]]
                edge = np.zeros(len(raw) + 1, dtype=np.int64)
                if spans.is_valid:
                    first, last = (x.to_numpy() for x in spans.values.flatten())
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                runs = int((gone & ~np.concatenate([[False], gone])[:-1]).sum())
                out.append((raw[~gone].tobytes(), len(raw), int(gone.sum()), runs))
            rest = [pa.array(x, kind) for x, kind in zip(zip(*out) if out else [()] * 4, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *rest], names=[*kept, "kept", "n_bytes", "n_removed", "n_spans"])

    rows = named.join(gathered, ["doc", "t"], "left").select(*[f"__{i}" for i in range(n)], "text", "spans")
    fields = ", ".join(f"`{c}` {rows.schema[f'__{i}'].dataType.simpleString()}" for i, c in enumerate(kept))
    return rows.mapInArrow(removed, f"{fields}, kept binary, n_bytes long, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_substrings(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
