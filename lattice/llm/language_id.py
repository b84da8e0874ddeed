"""Language identification by error-correcting output codes.

Each language has a codeword; for each of its bits a binary classifier over hashed byte n-grams predicts the bit from a
text. Decoding sums, over the bits, a loss of the predicted margin against the codeword's bit, weighted by how well the
bit's classifier does, and takes the codeword with the least sum. A text whose two best codewords are nearly as good is
flagged as ambiguous.

The classifiers are least-squares fits with a ridge penalty, solved in closed form on the driver from a bounded sample of
labelled rows (``Settings``: rows, rows_per_language, languages); features are computed on the executors over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import python_ready, table

UNDETERMINED = "und"
#: Buckets of the hashed n-grams, as a power of 2.
BITS = 14
_LETTER = regex.compile(r"\p{L}")
#: ASCII characters but letters count as a space.
_FOLD = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_CHUNK = 1 << 20


@dataclass(frozen=True)
class Settings:
    rows_per_language: int = 300  # of the sample that is learned from, at most
    rows: int = 3000  # of the whole sample, at most
    languages: int = 3000  # that are learned, at most (one row of each is the whole sample): those with the most rows, of equals the first by name
    ridge: float = 0.1
    slope: float = 3.0  # of the loss
    margin: float = 0.08  # of the mean weighted loss: nearer codewords are ambiguous


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the hashed byte bigrams and trigrams of the whole text: a vector of length 1."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD), dtype=np.uint8)
    counts = np.zeros(1 << BITS, dtype=np.int64)
    for at in range(0, max(1, len(raw) - 2), _CHUNK):
        b = raw[at : at + _CHUNK + 2].astype(np.uint32)
        pairs = b[:-1] << 8 | b[1:]
        for grams in (pairs[: _CHUNK] | 1 << 24, pairs[:-1] << 8 | b[2:]):
            grams *= np.uint32(2654435761)
            counts += np.bincount(grams >> np.uint32(32 - BITS), minlength=1 << BITS)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages. Up to 6: all distinct splits of them; beyond: of some random codes,
    that with the largest least distance."""
    if n <= 6:
        bits = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if k == 0 else (1 if (b >> (k - 1)) & 1 else -1) for b in range(bits)] for k in range(n)], dtype=np.float64)
    rng, best, found = np.random.default_rng(7), -1, None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if apart.min() > best:
            best, found = apart.min(), code
    return found


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    settings: Settings

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score from 0 to 1, and whether it is ambiguous."""
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = features(text) @ self.weights + self.bias
        loss = np.logaddexp(0, -self.settings.slope * self.code * margins) @ self.bit_weights
        order = np.argsort(loss, kind="stable")
        share = np.exp(-(loss - loss[order[0]]) * len(margins))
        return self.languages[order[0]], float(1 / share.sum()), bool(loss[order[1]] - loss[order[0]] < self.settings.margin * loss.mean())


def fit(labelled: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from the rows with a language and a text with letters. The sample of each language holds the rows whose ids'
    hashes are least, so it is the same in every run."""
    spark = labelled.sparkSession
    python_ready(spark)
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.languages).collect()}
    if not counts:
        return Model((), np.zeros((0, 0)), np.zeros((1 << BITS, 0)), np.zeros(0), np.zeros(0), settings)
    per = max(1, min(settings.rows_per_language, settings.rows // len(counts)))
    part, text_hash = F.pmod(F.xxhash64("id"), F.lit(1_000_000)), F.xxhash64("text")
    # first a filter that keeps about twice what is wanted of each language, then the exact choice, of rows by id and text
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1_000_001, int(2_000_000 * max(per, 20) / n) + 1))])
    some = rows.withColumn("t", text_hash).filter(part < share[F.col("lang")])
    ids = some.select("lang", "id", "t", part.alias("h")).distinct().withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "t"))).filter(F.col("k") <= per).select("lang", F.coalesce("id", F.lit("")).alias("id"), "t")
    # at most settings.rows ids
    chosen = some.withColumn("id", F.coalesce("id", F.lit(""))).join(F.broadcast(ids), ["lang", "id", "t"], "left_semi").dropDuplicates(["lang", "id", "t"])

    def vectors(batches):
        for batch in batches:
            langs, at, values = [], [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if has_letter(text):
                    x = features(text)
                    langs.append(lang)
                    at.append(np.nonzero(x)[0].astype(np.int32))
                    values.append(x[at[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in values], pa.binary())], names=["lang", "at", "x"])

    # counts and vectors of the bounded sample only
    got = sorted(chosen.select("lang", "text").mapInArrow(vectors, "lang string, at binary, x binary").collect(), key=lambda r: (r["lang"], bytes(r["x"]), bytes(r["at"])))
    languages = tuple(sorted({r["lang"] for r in got}))
    if len(languages) < 2:
        return Model(languages, np.ones((len(languages), 1)), np.zeros((1 << BITS, 1)), np.zeros(1), np.ones(1), settings)
    x = np.zeros((len(got), 1 << BITS), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], dtype=np.int32)] = np.frombuffer(r["x"], dtype=np.float32)
    of = np.array([languages.index(r["lang"]) for r in got])
    del got
    code = codewords(len(languages))
    y = code[of]
    mean = x.mean(axis=0)
    x -= mean
    # a language with many rows weighs as much as one with few
    weight = np.sqrt((len(of) / len(languages)) / np.bincount(of)[of])[:, None]
    bias = (y * weight**2).sum(axis=0) / (weight**2).sum()
    x *= weight.astype(np.float32)  # in place, and in single precision: the sample is the largest thing on the driver
    gram = (x @ x.T).astype(np.float64)
    alpha = np.linalg.solve(gram + settings.ridge * np.eye(len(of)), (y - bias) * weight)
    w = x.T @ alpha.astype(np.float32)
    right = (np.sign((x @ w) / weight + bias) == y).mean(axis=0)
    trust = np.maximum(right - 0.5, 0.01)
    return Model(languages, code, w.astype(np.float32), bias - mean @ w, trust / trust.sum(), settings)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id and the columns ``keep`` as they are, lang_pred, score and ambiguous, of every row, repeated or not.

    A null text, one without any letter, and every text if nothing was learned, is `und` with score 0. Texts are read
    whole. Other columns are ignored. ``keep`` may not name a column of the result.
    """
    if set(keep) & {"lang_pred", "score", "ambiguous"}:
        raise ValueError("keep names a column of the result")
    spark = df.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(model)
    kept = list(dict.fromkeys([id_col, *keep]))

    def predicted(batches):
        m = sent.value
        for batch in batches:
            out = [m.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.bool_())], names=[*kept, "lang_pred", "score", "ambiguous"])

    has_text = text_col in kept and df.schema[text_col].dataType.simpleString() == "string"
    at = kept.index(text_col) if has_text else len(kept)
    rows = df.select(*[F.col(c) for c in kept], *([] if has_text else [F.col(text_col).cast("string").alias("__text")]))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInArrow(predicted, f"{fields}, lang_pred string, score double, ambiguous boolean")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(docs: DataFrame) -> Model:
    return fit(docs.filter(~held_out()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, learned(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
