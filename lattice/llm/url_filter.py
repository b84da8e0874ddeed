"""URL filters by a sorted digest array.

The rules' 64-bit xxhash digests lie sorted in one file that Spark sends to every executor and workers memory-map.
A batch of URLs is turned into the keys that could match (each dotted suffix of the host with each path prefix as long
as some rule's path), all are probed with one vectorised binary search, and each hit is confirmed against the stored
strings, so equal digests of different strings do no harm.

The file holds: the number of rules, the digests, offsets, the strings, and the verdicts. It is built from a list of
rules on the driver, 8 bytes a rule and the strings; a rule list of 10 million entries takes some 500 MB.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, table

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path). A rule fits its host and all subdomains, and paths that start with its own.
RULES = ((BLOCK, "com", "/en/"), (ALLOW, "example.com", "/en/7"), (ALLOW, "net", "/de/"), (BLOCK, "example.net", "/de/8"), (BLOCK, "org", "/es/"))


def digest(key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"))


class DigestArray:
    """The rules, sorted by digest, as arrays over one memory-mapped file."""

    def __init__(self, path: str):
        head = np.memmap(path, dtype="<u8", mode="r")
        n, n_lengths, self.labels = (int(x) for x in head[:3])  # labels: of the host of a rule, at most
        at = 3
        self.digests, at = head[at : at + n], at + n
        self.offsets, at = head[at : at + n + 1], at + n + 1
        self.blocks, at = head[at : at + n], at + n
        self.lengths, at = [int(x) for x in head[at : at + n_lengths]], at + n_lengths
        self.strings = np.memmap(path, dtype=np.uint8, mode="r")[at * 8 :]

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]], path: str) -> None:
        """A rule given twice keeps its first verdict."""
        found: dict[str, str] = {}
        for verdict, host, prefix in rules:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"verdict {verdict!r}")
            found.setdefault(host.translate(_LOWER) + "\0" + prefix, verdict)
        keys = sorted(found, key=lambda k: (digest(k), k))
        raw = [k.encode("utf-8", "surrogatepass") for k in keys]
        lengths = sorted({len(k.split("\0", 1)[1]) for k in keys})
        labels = max((k.split("\0", 1)[0].count(".") + 1 for k in keys), default=0)
        words = [len(keys), len(lengths), labels, *map(digest, keys), *np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]).tolist(), *(int(found[k] == BLOCK) for k in keys), *lengths]
        with open(path, "wb") as out:
            out.write(np.array(words, dtype="<u8").tobytes() + b"".join(raw) + b"\0" * (-sum(map(len, raw)) % 8))

    def find(self, keys: list[str]) -> np.ndarray:
        """The place of each key among the rules, or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        if not keys or not len(self.digests):
            return found
        wanted = np.fromiter(map(digest, keys), dtype="<u8", count=len(keys))
        at = np.searchsorted(self.digests, wanted, side="left")
        hits = np.nonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == wanted))[0]
        for i in hits:
            key, k = keys[i].encode("utf-8", "surrogatepass"), int(at[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                if self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes() == key:
                    found[i] = k
                    break
                k += 1
        return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path. A null, or one without ``://``, has neither."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("#", 1)[0].split("?", 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def _suffixes(host: str, labels: int) -> list[str]:
    """The host's last labels, up to as many as a rule has."""
    parts = host.rsplit(".", labels)
    parts = parts[1:] if len(parts) > labels else parts
    return [".".join(parts[i:]) for i in range(len(parts))] if host else []


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """``df``'s id as it is, with host, path, rule (host and path of the longest rule that fits, or null) and verdict.

    The longest rule has the most characters of host and path together; of equals, that with the longer host wins. A URL
    that no rule fits is allowed, as are nulls and strings without ``://``. Every row gives a row, repeated or not; other
    columns are ignored; an empty table or an empty list of rules is no special case.
    """
    spark = df.sparkSession
    python_ready(spark)
    folder = tempfile.mkdtemp(prefix="lattice-rules-")
    DigestArray.write(rules, f"{folder}/rules")
    with open(f"{folder}/rules", "rb") as f:
        name = f"rules-{hashlib.sha256(f.read()).hexdigest()[:16]}.bin"
    os.rename(f"{folder}/rules", f"{folder}/{name}")
    if name not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(f"{folder}/{name}")  # to each executor, also to those that come later

    def judged(batches):
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            keys, of, size = [], [], []
            for i, (host, path) in enumerate(parts):
                for suffix in _suffixes(host, array.labels):
                    for n in array.lengths:
                        if n <= len(path):
                            keys.append(suffix + "\0" + path[:n])
                            of.append(i)
                            size.append((len(suffix) + n, len(suffix)))
            best: dict[int, tuple[tuple[int, int], int, int]] = {}
            for j, k in enumerate(array.find(keys).tolist()):
                if k >= 0 and (of[j] not in best or best[of[j]][0] < size[j]):
                    best[of[j]] = (size[j], j, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([keys[best[i][1]].replace("\0", "", 1) if i in best else None for i in range(len(parts))], pa.string()),
                    pa.array([BLOCK if i in best and array.blocks[best[i][2]] else ALLOW for i in range(len(parts))], pa.string()),
                ],
                names=["id", "host", "path", "rule", "verdict"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(judged, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
SQL = rf"""
WITH rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path, row_number() OVER () AS i FROM rests
), fits AS (
  SELECT i, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY i ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS k
  FROM parts p JOIN (VALUES {_RULES_SQL}) r(verdict, host, path)
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (i)
"""
