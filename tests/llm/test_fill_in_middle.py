"""Fill-in-the-middle against its rule in plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lattice.llm import fill_in_middle as fim

TEXTS = [
    "plain words, and 12 digits",
    "",
    None,
    "a",
    "\x01",
    "\x02\x01\x021\x020\x02",
    "a\x020b\x021c\x01d\x01",
    "holds <P> a marker",
    "<P<S<M>P>",
    "😀 é\n\r\n\x00 tail😀",
    "x<",
    "P>S>M>",
    "$0\\1 $",
    "word " * 60_000,
]


def by_rule(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def test_same_as_the_rule(spark):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(140)] + [(None, "without an id"), (None, None), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_units int, __text string")
    got = fim.fill_in_middle(docs, keep=("n_units",)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    seen = sorted((tuple(r[c] for c in ("doc_id", "n", "form", "prefix", "middle", "suffix", "output", "back")) for r in got.collect()), key=repr)
    assert seen == sorted(((i, *by_rule(i, t), t or "") for i, t in rows), key=repr)
    assert {r[2] for r in seen} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_shares_and_names(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words to cut").alias("text"))
    forms = {r["form"]: r["count"] for r in fim.fill_in_middle(docs).groupBy("form").count().collect()}
    assert 140 < forms["plain"] < 260 and 280 < forms["spm"] < 440
    assert {r["form"] for r in fim.fill_in_middle(docs, plain_percent=0, spm_percent=100).select("form").distinct().collect()} == {"spm"}
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, keep=("output",))
