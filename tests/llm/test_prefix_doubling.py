"""Repeated byte strings against a plain search of every position."""

import random

import pyarrow as pa
import pytest

from lattice.llm import prefix_doubling as pd_


def brute(rows, length):
    """rows: (id, text). Sorted (id, kept, n_bytes, n_removed, n_spans)."""
    raws = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raws:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(least.get(s, i), i)
    out = []
    for (row_id, _), (i, b) in zip(rows, raws):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((row_id, bytes(c for c, g in zip(b, gone) if not g), len(b), sum(gone), spans))
    return sorted(out, key=repr)


def deduped(spark, rows, length=pd_.LENGTH):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, kept string")
    got = pd_.dedup_substrings(docs, length=length)
    return sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()), key=repr)


def mixed_rows(seed, n=60):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lor", "ips", "dol", "é", "😀", "sit") for b in ("em", "um", "a", "or", "i")]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [prose(rng.randint(8, 30)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            lo = rng.randint(0, len(p) // 2)
            parts += [p[lo : rng.randint(lo, len(p))], prose(rng.randint(0, 8))]
        text = rng.choice(["", " "]).join(parts)
        rows.append((rng.randint(0, 2 * n), text))
        if rng.random() < 0.2:  # near copies
            at = rng.randint(0, len(text))
            rows.append((rng.randint(0, 2 * n), text[:at] + rng.choice(["", "x", prose(3)]) + text[at:]))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_same_as_brute_force(spark, seed, monkeypatch):
    if seed == 1:  # many batches and buckets, small steps
        for name, value in (("BATCH_GRAMS", 50), ("BUCKET_GRAMS", 40), ("STEP", 97)):
            monkeypatch.setattr(pd_, name, value)
    rows = mixed_rows(seed)
    assert deduped(spark, rows) == brute(rows, 50)


@pytest.mark.parametrize("length", [2, 20])
def test_other_lengths(spark, length):
    rows = mixed_rows(9, 20)
    assert deduped(spark, rows, length) == brute(rows, length)


def test_hard_rows(spark):
    passage = "The quick brown fox jumps over the lazy dog, and then rests for a while."
    rows = [(1, passage), (2, passage), (2, passage), (3, None), (None, passage + passage), (None, None), (4, ""), (5, passage[:49]), (6, passage[:50])]
    rows += [(7, "a" * 300), (8, "a" * 49), (9, "a" * 50), (10, "ab" * 200), (11, "ba" * 30), (12, "x" + passage[10:] + "é" * 40), (13, "é" * 40), (14, "\n" * 200), (15, "\n" * 60)]
    rows += [(16, passage + " " + passage), (17, passage[5:] + passage[:60])]
    assert deduped(spark, rows) == brute(rows, 50)


def test_empty_names_and_long_text(spark):
    assert deduped(spark, []) == []
    assert deduped(spark, [(1, ""), (2, None)]) == [(1, b"", 0, 0, 0), (2, b"", 0, 0, 0)]
    with pytest.raises(ValueError):
        pd_.dedup_substrings(spark.createDataFrame([], "doc_id long, text string, kept int"), keep=("kept",))
    rng = random.Random(4)
    long = " ".join(str(rng.random()) for _ in range(60_000))
    assert len(long) > 2 * pd_.STEP
    got = {r[0]: r[2:] for r in deduped(spark, [(1, long), (2, long[1_000:900_000]), (3, "z" + long[600_000:600_060])])}
    assert got[1][1:] == (0, 0) and got[2] == (899_000, 899_000, 1) and got[3] == (61, 60, 1)


def test_strings_of_one_document_stay(spark):
    line = "a line that one document repeats, longer than fifty bytes\n"
    assert deduped(spark, [(5, line * 20)])[0][3] == 0
    assert [r[3] for r in deduped(spark, [(5, line * 20), (6, line)])] == [0, len(line)]


def test_driver_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = pd_.dedup_substrings(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(((r["doc_id"], bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got.collect()), key=repr) == brute(rows, 50)


def test_runs_do_not_depend_on_steps(monkeypatch):
    rng = random.Random(8)
    values = pa.array(["".join(rng.choice("abc") for _ in range(rng.choice([0, 3, 49, 50, 51, 400]))) for _ in range(30)] + [None, "é" * 60])
    data, offsets = pd_.flat(values)

    def by_place():
        return {p: (o, g, n) for o, a, b, g, n in zip(*pd_.named_runs(data, offsets, 50)) for p in range(a, b + 1)}

    whole = by_place()
    assert sorted(whole) == [p for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist()) for p in range(lo, hi - 49)]
    for step in (1, 64, 97):
        monkeypatch.setattr(pd_, "STEP", step)
        stepped = by_place()
        # the leftmost of equal grams is the same in every step
        assert {p: x[:2] for p, x in stepped.items()} == {p: x[:2] for p, x in whole.items()}


def test_steps_pass_packs_on(spark, monkeypatch):
    """A row for each stretch, piece or position costs more CPU than the rest: steps write fewer rows than there are documents, with the same results."""
    rows, written, table = mixed_rows(3, 200), {}, pd_.Scratch.table

    def counted(self, name, made, drop=()):
        out = table(self, name, made, drop)
        written[name] = out.count()
        return out

    monkeypatch.setattr(pd_.Scratch, "table", counted)
    assert deduped(spark, rows) == brute(rows, 50)
    assert written and max(written.values()) <= len(rows) and sum(n for name, n in written.items() if name not in ("grams", "spans")) < len(rows)


@pytest.mark.parametrize("size", [1, 64, 100_000])
def test_batches_of_any_size(spark, monkeypatch, size):
    for name in ("RUN_BYTES", "BATCH_RUNS", "PACK_BYTES", "PACK_RUNS", "TEXT_BUCKET", "STRETCH_BUCKET", "PIECE_BUCKET"):
        monkeypatch.setattr(pd_, name, max(size, 400) if name.endswith("BUCKET") else size)
    monkeypatch.setattr(pd_, "AT_ONCE", 3)
    rows = mixed_rows(5, 40)
    assert deduped(spark, rows) == brute(rows, 50)
