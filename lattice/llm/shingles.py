"""Digests of words and of word shingles, vectorised over a text's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a text that are taken at a time; a step ends between words.
STEP = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, n of them at least."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column one after another, and where each value begins (and the last one ends). Nulls are empty."""
    column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each value of ``flat``."""
    out = np.zeros(len(offsets) - 1, np.int64)
    for lo in range(0, len(data), STEP):
        held = ~_SPACE[data[max(0, lo - 1) : lo + STEP]]
        new = held[1:] & ~held[:-1] if lo else np.concatenate([held[:1], held[1:] & ~held[:-1]])
        first = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, min(lo + STEP, len(data)))] - lo
        new[first] = held[-len(new) :][first]  # a word doesn't go on in the next value
        out += np.bincount(np.searchsorted(offsets, np.flatnonzero(new) + lo, side="right") - 1, minlength=len(out))
    return out


def word_digests(text: str) -> np.ndarray:
    """64-bit digests of the words ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lower-cased."""
    raw = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    if len(raw) <= STEP:
        return _digests(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + STEP)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(_digests(raw[at:end]))
        at = end
    return np.concatenate(out)


def _digests(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(np.concatenate([[1], _SPACE[b].view(np.int8), [1]]))
    starts, ends = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    power, inverse = power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum((b.astype(np.uint64) + _U(1)) * power[: len(b)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def shingle_digests(words: np.ndarray, size: int) -> np.ndarray:
    """Digests of the shingles of ``size`` words in order; of fewer words, of the whole sequence; none without words."""
    n = len(words)
    if n == 0:
        return words
    k = min(size, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        out = (out + words[i : n - k + 1 + i]) * _U(_BASE | 1) ^ (out >> _U(29))
    return mixed(out + _U(k))


def shingle_digests_at(words: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """Those of ``shingle_digests`` at places from which ``size`` words are left."""
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(size):
        out = (out + words[at + i]) * _U(_BASE | 1) ^ (out >> _U(29))
    return mixed(out + _U(size))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted. Empty for null and for a text without words."""
    return np.unique(shingle_digests(word_digests(text or ""), size))
