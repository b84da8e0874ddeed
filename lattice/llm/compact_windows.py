"""Substring dedup by compact windows.

A text is a sequence of word shingles. Under a hash function, the nodes of a Cartesian tree over the shingles' hashes group
its subsequences: those that lie within [l, r] and hold c have the hash at c as their min-hash, and only windows long enough for
the run that two similar passages share are kept. Windows of the hash functions are joined where their intervals overlap, so
that a joint window stands for all subsequences that share the functions' signature. A signature, with half of the shared run beside its
place, is a key; keys that several documents have lead to the texts again:

1. Around places with a shared key, shingles that no other such document has are blanked. What is left are stretches; one that is
   too short for a passage, or holds too few shared shingles, is gone, and equal stretches are one from here on. A passage or a
   phrase that very many documents hold thus becomes one stretch, or none.
2. Stretches of one key meet: first each meets one head of the key, in ``HEADS`` rounds with other heads; what is connected by
   then is left alone, and everything else in a key meets all members of the key that it isn't connected with, in tiles of bounded
   size. So no pair with a key in common is left out unless it is connected anyway.
3. Pairs are verified many at once: on their diagonals with a long common run, or, where a text repeats a phrase, by all windows of the
   least length. Shingles that agree near to a diagonal are strung together, and a passage must be long enough and similar enough as a set of shingles.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, cut, python_ready, sent, spread_join, table
from .graph import components, rooted, tiles, with_heads
from .shingles import flat, mixed, power_tables, shingle_digests, shingle_digests_at, word_counts, word_digests

SHINGLE = 5
#: Words of a passage, at least, and the similarity (percent) of its shingle sets.
PASSAGE, PERCENT = 50, 80
#: Hash functions of a signature. Windows are as long as the run that two passages at the threshold share in any case
#: (shared_run: 21 shingles); equal runs have equal signatures, so that more functions would find nothing more.
ROWS = 1
#: Rounds in which the stretches of a key meet one head, before all that is not connected meets.
HEADS = 2
#: Stretches and shingles of a tile, at most, on average.
TILE_STRETCHES, TILE_SHINGLES = 512, 500_000
#: Shingles that may differ in a row inside a passage; two words changed close together change ten.
GAP = 12
#: Pairs of places of common runs that are looked at together, and pairs of windows.
BLOCK, CELLS = 1 << 20, 1 << 21
#: Shingles of the pairs that are verified at once, about, and pairs of a tile.
TOGETHER, WAVE = 1 << 17, 256
#: Places near to diagonals that are strung together at once.
BAND = 1 << 14


def nearest_smaller(h: np.ndarray, strict: bool) -> np.ndarray:
    """For each place the nearest one before it with a smaller hash (or, if not strict, an equal one), else -1. All places hop
    at once over what is too large, along the hops found so far."""
    n = len(h)
    at = np.arange(-1, n - 1)
    live = np.arange(n)
    while len(live):
        to = at[live]
        over = to >= 0
        if strict:
            over[over] = h[to[over]] >= h[live[over]]
        else:
            over[over] = h[to[over]] > h[live[over]]
        live = live[over]
        at[live] = at[at[live]]
    return at


def compact_windows(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c and r of the nodes of the Cartesian tree over ``hashes``, as far as r - l + 1 >= least, by c. Of equal hashes the
    first is the root."""
    left = nearest_smaller(hashes, False) + 1
    right = len(hashes) - 2 - nearest_smaller(hashes[::-1], True)[::-1]
    c = np.flatnonzero(right - left + 1 >= least)
    return left[c], c, right[c]


def joint_windows(shingles: np.ndarray, least: int, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys and places of the joint windows: the signature of the hash functions, and the place of the first one's
    minimum; and the first and last start of a subsequence of the least length. A window's subsequences of that length begin in one
    interval; the joint windows are the intervals' common refinement. No window holds a place of ``apart`` (a mask)."""
    starts, ends, hashes, centres = [], [], [], []
    for f in range(ROWS):
        h = mixed(shingles ^ np.uint64((f + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1)) | np.uint64(1)
        if apart is not None:
            h[apart] = 0
        left, c, right = compact_windows(h, least)
        if apart is not None:
            left, c, right = (v[~apart[c]] for v in (left, c, right))
        starts.append(np.maximum(left, c - least + 1))
        ends.append(np.minimum(c, right - least + 1))
        hashes.append(h[c])
        centres.append(c)
    at = np.unique(np.concatenate(starts))
    key, until, place = np.full(len(at), 1, dtype=np.uint64), np.full(len(at), len(shingles)), None
    for s, e, h, c in zip(starts, ends, hashes, centres):
        i = np.searchsorted(s, at, side="right") - 1
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[i])
        until = np.minimum(until, e[i])
        place = c[i] if place is None else place
    until = np.minimum(until, np.concatenate([at[1:], [len(shingles) + 1]])[: len(at)] - 1)
    return key.view(np.int64), at if place is None else place, at, until


def text_keys(texts: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, text and place of the joint windows of texts, given as their shingles, in this order. A run around a place holds half of
    its shingles up to it or from it on: each window gives a key with the one half, the other, or both, as its runs have them."""
    half = (run + 1) // 2
    size = np.array([len(t) for t in texts], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]  # one place apart between texts
    s = np.concatenate([x for t in texts for x in (t, np.zeros(1, np.uint64))] or [np.zeros(0, np.uint64)])
    apart = np.zeros(len(s), bool)
    apart[first + size] = True
    k, p, start, until = joint_windows(s, run, apart)
    if not len(k):
        return k, p, p
    of = np.searchsorted(first, p, side="right") - 1
    # a run from start to until holds half of itself up to the place if it begins early enough, else half of itself from the place on
    before, after = start <= p - half + 1, until > p - half + 1
    k = k.view(np.uint64)
    side = shingle_digests_at(s, half, np.concatenate([p[after], p[before] - half + 1]))
    n = np.count_nonzero(after)
    k = np.concatenate([mixed(k[after] ^ side[:n]), mixed(k[before] + side[n:])]).view(np.int64)
    of, p = np.concatenate([of[after], of[before]]), np.concatenate([p[after], p[before]])
    order = np.lexsort((p, of, k))
    k, of, p = k[order], of[order], p[order]
    new = np.concatenate([[True], (np.diff(k) != 0) | (np.diff(of) != 0) | (np.diff(p) != 0)])
    k, of, p = k[new], of[new], p[new]
    return k, of, p - first[of]


def shared_run(least: int, percent: int) -> int:
    """Shingles in a row that two passages of ``least`` shingles or more have in common at the least, if ``percent`` of
    their shingles agree and they repeat no phrase of their own. Each of k changed places costs the two sides nine shingles
    or more together and leaves k + 1 runs."""
    common, runs = least_common(least, percent), []
    for k in range(least):
        if percent == 100 and k:
            break
        held = max(common, -(-9 * k * percent // (100 - percent)) if k else 0)
        runs.append(-(-held // (k + 1)))
    return max(1, min(runs))


def least_common(least: int, percent: int) -> int:
    """Shingles that two passages of ``least`` shingles have in common, at least."""
    return -(-2 * percent * least // (100 + percent))


def passages(x: np.ndarray, y: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Verified passages (first and last shingle in x, in y) of two texts; see ``aligned``."""
    return aligned([(x, y)], least, percent)[0]


def run_digests(shingles: np.ndarray, run: int) -> np.ndarray:
    """Digests of the runs of ``run`` shingles, from running sums; none of a shorter text."""
    n = len(shingles)
    if n < run:
        return shingles[:0]
    power, inverse = power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(shingles * power[:n], out=sums[1:])
    return mixed((sums[run:] - sums[:-run]) * inverse[: n - run + 1])


class Indexed:
    """A text's shingles and runs, and their places by value."""

    def __init__(self, shingles: np.ndarray, run: int):
        self.run, self.s, self.by = run, shingles, np.argsort(shingles, kind="stable")
        self.s_sorted = self.s[self.by]
        # the place before with the same shingle, or -1
        self.before = np.full(len(self.s), -1)
        same = self.s_sorted[1:] == self.s_sorted[:-1]
        self.before[self.by[1:][same]] = self.by[:-1][same]

    @functools.cached_property
    def runs(self) -> np.ndarray:
        return run_digests(self.s, self.run)

    @functools.cached_property
    def runs_by(self) -> np.ndarray:
        return np.argsort(self.runs, kind="stable")

    def distinct(self, least: int) -> np.ndarray:
        """Distinct shingles of each window of ``least`` shingles."""
        if not hasattr(self, "counts"):
            self.counts = window_counts(self.before, least)
        return self.counts

    def sets(self, least: int) -> np.ndarray:
        """A digest of the set of shingles of each window of ``least`` shingles."""
        if not hasattr(self, "digests"):
            n, at = len(self.s), np.arange(len(self.s))
            steps, one = np.zeros(n + 1, np.uint64), mixed(self.s ^ np.uint64(0x6C62272E07BB0142))
            np.add.at(steps, np.maximum(np.maximum(self.before, at - least) + 1, 0), one)
            steps[1:] -= one
            self.digests = np.cumsum(steps)[: max(0, n - least + 1)]
        return self.digests


def window_counts(before: np.ndarray, least: int, of: np.ndarray | None = None) -> np.ndarray:
    """Distinct shingles of each window of ``least`` places (those of the mask ``of``, if given). A place counts in the windows
    that hold it and no place before with the same shingle, which are next to each other."""
    n = len(before)
    at = np.arange(n) if of is None else np.flatnonzero(of)
    steps = np.bincount(np.maximum(np.maximum(before[at], at - least) + 1, 0), minlength=n + 1) - np.bincount(at + 1, minlength=n + 1)
    return np.cumsum(steps)[: max(0, n - least + 1)]


class Common:
    """Distinct shingles of windows of two texts, and how many of them both have."""

    def __init__(self, one: Indexed, two: Indexed):
        n = len(two.s)
        self.one, self.two, self.held = one, two, np.zeros(n + 1, bool)
        # a shingle's number is its first place in the order of y's shingles; n is one that y doesn't have
        self.of_y = np.empty(n, np.int64)
        self.of_y[two.by] = np.searchsorted(two.s_sorted, two.s_sorted)
        at = np.searchsorted(two.s_sorted, one.s)
        self.of_x = np.where(two.s_sorted[np.minimum(at, n - 1)] == one.s, at, n) if n else np.zeros(len(one.s), np.int64)

    def __call__(self, x0: int, x1: int, y0: int, y1: int) -> tuple[int, int, int]:
        """Of the windows from x0 to x1 and y0 to y1, both ends included: distinct shingles of each, and common ones."""
        new, held_y = self.one.before[x0 : x1 + 1] < x0, self.of_y[y0 : y1 + 1]
        self.held[held_y] = True
        common = np.count_nonzero(self.held[self.of_x[x0 : x1 + 1]] & new)
        self.held[held_y] = False
        return np.count_nonzero(new), np.count_nonzero(self.two.before[y0 : y1 + 1] < y0), common

    def both(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of numbers of shingles of x and of y, which of either are among the other."""
        self.held[y] = True
        in_y = self.held[x]
        self.held[y] = False
        self.held[x] = True
        self.held[-1] = False
        in_x = self.held[y]
        self.held[x] = False
        return in_y, in_x


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted; by a sort, as hashing them takes longer."""
    s = np.sort(values)
    return s[np.concatenate([np.ones(1, bool), s[1:] != s[:-1]])] if len(s) else s


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Of values, whether they are among ``some``, which are sorted."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values if len(some) else np.zeros(len(values), bool)


def aligned(pairs: list[tuple[np.ndarray, np.ndarray]], least: int, percent: int) -> list[list[tuple[int, int, int, int]]]:
    """Verified passages (first and last shingle in x, in y) of each pair of texts. In texts whose windows of ``least`` shingles repeat none, each
    diagonal (place in x less place in y) with a long common run is verified with those next to it, for all pairs at once (``_plain``); of other
    texts all windows meet all (``_repeating``). Passages reach from their first to their last common shingle. Those that add nothing to what others cover of x and y are left out."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in pairs]
    long = [k for k, (x, y) in enumerate(pairs) if len(x) >= least <= len(y)]
    if not long:
        return out
    run, at = shared_run(least, percent), 0
    while at < len(long):
        upto, size = at, 0
        while upto < len(long) and (upto == at or size < TOGETHER):
            size += sum(len(t) for t in pairs[long[upto]])
            upto += 1
        some, at = long[at:upto], upto
        together = _Together([pairs[k] for k in some], run)
        again = together.repeating(least)
        for k, found in zip(some, _plain(together, ~again, least, percent)):
            out[k] = found
        for k in np.array(some)[again].tolist():
            out[k] = _repeating(Indexed(pairs[k][0], run), Indexed(pairs[k][1], run), least, percent)
    return out


class _Together(Common):
    """Pairs of texts end to end, each pair with shingles of its own."""

    def __init__(self, pairs: list[tuple[np.ndarray, np.ndarray]], run: int):
        salt = mixed(np.arange(1, len(pairs) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.sizes = [np.array([len(p[k]) for p in pairs]) for k in range(2)]
        self.first = [np.cumsum(n) - n for n in self.sizes]
        self.of = [np.repeat(np.arange(len(pairs)), n) for n in self.sizes]
        super().__init__(*(Indexed(mixed(np.concatenate([p[k] for p in pairs]) ^ salt[self.of[k]]), run) for k in range(2)))

    def repeating(self, least: int) -> np.ndarray:
        """Of each pair, whether a window of ``least`` shingles of either text holds one twice."""
        out = np.zeros(len(self.sizes[0]), bool)
        for text, of in zip((self.one, self.two), self.of):
            out[of[(text.before >= 0) & (np.arange(len(text.s)) - text.before < least)]] = True
        return out


class _Spans:
    """Spans of pairs of texts, and the places that none covers yet."""

    def __init__(self, n_x: int, n_y: int):
        self.open_x, self.open_y, self.found = np.ones(n_x, bool), np.ones(n_y, bool), []

    def close(self, x: list[int], y: list[int]) -> None:
        """Nothing outside of these ranges (both ends included) is left to be covered."""
        for left, (a, b) in ((self.open_x, x), (self.open_y, y)):
            left[:a] = left[b + 1 :] = False

    def adds(self, x0: int, x1: int, y0: int, y1: int) -> bool:
        return bool(self.open_x[x0 : x1 + 1].any() or self.open_y[y0 : y1 + 1].any())

    def add(self, span: tuple[int, int, int, int]) -> bool:
        x0, x1, y0, y1 = span
        if not self.adds(*span):
            return False
        self.found.append(span)
        self.open_x[x0 : x1 + 1] = self.open_y[y0 : y1 + 1] = False
        return True


def _sliced(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the ranges from lo to hi (not included) one after the other, and which range each is of."""
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n)[of] + lo[of], of


def _plain(pairs: _Together, wanted: np.ndarray, least: int, percent: int) -> list[list[tuple[int, int, int, int]]]:
    """Passages of the wanted pairs, whose windows of ``least`` shingles repeat none. So what two windows have in common is the number of
    places that agree in them."""
    one, two, run, x_first, y_first = pairs.one, pairs.two, pairs.one.run, *pairs.first
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in wanted]
    # places that agree, by diagonal; those of different pairs are too far apart to meet
    at = np.flatnonzero(wanted[pairs.of[0]] & (pairs.of_x < len(two.s)))
    lo, hi = pairs.of_x[at], np.searchsorted(two.s_sorted, one.s[at], side="right")
    py, of = _sliced(lo, hi)
    px, py = at[of], two.by[py]
    pair = pairs.of[0][px]
    wide = pairs.sizes[0] + pairs.sizes[1] + 3 * least
    base = np.cumsum(wide) - wide + pairs.sizes[1] + least
    diagonal = base[pair] + (px - x_first[pair]) - (py - y_first[pair])
    order = np.argsort(diagonal, kind="stable")
    px, py, diagonal, pair = px[order], py[order], diagonal[order], pair[order]
    # diagonals with a run, and where their runs begin and end
    edge = np.flatnonzero(np.concatenate([[True], (np.diff(diagonal) != 0) | (np.diff(px) != 1)])[: len(px)])
    length = np.diff(np.append(edge, len(px)))
    edge, length = edge[length >= run], length[length >= run]
    if not len(edge):
        return out
    named, begin = np.unique(diagonal[edge], return_index=True)
    end = np.append(begin[1:], len(edge)) - 1
    # a passage has so many places near to its diagonal
    enough = np.searchsorted(diagonal, named + least, side="right") - np.searchsorted(diagonal, named - least, side="left") >= least_common(least, percent)
    named, begin, end = named[enough], begin[enough], end[enough]
    if not len(named):
        return out
    of_pair, first, last = pair[edge[begin]], px[edge[begin]], px[edge[end]] + length[end] - run
    spans = _Spans(len(one.s), len(two.s))
    for e in (0, -1, 1):
        d = named + e
        shift = d - base[of_pair] + x_first[of_pair] - y_first[of_pair]  # place in x less place in y, end to end
        lo = np.maximum(np.maximum(first + run - least - GAP, x_first[of_pair]), y_first[of_pair] + shift)
        hi = np.minimum(np.minimum(last + GAP, x_first[of_pair] + pairs.sizes[0][of_pair] - least), y_first[of_pair] + pairs.sizes[1][of_pair] - least + shift)
        size = np.maximum(hi - lo + 1, 0)
        start = np.cumsum(size + 1) - size - 1
        near, of = _sliced(np.searchsorted(diagonal, d - least, side="right"), np.searchsorted(diagonal, d + least, side="left"))
        off = diagonal[near] - d[of]
        # windows that hold the place on either side
        a = np.maximum(px[near] - least + 1 - np.minimum(off, 0), lo[of])
        b = np.minimum(px[near] - np.maximum(off, 0), hi[of])
        a, b = ((v - lo[of] + start[of])[a <= b] for v in (a, b))
        n = int(size.sum()) + len(size) + 1
        common = np.cumsum(np.bincount(a, minlength=n) - np.bincount(b + 1, minlength=n))
        good = np.flatnonzero(100 * common >= percent * (2 * least - common))
        if len(good):
            begins = np.concatenate([[True], np.diff(good) > 1])
            ends = np.append(good[np.flatnonzero(begins)[1:] - 1], good[-1])
            begins = good[begins]
            job = np.searchsorted(start, begins, side="right") - 1
            x0 = begins - start[job] + lo[job]
            for u, v, w in zip(x0.tolist(), (x0 + ends - begins + least - 1).tolist(), shift[job].tolist()):
                if spans.adds(u, v, u - w, v - w):
                    spans.add(_trimmed(pairs, u, v, u - w, v - w))
    near, of = _sliced(np.searchsorted(diagonal, named - GAP, side="left"), np.searchsorted(diagonal, named + GAP, side="right"))
    _add_strung(spans, pairs, *_nearest(px[near], py[near], diagonal[near] - named[of], of), least, percent)
    for x0, x1, y0, y1 in spans.found:
        k = int(pairs.of[0][x0])
        i, j = int(x_first[k]), int(y_first[k])
        out[k].append((x0 - i, x1 - i, y0 - j, y1 - j))
    return out


def _nearest(px: np.ndarray, py: np.ndarray, off: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of places near to diagonals (number ``of``, ``off`` places from it) the nearest one of each place in x: px, py, of; by of and px."""
    order = np.lexsort((off, np.abs(off), px, of))
    px, py, of = px[order], py[order], of[order]
    new = np.concatenate([[True], (np.diff(px) != 0) | (np.diff(of) != 0)])[: len(px)]
    return px[new], py[new], of[new]


def _add_strung(spans: _Spans, held: Common, px: np.ndarray, py: np.ndarray, of: np.ndarray, least: int, percent: int) -> bool:
    """Adds the passages of stretches of places near to a diagonal (as ``_nearest`` gives them), and says if there are any."""
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(px) > GAP) | (np.abs(np.diff(py)) > GAP)])[: len(px)])
    end = np.append(begin[1:], len(px))
    enough = (end - begin >= least_common(least, percent)) & (px[end - 1] - px[begin] + 1 >= least)
    any_new = False
    for a, b in zip(begin[enough].tolist(), end[enough].tolist()):
        if spans.adds(int(px[a]), int(px[b - 1]), int(py[a:b].min()), int(py[a:b].max())):
            for span in _strung(held, px[a:b], py[a:b], least, percent):
                any_new |= spans.add(span)
    return any_new


def _trimmed(held: Common, x0: int, x1: int, y0: int, y1: int) -> tuple[int, int, int, int]:
    """Ranges of two texts, from their first to their last common shingle."""
    x, y = held.of_x[x0 : x1 + 1], held.of_y[y0 : y1 + 1]
    if x[0] == y[0] and x[-1] == y[-1]:
        return x0, x1, y0, y1
    at_x, at_y = held.both(x, y)
    return x0 + int(at_x.argmax()), x1 - int(at_x[::-1].argmax()), y0 + int(at_y.argmax()), y1 - int(at_y[::-1].argmax())


def _repeating(one: Indexed, two: Indexed, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Passages of two texts that may repeat shingles: all of ``least`` shingles, and longer ones along the diagonals with a common run."""
    if not np.isin(one.runs, two.runs).any():
        return []
    held = Common(one, two)
    ends = [np.flatnonzero(common)[[0, -1]].tolist() for common in (held.of_x < len(two.s), np.isin(two.s, one.s))]
    # in copies with few changes, two diagonals hold all between the first and the last common shingle
    spans = _Spans(len(one.s), len(two.s))
    spans.close(*ends)
    for d in _end_diagonals(one, two):
        for span in _slid(held, d, 0, len(one.s), least, percent):
            spans.add(span)
    if not spans.open_x.any() and not spans.open_y.any():
        return _merged(spans.found)
    spans = _Spans(len(one.s), len(two.s))
    for span in _all_windows(held, least, percent):
        spans.add(span)
    # what lies before the first or behind the last common shingle is in no passage
    spans.close(*ends)
    if not spans.open_x.any() and not spans.open_y.any():
        return _merged(spans.found)
    # places of runs inside windows that can be a passage; of windows with the same set of shingles the first and the last stand for all
    band, kept = _Band(held), [_may_hold(t, of, least, percent) for t, of in ((one, held.of_x < len(two.s)), (two, np.isin(two.s, one.s)))]
    named, hits = _diagonals(one, two, *kept)
    # equal ones far apart from each other, as neighbours in a periodic stretch cover nearly the same
    order = np.lexsort((mixed(named.astype(np.uint64)), -hits))
    named = named[order[band.sizes(named[order]) >= least_common(least, percent)]]
    some, named, first = named[:1], named[1:], True
    while len(some):
        if _add_strung(spans, held, *band.near(some), least, percent) or first:
            if not spans.open_x.any() and not spans.open_y.any():
                break
            # a run may add words of its own, or what lies next to it
            fresh, first = (_near(spans.open_x, one.run), _near(spans.open_y, one.run)), False
            named = named[np.isin(named, _diagonals(one, two, *kept, fresh)[0])]
        n = max(1, int(np.searchsorted(np.cumsum(band.sizes(named)), BAND)))
        some, named = named[:n], named[n:]
    if spans.found:
        # windows with the same set as one inside a passage are as similar
        found = list(spans.found)
        for u, v in _as_inside(one, [f[:2] for f in found], spans.open_x, least):
            spans.add((u, v, *found[0][2:]))
        for u, v in _as_inside(two, [f[2:] for f in found], spans.open_y, least):
            spans.add((*found[0][:2], u, v))
    return _merged(spans.found)


def _end_diagonals(one: Indexed, two: Indexed) -> list[int]:
    """The diagonals of the first and of the last run of x that y has."""
    held = two.runs[two.runs_by]
    lo, hi = (np.searchsorted(held, one.runs, side=side) for side in ("left", "right"))
    at = np.flatnonzero(hi > lo)
    return list({int(at[0] - two.runs_by[lo[at[0]]]), int(at[-1] - two.runs_by[hi[at[-1]] - 1])})


def _merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Spans with what touches in x, and in y, put together; each side's least first."""
    sides = []
    for k in (0, 2):
        side: list[list[int]] = []
        for a, b in sorted({(s[k], s[k + 1]) for s in spans}):
            if side and a <= side[-1][1] + 1:
                side[-1][1] = max(b, side[-1][1])
            else:
                side.append([a, b])
        sides.append(side)
    x, y = sides
    return [(*x[min(k, len(x) - 1)], *y[min(k, len(y) - 1)]) for k in range(max(len(x), len(y)))]


def _all_windows(held: Common, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Passages that cover each window of ``least`` shingles that is similar enough to one of the other text. A shingle is in the windows of intervals of
    starts on either side, and counts in the rectangles where two meet."""
    one, two, n = held.one, held.two, len(held.two.s)
    counts = [t.distinct(least) for t in (one, two)]
    rows, columns = (np.flatnonzero(100 * window_counts(t.before, least, of) >= percent * c) for t, of, c in zip((one, two), (held.of_x < n, np.isin(two.s, one.s)), counts))
    if not len(rows) or not len(columns):
        return []
    if len(rows) * len(columns) > CELLS:
        # of windows with the same set the first and the last stand for all; ``_as_inside`` gives the others
        rows, columns = (some[_ends(t.sets(least)[some])] for t, some in ((one, rows), (two, columns)))
    sides = []
    for values, some in ((held.of_x, rows), (held.of_y, columns)):
        v, a, b = _starts(values, least)
        a, b = np.searchsorted(some, a - least, side="left"), np.searchsorted(some, b - least, side="right")
        kept = (a < b) & (v < n)
        sides.append((v[kept], a[kept], b[kept]))
    (vx, ax, bx), (vy, ay, by) = sides
    of_y, of_x = _sliced(np.searchsorted(vy, vx, side="left"), np.searchsorted(vy, vx, side="right"))
    top, bottom, left, right = ax[of_x], bx[of_x], ay[of_y], by[of_y]
    wide, found = len(columns) + 1, []
    n_x, n_y = counts[0][rows], counts[1][columns]
    step = max(1, CELLS // wide)
    for r in range(0, len(rows), step):
        high = min(step, len(rows) - r)
        here = (top < r + high) & (bottom > r)
        t, b, le, ri = np.maximum(top[here] - r, 0) * wide, np.minimum(bottom[here] - r, high) * wide, left[here], right[here]
        one_each = np.ones(len(t), np.float32)
        common = np.bincount(np.concatenate([t + le, b + ri, t + ri, b + le]), np.concatenate([one_each, one_each, -one_each, -one_each]), minlength=(high + 1) * wide)
        common = common.reshape(high + 1, wide).cumsum(axis=0).cumsum(axis=1)[:high, :-1]
        good = (100 + percent) * common >= percent * (n_x[r : r + high, None] + n_y[None, :])
        i, j = np.nonzero(good)
        if not len(i):
            continue
        # each window goes with the diagonal that has the most of them
        weight = np.bincount(rows[r + i] - columns[j] + columns[-1])
        cells = []
        for matrix, swapped in ((good, False), (good.T, True)):
            i, j = np.nonzero(matrix)
            d = (rows[r + j] - columns[i] if swapped else rows[r + i] - columns[j]) + columns[-1]
            best = np.maximum.reduceat(weight[d] * len(weight) + d, np.flatnonzero(np.diff(i, prepend=-1))) % len(weight)
            i = i[np.flatnonzero(np.diff(i, prepend=-1))]
            cells.append((best, columns[i] + best - columns[-1] if swapped else rows[r + i]))
        d, x = (np.concatenate(v) for v in zip(*cells))
        at = np.unique(d * len(one.s) + x)
        d, x = at // len(one.s) - columns[-1], at % len(one.s)
        for part in np.split(np.arange(len(x)), np.flatnonzero((np.diff(x) != 1) | (np.diff(d) != 0)) + 1):
            x0, x1, k = int(x[part[0]]), int(x[part[-1]]) + least - 1, int(d[part[0]])
            found.append(_trimmed(held, x0, x1, x0 - k, x1 - k))
    return sorted(found, key=lambda f: (f[0] - f[1], f))


def _ends(values: np.ndarray) -> np.ndarray:
    """A mask of the first and the last place of each value."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    out[len(values) - 1 - np.unique(values[::-1], return_index=True)[1]] = True
    return out


def _as_inside(text: Indexed, spans: list[tuple[int, int]], free: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of windows that have the set of a window inside a span, where something is free."""
    inside, sets = np.zeros(len(text.s) - least + 2, np.int64), text.sets(least)
    for u, v in spans:
        if v - u + 1 >= least:
            inside[u] += 1
            inside[v - least + 2] -= 1
    total = np.concatenate([[0], np.cumsum(free)])
    some = np.flatnonzero(np.isin(sets, sets[np.cumsum(inside)[:-1] > 0]) & (total[least:] > total[:-least]))
    return [(int(part[0]), int(part[-1]) + least - 1) for part in np.split(some, np.flatnonzero(np.diff(some) > 1) + 1) if len(part)]


def _may_hold(text: Indexed, held: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Of each run, whether it lies in a window of ``least`` shingles that can be a passage, as enough of its distinct shingles are
    held by the other text; of windows with the same set, the first and the last count."""
    good = 100 * window_counts(text.before, least, held) >= percent * text.distinct(least)
    if text.distinct(least).min() < least:
        sets = text.sets(least)
        for order in (slice(None), slice(None, None, -1)):
            first = np.zeros(len(good), bool)
            first[np.unique(sets[order], return_index=True)[1]] = True
            ends = first if order.step is None else ends | first[order]
        good &= ends
    total = np.concatenate([[0], np.cumsum(good)])
    i = np.arange(len(text.runs))
    return total[np.minimum(i + 1, len(good))] > total[np.maximum(i + text.run - least, 0)]


def _diagonals(one: Indexed, two: Indexed, of_x: np.ndarray, of_y: np.ndarray, fresh: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Diagonals with common runs (of the places in the masks, and in a mask of ``fresh`` on one side), and how many."""
    by = two.runs_by[of_y[two.runs_by]]
    at, held = np.flatnonzero(of_x), two.runs[by]
    lo, hi = (np.searchsorted(held, one.runs[at], side=side) for side in ("left", "right"))
    at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    hits, upto, i = np.zeros(len(one.runs) + len(two.runs), np.int64), np.cumsum(n), 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + BLOCK, side="right")))
        y, x = _sliced(lo[i:j], lo[i:j] + n[i:j])
        x, y = at[i:j][x], by[y]
        if fresh:
            wanted = fresh[0][x] | fresh[1][y]
            x, y = x[wanted], y[wanted]
        hits += np.bincount(x - y + len(two.runs), minlength=len(hits))
        i = j
    d = np.flatnonzero(hits)
    return d - len(two.runs), hits[d]


def _slid(held: Common, d: int, first: int, last: int, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Passages of windows of ``least`` shingles that begin from first to last in x, and d places less in y. What two windows have in common is
    counted for all of them at once: a shingle is in the windows of an interval of starts on either side, and counts where two meet."""
    first, last = max(first, 0, d), min(last, len(held.one.s) - least, len(held.two.s) - least + d)
    size = last - first + 1
    if size < 1:
        return []
    x, y = held.of_x[first : last + least], held.of_y[first - d : last - d + least]
    wide = size + 3 * least
    (vx, ax, bx), (vy, ay, by) = (_starts(v, least) for v in (x, y))
    lo, hi = np.searchsorted(vy * wide + by, vx * wide + ax, side="left"), np.searchsorted(vy * wide + ay, vx * wide + bx, side="right")
    n = np.maximum(hi - lo, 0)
    of_y = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = np.maximum(np.maximum(np.repeat(ax, n), ay[of_y]) - least, 0)
    b = np.minimum(np.minimum(np.repeat(bx, n), by[of_y]) - least, size - 1)
    a, b = a[a <= b], b[a <= b]
    common = np.cumsum(np.bincount(a, minlength=size + 1) - np.bincount(b + 1, minlength=size + 1))[:size]
    nx, ny = held.one.distinct(least)[first : last + 1], held.two.distinct(least)[first - d : last - d + 1]
    good, found = np.flatnonzero(100 * common >= percent * (nx + ny - common)), []
    for part in np.split(good, np.flatnonzero(np.diff(good) > 1) + 1) if len(good) else ():
        u, v = int(part[0]), int(part[-1]) + least
        at_x, at_y = np.flatnonzero(np.isin(x[u:v], y[u:v])), np.flatnonzero(np.isin(y[u:v], x[u:v]))
        x0, y0 = first + u, first - d + u
        found.append((x0 + int(at_x[0]), x0 + int(at_x[-1]), y0 + int(at_y[0]), y0 + int(at_y[-1])))
    return found


def _starts(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, and the intervals of starts (first and last, plus ``least``) of windows of ``least`` places that hold them; sorted."""
    at = np.argsort(values, kind="stable")
    v = values[at]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (np.diff(at) > least)
    begin = np.flatnonzero(new)
    return v[begin], at[begin] + 1, at[np.append(begin[1:], len(v)) - 1] + least


class _Band:
    """Places of common shingles on diagonals or up to GAP from them: of each place of x the one nearest to the diagonal."""

    def __init__(self, held: Common):
        n = len(held.two.s)
        self.x, self.y = held.of_x, held.of_y
        at = np.flatnonzero(self.x < n)
        lo, hi = self.x[at], np.searchsorted(held.two.s_sorted, held.one.s[at], side="right")
        self.dense = (hi - lo).sum() > 8 * (len(self.x) + n)
        if self.dense:
            # y with places that agree with nothing at both ends
            self.at, self.ends = at, len(self.x) + GAP
            self.y = np.concatenate([np.full(self.ends, n), self.y, np.full(self.ends, n)])
        else:
            py, of = _sliced(lo, hi)
            px, py = at[of], held.two.by[py]
            order = np.argsort(px - py, kind="stable")
            self.px, self.d = px[order], (px - py)[order]

    def sizes(self, diagonals: np.ndarray) -> np.ndarray:
        if self.dense:
            return np.full(len(diagonals), len(self.x))
        return np.searchsorted(self.d, diagonals + GAP, side="right") - np.searchsorted(self.d, diagonals - GAP, side="left")

    def near(self, diagonals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in x, in y, and the diagonal's number; by the latter and the place in x."""
        if not self.dense:
            at, of = _sliced(np.searchsorted(self.d, diagonals - GAP, side="left"), np.searchsorted(self.d, diagonals + GAP, side="right"))
            px, d = self.px[at], self.d[at]
            return _nearest(px, px - d, d - diagonals[of], of)
        # what agrees with nothing yet is tried one place farther from the diagonal each time
        off = np.full(len(diagonals) * len(self.at), GAP + 1)
        left, shift = np.arange(len(off)), np.repeat(diagonals, len(self.at))
        px = np.tile(self.at, len(diagonals))
        want, at = self.x[px], np.minimum(np.maximum(px - shift, -len(self.x)), len(self.y) - self.ends - 1) + self.ends
        for e in sorted(range(-GAP, GAP + 1), key=abs):
            same = self.y[at - e] == want
            off[left[same]] = e
            left, want, at = left[~same], want[~same], at[~same]
        kept = off <= GAP
        px = px[kept]
        return px, px - shift[kept] - off[kept], np.repeat(np.arange(len(diagonals)), len(self.at))[kept]


def _near(left: np.ndarray, run: int) -> np.ndarray:
    """Of each run of places, whether one of them, or one up to GAP places from it, is left."""
    n = len(left)
    total = np.concatenate([[0], np.cumsum(left)])
    i = np.arange(n - run + 1)
    return total[np.minimum(i + run + GAP, n)] > total[np.maximum(i - GAP, 0)]


def _exact(at_x: np.ndarray, at_y: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    if not len(at_x):
        return []
    edge = np.nonzero(np.diff(at_x) != 1)[0] + 1
    return [(int(at_x[k]), int(at_x[e - 1]), int(at_y[k]), int(at_y[e - 1])) for k, e in zip([0, *edge.tolist()], [*edge.tolist(), len(at_x)]) if e - k >= least]


def _strung(held: Common, px: np.ndarray, py: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    found, stack, common_least = [], [(0, len(px))], least_common(least, percent)
    if len(px) < common_least:
        return found
    steps = np.maximum(np.diff(px), np.abs(np.diff(py)))
    # of x up to each place: what y has, and what may be there twice; of y the latter
    x_least, y_least, y_most = int(px[0]), int(py.min()), int(py.max())
    held_upto = np.concatenate([[0], np.cumsum(held.of_x[x_least : px[-1] + 1] < len(held.two.s))])
    twice = [np.concatenate([[0], np.cumsum(t.before[a:b] >= a)]) for t, a, b in ((held.one, x_least, px[-1] + 1), (held.two, y_least, y_most + 1))]
    while stack:
        a, b = stack.pop()
        if b - a < common_least or px[b - 1] - px[a] + 1 < least:
            continue
        step = steps[a : b - 1]
        most = step.max() if len(step) else 0
        if most > GAP:
            cuts = [a, *(np.flatnonzero(step > GAP) + a + 1).tolist(), b]
            stack.extend(zip(cuts, cuts[1:]))
            continue
        x0, x1, y0, y1 = int(px[a]), int(px[b - 1]), int(py[a:b].min()), int(py[a:b].max())
        # bounds first: at most so many common ones, at least so many distinct ones
        i, j = x0 - x_least, x1 - x_least + 1
        sizes = j - i - (twice[0][j] - twice[0][i]) + y1 - y0 + 1 - (twice[1][y1 - y_least + 1] - twice[1][y0 - y_least])
        nx, ny, common = held(x0, x1, y0, y1) if (100 + percent) * (held_upto[j] - held_upto[i]) >= percent * sizes else (1, 0, 0)
        if 100 * common >= percent * (nx + ny - common):
            if y1 - y0 + 1 >= least:
                found.append((x0, x1, y0, y1))
        elif b - a > 1:
            widest = np.flatnonzero(step == most)
            k = a + 1 + int(widest[len(widest) // 2])
            stack.extend([(a, k), (k, b)])
    return found


def filled(content: bytes | np.ndarray, side: int) -> np.ndarray:
    """A stretch's shingles, with its blanks turned into shingles that nothing has in common with it but for ``side``."""
    s = mixed((np.frombuffer(content, np.uint32) if isinstance(content, bytes) else content).astype(np.uint64))
    blank = np.flatnonzero(s == 0)
    s[blank] = mixed(blank.astype(np.uint64) * np.uint64(2) + np.uint64(side) + np.uint64(0x51ED270B0001))
    return s


def own_passages(content: bytes, least: int, percent: int) -> list[tuple[int, int]]:
    """First and last shingle of the passages that documents with the same stretch have in common."""
    x, y = filled(content, 0), filled(content, 1)
    at, both = np.flatnonzero(x == y), Common(Indexed(x, 1), Indexed(y, 1))
    return sorted({(a, b) for a, b, _, _ in _exact(at, at, least) + _strung(both, at, at, least, percent) + _slid(both, 0, 0, len(x), least, percent)})


def before_of(content: np.ndarray) -> np.ndarray:
    """Of each place of a stretch the one before with the same shingle, or -1; each blank is one of its own."""
    order = np.argsort(content, kind="stable")
    before = np.full(len(content), -1)
    same = content[order[1:]] == content[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    before[content == 0] = -1
    return before


def _fewest(content: np.ndarray, least: int) -> int:
    """The fewest distinct shingles of a window of ``least`` shingles."""
    return int(window_counts(before_of(content), least).min()) if len(content) >= least else 0


def stretches(content: np.ndarray, least: int, percent: int) -> list[tuple[int, int]]:
    """Half-open ranges of a text (0 where a shingle isn't shared) that may hold a passage: without more than GAP blanks between shared
    shingles, and with the blanks that a passage can have at its ends. In one of its windows the shared shingles are enough."""
    at, edge = np.flatnonzero(content), least * (100 - percent) // 100
    out = []
    for p in np.split(at, np.flatnonzero(np.diff(at) > GAP) + 1) if len(at) else ():
        a, b = max(0, int(p[0]) - edge), min(len(content), int(p[-1]) + 1 + edge)
        before, shared = before_of(content[a:b]), content[a:b] != 0
        if b - a >= least and (100 * window_counts(before, least, shared) >= percent * window_counts(before, least)).any():
            out.append((a, b))
    return out


def common_counts(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many values each array of ``some`` has in common with each of ``others``; arrays hold distinct values."""
    out = np.zeros((len(some), len(others)), dtype=np.float32)
    flat = [np.concatenate([*side, np.zeros(0, np.uint64)]) for side in (some, others)]
    flat_sorted = np.sort(np.concatenate([distinct(f) for f in flat]))
    shared = flat_sorted[1:][flat_sorted[1:] == flat_sorted[:-1]]
    if not len(shared):
        return out
    sides = []
    for side, f in zip((some, others), flat):
        at = np.minimum(np.searchsorted(shared, f), len(shared) - 1)
        held = shared[at] == f
        at, of = at[held], np.repeat(np.arange(len(side)), [len(v) for v in side])[held]
        order = np.argsort(at, kind="stable")
        sides.append((at[order], of[order]))
    for lo in range(0, len(shared), 2048):
        parts = []
        for (at, of), n in zip(sides, out.shape):
            here = slice(*np.searchsorted(at, [lo, lo + 2048]))
            m = np.zeros((n, 2048), dtype=np.float32)
            m[of[here], at[here] - lo] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def marked_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of every row: doc, n_words, n_bytes, t (hash of the text) and d (digest of the text). Null texts are empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(word_counts(data, offsets)), pa.array(np.diff(offsets)), batch.column(2), batch.column(3)], names=["doc", "n_words", "n_bytes", "t", "d"])

    hashed = rows.select("doc", "text", F.xxhash64("text").alias("t"), F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    return cut(hashed.mapInArrow(counted, "doc long, n_words long, n_bytes long, t long, d string"))


def documents_of(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Of rows (doc, text), which are marked: doc, t (hash of the text) and text of one row for each distinct text."""
    some = marked.filter(F.col("doc").isNotNull() & (F.col("n_bytes") > 0)).select("doc", "t", "d")
    classes = some.groupBy("d").agg(F.min(F.struct("doc", "t")).alias("rep"), F.count("*").alias("members")).filter("members > 1")
    copies = some.join(classes, "d").filter((F.col("doc") != F.col("rep.doc")) | (F.col("t") != F.col("rep.t"))).select("doc", "t").distinct()
    # texts stay where they are: only ids of copies are sent to them
    return rows.withColumn("t", F.xxhash64("text")).join(sent(copies), ["doc", "t"], "left_anti").select("doc", "t", "text")


#: A key that one document of a pack asks for; one that several have, which tells others; and what is known to be shared.
_ONE, _SEVERAL, _KNOWN = range(3)
_PACK = "bucket int, kind int, keys binary, docs binary, values binary"
#: Bytes of texts for which there is a bucket, and fewest buckets.
BUCKET_BYTES, BUCKETS = 1 << 24, 24
#: Keys of the batches that are packed together.
PACKED = 1 << 20


def _starts_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])


def _rows_by(bucket: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Buckets, each with the bytes of its part of the columns."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    start = _starts_of(bucket)
    return [(int(bucket[lo]), *(c[lo:hi].tobytes() for c in columns)) for lo, hi in zip(start.tolist(), np.append(start[1:], len(bucket)).tolist())]


def packed(keys: np.ndarray, docs: np.ndarray, values: np.ndarray, several: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Packs for the buckets of keys, of documents' values that have a key. Of a key that several documents have (or that is marked so) one entry
    tells the other packs, its documents know; so a frequent key is shuffled once a pack and not once a document."""
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    start = _starts_of(k)
    size = np.diff(np.append(start, len(k)))
    shared = (d[start] != d[start + size - 1]) | (np.logical_or.reduceat(several[order], start) if len(start) else False)
    known = np.zeros(len(k), bool)
    known[order] = np.repeat(shared, size)
    ask, know, tell = np.flatnonzero(~known), np.flatnonzero(known & ~several), order[start[shared]]
    n, rows = np.uint64(n_buckets), []
    for kind, at in ((_ONE, ask), (_SEVERAL, tell)):
        rows += [(b, kind, *x) for b, *x in _rows_by((mixed(keys[at].astype(np.uint64)) % n).astype(np.int32), keys[at], docs[at], values[at])]
    rows += [(b, _KNOWN, b"", *x) for b, *x in _rows_by((mixed(docs[know].view(np.uint64)) % n).astype(np.int32), docs[know], values[know])]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["bucket", "kind", "keys", "docs", "values"])


def packs(parts: Iterator[tuple[np.ndarray, ...]], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Packs of keys, documents, values and marks, many at once."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= PACKED:
            yield packed(*(np.concatenate(c) for c in zip(*held)), n_buckets)
            held, size = [], 0
    if size:
        yield packed(*(np.concatenate(c) for c in zip(*held)), n_buckets)


def shared_values(packs: DataFrame, n_buckets: int, key_type: str, value_type: str) -> DataFrame:
    """doc and values (an array's bytes, sorted): of each document the distinct values of keys that another document has, too, but for entries that were marked."""

    def met(got: pa.Table) -> pa.Table:
        kind = got.column("kind").to_numpy()
        keys, docs, values = ([np.frombuffer(x, t) for x in got.column(c).to_pylist()] for c, t in (("keys", key_type), ("docs", "<i8"), ("values", value_type)))
        told = np.repeat(kind, [len(d) for d in docs])
        d, v = np.concatenate(docs), np.concatenate(values)
        k = np.concatenate([*keys, np.zeros(0, key_type)])
        asks, know = np.flatnonzero(told != _KNOWN), told == _KNOWN
        order = np.lexsort((d[asks], k))
        at, k = asks[order], k[order]
        start = _starts_of(k)
        size = np.diff(np.append(start, len(k)))
        shared = (d[at[start]] != d[at[start + size - 1]]) | np.logical_or.reduceat(told[at] == _SEVERAL, start) if len(k) else np.zeros(0, bool)
        know[at] = np.repeat(shared, size)
        know[told == _SEVERAL] = False
        rows = _rows_by((mixed(d[know].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32), d[know], v[know])
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "docs", "values"])

    def gathered(got: pa.Table) -> pa.Table:
        d, v = (np.concatenate([np.frombuffer(x, t) for x in got.column(c).to_pylist()]) for c, t in (("docs", "<i8"), ("values", value_type)))
        order = np.lexsort((v, d))
        d, v = d[order], v[order]
        new = np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
        d, v = d[new], v[new]
        start = _starts_of(d)
        return pa.table([pa.array(d[start], pa.int64()), pa.array([x.tobytes() for x in np.split(v, start[1:])], pa.binary())], names=["doc", "values"])

    told = packs.groupBy("bucket").applyInArrow(met, "bucket int, docs binary, values binary")
    return told.groupBy("bucket").applyInArrow(gathered, "doc long, values binary")


def shared_places(first: DataFrame, passage: int, percent: int, n_buckets: int) -> DataFrame:
    """doc and places (the bytes of an array, sorted): of each document those with a key that another row has, too."""
    run = shared_run(passage - SHINGLE + 1, percent)

    def made(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            docs, texts = batch.column(0).to_numpy(), []
            for text in batch.column(1).to_pylist():
                words = word_digests(text)
                texts.append(shingle_digests(words, SHINGLE) if len(words) >= passage else words[:0])
            k, of, p = text_keys(texts, run)
            yield k, docs[of], p.astype(np.int32), np.zeros(len(k), bool)

    keys = first.select("doc", "text").mapInArrow(lambda batches: packs(made(batches), n_buckets), _PACK)
    return shared_values(keys, n_buckets, "<i8", "<i4").withColumnRenamed("values", "places")


def marked_stretches(first: DataFrame, passage: int, percent: int, n_buckets: int) -> DataFrame:
    """doc, t, at (first shingle), d (digest) and content (32 bits of each shingle, 0 where no other document has it) of all stretches."""
    least = passage - SHINGLE + 1
    places = cut(shared_places(first, passage, percent, n_buckets))
    met = first.join(sent(places.select("doc")), "doc", "left_semi").join(places, "doc")

    def segments(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            rows, names, of = [], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
            for doc, t, text, at in zip(*(batch.column(c).to_pylist() for c in ("doc", "t", "text", "places"))):
                s = shingle_digests(word_digests(text), SHINGLE)
                s[s.astype(np.uint32) == 0] = 1  # 0 is a blank
                p = np.frombuffer(at, np.int32)
                p = p[p < len(s)]
                for piece in np.split(p, np.flatnonzero(np.diff(p) > 2 * least) + 1) if len(p) else ():
                    a, b = max(0, int(piece[0]) - least), min(len(s), int(piece[-1]) + least + 1)
                    rows.append((doc, t, a, s[a:b]))
                    names.append(distinct(s[a:b].astype(np.uint32)))
                    of.append(np.full(len(names[-1]), doc))
            h, d = np.concatenate(names), np.concatenate(of)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.concatenate([[True], np.diff(h) != 0])[: len(h)]
            last = np.concatenate([new[1:], [True]])[: len(h)]
            several = d[new] != d[last]
            known = h[new][several]
            # of the documents of the batch that have a shingle, the least asks who else has it, or tells the others of it
            order = np.argsort(d[new], kind="stable")
            asker, asked, several = d[new][order], h[new][order], several[order]
            asks, seen = [], set()
            for doc, *_ in rows:
                lo, hi = np.searchsorted(asker, [doc, doc + 1]) if doc not in seen else (0, 0)
                one = ~several[lo:hi]
                asks.append((asked[lo:hi][one].tobytes(), asked[lo:hi][~one].tobytes()))
                seen.add(doc)
            marks = [np.packbits(_among(r[3].astype(np.uint32), known)).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))), pa.array([r[3].astype(np.uint32).tobytes() for r in rows], pa.binary()), pa.array(marks, pa.binary()), *(pa.array([a[k] for a in asks], pa.binary()) for k in range(2))], names=["doc", "t", "at", "shingles", "known", "asks", "tells"])

    def asked(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            docs, parts = batch.column(0).to_numpy(), [[np.frombuffer(x, np.uint32) for x in batch.column(c).to_pylist()] for c in (1, 2)]
            h = np.concatenate([*parts[0], *parts[1], np.zeros(0, np.uint32)])
            sizes = [np.array([len(x) for x in part], np.int64) for part in parts]
            yield h, np.concatenate([np.repeat(docs, n) for n in sizes]), h, np.arange(len(h)) >= sizes[0].sum()

    found = cut(met.select("doc", "t", "text", "places").mapInArrow(segments, "doc long, t long, at int, shingles binary, known binary, asks binary, tells binary"))
    asks = found.select("doc", "asks", "tells").mapInArrow(lambda batches: packs(asked(batches), n_buckets), _PACK)
    answers = shared_values(asks, n_buckets, "<u4", "<u4").withColumnRenamed("values", "others")

    def blanked(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = []
            for doc, t, at, raw, known, others in zip(*(batch.column(c).to_pylist() for c in range(6))):
                s = np.frombuffer(raw, np.uint32)
                shared = np.unpackbits(np.frombuffer(known, np.uint8), count=len(s)).astype(bool)
                if others:
                    shared |= _among(s, np.frombuffer(others, np.uint32))
                s = np.where(shared, s, np.uint32(0))
                for a, b in stretches(s, least, percent):
                    content = s[a:b].tobytes()
                    out.append((doc, t, at + a, xxhash.xxh3_128_digest(content), content))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc", "t", "at", "d", "content"])

    return found.drop("asks", "tells").join(answers, "doc", "left").mapInArrow(blanked, "doc long, t long, at int, d binary, content binary")


def linked_stretches(kinds: DataFrame, passage: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of distinct stretches (d, content, lo and hi: the least and largest document that has it): spans (d, a, b) of all passages
    that were verified, and components (node, root) of what they connect."""
    least = passage - SHINGLE + 1
    run = shared_run(least, percent)
    spark = kinds.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.column(0).to_pylist()
            # a blank has other shingles in other stretches
            texts = [filled(c, int.from_bytes(n[:7], "little")) for n, c in zip(names, batch.column(1).to_pylist())]
            k, of, _ = text_keys(texts, run)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(k) != 0) | (np.diff(of) != 0)])[: len(k)])
            yield pa.RecordBatch.from_arrays([pa.array(k[new]), pa.array([names[i] for i in of[new].tolist()], pa.binary())], names=["key", "d"])

    keys = kinds.select("d", "content").mapInArrow(keyed, "key long, d binary")
    # keys that the very same stretches have give the same pairs: of these one stays (sets by their number and 128 bits of digests)
    members = [F.count("*").alias("c"), *(F.bit_xor(F.xxhash64(F.lit(k), "d")).alias(f"m{k}") for k in range(2))]
    several = keys.groupBy("key").agg(*members).filter("c > 1").groupBy("c", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    keys = cut(keys.join(several, "key"))
    places = kinds.select("d", "content", "lo", "hi")

    def verified(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, y, cx, cy = (batch.column(c).to_pylist() for c in ("x", "y", "cx", "cy"))
            spans = aligned([(filled(a, 0), filled(b, 1)) for a, b in zip(cx, cy)], least, percent)
            yield _six([(a, b, *p) for a, b, found in zip(x, y, spans) for p in found])

    found, roots = None, None
    apart = (F.col("x_lo") != F.col("y_lo")) | (F.col("x_hi") != F.col("y_hi")) | (F.col("x_lo") != F.col("x_hi"))
    for k in range(HEADS):
        pairs = cut(with_heads(rooted(keys, roots, "d"), "d", k))
        if pairs.isEmpty():
            break
        x, y = (places.toDF(c, f"c{c}", f"{c}_lo", f"{c}_hi") for c in "xy")
        full = spread_join(spread_join(pairs, y, "y"), x, "x").filter(apart)
        some = cut(full.select("x", "y", "cx", "cy").mapInArrow(verified, _SIX_SCHEMA))
        found = some if found is None else found.unionByName(some)
        roots = cut(components(found.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    else:
        rest = cut(_tiles(rooted(keys, roots, "d"), places, least, percent, run))
        found = rest if found is None else found.unionByName(rest)
        roots = cut(components(found.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    if found is None:
        none = spark.createDataFrame([], "d binary, a long, b long")
        return none, none.select(F.col("d").alias("node"), F.col("d").alias("root"))
    spans = found.select(F.col("x").alias("d"), F.col("x_from").alias("a"), F.col("x_to").alias("b")).unionByName(found.select(F.col("y").alias("d"), F.col("y_from").alias("a"), F.col("y_to").alias("b")))
    return spans, found.sparkSession.createDataFrame([], "node binary, root binary") if roots is None else roots


def _tiles(placed: DataFrame, places: DataFrame, least: int, percent: int, run: int) -> DataFrame:
    """Passages of all pairs of stretches that have a key in common and aren't connected yet, of each pair in its least such key.
    placed: key, d and root."""
    sized = placed.join(places.select("d", (F.length("content") / 4).alias("n")), "d")
    keys_of = placed.groupBy("d").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    rows = spread_join(tiles(sized, "d", TILE_STRETCHES, TILE_SHINGLES), places.join(keys_of, "d"), "d")

    def compared(got: pa.Table) -> pa.Table:
        i, j, key = (got.column(c)[0].as_py() for c in ("i", "j", "key"))
        at = sorted(range(got.num_rows), key=got.column("d").to_pylist().__getitem__)
        side, names, root, contents = (got.column(c).to_pylist() for c in ("side", "d", "root", "content"))
        lo, hi = (got.column(c).to_numpy() for c in ("lo", "hi"))
        lesser = [np.array([v for v in k if v < key], np.int64).view(np.uint64) for k in got.column("keys").to_pylist()]
        forest = Forest(0)
        number: dict[bytes, int] = {}
        node = np.array([number.setdefault(r, forest.add() if r not in number else 0) for r in root])
        left, right = (np.array([k for k in at if side[k] == s], int) for s in (i, j))
        # pairs that aren't connected, have this as their least key, and aren't of one document alone
        near = common_counts([lesser[k] for k in left], [lesser[k] for k in right]) == 0
        near &= (node[left][:, None] != node[right]) & ((lo[left][:, None] != lo[right]) | (hi[left][:, None] != hi[right]) | (lo[left] != hi[left])[:, None])
        near = np.triu(near, 1) if i == j else near
        if not near.any():
            return pa.Table.from_batches([_six([])])
        left, right, near = left[near.any(axis=1)], right[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
        # a common run, and as many common shingles as the passages with the fewest distinct ones need
        texts = {k: np.frombuffer(contents[k], np.uint32) for k in {*left.tolist(), *right.tolist()}}
        runs = {k: distinct(run_digests(filled(c, k), run)) for k, c in texts.items()}
        near &= common_counts([runs[k] for k in left], [runs[k] for k in right]) > 0
        sets = {k: distinct(c[c != 0]).astype(np.uint64) for k, c in texts.items()}
        need = {k: -(-percent * _fewest(c, least) // 100) for k, c in texts.items()}
        total = common_counts([sets[k] for k in left], [sets[k] for k in right])
        near &= total >= np.maximum(np.array([need[k] for k in left])[:, None], np.array([need[k] for k in right]))
        pairs = [(float(total[a, b]), int(left[a]), int(right[b])) for a, b in zip(*(v.tolist() for v in np.nonzero(near)))]
        full = functools.cache(lambda k, s: filled(texts[k], s))
        out, todo = [], [(x, y) for _, x, y in sorted(pairs, key=lambda p: (-p[0], names[p[1]], names[p[2]]))]
        while todo:
            # pairs that connect what the others of their wave don't; the rest waits for what the wave gives
            later, k = [], 0
            while k < len(todo):
                wave, would = [], Forest(0)
                would.up = list(forest.up)
                while k < len(todo) and len(wave) < WAVE:
                    x, y = todo[k]
                    if forest.root(node[x]) != forest.root(node[y]):
                        (wave if would.join(node[x], node[y]) else later).append((x, y))
                    k += 1
                for (x, y), spans in zip(wave, aligned([(full(x, 0), full(y, 1)) for x, y in wave], least, percent)):
                    if spans:
                        forest.join(node[x], node[y])
                        out.extend((names[x], names[y], *p) for p in spans)
            todo = later
        return pa.Table.from_batches([_six(out)])

    return rows.groupBy("key", "i", "j").applyInArrow(compared, _SIX_SCHEMA)


_SIX = ["x", "y", "x_from", "x_to", "y_from", "y_to"]
_SIX_SCHEMA = "x binary, y binary, x_from long, x_to long, y_from long, y_to long"


def _six(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k < 2 else pa.int64()) for k in range(6)], names=_SIX)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, percent: int = PERCENT, rows_marked: DataFrame | None = None) -> DataFrame:
    """doc, t (xxhash64 of the text), word_from, word_to (from 0, both ends included), node, root: each verified passage of each distinct text, the stretch it
    stands in, and the least stretch that is connected with that. Of rows with equal texts only the one with the least id takes part, unless
    ids repeat. Rows with a null id or text, and texts shorter than a passage, take part in nothing. Rows of one id are one
    document: nothing links it with itself. Other columns are ignored; an empty table gives no rows. rows_marked is what
    ``marked_rows`` gives of docs, if that is known."""
    python_ready(docs.sparkSession)
    rows_marked = marked_rows(docs, id_col, text_col) if rows_marked is None else rows_marked
    n_buckets = max(BUCKETS, -(-(rows_marked.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).filter(F.col("doc").isNotNull() & F.col("text").isNotNull())
    least = passage - SHINGLE + 1
    marked = cut(marked_stretches(documents_of(rows, rows_marked), passage, percent, n_buckets))
    kinds = cut(marked.groupBy("d").agg(F.first("content").alias("content"), F.min("doc").alias("lo"), F.max("doc").alias("hi")))

    def own(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            out = [(d, a, b) for d, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for a, b in own_passages(c, least, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64()))], names=["d", "a", "b"])

    spans, roots = linked_stretches(kinds, passage, percent)
    spans = spans.unionByName(kinds.filter("lo <> hi").select("d", "content").mapInArrow(own, "d binary, a long, b long"))
    merged = spans.groupBy("d").agg(F.collect_set(F.struct("a", "b")).alias("spans")).join(roots.select(F.col("node").alias("d"), "root"), "d", "left")
    met = spread_join(marked.select("doc", "t", "at", "d"), merged, "d").select("doc", "t", "at", "d", F.coalesce("root", "d").alias("root"), F.explode("spans").alias("span"))
    at = F.col("at").cast("long")
    return met.select("doc", "t", (at + F.col("span.a")).alias("word_from"), (at + F.col("span.b") + SHINGLE - 1).alias("word_to"), F.col("d").alias("node"), "root").distinct()


def substring_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, percent: int = PERCENT) -> DataFrame:
    """Of every document row: the id (as a long), n_words, n_repeated (words inside verified passages that another document has,
    too), class_id (least id of the class that passages connect) and repeated (n_repeated > 0).

    Each stretch of a text that may hold passages is verified against one or more heads of its keys, and against all that these don't connect it
    with; n_repeated counts the words of the passages found. A text of ``passage`` words or more that a row with another id has, too, is repeated
    as a whole. Null texts have no words; rows with a null id stay alone. Rows of one id are one document, so they share class_id;
    other columns are ignored; an empty table gives no rows.
    """
    python_ready(docs.sparkSession)
    marked = marked_rows(docs, id_col, text_col)
    named = marked.filter(F.col("doc").isNotNull())
    classes = named.groupBy("d").agg(F.min(F.struct("doc", "t")).alias("rep"), F.max("doc").alias("last"))
    found = cut(repeated_passages(docs, id_col, text_col, passage, percent, marked))
    # words covered: intervals by their ends, each adding what lies beyond all before it
    spans = found.groupBy("doc", "t").agg(F.sort_array(F.collect_set(F.struct(F.col("word_from").alias("a"), F.col("word_to").alias("b")))).alias("spans"))
    start = F.struct(F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("spans", start, lambda s, x: F.struct(F.greatest(s["upto"], x["b"]).alias("upto"), (s["n"] + F.greatest(x["b"] - F.greatest(s["upto"], x["a"] - 1), F.lit(0))).alias("n")), lambda s: s["n"])
    covers = spans.select("doc", "t", covered.alias("covered"))
    # documents of connected stretches, each with the least document of that, and with the least that has the same text
    least = found.groupBy("root").agg(F.min("doc").alias("b"))
    whole = F.col("n_words") >= passage
    pairs = found.select("doc", "root").distinct().join(least, "root").select(F.col("doc").alias("a"), "b")
    same = named.filter(whole).join(classes.filter(F.col("rep.doc") != F.col("last")), "d").select(F.col("doc").alias("a"), F.col("rep.doc").alias("b"))
    roots = components(pairs.unionByName(same).filter("a <> b").distinct())
    per_text = classes.join(covers, (F.col("rep.doc") == F.col("doc")) & (F.col("rep.t") == F.col("t")), "left").select("d", F.col("rep.doc").alias("rep"), "last", "covered")
    joined = marked.join(per_text, "d", "left").join(roots.withColumnRenamed("node", "doc"), "doc", "left")
    n = F.when(F.col("doc").isNull(), 0).when(whole & (F.col("rep") != F.col("last")), F.col("n_words")).otherwise(F.coalesce("covered", F.lit(0)))
    out = joined.select(F.col("doc").alias(id_col), "n_words", n.cast("long").alias("n_repeated"), F.coalesce("root", "doc").alias("class_id"))
    return out.withColumn("repeated", F.col("n_repeated") > 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_duplicates(table(spark, sf_dir, "documents"))
