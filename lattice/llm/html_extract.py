"""HTML extraction by the distribution of text over line blocks.

Markup is stripped so that each block element starts a line, and containers leave blank lines between their lines. Of each line the length
without link text counts. The lengths of a few successive lines (a line block) are summed. A surge is where the sums rise
from nothing, a dive where they fall back to nothing; the stretch between them is kept if one of its line blocks holds at least ``SHARE`` of
what the page's fullest line block holds, be it one stretch or several.

What tags, classes and roles say goes into the lengths: what stands in menus, headers, footers, sidebars, notices, adverts, forms and
reader comments counts for nothing and parts no text that it stands within; where a page marks its article, lines
outside count ``OUTSIDE`` as much, and all lines inside, linked or not, stand without blank lines between them.
"""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_ready, table

#: Lines of a line block, the share of the fullest line block that a stretch must reach, the weight of lines outside a marked article.
WINDOW, SHARE, OUTSIDE = 3, 0.2, 0.02
#: Elements whose content is no text; it runs to the next end tag of the same name.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas audio video".split())
#: Elements that are never main text; a header is, inside an article.
BOILER = frozenset("head nav header footer aside form button select menu dialog fieldset datalist noframes".split())
#: Those that stand within a text: what they part is one text.
INLINE = frozenset("aside form button select fieldset datalist".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks that part what stands before and after them by a blank line.
CONTAINER = frozenset("address article body center details div dl figure main ol section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Words of a class, id or role that say what an element is, those of them that stand within texts, and words of layout that say nothing.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies respond search share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
WITHIN = frozenset("ad ads advert adverts advertisement advertising newsletter notice notices promo promotion sponsor sponsored subscribe subscription".split())
LAYOUT = frozenset("area bar block body bottom box container content inner item items left links list main outer page right section site slot top unit wrap wrapper".split())
#: A quote opens a value only after an equals sign; else a tag ends at the next >.
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)(?:>|$)""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'/])(?:hidden(?=$|[\s/=])|aria-hidden\s*=\s*[\"']?true)", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+[a-z]*|[^a-zA-Z\s_-]+")


@lru_cache(maxsize=4096)
def _said(attrs: str) -> tuple[bool, bool]:
    """Whether attributes say that an element is no main text, and whether it may stand within a text all the same. A name
    counts if each of its words is a hint or of layout: `site-footer` does, `share-price` doesn't."""
    found = [_HIDDEN.search(attrs) is not None]
    within = found[0]
    for _, a, b, c in _ATTR.findall(attrs):
        for name in (a or b or c).split():
            words = {w.lower() for w in _WORD.findall(name)}
            if words & HINTS and words <= HINTS | LAYOUT:
                found.append(True)
                within |= bool(words & WITHIN)
    return any(found), within


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines in order: text, its length without link text (0 in elements that are no main text), and whether it
    stands in a marked article. Blank lines have no text. Lines of elements that stand within a text without being part of it are left out."""
    lines: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = in_link = main = 0
    side: list[str] = []  # open elements since the outermost that is no main text
    inner = False  # whether that stands within a text
    opened: list[str] = []  # open block elements outside of such
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text and not (side and inner):
                lines.append((text, 0 if side else max(0, len(text) - linked), main > 0))
        linked = 0

    def blank(n: int) -> None:
        lines.extend([("", 0, False)] * n)

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            parts.append(page[at:stop])
            if in_link:
                linked += stop - at
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1]), m[3]
        empty = name in VOID or attrs.endswith("/")
        if name in RAW:
            if not closing and not empty:
                at = _after(page, at, name)
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if side:
            if closing and name in side:
                flush()
                while side.pop() != name:
                    pass
                continue
            if closing and name in BLOCK and name in opened:  # the element was never closed
                flush()
                side.clear()
            elif not closing and side == ["p"] and name in BLOCK:  # a paragraph ends where a block starts
                flush()
                side.clear()
            else:
                if name in BLOCK:
                    flush()
                    if not closing and not empty and name != "p":  # its end may be left out
                        side.append(name)
                elif not closing and not empty and name in side:
                    side.append(name)
                continue
        if not closing and not empty and name not in MAIN and name not in ("html", "body"):
            no_text, within = _said(attrs) if "=" in attrs or "hidden" in attrs.lower() else (False, False)
            boiler = name in BOILER and not (name == "header" and main)
            if boiler or no_text:
                if name in BLOCK or name in BOILER:
                    flush()
                    in_link = 0
                    inner = main > 0 or name in INLINE or name not in BOILER and within
                    if not inner:
                        blank(WINDOW)
                else:  # an inline element parts its line, not the text
                    flush()
                    inner = True
                side.append(name)
                continue
        if name in BLOCK:
            flush()
            in_link = 0
            if closing:
                if name in opened:
                    while opened.pop() != name:
                        pass
            elif not empty and name != "p":
                opened.append(name)
            now = sum(x in MAIN for x in opened) if name in MAIN else main
            if bool(now) != bool(main):
                blank(WINDOW)
            elif not main and name in CONTAINER:
                blank(1)
            main = now
    flush()
    return lines


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I)


def _after(page: str, at: int, name: str) -> int:
    m = _end_of(name).search(page, at)
    return m.end() if m else len(page)


def stretches(sizes: list[float], share: float = SHARE, window: int = WINDOW) -> list[tuple[int, int]]:
    """From each surge to its dive: half-open ranges of lines between places where all of a line block is blank, from the first to the last
    with a size, if one of their line blocks reaches ``share`` of the fullest."""
    x = np.asarray(sizes, dtype=np.float64)
    if not x.any():
        return []
    n = len(x)
    padded = np.concatenate([x, np.zeros(window - 1)])
    sums = sum(padded[k : n + k] for k in range(window))  # of the block that starts at each line
    least = share * sums.max()
    step = np.diff(np.concatenate([[0], sums > 0, [0]]).astype(np.int8))
    found = []
    for surge, dive in zip(np.nonzero(step == 1)[0].tolist(), np.nonzero(step == -1)[0].tolist()):
        if sums[surge:dive].max() >= least:
            held = np.nonzero(x[surge:dive])[0]
            found.append((surge + int(held[0]), surge + int(held[-1]) + 1))
    return found


def main_text(page: str | None, share: float | None = SHARE) -> str:
    """The main text of a page, one line for each block. Empty for null, for an empty page and for one without text. Without a
    share, neither surges nor dives count, and all lines are given."""
    if not page:
        return ""
    lines = lines_of(page)
    marked = any(m and t for t, _, m in lines)
    sizes = [(len(t) if m else OUTSIDE * n) if marked else n for t, n, m in lines]
    kept = stretches(sizes, share) if share is not None else [(0, len(lines))]
    return "\n".join(t for a, b in kept for t, _, _ in lines[a:b] if t)


def extract(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns ``keep`` as they are, text (main text) and n_chars (its code points). Every row gives a row, repeated or
    not; null and empty pages have an empty text; other columns are ignored."""
    python_ready(df.sparkSession)
    rows = df.select(*[F.col(c) for c in keep], F.col(html_col).cast("string").alias("__html"))
    names = [*keep, "text"]

    def extracted(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], names=names)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(extracted, f"{fields}, text string").withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
