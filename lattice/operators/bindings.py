"""Names that files bring in and give away: one row for each name of an import, re-export, export list or ``use`` tree.

A scanner over the code of each body (comments and literals blanked, places kept) reads the statements in an Arrow function; what they
mean across files is joined afterwards (``names``).

Forms: ``import`` (name of spec, bound to local), ``namespace`` (all of spec under one local name), ``side_effect``, ``dynamic``,
``type`` (no value at run time), ``reexport`` (name of spec, public as local), ``star`` (all of spec but its default), ``export``
(the declaration name, public as local) and ``default`` (the same, public as default; name is null where it has none).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import python_ready
from .extract import code_of

SCHEMA = "rel string, language string, line int, form string, spec string, name string, local string"
_TOKEN = re.compile(r"""(?P<literal>(?P<q>['"`])[ \n]*(?P=q))|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<sign>\S)""")
_DECLARING = {"function", "class", "const", "let", "var", "enum", "namespace"}
_BEFORE = {"async", "abstract", "declare"}


class Tokens:
    """Words, literals and signs of code from a place on; a literal's value is read from the text."""

    def __init__(self, code: str, text: str, at: int):
        self.code, self.text, self.at = code, text, at

    def peek(self) -> tuple[str, str, int]:
        """kind, value and end of the next one; empty at the end."""
        m = _TOKEN.search(self.code, self.at)
        if m is None:
            return "", "", len(self.code)
        if m["literal"]:
            return "literal", self.text[m.start() + 1 : m.end() - 1], m.end()
        return ("word" if m["word"] else "sign"), m[0], m.end()

    def take(self) -> tuple[str, str]:
        kind, value, self.at = self.peek()
        return kind, value

    def takes(self, value: str) -> bool:
        kind, got, end = self.peek()
        if kind != "literal" and got == value:
            self.at = end
            return True
        return False

    def source(self) -> str | None:
        """The literal of a from clause."""
        if not self.takes("from"):
            return None
        kind, value = self.take()
        return value if kind == "literal" else None

    def names(self) -> list[tuple[str, str, bool]]:
        """name, local and whether it is a type, of what stands in braces; the opening one was taken."""
        out = []
        while True:
            kind, value = self.take()
            if not kind or value == "}":
                return out
            if value == ",":
                continue
            is_type = False
            if value == "type" and self.peek()[0] == "word" and self.peek()[1] != "as":
                is_type, (kind, value) = True, self.take()
            local = self.take()[1] if self.takes("as") else value
            out.append((value, local, is_type))


#: The word that begins a statement, with all of it where a file gives away all that another one does, as barrels have a line of these for each file.
_STATEMENT = re.compile(r"""(?<![\w$.])(import|export)(?![\w$])(?:\s*\*\s*from\s*(['"`])([ \n]*)\2)?""")


def _javascript(code: str, text: str):
    for m in _STATEMENT.finditer(code):
        if m[2] and m[1] == "export":
            yield m.start(), "star", text[m.start(3) : m.end(3)], None, None
            continue
        t = Tokens(code, text, m.end(1))
        yield from ((m.start(), *row) for row in (_imported(t) if m[1] == "import" else _exported(t)))


def _imported(t: Tokens):
    kind, value, _ = t.peek()
    if value == "(" and kind == "sign":
        t.take()
        kind, value = t.take()
        yield "dynamic", value if kind == "literal" and t.takes(")") else None, None, None
        return
    if kind == "literal":
        yield "side_effect", value, None, None
        return
    if value == ".":
        return
    rows, is_type = [], False
    if value == "type":
        before = t.at
        t.take()
        kind, value, _ = t.peek()
        is_type = value in ("{", "*") or (kind == "word" and value != "from")
        if not is_type:
            t.at = before
    while True:
        kind, value = t.take()
        if value == "*" and t.takes("as"):
            rows.append(("namespace", "*", t.take()[1], False))
        elif value == "{":
            rows += [("import", *x) for x in t.names()]
        elif kind == "word":
            rows.append(("import", "default", value, False))
        if not t.takes(","):
            break
    spec = t.source()
    if spec is not None:
        for form, name, local, one_type in rows:
            yield ("type" if is_type or one_type else form), spec, name, local


def _exported(t: Tokens):
    is_type = False
    if t.peek()[1] == "type":
        t.take()
        if t.peek()[1] not in ("{", "*"):
            return  # a type's declaration
        is_type = True
    if t.takes("*"):
        local = t.take()[1] if t.takes("as") else None
        spec = t.source()
        if spec is not None and not is_type:
            yield ("reexport", spec, "*", local) if local else ("star", spec, None, None)
        return
    if t.takes("{"):
        names, spec = t.names(), t.source()
        for name, local, one_type in names:
            if is_type or one_type:
                yield "type", spec, name, local
            else:
                yield ("reexport" if spec is not None else "default" if local == "default" else "export"), spec, name, local
        return
    default = t.takes("default")
    while t.peek()[1] in _BEFORE:
        t.take()
    kind, value = t.take()
    if value in _DECLARING:
        if value == "const" and t.takes("enum"):
            pass
        t.takes("*")
        kind, value, _ = t.peek()
        value = value if kind == "word" and value not in ("extends", "implements") else None
    elif kind != "word" or t.peek()[1] in (".", "(", "=>", "="):
        value = None
    if default:
        yield "default", None, value, "default"
    elif value is not None and kind == "word":
        yield "export", None, value, value


def _use_tree(t: Tokens, path: tuple[str, ...]):
    """path, name and local of each leaf of a use tree."""
    while True:
        kind, value = t.take()
        if value == "{":
            while not t.takes("}") and t.peek()[0]:
                yield from _use_tree(t, path)
                t.takes(",")
            return
        if value == "*":
            yield path, "*", None
            return
        if kind != "word":
            return
        if t.takes(":"):
            t.takes(":")
            path = (*path, value)
            continue
        local = t.take()[1] if t.takes("as") else None
        if value == "self" and path:
            yield path[:-1], path[-1], local or path[-1]
        else:
            yield path, value, local or value
        return


def _rust(code: str, text: str):
    for m in re.finditer(r"(?:^|[;{}\s])(?P<pub>pub(?:\s*\([^()]*\))?\s+)?use\s+(?:::)?", code):
        for path, name, local in _use_tree(Tokens(code, text, m.end()), ()):
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if name == "*":
                yield at, "star" if m["pub"] else "import", "::".join(path), "*", None
            else:
                yield at, "reexport" if m["pub"] else "import", "::".join((*path, name)), name, local
    for m in re.finditer(r"(?:^|[;{}\s])(?:pub(?:\s*\([^()]*\))?\s+)?mod\s+(\w+)\s*;", code):
        yield m.start(1), "namespace", m[1], "*", m[1]


def _python(code: str, text: str):
    for m in re.finditer(r"(?m)^[ \t]*(?:from[ \t]+([.\w]+)[ \t]+)?import[ \t]+(\([^()]*\)|(?:[^\n;\\]|\\\n)*)", code):
        for part in m[2].replace("\\\n", " ").strip("() \n\t").split(","):
            words = part.split()
            if not words or (len(words) > 1 and (len(words) != 3 or words[1] != "as")):
                continue
            name, local = words[0], words[-1]
            at = m.start() + len(m[0]) - len(m[0].lstrip())
            if m[1] is None:
                yield at, "namespace", name, "*", local if len(words) > 1 else name.split(".")[0]
            else:
                yield at, "import", m[1], name, None if name == "*" else local


def _go(code: str, text: str):
    one = r"([\w.]+[ \t]+)?([\"`])( *)\2"
    for m in re.finditer(r"(?m)^import\b\s*(?:\(([^()]*)\)|[^\n(]+)", code):
        inside = re.finditer(one, code[m.start() : m.end()]) if m[1] is None else re.finditer(one, code[m.start(1) : m.end(1)])
        base = m.start() if m[1] is None else m.start(1)
        for x in inside:
            spec = text[base + x.start(3) : base + x.end(3)]
            alias = (x[1] or "").strip()
            alias = "" if alias == "import" else alias
            form = "side_effect" if alias == "_" else "namespace"
            yield base + x.start(2), form, spec, "*", None if alias in ("_", ".") else alias or spec.rsplit("/", 1)[-1]


_READERS = {"javascript/typescript": _javascript, "rust": _rust, "python": _python, "go": _go}


def bindings(bodies: DataFrame) -> DataFrame:
    """The rows of bodies (rel, language, text) in the columns of SCHEMA. Null texts and other languages have none."""
    python_ready(bodies.sparkSession)
    return bodies.filter(bodies["language"].isin(*_READERS)).select("rel", "language", "text").mapInArrow(scan_batches, SCHEMA)


#: Rows after which a batch is handed on, so that files of many bindings don't pile up.
_PACKED_ROWS = 16_384


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if n == "line" else pa.string()) for n, x in zip(names, zip(*rows) if rows else [()] * len(names))], names=names)

    for batch in batches:
        rows = []
        for rel, language, text in zip(*(c.to_pylist() for c in batch.columns)):
            code = "\n".join(code_of(text or "", language))
            breaks = [m.start() for m in re.finditer("\n", code)]
            rows += [(rel, language, bisect_left(breaks, at) + 1, *rest) for at, *rest in _READERS[language](code, text or "")]
            if len(rows) >= _PACKED_ROWS:
                yield packed(rows)
                rows = []
        yield packed(rows)
