"""Facts of file bodies: lines, symbols, imports, references, routes, environment reads, side effects.

One lexer runs as an Arrow function over bodies and gives lines with comments and literals blanked; everything after
that is column expressions over the lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import python_ready
from .brackets import with_ends

#: By language: line comment, block comment (open, close, nests), quotes that end on their line, quotes that span lines.
_SYNTAX = {
    "javascript/typescript": ("//", ("/*", "*/", False), "'\"", ("`",)),
    "rust": ("//", ("/*", "*/", True), '"', ()),
    "go": ("//", ("/*", "*/", False), "'\"", ("`",)),
    "swift": ("//", ("/*", "*/", True), '"', ('"""',)),
    "python": ("#", None, "'\"", ('"""', "'''")),
    "sql": ("--", ("/*", "*/", False), "'", ()),
    "style": (None, ("/*", "*/", False), "'\"", ()),
    "shell": ("#", None, "'\"", ()),
}


#: What stands before a slash that begins a pattern in JavaScript: a sign after which a value comes, or a word.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?;{+\-*%~^]|=>|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await))$")
_PATTERN = re.compile(r"/(?![/*])(?:[^\n\\\[/]|\\.|\[(?:[^\n\\\]]|\\.)*\])+/")


def _runs(language: str) -> tuple[re.Pattern, dict[str, re.Pattern]]:
    """What begins nothing outside literals and comments, and what begins nothing inside each literal."""
    comment, block, quotes, spans = _SYNTAX[language]
    begins = {"/" if language == "javascript/typescript" else quotes[0], *quotes, *(s[0] for s in spans), *(x[0] for x in (comment, block and block[0]) if x)}
    none_of = lambda chars: re.compile("[^" + re.escape("".join(sorted(chars))) + "]+")
    return none_of(begins), {mark: none_of({"\n", "\\", mark[0]}) for mark in (*quotes, *spans)}


_RUNS = {language: _runs(language) for language in _SYNTAX}
#: A literal that ends on its line and escapes nothing.
_WHOLE = {q: re.compile(rf"{q}[^{q}\\\n]*{q}") for q in "'\"`"}


def _last(out: list[str]) -> str:
    """The end of the last piece that isn't blank, without the spaces behind it."""
    return next((p[-40:] for piece in reversed(out) if (p := piece.rstrip())), "")


def code_of(text: str, language: str) -> list[str]:
    """The text's lines with comments and the contents of literals turned into spaces; every place stays where it was."""
    syntax = _SYNTAX.get(language)
    if syntax is None:
        return text.split("\n")
    comment, block, quotes, spans = syntax
    plain, inside = _RUNS[language]
    out, i, n = [], 0, len(text)
    depth, until = 0, ""
    while i < n:
        c = text[i]
        if not depth and (run := (inside[until] if until else plain).match(text, i)):
            out.append(" " * (run.end() - i) if until else run[0])
            i = run.end()
        elif c == "\n":
            if until and len(until) == 1 and until not in spans:
                until = ""  # an unclosed literal ends with its line
            out.append(c)
            i += 1
        elif depth:
            if text.startswith(block[1], i):
                depth -= 1
                out.append(" " * len(block[1]))
                i += len(block[1])
            elif block[2] and text.startswith(block[0], i):
                depth += 1
                out.append(" " * len(block[0]))
                i += len(block[0])
            else:
                out.append(" ")
                i += 1
        elif until:
            if c == "\\" and i + 1 < n and text[i + 1] != "\n":
                out.append("  ")
                i += 2
            elif text.startswith(until, i):
                out.append(until)
                i += len(until)
                until = ""
            else:
                out.append(" ")
                i += 1
        elif comment and text.startswith(comment, i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            out.append(" " * (end - i))
            i = end
        elif block and text.startswith(block[0], i):
            depth = 1
            out.append(" " * len(block[0]))
            i += len(block[0])
        elif c == "/" and language == "javascript/typescript" and _BEFORE_PATTERN.search(_last(out)) and (pattern := _PATTERN.match(text, i)):
            out.append("/" + " " * (len(pattern[0]) - 2) + "/")
            i = pattern.end()
        else:
            mark = next((s for s in spans if text.startswith(s, i)), c if c in quotes else "")
            if len(mark) == 1 and (whole := _WHOLE[mark].match(text, i)):
                out.append(mark + " " * (whole.end() - i - 2) + mark)
                i = whole.end()
                continue
            until = mark
            out.append(mark or c)
            i += len(mark) or 1
    return "".join(out).split("\n")


def lines(bodies: DataFrame) -> DataFrame:
    """rel, language, line_no (from 1), text and code of each line of bodies (rel, language, text). Null texts have none."""
    python_ready(bodies.sparkSession)
    return bodies.select("rel", "language", "text").mapInArrow(lexed_batches, "rel string, language string, line_no int, text string, code string")


#: Lines after which a batch is handed on: small files share one, and large ones don't pile up.
_PACKED_LINES = 16_384


def lexed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rels, languages, raws, codes):
        counts = [len(x) for x in raws]
        owner = pa.array(np.repeat(np.arange(len(rels)), counts))
        numbers = np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in counts]) if counts else np.empty(0, np.int32)
        columns = [pa.array(rels, pa.string()).take(owner), pa.array(languages, pa.string()).take(owner), pa.array(numbers), *(pa.array([row for x in rows for row in x], pa.string()) for rows in (raws, codes))]
        return pa.RecordBatch.from_arrays(columns, names=["rel", "language", "line_no", "text", "code"])

    for batch in batches:
        files, size = ([], [], [], []), 0
        for rel, language, text in zip(*(c.to_pylist() for c in batch.columns)):
            if text is None:
                continue
            raw = text.split("\n")
            for column, x in zip(files, (rel, language, raw, code_of(text, language or ""))):
                column.append(x)
            size += len(raw)
            if size >= _PACKED_LINES:
                yield packed(*files)
                files, size = ([], [], [], []), 0
        yield packed(*files)


#: Words and signs of a line.
_TOKEN = r"[\p{L}_$][\p{L}\p{N}_$]*|\p{N}[\p{L}\p{N}_]*|[^\s]"
_NAME = r"^[\p{L}_$]"
#: By language: words that may stand before a declaration, those of them that export it, and what each declaring word declares.
_DECLARING = {
    "javascript/typescript": ("export default declare abstract async", "export", {"function": "function", "class": "class", "const": "const", "let": "variable", "var": "variable", "interface": "interface", "type": "type", "enum": "enum"}),
    "rust": ("pub async unsafe extern default \"", "pub", {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "mod": "module", "const": "const", "static": "static", "impl": "impl"}),
    "python": ("async", "", {"def": "function", "class": "class"}),
    "go": ("", "", {"func": "function", "type": "type"}),
    "swift": ("public open package internal private fileprivate final static indirect lazy weak unowned override mutating nonmutating convenience required dynamic nonisolated", "public open package", {"class": "class", "struct": "struct", "enum": "enum", "protocol": "protocol", "actor": "actor", "func": "function", "let": "let", "var": "var"}),
}
#: What is taken out before a line is read: by language, what may stand between or before words without being a declaration itself.
_SET_ASIDE = {
    "rust": (r"(?<=pub)\s*\([^()]*\)", r"const\s+(?=(?:unsafe|async|extern|fn)\s)"),
    "swift": (r"@[\p{L}_]+(?:\([^()]*\))?", r"(?<=(?:public|open|package)\(set\))", r"class\s+(?=(?:func|var|let)\s)"),
}


def _once(value, then):
    """``then`` of ``value``, which is computed once however often it is used: in a lambda it is a variable, elsewhere it would be written out each time."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _declared(language: str, code):
    """name, raw (what is declared) and export of the declaration that a line begins with; null where it begins with none."""
    before = _DECLARING[language][0]
    for pattern in _SET_ASIDE.get(language, ()):
        code = F.regexp_replace(code, pattern, " ")
    placed = lambda tokens: F.transform(tokens, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    first = lambda tokens: F.get(F.filter(placed(tokens), lambda s: ~s["x"].isin(before.split())) if before else placed(tokens), F.lit(0))
    rest = lambda tokens, found: F.slice(tokens, found["i"] + 2, F.size(tokens))
    named = lambda tokens, found: _once(rest(tokens, found), lambda x: _declaration(language, code, tokens, found, x))
    return _once(F.regexp_extract_all(code, F.lit(_TOKEN), F.lit(0)), lambda tokens: _once(first(tokens), lambda found: named(tokens, found)))


def _declaration(language: str, code, tokens, first, rest):
    """tokens: words and signs of a line; first: the one that may declare, and its place; rest: what comes after that."""
    _, exporting, kinds = _DECLARING[language]
    word = first["x"]
    named = F.get(F.filter(rest, lambda x: x.rlike(_NAME)), F.lit(0))
    raw = None
    for k, v in kinds.items():
        raw = F.when(word == k, v) if raw is None else raw.when(word == k, v)
    begins = F.get(rest, F.lit(0))
    if language == "go":
        # a receiver stands before the name of a method; a type's form after its name
        method = (word == "func") & (begins == "(")
        closed = F.array_position(rest, F.lit(")")).cast("int")
        form = F.get(F.filter(F.slice(rest, 2, 8), lambda x: x.isin("struct", "interface")), F.lit(0))
        named = F.when(method & (closed > 0), F.get(rest, closed)).otherwise(named)
        raw = F.when(method, "method").when((word == "type") & form.isNotNull(), form).otherwise(raw)
        raw = F.when(code.rlike(r"^\s"), F.lit(None)).otherwise(raw)
    if language == "rust":
        # an implementation is named by all that stands between its own parameters and its body
        body = F.split(F.regexp_extract(code, r"impl(.*)$", 1), r"[{]|\swhere(?:\s|$)")[0]
        named = F.when(word == "impl", F.trim(F.regexp_replace(body, r"^\s*<.*?>(?=\s)", ""))).otherwise(named)
    export = F.exists(F.slice(tokens, 1, first["i"]), lambda x: x.isin(exporting.split())) if exporting else F.lit(False)
    fits = raw.isNotNull() & named.isNotNull() & (named != "") & (begins.rlike(_NAME) | begins.isin("*", "(", "<", "[", "{"))
    if language == "javascript/typescript":
        fits = fits & (begins.rlike(_NAME) | (begins == "*"))  # no name where a pattern is taken apart
    return F.when(fits, F.struct(named.alias("name"), raw.alias("raw"), export.alias("export")))


def symbols(lines_: DataFrame) -> DataFrame:
    """rel, name, kind, exported, line_start, line_end and ordinal of declarations.

    A symbol ends with its body (``brackets.with_ends``). In JavaScript a name like useX is a
    hook and an exported capitalised function or constant a component; Go exports capitalised names; Python marks none."""
    found = None
    for language in _DECLARING:
        part = lines_.filter(F.col("language") == language).withColumn("s", _declared(language, F.col("code"))).filter("s IS NOT NULL")
        starts = part.select("rel", "language", "line_no", F.length(F.regexp_extract("code", r"^(\s*)", 1)).alias("indent"), "s.*")
        found = starts if found is None else found.unionByName(starts)
    raw, name = F.col("raw"), F.col("name")
    kind = raw
    js, valued = F.col("language") == "javascript/typescript", raw.isin("function", "const", "variable")
    kind = F.when(js & valued & name.rlike("^use[A-Z]"), "hook").when(js & valued & F.col("export") & name.rlike("^[A-Z]"), "component").when((F.col("language") == "swift") & (raw == "let"), "constant").when((F.col("language") == "swift") & (raw == "var"), "property").otherwise(kind)
    exported = F.when(F.col("language") == "go", name.rlike("^[A-Z]")).otherwise(F.col("export"))
    ordinal = F.row_number().over(Window.partitionBy("rel").orderBy("line_no")) - 1
    starts = found.select("rel", "language", "name", kind.alias("kind"), exported.alias("exported"), F.col("line_no").alias("line_start"), "indent", ordinal.alias("ordinal"))
    return with_ends(starts, lines_).select("rel", "name", "kind", "exported", "line_start", "line_end", "ordinal")


def declared_names(lines_: DataFrame) -> DataFrame:
    """rel and name of each declaration, without where it ends; lines are read once, whatever their languages."""
    words = "|".join(sorted({word for _, _, kinds in _DECLARING.values() for word in kinds}))
    name = F.coalesce(*[F.when(F.col("language") == language, _declared(language, F.col("code"))["name"]) for language in _DECLARING])
    # a line without any declaring word isn't read, and the others once: what is exploded isn't written out again in a filter
    rows = lines_.filter(F.rlike(F.col("code"), F.lit(words)))
    return rows.select("rel", F.explode(F.array(name)).alias("name")).filter("name IS NOT NULL").distinct()


#: Literals, words (with dots, where modules have them) and signs of a line.
_PARTS = r"""'[^']*'|"[^"]*"|[\p{L}\p{N}_$]+|\S"""
_DOTTED = r"[\p{L}\p{N}_.]+|\S"
_SWIFT_KINDS = ("class", "struct", "enum", "protocol", "func", "var", "let", "typealias")


def _specs(language: str, code, text):
    """What a line imports, as an array."""
    parts = F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))
    words = F.regexp_extract_all(code, F.lit(_DOTTED), F.lit(0))
    at = lambda k: F.get(words, F.lit(k))
    none = F.array().cast("array<string>")
    if language in ("javascript/typescript", "style"):
        # a literal right after a word that imports, or after that and a bracket
        direct, called = (("from", "import"), ("require", "import")) if language != "style" else (("import",), ("url",))
        seen = F.transform(parts, lambda x, i: F.struct(x.alias("x"), F.get(parts, i - 1).alias("one"), F.get(parts, i - 2).alias("two"), F.get(parts, i + 1).alias("next")))
        hit = F.filter(seen, lambda s: s["x"].rlike(r"""^(?:'[^']+'|"[^"]+")$""") & (s["one"].isin(*direct) | ((s["one"] == "(") & s["two"].isin(*called) & (s["next"] == ")"))))
        # the word must be one of the code, not of a comment or of another literal
        return F.when(F.exists(words, lambda w: w.isin(*direct, *called)), F.transform(hit, lambda s: F.substring(s["x"], F.lit(2), F.length(s["x"]) - 2))).otherwise(none)
    if language == "python":
        several = F.transform(F.split(F.regexp_replace(F.trim(code), r"^import\s+", ""), ","), lambda x: F.regexp_extract(x, r"[\p{L}\p{N}_.]+", 0))
        return F.when((at(0) == "from") & F.array_contains(words, "import"), F.array(at(1))).when((at(0) == "import") & at(1).isNotNull(), several).otherwise(none)
    if language == "go":
        named = F.filter(parts, lambda x: x.rlike('^"[^"]+"$'))
        return F.when((at(0) == "import") | F.col("listed"), F.transform(named, lambda x: F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(none)
    if language == "rust":
        stated = F.trim(F.regexp_replace(code, r"^\s*pub(?:\s*\([^()]*\))?\s+", ""))
        rest = F.trim(F.substring_index(F.regexp_replace(stated, r"^use\s", ""), ";", 1))
        module = F.regexp_replace(stated, r"^mod\s+|\s*;.*$", "")
        path = F.regexp_extract(rest, r"^[\p{L}\p{N}_:]+", 0)
        return F.when(stated.rlike(r"^use\s"), F.array(path)).when(stated.rlike(r"^mod\s[^{]*;"), F.array(module)).otherwise(none)
    # swift: attributes go, then the kind of a single declaration
    words = F.regexp_extract_all(F.regexp_replace(code, r"@[\p{L}_]+", " "), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    second = F.get(words, F.lit(1))
    return F.when(F.get(words, F.lit(0)) == "import", F.array(F.when(second.isin(*_SWIFT_KINDS), F.get(words, F.lit(2))).otherwise(second))).otherwise(none)


def imports(lines_: DataFrame) -> DataFrame:
    """rel, spec and line of each import. In Go, what stands between the brackets of an import is one, too."""
    found = None
    for language in ("javascript/typescript", "python", "go", "rust", "swift", "style"):
        part = lines_.filter(F.col("language") == language)
        if language == "go":
            upto = Window.partitionBy("rel").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
            opens, closes = (F.coalesce(F.last(F.when(F.col("code").rlike(p), F.col("line_no")), ignorenulls=True).over(upto), F.lit(0)) for p in (r"^import\s*\(", r"^\s*\)"))
            part = part.withColumn("listed", opens > closes)
        specs = F.array_distinct(F.filter(F.array_compact(_specs(language, F.col("code"), F.col("text"))), lambda x: x != ""))
        rows = part.filter(F.trim("code") != "").select("rel", "language", F.col("line_no").alias("line"), F.explode(specs).alias("spec"))
        found = rows if found is None else found.unionByName(rows)
    return found


def references(lines_: DataFrame) -> DataFrame:
    """rel, name and first line of each identifier in code."""
    return lines_.select("rel", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"[\p{L}_$][\p{L}\p{N}_$]*"), F.lit(0)))).alias("name")).groupBy("rel", "name").agg(F.min("line_no").alias("line"))


_ROUTES = [
    ("javascript/typescript", r"\b(?:app|router|server|api)\.(get|post|put|patch|delete|options|head|all)\(\s*[\"'](/[^\"']*)[\"']\s*,\s*(?:[\w.]+\s*,\s*)*([A-Za-z_$][\w$]*)?", "router_call"),
    ("python", r"^\s*@\w+\.(get|post|put|patch|delete|options|head)\(\s*[\"'](/[^\"']*)[\"']\s*[,)]()", "decorator"),
    ("go", r"\.HandleFunc\(\s*()\"(/[^\"]*)\"\s*,\s*([A-Za-z_]\w*)", "handle_func"),
]


def routes(lines_: DataFrame) -> DataFrame:
    """method, path, file, handler, line and evidence of route declarations; a path put together at run time has none."""
    found = None
    for language, pattern, evidence in _ROUTES:
        g = lambda k: F.regexp_extract("text", pattern, k)  # noqa: E731, B023
        mounted = F.rlike(F.col("text"), F.lit(r"[\"']\s*\+|\+\s*[\"']|\.Methods\(\s*[A-Za-z_]\w*\s*\)"))
        method = F.upper(g(1)) if language != "go" else F.coalesce(F.nullif(F.regexp_extract("text", r"\.Methods\(\s*\"(\w+)\"", 1), F.lit("")), F.nullif(F.upper(F.regexp_extract("text", r"\.Methods\(\s*http\.Method(\w+)", 1)), F.lit("")), F.lit("ANY"))
        rows = lines_.filter((F.col("language") == language) & (F.trim("code") != "") & F.rlike(F.col("text"), F.lit(pattern)) & ~mounted).select(method.alias("method"), g(2).alias("path"), F.col("rel").alias("file"), F.nullif(g(3), F.lit("")).alias("handler"), F.col("line_no").alias("line"), F.lit(evidence).alias("evidence"))
        found = rows if found is None else found.unionByName(rows)
    # app/<path>/route.ts exports a function for each method
    nested = lines_.filter(F.col("rel").rlike(r"(^|/)app/(.*/)?route\.(ts|js)$"))
    method = r"^\s*export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("rel", r"(?:^|/)app/(?:(.*)/)?route\.(?:ts|js)$", 1), r"\([^/]*\)/", ""))
    files = nested.filter(F.col("code").rlike(method)).select(F.regexp_extract("code", method, 1).alias("method"), path.alias("path"), F.col("rel").alias("file"), F.regexp_extract("code", method, 1).alias("handler"), F.col("line_no").alias("line"), F.lit("file_route_convention").alias("evidence"))
    return found.unionByName(files)


_ENV = [r"process\.env\.([A-Z][A-Z0-9_]*)", r"import\.meta\.env\.([A-Z][A-Z0-9_]*)", r"os\.(?:getenv|environ\.get)\(\s*[\"']([A-Z][A-Z0-9_]*)[\"']", r"os\.environ\[\s*[\"']([A-Z][A-Z0-9_]*)[\"']", r"env::var\(\s*\"([A-Z][A-Z0-9_]*)\"", r"os\.Getenv\(\s*\"([A-Z][A-Z0-9_]*)\"", r"Deno\.env\.get\(\s*[\"']([A-Z][A-Z0-9_]*)[\"']"]


def env_reads(lines_: DataFrame) -> DataFrame:
    """name, rel and line of each environment variable that code reads by a constant name."""
    names = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(p), 1) for p in _ENV]))
    return lines_.filter(F.trim("code") != "").select("rel", F.col("line_no").alias("line"), F.explode(F.array_distinct(names)).alias("name"))


def topics(lines_: DataFrame) -> DataFrame:
    """rel, line and topic of each event topic that code states as a literal; a null topic is computed."""
    stated = lines_.filter(F.col("code").rlike(r"\btopic:\s*\S"))
    literal = F.regexp_extract("text", r"""\btopic:\s*["'`]([^"'`$]+)["'`]""", 1)
    computed = F.col("code").rlike(r"\btopic:\s*(?:[\w.]+\s*[(\[]|\w+\.|`)")
    return stated.filter((literal != "") | computed).select("rel", F.col("line_no").alias("line"), F.nullif(literal, F.lit("")).alias("topic"))


def env_declarations(lines_: DataFrame) -> DataFrame:
    """key, rel and line of the keys that .env files declare."""
    rows = lines_.filter("language = 'env'").select("rel", F.col("line_no").alias("line"), F.regexp_extract("text", r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1).alias("key"))
    return rows.filter("key <> ''")


def side_effects(lines_: DataFrame) -> DataFrame:
    """rel, line and kind of the first side effect that a line shows."""
    code, text = F.col("code"), F.col("text")
    kind = F.when(code.rlike(r"\b(fetch|axios|http\.(get|post|request)|requests\.(get|post|put|delete)|reqwest::|urllib|XMLHttpRequest|WebSocket)\b"), "network")
    kind = kind.when(code.rlike(r"\b(localStorage|sessionStorage|writeFile(Sync)?|fs\.write|File::create|os\.Create|os\.WriteFile)\b"), "storage")
    kind = kind.when(text.rlike(r"(?i)\b(insert\s+into|update\s+\w+\s+set|delete\s+from)\b") & code.rlike(r"\b(query|execute|exec|Exec|raw|sql)\b"), "db_write")
    return lines_.withColumn("kind", kind).filter("kind IS NOT NULL").select("rel", F.col("line_no").alias("line"), "kind")


def unknowns(lines_: DataFrame) -> DataFrame:
    """kind, path, line_start and reason of constructs that can't be followed statically."""
    code, text = F.col("code"), F.col("text")
    cases = [
        ("dynamic_import", code.rlike(r"\bimport\(\s*[^\"'\s)`]") | code.rlike(r"\bimport\([^)]*[+$]") | code.rlike(r"\bimportlib\.import_module\("), "the imported module is computed"),
        ("dynamic_require", code.rlike(r"\brequire\(\s*[^\"'\s)]"), "the required module is computed"),
        ("env_dynamic_lookup", code.rlike(r"process\.env\[\s*[A-Za-z_$]") | code.rlike(r"os\.(getenv|environ\.get)\(\s*[A-Za-z_]"), "the variable's name is computed"),
        ("route_string_concat", code.rlike(r"\b(app|router|server|api)\.(get|post|put|patch|delete)\(") & code.rlike(r"[\"'`]\s*\+|\+\s*[\"'`]") | text.rlike(r"\b(app|router)\.(get|post|put|patch|delete)\(\s*`[^`]*\$\{") | (code.rlike(r"^\s*@\w+\.(get|post|put|patch|delete)\(") & code.rlike(r"\+")), "the route's path is put together at run time"),
    ]
    kinds = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(r).alias("reason"))) for k, c, r in cases]))
    return lines_.select(F.col("rel").alias("path"), F.col("line_no").alias("line_start"), F.explode(kinds).alias("x")).select("x.kind", "path", "line_start", "x.reason")


def sql_tables(lines_: DataFrame) -> DataFrame:
    """rel, line and table of CREATE TABLE statements, with the field names of the statement's body."""
    bodies = lines_.filter("language = 'sql'").groupBy("rel").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "code"))), lambda x: x["code"]), "\n").alias("code"))
    created = bodies.select("rel", F.explode(F.regexp_extract_all("code", F.lit(r"(?is)(create\s+table\s+(?:if\s+not\s+exists\s+)?[\w.\"]+\s*\(.*?\)\s*;)"), 1)).alias("s"))
    name = F.regexp_extract("s", r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)", 1)
    body = F.regexp_extract("s", r"(?s)\((.*)\)\s*;", 1)
    fields = F.filter(F.transform(F.split(body, r",\s*\n|,(?![^(]*\))"), lambda x: F.lower(F.regexp_extract(x, r"^\s*\"?(\w+)\"?\s+\w", 1))), lambda x: (x != "") & ~x.isin("primary", "foreign", "unique", "constraint", "check", "key", "index"))
    return created.select("rel", F.concat(F.lit("table:"), F.lower(F.regexp_replace(name, '"', ""))).alias("table"), fields.alias("fields"))
