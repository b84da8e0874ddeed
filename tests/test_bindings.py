"""Names that files import and export, and what a public name means."""

import pytest

from lattice.operators import bindings as B
from lattice.operators import names

JS = "javascript/typescript"


def read(language, text):
    return [tuple(x) for x in ((form, spec, name, local) for _, form, spec, name, local in B._READERS[language]("\n".join(B.code_of(text, language)), text))]


def test_javascript():
    text = """import a, { b, c as d, type T, default as e } from './x';
import * as ns from "y"; import './side'; import type { U } from './types'; import type V from './v';
import type from './t';
// import { no } from './comment'
const s = "import { no } from './string'", lazy = import('./lazy'), more = import(name);
export { one, two as deux } from './z' // tail
export {
  many, /* gone */ lines as several,
} /* gap */ from './w'
export * from './star'; export * as all from './whole'; export type { W } from './types'; export type X = string;
export { local, other as default };
export async function fetchAll() {} export const K = 1; export default class Widget extends Base {}
const re = /export { fake as re } from '.\\/no'/; const q = a / b; export { q };
foo.import('./no'); import.meta.env;
"""
    assert read(JS, text) == [
        ("import", "./x", "default", "a"), ("import", "./x", "b", "b"), ("import", "./x", "c", "d"), ("type", "./x", "T", "T"), ("import", "./x", "default", "e"),
        ("namespace", "y", "*", "ns"), ("side_effect", "./side", None, None), ("type", "./types", "U", "U"), ("type", "./v", "default", "V"),
        ("import", "./t", "default", "type"), ("dynamic", "./lazy", None, None), ("dynamic", None, None, None),
        ("reexport", "./z", "one", "one"), ("reexport", "./z", "two", "deux"), ("reexport", "./w", "many", "many"), ("reexport", "./w", "lines", "several"),
        ("star", "./star", None, None), ("reexport", "./whole", "*", "all"), ("type", "./types", "W", "W"),
        ("export", None, "local", "local"), ("default", None, "other", "default"),
        ("export", None, "fetchAll", "fetchAll"), ("export", None, "K", "K"), ("default", None, "Widget", "default"), ("export", None, "q", "q"),
    ]
    assert read(JS, "export default function () {}\n") == [("default", None, None, "default")]
    assert read(JS, "export default compute(1)\n") == [("default", None, None, "default")]
    assert read(JS, "export default Thing;\nexport { a } from\n") == [("default", None, "Thing", "default"), ("export", None, "a", "a")]


def test_rust():
    text = """use std::collections::{BTreeMap, HashMap as Map};
pub use crate::model::{self, inner::{Deep, other::*}, Shape};
pub(crate) use super::thing as renamed;
use one::*; mod child; pub mod open_one;
// use commented::out;
"""
    assert read("rust", text) == [
        ("import", "std::collections::BTreeMap", "BTreeMap", "BTreeMap"), ("import", "std::collections::HashMap", "HashMap", "Map"),
        ("reexport", "crate::model", "model", "model"), ("reexport", "crate::model::inner::Deep", "Deep", "Deep"), ("star", "crate::model::inner::other", "*", None), ("reexport", "crate::model::Shape", "Shape", "Shape"),
        ("reexport", "super::thing", "thing", "renamed"), ("import", "one", "*", None), ("namespace", "child", "*", "child"), ("namespace", "open_one", "*", "open_one"),
    ]


def test_python_and_go():
    assert read("python", "import os.path, sys as system\nfrom . import x, y as z\nfrom ..a.b import (\n    c,  # note\n    d as e,\n)\nfrom m import *\ns = 'import no'\n") == [
        ("namespace", "os.path", "*", "os"), ("namespace", "sys", "*", "system"), ("import", ".", "x", "x"), ("import", ".", "y", "z"), ("import", "..a.b", "c", "c"), ("import", "..a.b", "d", "e"), ("import", "m", "*", None),
    ]
    assert read("go", 'package m\nimport "fmt"\nimport alias "x.org/y"\nimport (\n\t"net/http"\n\t_ "x.org/driver"\n\t. "x.org/dot"\n)\n') == [
        ("namespace", "fmt", "*", "fmt"), ("namespace", "x.org/y", "*", "alias"), ("namespace", "net/http", "*", "http"), ("side_effect", "x.org/driver", "*", None), ("namespace", "x.org/dot", "*", None),
    ]


def means(spark, exports, reexports=(), stars=(), **settings):
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    got = names.public_names(made(exports, "file string, name string, symbol string"), made(reexports, "file string, name string, source string, source_name string"), made(stars, "file string, source string"), **settings)
    return {(r["file"], r["name"]): (r["owner"], r["symbol"], r["hops"]) if r["status"] == "one" else "ambiguous" for r in got.collect()}


def test_stars_aliases_and_chains(spark):
    got = means(
        spark,
        [("core", "pick", "pick"), ("core", "default", "Main"), ("core", "shown", "hidden")],
        [("alias", "publicPick", "core", "pick"), ("alias2", "publicPick", "alias", "publicPick"), ("named", "Main", "core", "default"), ("space", "all", "core", "*")],
        [("mid", "core"), ("index", "mid"), ("index", "mid"), ("over", "alias2")],
    )
    core = {"pick": ("core", "pick"), "shown": ("core", "hidden")}
    want = {("core", n): (*x, 0) for n, x in core.items()} | {("core", "default"): ("core", "Main", 0)}
    want |= {(f, n): (*x, h) for f, h in (("mid", 1), ("index", 2)) for n, x in core.items()}
    want |= {("alias", "publicPick"): ("core", "pick", 1), ("alias2", "publicPick"): ("core", "pick", 2), ("over", "publicPick"): ("core", "pick", 3), ("named", "Main"): ("core", "Main", 1), ("space", "all"): ("core", "*", 1)}
    assert got == want


def test_rejects(spark):
    got = means(
        spark,
        [("a", "x", "x"), ("b", "x", "x"), ("own", "x", "x"), ("dangling", "x", None), ("twice", "x", "x"), ("twice", "x", "y"), ("core", "x", "x")],
        [("explicit", "x", "b", "x"), ("outside", "x", None, "x"), ("clash", "x", "a", "x"), ("clash", "x", "b", "x"), ("loop1", "z", "loop2", "z"), ("loop2", "z", "loop1", "z")],
        [("both", "a"), ("both", "b"), ("own", "a"), ("explicit", "a"), ("dangling", "a"), ("outside", "a"), ("above", "both"), ("left", "core"), ("right", "core"), ("dup", "left"), ("dup", "right"), ("c1", "c2"), ("c2", "c1")],
    )
    assert got[("both", "x")] == got[("above", "x")] == got[("twice", "x")] == got[("clash", "x")] == got[("dup", "x")] == "ambiguous"
    assert got[("own", "x")] == ("own", "x", 0) and got[("explicit", "x")] == ("b", "x", 1)
    # what leads nowhere still hides the star; cycles bring nothing
    assert not {("dangling", "x"), ("outside", "x"), ("c1", "x"), ("c2", "x"), ("loop1", "z"), ("loop2", "z")} & set(got)


def test_cycles_with_a_way_in(spark):
    got = means(spark, [("core", "x", "x")], [], [("p", "q"), ("q", "p"), ("q", "core"), ("s", "s"), ("r3", "r2"), ("r2", "r1"), ("r1", "r3"), ("r1", "core")])
    assert got == {("core", "x"): ("core", "x", 0), ("q", "x"): ("core", "x", 1), ("p", "x"): ("core", "x", 2), ("r1", "x"): ("core", "x", 1), ("r2", "x"): ("core", "x", 2), ("r3", "x"): ("core", "x", 3)}


def test_empty_and_too_long(spark):
    assert means(spark, []) == {}
    with pytest.raises(RuntimeError):
        means(spark, [("f0", "x", "x")], [], [(f"f{i + 1}", f"f{i}") for i in range(6)], rounds=3)


def test_bodies_are_scanned_in_bounded_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(B, "_PACKED_ROWS", 5)
    text = "// first\n" + "".join(f"export * from './m{i}';\n" for i in range(4))
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}.ts" for i in range(6)]), pa.array([JS] * 6), pa.array([text] * 6)], names=["rel", "language", "text"])
    got = list(B.scan_batches([batch]))
    assert max(b.num_rows for b in got) == 8 and sum(b.num_rows for b in got) == 24
    assert got[0].to_pydict()["line"] == [2, 3, 4, 5] * 2


def test_a_name_that_comes_again_by_a_longer_way(spark):
    # a has x by one step and by three, b has it by way of a, which changes after b has seen it
    exports = spark.createDataFrame([("o", "x", "x"), ("p", "x", "x")], "file string, name string, symbol string")
    stars = spark.createDataFrame([("a", "o"), ("m", "p"), ("n", "m"), ("a", "n"), ("b", "a")], "file string, source string")
    none = spark.createDataFrame([], "file string, name string, source string, source_name string")
    got = sorted(tuple(r)[:4] + (r["hops"],) for r in names.public_names(exports, none, stars).collect())
    assert got == [("a", "x", "ambiguous", None, None), ("b", "x", "ambiguous", None, None), ("m", "x", "one", "p", 1), ("n", "x", "one", "p", 2), ("o", "x", "one", "o", 0), ("p", "x", "one", "p", 0)]


def test_normalized_paths(spark):
    import posixpath
    import random

    from pyspark.sql import functions as F

    from lattice.functions.text import normalized_path

    rng = random.Random(2)
    paths = ["/".join(rng.choice(["a", "b.ts", "..", ".", "", "..c", "d..", "...", "x\\y", "a"]) for _ in range(rng.randint(1, 7))) for _ in range(3000)] + ["", "./", "..", "supplier/../part/p1.ts", "././a"]
    want = [posixpath.normpath("/" + p.replace("\\", "/")).strip("/") or "." for p in paths]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string").select("i", normalized_path(F.col("p")).alias("n"))
    got = dict(map(tuple, frame.collect()))
    assert [got[i] for i in range(len(paths))] == want


def test_statements_of_barrels_and_plain_literals():
    assert read(JS, "export*from'./a';export * from './b'\nexport *\n  from \"./c\"; export * fromage './no'; import * from './no'; export * as d from './d'; exports * from './no'\nexport * from `./e`; x.export * from './no'") == [
        ("star", "./a", None, None), ("star", "./b", None, None), ("star", "./c", None, None), ("reexport", "./d", "*", "d"), ("star", "./e", None, None),
    ]
    assert B.code_of("a = 'b' + \"c'd\"; // 'e\n\n\n/'f\"/.x; g / h / 'i\\'j'\n`k\nl` 'm", JS) == ["a = ' ' + \"   \";      ", "", "", "/   /.x; g / h / '    '", "` ", " ` ' "]


def test_rounds_and_lines_are_read_at_once(spark, monkeypatch):
    import pyarrow as pa

    from lattice.operators import extract

    # small files share a batch, and files of many lines don't pile up
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(7)]), pa.array([JS] * 6 + [None]), pa.array(["const a = 1\n", None, "", "x\ny", "'z'", "// w", "q"])], names=["rel", "language", "text"])
    [got] = extract.lexed_batches([batch])
    assert [tuple(r.values()) for r in got.to_pylist()] == [("f0", JS, 1, "const a = 1", "const a = 1"), ("f0", JS, 2, "", ""), ("f2", JS, 1, "", ""), ("f3", JS, 1, "x", "x"), ("f3", JS, 2, "y", "y"), ("f4", JS, 1, "'z'", "' '"), ("f5", JS, 1, "// w", "    "), ("f6", None, 1, "q", "q")]
    monkeypatch.setattr(extract, "_PACKED_LINES", 2)
    assert [b.num_rows for b in extract.lexed_batches([batch])] == [2, 3, 2, 1]
    # a line's words are written out once for each language
    rows = spark.createDataFrame([("f", JS, 1, "export const a = 1", "export const a = 1")], "rel string, language string, line_no int, text string, code string")
    plan = extract.declared_names(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 5 and extract.declared_names(rows).collect() == [("f", "a")]


def test_an_explicit_name_keeps_what_it_is_taken_from(spark):
    # stars and an alias bring the same name in one round; two stars bring another one, of which a third comes a round later
    got = means(spark, [("a", "x", "x"), ("b", "x", "x"), ("b", "y", "y"), ("c", "y", "y")], [("top", "x", "a", "x")], [("top", "b"), ("top", "c"), ("m", "c"), ("late", "m"), ("late", "b"), ("over", "late")])
    assert got[("top", "x")] == ("a", "x", 1) and got[("top", "y")] == "ambiguous" and got[("m", "y")] == ("c", "y", 1)
    assert got[("late", "x")] == ("b", "x", 1) and got[("late", "y")] == got[("over", "y")] == "ambiguous"
