import pytest

from lattice.operators.delta import diff_lines
from lattice.operators.extract import code_of
from lattice.plans import lenses
from lattice.plans.fact_base import FactBase
from lattice.sources.repo_files import from_texts, read_tree

TREE = {
    "package.json": '{"name": "root", "workspaces": ["packages/*"]}',
    "tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"paths": {"@vault/*": ["services/vault/src/*"]}}\n}',
    "packages/app/package.json": '{"name": "@x/app", "dependencies": {"@x/clock": "1.0.0"}}',
    "packages/clock/package.json": '{"name": "@x/clock"}',
    "packages/clock/src/index.ts": 'export { tick } from "./internal";\n',
    "packages/clock/src/internal.ts": "export function tick() {\n  return 1;\n}\nfunction hidden() {}\n",
    "packages/app/src/main.ts": 'import { tick } from "@x/clock";\nimport { token } from "@vault/token";\n// import x from "./gone"\nconst s = "import y";\nexport const App = () => tick();\nimport("./" + s);\n',
    "packages/app/src/bad.ts": 'import { tick } from "../../clock/src/internal";\nimport z from "./missing";\n',
    "services/vault/src/token.ts": "export function token() {\n  return process.env.SECRET;\n}\nexport const v = process.env[name];\n",
    "services/vault/tests/token.test.ts": 'import { token } from "../src/token";\ntest("t", () => token());\n',
    "services/vault/.env.example": "SECRET=x\nOTHER=y\n",
    "services/api/server.ts": 'app.get("/users/:id", userHandler);\napp.post("/x" + y, h);\nfetch("/z");\nconst q = db.query("INSERT INTO parcels VALUES (1)");\n',
    "py/app/main.py": 'import os\nfrom .util import helper\n\n@app.post("/vault/open")\ndef login():\n    """doc # no"""\n    return os.getenv("HOME_DIR")\n\nclass A:\n    def method(self):\n        pass\n',
    "py/app/util.py": "def helper():\n    return 1\n",
    "go/go.mod": "module example.org/svc\n",
    "go/main.go": 'package main\n\nimport (\n\t"example.org/svc/api"\n)\n\nfunc main() { api.Run() }\n',
    "go/api/routes.go": 'package api\n\nfunc Run() {\n\tr.HandleFunc("/health", health).Methods("GET")\n\tr.HandleFunc("/v", v).Methods(method)\n}\n\ntype Server struct {\n}\n',
    "rust/Cargo.toml": '[package]\nname = "one"\n[dependencies]\ntwo = { path = "../two" }\n',
    "two/Cargo.toml": '[package]\nname = "two"\n',
    "rust/src/lib.rs": "mod inner;\npub use crate::inner::Thing;\n/* pub fn no() {} */\npub fn yes() {}\nimpl Thing {\n}\n",
    "rust/src/inner.rs": "pub struct Thing;\n",
    "db/migrations/0007_parcels.sql": "CREATE TABLE parcels (\n  id INT PRIMARY KEY,\n  label TEXT,\n  weight TEXT\n);\n",
    "app/api/login/route.ts": "export async function POST() {}\n",
    "node_modules/x/index.js": "export const n = 1;\n",
    "image.bin": "x",
    "locked.py": None,
}


@pytest.fixture(scope="module")
def facts(spark):
    return FactBase(from_texts(spark, TREE))


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_scan_leaves_out_and_counts(facts):
    stats = {r["reason"]: (r["count"], r["hidden"]) for r in facts.scan_stats.collect()}
    assert stats["ignored_dir"] == (1, 0) and stats["binary_extension"] == (1, 0)
    assert stats["unreadable"][0] == 1


def test_languages_roles_kinds(facts):
    got = {r["rel"]: r for r in facts.files.collect()}
    assert got["services/vault/tests/token.test.ts"]["kind"] == "test"
    assert "public_boundary" in got["packages/clock/src/index.ts"]["roles"]
    assert got["db/migrations/0007_parcels.sql"]["kind"] == "migration"
    assert got["services/vault/.env.example"]["language"] == "env"
    assert got["packages/app/package.json"]["domain"] == "packages/app"
    assert got["locked.py"]["content_hash"] is None


def test_symbols(facts):
    got = {(r["rel"], r["name"]): (r["kind"], r["exported"], r["line_start"], r["line_end"]) for r in facts.symbols.collect()}
    assert got["packages/clock/src/internal.ts", "tick"] == ("function", True, 1, 3)
    assert got["packages/app/src/main.ts", "App"][:2] == ("component", True)
    assert got["py/app/main.py", "method"][:1] == ("function",) and got["py/app/main.py", "A"][2] == 9
    assert got["go/api/routes.go", "Server"][:2] == ("struct", True)
    assert got["rust/src/lib.rs", "yes"][:2] == ("function", True) and ("rust/src/lib.rs", "no") not in got


def test_imports_resolve(facts):
    got = {(r["rel"], r["spec"]): r["target"] for r in facts.imports.collect()}
    assert got["packages/clock/src/index.ts", "./internal"] == "packages/clock/src/internal.ts"
    assert got["packages/app/src/main.ts", "@x/clock"] == "packages/clock/src/index.ts"
    assert got["packages/app/src/main.ts", "@vault/token"] == "services/vault/src/token.ts"
    assert ("packages/app/src/main.ts", "./gone") not in got
    assert got["py/app/main.py", ".util"] == "py/app/util.py" and got["py/app/main.py", "os"] is None
    assert got["go/main.go", "example.org/svc/api"] == "go/api/routes.go"
    assert got["rust/src/lib.rs", "inner"] == "rust/src/inner.rs" and got["rust/src/lib.rs", "crate::inner::Thing"] == "rust/src/inner.rs"
    assert rows(facts.unresolved, "rel", "spec") == [("packages/app/src/bad.ts", "./missing")]


def test_packages(facts):
    assert rows(facts.package_edges, "from", "to", "kind") == [("packages/app", "packages/clock", "dependencies"), ("rust", "two", "path")]


def test_runtime_facts(facts):
    assert {tuple(r) for r in facts.routes.select("method", "path", "handler").collect()} == {("GET", "/users/:id", "userHandler"), ("POST", "/vault/open", None), ("GET", "/health", "health"), ("POST", "/api/login", "POST")}
    assert {(r["name"], r["declaration"]) for r in facts.env.collect()} == {("SECRET", "services/vault/.env.example"), ("HOME_DIR", None)}
    kinds = {(r["kind"], r["path"]) for r in facts.unknowns.collect()}
    assert {("env_dynamic_lookup", "services/vault/src/token.ts"), ("route_string_concat", "services/api/server.ts"), ("unread_body", "locked.py"), ("dynamic_import", "packages/app/src/main.ts")} <= kinds
    assert rows(facts.tables, "table", "fields") == [("table:parcels", ["id", "label", "weight"])]
    assert {"network", "db_write"} <= {r["kind"] for r in facts.side_effects.filter("rel = 'services/api/server.ts'").collect()}


def test_tests_and_proof(spark, facts):
    assert rows(facts.tests.filter("rel = 'services/vault/src/token.ts'"), "test", "score", "evidence") == [("services/vault/tests/token.test.ts", 80, "test_import")]
    paths = spark.createDataFrame([("services/vault/src/token.ts",), ("py/app/util.py",)], "path string")
    assert rows(lenses.proof(facts, paths), "rel", "class") == [("py/app/util.py", "missing"), ("services/vault/src/token.ts", "runnable")]


def test_lenses(spark, facts):
    assert rows(lenses.where(facts, "tick"), "rel", "position", "hidden") == [("packages/clock/src/internal.ts", 1, 0)]
    assert rows(lenses.cone(facts, "packages/app/src/main.ts", 2), "dst", "depth", "strength") == [("packages/clock/src/index.ts", 0, "high"), ("packages/clock/src/internal.ts", 1, "medium"), ("services/vault/src/token.ts", 0, "high")]
    assert rows(lenses.consumers(facts, "packages/clock/src/internal.ts", 2), "rel", "depth") == [("packages/app/src/bad.ts", 1), ("packages/app/src/main.ts", 2), ("packages/clock/src/index.ts", 1)]
    rules = spark.createDataFrame([("packages/app/src/**", "packages/clock/src/internal.ts", "use the barrel", "hard")], "from_glob string, to_glob string, reason string, status string")
    assert rows(lenses.boundaries(facts, rules), "src") == [("packages/app/src/bad.ts",)]
    assert ("packages/app/src/main.ts", "packages/clock/src/index.ts", False) in rows(lenses.boundary_map(facts), "src", "dst", "is_test")
    levels = {r["rel"]: r["level"] for r in lenses.impact(facts, spark.createDataFrame([("packages/clock/src/internal.ts",), ("db/migrations/0007_parcels.sql",)], "path string")).collect()}
    assert levels == {"packages/clock/src/internal.ts": "high", "db/migrations/0007_parcels.sql": "critical"}
    assert rows(lenses.delete(facts, "services/vault/src/token.ts"), "group", "from") == [("consumers", "packages/app/src/main.ts"), ("consumers", "services/vault/tests/token.test.ts"), ("tests", "services/vault/src/token.ts")]
    assert rows(lenses.contract(facts, "table:parcels"), "from", "type") == [("db/migrations/0007_parcels.sql", "declares_table"), ("services/api/server.ts", "reads_table")]
    assert [r["what"] for r in lenses.flow(facts, "GET", "/users/:id").orderBy("step").collect()][0] == "GET /users/:id"
    assert ("rust", True, 3) in rows(lenses.ls(facts), "entry", "is_dir", "files")
    assert rows(lenses.siblings(facts, "services/vault"), "kind", "count") == [("env_config", 1)]
    assert {r["language"]: r["closure"] for r in lenses.coverage(facts).collect()}["python"] == "open"
    assert lenses.graph(facts).count() > 0 and lenses.status(facts).count() == 7 and lenses.runtime(facts).count() > 0
    assert lenses.directory_edges(facts).count() > 0 and lenses.package_paths(facts).count() == 2


def test_changes(spark, facts):
    tree = dict(TREE)
    tree["packages/clock/src/internal.ts"] = "export function tick() {\n  const two = 2;\n  return 1;\n}\nfunction hidden() {}\n"
    tree["py/app/helpers.py"] = tree.pop("py/app/util.py")
    tree["new.py"] = "x = 1\n"
    del tree["go/main.go"]
    after = FactBase(from_texts(spark, tree))
    got = {tuple(r) for r in lenses.changed(facts, after).collect()}
    assert got == {("packages/clock/src/internal.ts", "modified", None), ("py/app/helpers.py", "renamed", "py/app/util.py"), ("new.py", "added", None), ("go/main.go", "removed", None)}
    assert rows(lenses.changed_symbols(facts, after).filter("name = 'tick'"), "name", "added_lines") == [("tick", 1)]


def test_lexer_keeps_places():
    for language, text in {"rust": "a /* x /* y */ z */ b // c\n\"s\\\"t\" d", "python": "x = '''a\n# b\n''' # c\ny", "javascript/typescript": "a `t ${x}\nq` 'u' // v\n'open\nnext"}.items():
        code = code_of(text, language)
        assert [len(x) for x in code] == [len(x) for x in text.split("\n")]
    assert code_of("a /* x /* y */ z */ b", "rust")[0].split() == ["a", "b"]
    assert code_of("x = 1  # import y", "python")[0].strip() == "x = 1"


def test_diff_lines():
    assert diff_lines(["a", "b", "c"], ["a", "x", "c", "d"]) == [("removed", 2, "b"), ("added", 2, "x"), ("added", 4, "d")]
    assert diff_lines([], ["a"]) == [("added", 1, "a")] and diff_lines(["a"], ["a"]) == []


def test_read_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "m.py").write_text("import os\n")
    assert rows(read_tree(spark, str(tmp_path)), "rel", "size") == [("a/b/m.py", 10)]


def test_nothing(spark):
    empty = FactBase(from_texts(spark, {"a.py": ""}))
    assert empty.imports.count() == 0 and empty.symbols.count() == 0 and empty.edges.count() == 0


def test_declarations_and_imports_of_single_lines(spark):
    from lattice.operators import extract

    declared = [
        ("javascript/typescript", "export default async function* walk() {", ("walk", "function", True)),
        ("javascript/typescript", "  const { a, b } = c;", None),
        ("javascript/typescript", "abstract class Über extends Base {", ("Über", "class", False)),
        ("rust", "pub(crate) const fn size() -> usize {", ("size", "function", True)),
        ("rust", "impl<'a, T: Into<X>> Shape for Circle<T> where T: Y {", ("Shape for Circle<T>", "impl", False)),
        ("go", "func (s *Server) Serve() {", ("Serve", "method", True)),
        ("go", "type pair[K any] struct {", ("pair", "struct", False)),
        ("swift", "  @objc public static func run() {", ("run", "function", True)),
        ("swift", "  class func make() {", ("make", "function", False)),
        ("python", "    async def go(self):", ("go", "function", False)),
        ("python", "default = 3", None),
    ]
    lines = [(str(i), language, 1, code, code) for i, (language, code, _) in enumerate(declared)]
    df = spark.createDataFrame(lines, "rel string, language string, line_no int, code string, text string")
    got = {int(r["rel"]): (r["name"], r["kind"], r["exported"]) for r in extract.symbols(df).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(declared) if want}
    imported = [
        ("javascript/typescript", ["import {", "  a,", "} from './x';", "// from './no'", "const y = require(\"y\"), z = import('z');", "import('./' + z);"], ["./x", "y", "z"]),
        ("python", ["import os.path as p, sys", "from .. import up", "x = 'import no'"], ["os.path", "sys", ".."]),
        ("go", ['import f "fmt"', "import (", '  x "a/b"', ")", 'var s = "no"'], ["fmt", "a/b"]),
        ("rust", ["pub use crate::a::{b, c};", "mod d;", "mod e {"], ["crate::a::", "d"]),
        ("swift", ["@testable import struct Kit.Thing", "let x = 1"], ["Kit"]),
        ("style", ['@import url("a.css");', "@import 'b.css';"], ["a.css", "b.css"]),
    ]
    lines = [(language, language, k, extract.code_of("\n".join(body), language)[k - 1], body[k - 1]) for language, body, _ in imported for k in range(1, len(body) + 1)]
    df = spark.createDataFrame(lines, "rel string, language string, line_no int, code string, text string")
    got = {}
    for r in extract.imports(df).orderBy("line").collect():
        got.setdefault(r["rel"], []).append(r["spec"])
    assert {k: sorted(v) for k, v in got.items()} == {language: sorted(want) for language, _, want in imported}
