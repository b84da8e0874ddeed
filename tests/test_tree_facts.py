"""Names through barrels, aliases along chains of configurations, lineage and workflows of small trees."""

import random

import pytest
from pyspark.sql import functions as F

from lattice.operators import inherit
from lattice.plans import lenses
from lattice.plans.fact_base import FactBase
from lattice.sources.repo_files import from_texts

CORE = "function measure(x) {\n  return x;\n}\nexport class Gauge {}\nexport { measure };\nexport { measure as gaugeOf };\nexport default function Main() {}\n"
NAMES = {
    "src/core.ts": CORE,
    "src/other.ts": "export const measure = 2;\nexport const solo = 3;\n",
    "src/star.ts": "export * from './core';\n",
    "src/deep.ts": "export * from './star';\n",
    "src/named.ts": "export { measure as publicMeasure } from './core';\n",
    "src/again.ts": "export { publicMeasure } from './named';\n",
    "src/both.ts": "export * from './core';\nexport * from './other';\n",
    "src/twice.ts": "export * from './star';\nexport * from './deep';\n",
    "src/own.ts": "export * from './core';\nexport const measure = 9;\n",
    "src/picked.ts": "export * from './core';\nexport { solo as measure } from './other';\n",
    "src/noted.ts": "// export { solo } from './other';\nexport { /* measure, */ solo as Gauge } from './other' // tail\n",
    "src/text.ts": "function inner() {}\nconst s = \"export { inner }\";\nconst t = /export { inner as gone }/;\n",
    "src/textstar.ts": "export * from './text';\n",
    "src/gap.ts": "function localOne() {}\nexport { localOne as shared } /* gap */ from './other';\n",
    "src/left.ts": "export * from './right';\n",
    "src/right.ts": "export * from './left';\n",
    "src/maindefault.ts": "export { default as Main } from './core';\n",
    "src/types.ts": "export type { Gauge } from './core';\n",
    "src/uses.ts": "import { measure as m } from './deep';\nimport { publicMeasure } from './again';\nimport { gaugeOf } from './star';\nimport { measure as n } from './core';\nimport Main from './core';\nimport { Main as M2 } from './maindefault';\n",
    "src/wrong.ts": "import { measure } from './both';\nimport { measure as a } from './twice';\nimport { measure as b } from './left';\nimport { Main } from './star';\nimport { inner } from './textstar';\nimport { Gauge } from './types';\nimport { shared } from './gap';\n",
    "src/right2.ts": "import { measure } from './picked';\nimport { Gauge } from './noted';\nimport { measure as o } from './own';\n",
}


@pytest.fixture(scope="module")
def named(spark):
    return FactBase(from_texts(spark, NAMES))


def test_public_names(named):
    got = {(r["rel"], r["local"]): (r["owner"], r["symbol"], r["evidence"].split("_")[0]) for r in named.symbol_consumers.collect()}
    assert got == {
        ("src/uses.ts", "m"): ("src/core.ts", "measure", "reexported"), ("src/uses.ts", "publicMeasure"): ("src/core.ts", "measure", "reexported"), ("src/uses.ts", "gaugeOf"): ("src/core.ts", "measure", "reexported"),
        ("src/uses.ts", "n"): ("src/core.ts", "measure", "imported"), ("src/uses.ts", "Main"): ("src/core.ts", "Main", "imported"), ("src/uses.ts", "M2"): ("src/core.ts", "Main", "reexported"),
        ("src/right2.ts", "measure"): ("src/other.ts", "solo", "reexported"), ("src/right2.ts", "Gauge"): ("src/other.ts", "solo", "reexported"), ("src/right2.ts", "o"): ("src/own.ts", "measure", "imported"),
    }
    status = {(r["file"], r["name"]): r["status"] for r in named.public_names.collect()}
    assert status["src/both.ts", "measure"] == status["src/twice.ts", "measure"] == "ambiguous" and status["src/both.ts", "solo"] == "one"
    assert ("src/star.ts", "default") not in status and ("src/types.ts", "Gauge") not in status


def by_hand(rows):
    table = {n: (p, s) for n, p, s in rows}
    out = {}
    for n in table:
        seen, at, settings = [], n, {}
        while at in table and at not in seen:
            seen.append(at)
            settings = {**(table[at][1] or {}), **settings}
            at = table[at][0]
        out[n] = (settings, None if at in seen else len(seen) - 1, at in seen)
    return out


def test_inherited(spark):
    rng = random.Random(2)
    rows = [(f"n{i}", f"n{rng.randint(0, i - 1)}" if i else None, {f"k{rng.randint(0, 5)}": str(i)}) for i in range(60)]
    rows += [(f"c{i}", f"c{(i + 1) % 5}", {f"k{i}": "c"}) for i in range(5)] + [("behind", "c0", {"k0": "b"}), ("self", "self", {"a": "1"}), ("gone", "nowhere", None), ("bare", "n3", None)]
    rows += [(f"l{i}", f"l{i - 1}" if i else None, {f"k{i % 3}": str(i)}) for i in range(100)]
    got = {r["node"]: (r["settings"], r["length"], r["cyclic"]) for r in inherit.inherited(spark.createDataFrame(rows, "node string, parent string, settings map<string,string>")).collect()}
    want = by_hand(rows)
    assert {n: v for n, v in got.items() if not v[2]} == {n: v for n, v in want.items() if not v[2]}
    assert {n for n, v in got.items() if v[2]} == {n for n, v in want.items() if v[2]} == {"c0", "c1", "c2", "c3", "c4", "behind", "self"}
    assert got["behind"][0]["k0"] == "b" and got["c3"][0] == {f"k{i}": "c" for i in range(5)}
    assert inherit.inherited(spark.createDataFrame([], "node string, parent string, settings map<string,string>")).count() == 0


def test_comments_of_json(spark):
    text = '{ // note\n "url": "http://x/*y*/", /* a\n b */ "l": [1, 2, ], "q": "a\\"//b",\n}'
    got = spark.createDataFrame([(text,)], "t string").select(inherit.plain_json(F.col("t")).alias("t")).first()["t"]
    assert __import__("json").loads(got) == {"url": "http://x/*y*/", "l": [1, 2], "q": 'a"//b'}


def test_aliases_along_extends(spark):
    facts = FactBase(
        from_texts(
            spark,
            {
                "config/base.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"@lib/*": ["lib/*", "fallback/*"], "@lib/deep/*": ["deep/*"], "exact": ["lib/exact.ts"]}}}',
                "tsconfig.base.json": '{"extends": "./config/base"} // middle\n'.replace("./config/base", "./config/base.json"),
                "config/tsconfig.shared.json": '{"compilerOptions": {"baseUrl": "..", "paths": {"@lib/*": ["lib/*", "fallback/*"], "@lib/deep/*": ["deep/*"], "exact": ["lib/exact.ts"],}}}',
                "app/tsconfig.json": '{\n  // shared\n  "extends": "../config/tsconfig.shared"\n}',
                "near/tsconfig.json": '{"extends": "../config/tsconfig.shared.json", "compilerOptions": {"paths": {"@lib/*": ["near/own/*"]}}}',
                "loop/tsconfig.json": '{"extends": "./tsconfig.other.json"}',
                "loop/tsconfig.other.json": '{"extends": "./tsconfig.json"}',
                "pkg/package.json": '{"name": "@lib/a"}',
                "pkg/src/index.ts": "export const p = 1;\n",
                "lib/a.ts": "export const a = 1;\n",
                "lib/deep/x.ts": "export const no = 1;\n",
                "deep/x.ts": "export const x = 1;\n",
                "fallback/b.ts": "export const b = 1;\n",
                "lib/exact.ts": "export const e = 1;\n",
                "near/own/a.ts": "export const o = 1;\n",
                "app/main.ts": 'import "@lib/a";\nimport "@lib/b";\nimport "@lib/deep/x";\nimport "exact";\nimport "exact/more";\n',
                "near/main.ts": 'import "@lib/a";\n',
                "outside.ts": 'import "@lib/a";\n',
            },
        )
    )
    got = {(r["rel"], r["spec"]): r["target"] for r in facts.imports.collect()}
    assert got == {
        ("app/main.ts", "@lib/a"): "lib/a.ts", ("app/main.ts", "@lib/b"): "fallback/b.ts", ("app/main.ts", "@lib/deep/x"): "deep/x.ts", ("app/main.ts", "exact"): "lib/exact.ts", ("app/main.ts", "exact/more"): None,
        ("near/main.ts", "@lib/a"): "near/own/a.ts", ("outside.ts", "@lib/a"): "pkg/src/index.ts",
    }
    assert {r["node"] for r in facts.ts_configs.filter("cyclic").collect()} == {"loop/tsconfig.json", "loop/tsconfig.other.json"}


def test_lineage_and_workflows(spark):
    facts = FactBase(
        from_texts(
            spark,
            {
                "lib/store.ts": "export function save() {}\n",
                "lib/index.ts": "export { save } from './store';\n",
                "web/send.ts": 'import { save } from "../lib/index";\nexport const send = () => save({ topic: "parcel.sent", by: process.env.DEPOT });\nconst t = { topic: nameOf() };\n',
                "web/.env.example": "DEPOT=x\n",
                "web/page.ts": "import { send } from './send';\nexport const page = () => send();\n",
                "web/tests/page.test.ts": "import { page } from '../page';\ntest('p', () => page());\n",
                "package.json": '{"name": "r", "scripts": {"deploy": "node tools/ship.mjs", "test": "vitest"}}',
                "Makefile": "smoke:\n\techo ok\n",
                "tools/ship.mjs": "run();\n",
                ".github/workflows/go.yml": "jobs:\n  a:\n    steps:\n      - run: npm run deploy\n      - run: npm test && make smoke\n      - run: gh workflow run other.yml -f x=$Y\n      - run: node tools/ship.mjs --now\n",
                ".github/workflows/other.yml": "jobs:\n  b:\n    steps: []\n",
            },
        )
    )
    got = {tuple(r)[1:4] for r in lenses.lineage(facts, spark.createDataFrame([("s", "lib/store.ts")], "seed string, node string")).select("seed", "from", "to", "type").collect()}
    assert got == {
        ("lib/index.ts", "lib/store.ts", "consumes"), ("web/send.ts", "lib/index.ts", "consumes"), ("web/page.ts", "web/send.ts", "consumes"),
        ("web/send.ts", "topic:parcel.sent", "emits"), ("web/send.ts", "config:DEPOT", "reads_config"), ("web/tests/page.test.ts", "web/page.ts", "verifies_directly"),
    }
    edges = {(r["from"][-4:], r["to"]) for r in facts.execution_edges.filter("type IN ('invokes_target', 'invokes_script', 'dispatches_workflow')").collect()}
    assert edges == {("0001", "package.json#deploy"), ("0002", "package.json#test"), ("0002", "Makefile#make smoke"), ("0003", ".github/workflows/other.yml"), ("0004", "tools/ship.mjs")}
