"""Budgeted walks, levels, workflows, brackets, scopes and tries on small cases, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lattice.operators import brackets, extract, joins, traverse, tries, walks, workflow


def walk_by_hand(edges, seed, nodes, depth):
    out, frontier, k = {seed: (0, 0)}, [seed], 0
    links = {}
    for a, b, r in edges:
        links.setdefault(a, {})
        links[a][b] = min(r, links[a].get(b, r))
    for d in range(1, depth + 1):
        came = []
        for a in frontier:
            came += [b for b, _ in sorted(links.get(a, {}).items(), key=lambda x: (x[1], x[0])) if b not in out and b not in came]
        frontier = came[: nodes - len(out)]
        for b in frontier:
            k += 1
            out[b] = (d, k)
    return {(seed, n, *x) for n, x in out.items()}


@pytest.mark.parametrize("nodes,depth", [(128, 6), (7, 3), (1, 2)])
def test_budgeted_walk(spark, nodes, depth):
    rng = random.Random(nodes)
    edges = [(f"n{rng.randint(0, 30)}", f"n{rng.randint(0, 30)}", rng.randint(0, 3)) for _ in range(120)] + [("n1", f"h{i}", i % 5) for i in range(60)]
    seeds = [f"n{i}" for i in range(12)] + ["alone"]
    e = spark.createDataFrame(edges, "src string, dst string, rank int")
    got = walks.budgeted_walk(e, spark.createDataFrame([(s, s) for s in seeds + ["n0"]], "seed string, node string"), nodes, depth)
    want = set().union(*[walk_by_hand(edges, s, nodes, depth) for s in seeds])
    assert {tuple(r) for r in got.select("seed", "node", "depth", "position").collect()} == want
    pairs = {(a, b) for a, b, _ in edges}
    for r in walks.unfollowed(e, got).collect():
        mine = {n for s, n, *_ in want if s == r["seed"]}
        inner = sum(a in mine and b in mine for a, b in pairs)
        assert (r["visited"], r["followed"], r["unfollowed"]) == (len(mine), inner, sum(a in mine for a, b in pairs) - inner)


def test_walks_over_numbers_take_few_shuffles(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 40), rng.randint(0, 40), rng.randint(0, 9)) for _ in range(300)]
    e = spark.createDataFrame(edges, "src long, dst long, rank long")
    got = walks.budgeted_walk(e, spark.createDataFrame([(i, i) for i in range(40)], "seed long, node long"), 9, 5)
    assert {tuple(r) for r in got.select("seed", "node", "depth", "position").collect()} == set().union(*[walk_by_hand(edges, s, 9, 5) for s in range(40)])
    cut_off = walks.unfollowed(e, got)
    cut_off.collect()
    # edges, both sides of one join, and what seeds meet, by seed
    assert cut_off._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") <= 4


def test_small_levels_leave_edges_where_they_are(spark, sf, monkeypatch):
    from lattice.plans import driver_queries as q

    t = q.Tables(spark, sf)
    assert {x for _, x in q._edges(t).dtypes} == {"bigint"}
    ids = spark.range(1).select(*[q.node_name(q.node_id(k, "id")).alias(k) for k in q._KINDS])
    assert list(ids.first()) == [f"{k}:0" for k in q._KINDS]
    assert [r[0] for r in spark.createDataFrame([(-3,), (None,), (7 * 10**17,)], "k long").select(q.node_name(q.node_id("part", "k"))).collect()] == ["part:-3", None, f"part:{7 * 10**17}"]
    seen = []
    monkeypatch.setattr(traverse, "small", lambda df: seen.append(df.count()) or F.broadcast(df))
    links = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long")
    assert {tuple(r) for r in traverse.depths(links, spark.createDataFrame([(0,)], "node long"), 4).collect()} == {(i, i) for i in range(5)} and seen == [1] * 4


def test_shared_between(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randint(0, 20), rng.randint(0, 30)) for _ in range(300)] + [(None, 1), (3, None), (77, 5)]
    monkeypatch.setattr(traverse, "PAIRS_PER_TASK", 100)
    got = traverse.shared_between(spark.createDataFrame(rows, "p long, s long"), "p", "s")
    ends = {p: {s for q, s in rows if q == p and s is not None} for p, _ in rows if p is not None}
    want = {}
    for some in ends.values():
        for a in some:
            for b in some:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r["a"], r["b"]): r["shared"] for r in got.collect()} == want and got.count() == len(want)
    # one shuffle, before the pairs are made
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange ") == 1


def test_levels_and_cycles(spark):
    nodes = spark.createDataFrame([("w", n) for n in "abcdef"] + [("v", "a"), ("x", "p"), ("x", "q"), ("x", "r")], "scope string, node string")
    needs = spark.createDataFrame([("w", "b", "a"), ("w", "b", "a"), ("w", "c", "a"), ("w", "d", "b"), ("w", "d", "c"), ("w", "e", "gone"), ("w", "f", "d"), ("w", "f", "a"), ("x", "p", "q"), ("x", "q", "p"), ("x", "r", "q")], "scope string, node string, needed string")
    got = {(r["scope"], r["node"]): r["level"] for r in walks.levels(nodes, needs).collect()}
    assert got == {("w", "a"): 0, ("w", "b"): 1, ("w", "c"): 1, ("w", "d"): 2, ("w", "e"): 0, ("w", "f"): 3, ("v", "a"): 0, ("x", "p"): None, ("x", "q"): None, ("x", "r"): None}
    assert walks.levels(nodes.limit(0), needs).count() == 0


def test_shell_commands():
    script = """# note
npm ci && npm test -- --watch=false; echo "a; b && c" 'd | e'
bash scripts/run.sh --one \\
  --two
cat <<'EOF' > out && ./scripts/after.sh
./scripts/never.sh
EOF
cat <<-END
\tinner
\tEND
if [ -f x ]; then
  ./scripts/branch.sh
fi
./$(pick).sh
FOO=1 make all | tee log 2>&1
echo "multi
line" done
"""
    got = [(line, words, boundary) for line, _, words, boundary in workflow.commands(script)]
    assert got == [
        (1, ["npm", "ci"], None), (1, ["npm", "test", "--", "--watch=false"], None), (1, ["echo", "a; b && c", "d | e"], None),
        (2, ["bash", "scripts/run.sh", "--one", "--two"], None),
        (4, ["cat", ">", "out"], "heredoc"), (4, ["./scripts/after.sh"], None),
        (7, ["cat"], "heredoc"),
        (10, ["if", "[", "-f", "x", "]"], "control"), (10, ["then"], "control"), (11, ["./scripts/branch.sh"], None), (12, ["fi"], "control"),
        (13, ["./$(pick).sh"], "computed"), (14, ["FOO=1", "make", "all"], None), (14, ["tee", "log", "2>&1"], None), (15, ["echo", "multi\nline", "done"], None),
    ]
    assert workflow.commands("") == [] and workflow.commands("echo 'open") == [(0, "echo 'open", ["echo", "open"], None)]


WORKFLOW = """name: build
on: [push]
jobs:
  lint:
    runs-on: ubuntu
    steps:
      - uses: actions/checkout@v4
      - run: ./scripts/lint.sh --fast
  test:
    needs: lint
    steps:
    - name: "unit tests"  # quoted
      env:
        A: b
      run: |
        bash scripts/test.sh
        python -u tools/report.py out
    - name: own
      uses: ./.github/actions/setup
  ship:
    needs:
      - lint
      - test
    uses: ./.github/workflows/ship.yml
other: 1
"""


def test_workflow_chain(spark):
    bodies = spark.createDataFrame([(".github/workflows/b.yml", WORKFLOW), ("no.yml", "a: 1"), ("null.yml", None), ("x.yml", "jobs:\n")], "rel string, text string")
    facts = workflow.workflow_facts(bodies).cache()
    steps = {(r["job"], r["step"], r["name"], r["line"]) for r in facts.filter("kind = 'step'").collect()}
    assert steps == {("lint", 1, None, 7), ("lint", 2, None, 8), ("test", 1, "unit tests", 12), ("test", 2, "own", 18)}
    files = spark.createDataFrame([("scripts/lint.sh",), ("scripts/test.sh",), ("tools/report.py",), (".github/actions/setup/action.yml",)], "rel string")
    w = ".github/workflows/b.yml"
    edges = {(r["from"], r["to"], r["type"], r["strength"]) for r in workflow.execution_edges(facts, files).collect()}
    step = lambda job, k: f"step:{w}#{job}/000{k}"
    assert edges == {
        *((w, f"job:{w}#{j}", "declares_job", "hard") for j in ("lint", "test", "ship")),
        *((f"job:{w}#{a}", f"job:{w}#{b}", "needs_job", "hard") for a, b in (("test", "lint"), ("ship", "lint"), ("ship", "test"))),
        *((f"job:{w}#{j}", step(j, k), "contains_step", "hard") for j in ("lint", "test") for k in (1, 2)),
        (step("lint", 1), "action:actions/checkout@v4", "uses_external_action", "hard"),
        (step("test", 2), ".github/actions/setup", "invokes_action", "hard"),
        (f"job:{w}#ship", ".github/workflows/ship.yml", "invokes_workflow", "medium"),
        (step("lint", 2), "./scripts/lint.sh --fast", "runs_command", "hard"), (step("lint", 2), "scripts/lint.sh", "invokes_script", "hard"),
        (step("test", 1), "bash scripts/test.sh", "runs_command", "hard"), (step("test", 1), "scripts/test.sh", "invokes_script", "hard"),
        (step("test", 1), "python -u tools/report.py out", "runs_command", "hard"), (step("test", 1), "tools/report.py", "invokes_script", "hard"),
    }
    assert {r["node"]: r["level"] for r in workflow.job_levels(facts).collect()} == {"lint": 0, "test": 1, "ship": 2}
    assert [(r["kind"], r["line"]) for r in workflow.execution_unknowns(facts).collect()] == [("external_action_execution", 7)]


def test_odd_workflows_and_what_commands_name(spark):
    from pyspark.sql import functions as F

    from lattice.functions.text import normalized_path

    text = """# jobs: not here
jobs:\t
  # a note
  "one":
    needs:
      - two

      - 'three' # last
    steps:
    -\tname: no item
    -  name : spaced
       run: |
\t
          bash -x ./scripts/../tools/a.sh; npm test
            gh workflow run other.yml

       uses: ./actions/x/ # why
    - run: "make all && cat <<E"
    - - run: deeper
  two:
    run: none
    steps:
      - run: >-
          yarn run build

          ./b.sh
end: 1
  three:
"""
    got = [(kind, job, step, name, line, value) for kind, job, step, name, line, value, *_ in workflow.read_workflow(text)]
    assert got == [
        ("job", "one", None, "one", 4, None), ("needs", "one", None, "one", 5, "two"), ("needs", "one", None, "one", 5, "three"),
        ("step", "one", 1, "spaced", 11, None), ("command", "one", 1, None, 14, "bash -x ./scripts/../tools/a.sh"), ("command", "one", 1, None, 14, "npm test"), ("command", "one", 1, None, 15, "gh workflow run other.yml"), ("uses", "one", 1, None, 17, "./actions/x/"),
        ("step", "one", 2, None, 18, None), ("command", "one", 2, None, 18, "make all"), ("command", "one", 2, None, 18, "cat <<E"),
        ("step", "one", 3, None, 19, None), ("job", "two", None, "two", 20, None),
        ("step", "two", 1, None, 23, None), ("command", "two", 1, None, 24, "yarn run build"), ("command", "two", 1, None, 26, "./b.sh"),
    ]
    assert [x[-3:] for x in workflow.read_workflow(text) if x[0] == "command"] == [
        ("tools/a.sh", None, None), ("npm", None, "npm run test"), ("gh", ".github/workflows/other.yml", None), ("make", None, "make all"), (None, None, None), ("yarn", None, "npm run build"), ("b.sh", None, None),
    ]
    rng = random.Random(5)
    paths = ["/".join(rng.choice(["a", "b.ts", "..", ".", "", "..c", "...", "x\\y"]) for _ in range(rng.randint(1, 6))) for _ in range(500)]
    want = dict(map(tuple, spark.createDataFrame([(p,) for p in paths], "p string").select("p", normalized_path(F.col("p"))).collect()))
    assert {p: workflow._named(["bash", "-x", p])[0] for p in paths} == want
    # nothing of an edge is interpreted row by row
    facts, files = workflow.workflow_facts(spark.createDataFrame([("w.yml", text)], "rel string, text string")), spark.createDataFrame([("b.sh",)], "rel string")
    plan = workflow.execution_edges(facts, files)._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "RLIKE" not in plan


def test_workflows_are_read_in_bounded_batches(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([f"w{i}.yml" for i in range(20)]), pa.array([WORKFLOW] * 20)], names=["rel", "text"])
    each = len(workflow.read_workflow(WORKFLOW))
    read = list(workflow.read_batches([batch], rows=3))
    assert [b.num_rows for b in read] == [3 * each] * 6 + [2 * each]
    assert [b.num_rows for b in workflow.read_batches([batch.slice(0, 2)], rows=1)] == [each] * 2
    # a table of files that is too large to be broadcast gives the same edges, and of two scripts of one name both stay
    bodies = spark.createDataFrame([("w.yml", WORKFLOW.replace("bash scripts/test.sh", "make all; bash scripts/test.sh"))], "rel string, text string")
    files = spark.createDataFrame([("scripts/lint.sh",), ("scripts/test.sh",), (".github/actions/setup/action.yml",)], "rel string")
    named = spark.createDataFrame([("make all", "Makefile"), ("make all", "sub/Makefile")], "name string, rel string")
    facts = workflow.workflow_facts(bodies).cache()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    sent = sorted(map(tuple, workflow.execution_edges(facts, files, named).collect()))
    monkeypatch.setattr(workflow, "small", lambda df: df)
    assert sorted(map(tuple, workflow.execution_edges(facts, files, named).collect())) == sent
    assert {r[1] for r in sent if r[2] == "invokes_target"} == {"Makefile#make all", "sub/Makefile#make all"}


def test_matched_brackets(spark, monkeypatch):
    rng = random.Random(3)
    texts = {f"f{k}": "".join(rng.choice("{}{}[]() x\n") for _ in range(400)) for k in range(6)} | {"flat": "{}\n" * 300, "deep": "{\n" * 150 + "}\n" * 150, "none": "x\n", "strays": "}}}\n{{\n"}
    monkeypatch.setattr(brackets, "CHUNK_LINES", 7)
    lines = spark.createDataFrame([(rel, i, row) for rel, t in texts.items() for i, row in enumerate(t.split("\n"), 1)], "rel string, line_no int, code string")
    got = brackets.matched(brackets.marks(lines), ["rel", "kind"]).collect()
    want = set()
    for rel, t in texts.items():
        for a, b in ("{}", "()", "[]"):
            stack = []
            for i, row in enumerate(t.split("\n"), 1):
                for j, x in enumerate(row):
                    at = i * brackets.LINE_PLACES + j
                    if x == a:
                        stack.append(at)
                    elif x == b:
                        want.add((rel, a, stack.pop() if stack else None, at))
            want |= {(rel, a, at, None) for at in stack}
    assert {(r["rel"], r["kind"], r["open_at"], r["close_at"]) for r in got} == want and len(got) == len(want)


def test_ends_of_declarations(spark):
    files = {
        "a.ts": ("javascript/typescript", "export function f(a: { b: number }, c = [1]) {\n  if (a) { return 1; }\n}\nexport const g = (x) => x + 1;\nconst h = async () => {\n  g({ y: '}' });\n};\nclass K {\n  m() {\n  }\n}\nfunction open() {\n"),
        "b.rs": ("rust", "pub struct P;\nimpl P {\n  pub fn new() -> Self {\n    P\n  }\n}\nfn tail() {}\n"),
        "c.py": ("python", "class A:\n    def m(self,\n          x):\n        return [\n1]\n\n    def n(self):\n        pass\n\n\nx = 1\ndef last():\n    return x\n# end\n"),
        "d.go": ("go", "package d\ntype T struct {\n\tx int\n}\nfunc (t *T) M() {\n\tfor {\n\t}\n}\n"),
    }
    bodies = spark.createDataFrame([(r, lang, t) for r, (lang, t) in files.items()], "rel string, language string, text string")
    got = {(r["rel"], r["name"], r["line_start"]): r["line_end"] for r in extract.symbols(extract.lines(bodies)).collect()}
    assert got == {
        ("a.ts", "f", 1): 3, ("a.ts", "g", 4): 4, ("a.ts", "h", 5): 7, ("a.ts", "K", 8): 11, ("a.ts", "open", 12): 13,
        ("b.rs", "P", 1): 1, ("b.rs", "P", 2): 6, ("b.rs", "new", 3): 5, ("b.rs", "tail", 7): 7,
        ("c.py", "A", 1): 8, ("c.py", "m", 2): 5, ("c.py", "n", 7): 8, ("c.py", "last", 12): 13,
        ("d.go", "T", 2): 4, ("d.go", "M", 5): 8,
    }


@pytest.mark.parametrize("chunk", [3, 2000])
def test_innermost(spark, chunk):
    rng = random.Random(chunk)
    ranges, points = [], []

    def nest(rel, lo, hi):
        while lo <= hi and rng.random() < 0.8:
            end = rng.randint(lo, hi)
            ranges.append((rel, lo, end))
            nest(rel, lo + 1, end - 1)
            lo = end + 1 + rng.randint(0, 2)

    for k in range(8):
        nest(f"f{k}", 1, 40)
        points += [(f"f{k}", line) for line in range(1, 43)]
    got = brackets.innermost(spark.createDataFrame(points + [("other", 1)], "rel string, line int"), spark.createDataFrame(ranges, "rel string, line_start int, line_end int"), chunk)

    def plain(rel, line):
        around = [(a, b) for r, a, b in ranges if r == rel and a <= line <= b]
        return min(around, key=lambda x: (x[1] - x[0], -x[0])) if around else (None, None)

    assert {(r["rel"], r["line"]): (r["scope_start"], r["scope_end"]) for r in got.collect()} == {(r, x): plain(r, x) for r, x in points} | {("other", 1): (None, None)}


def test_routes(spark):
    patterns = ["/", "/users", "/users/:id", "/users/me", "/users/[id]/posts", "/shop/[...all]", "/docs/[[...slug]]", "/(group)/inside", "/:a/:b/:c", "/{x}/y"]
    paths = ["/", "/users", "/users/7", "/users/me", "/users/7/posts/", "/shop", "/shop/a", "/shop/a/b/c", "/docs", "/docs/a/b", "/inside", "/1/2/3", "/1/y", "/none/at/all/of/it", None]
    df = spark.createDataFrame([(p, 1) for p in paths] * 2, "path string, n int")
    best = tries.most_specific(df, "path", spark.createDataFrame([(p,) for p in patterns + [None]], "pattern string"), tries.route_kinds(F.col("pattern")))
    got = [(r["path"], r["pattern"]) for r in best.collect()]
    want = {"/": "/", "/users": "/users", "/users/7": "/users/:id", "/users/me": "/users/me", "/users/7/posts/": "/users/[id]/posts", "/shop": None, "/shop/a": "/shop/[...all]", "/shop/a/b/c": "/shop/[...all]", "/docs": "/docs/[[...slug]]", "/docs/a/b": "/docs/[[...slug]]", "/inside": "/(group)/inside", "/1/2/3": "/:a/:b/:c", "/1/y": "/{x}/y", "/none/at/all/of/it": None, None: None}
    assert sorted(got, key=repr) == sorted(list(want.items()) * 2, key=repr)


def test_globs_like_regexes(spark):
    globs = ["src/**/*.ts", "src/**", "**/test/*", "*.md", "a/*/c", "a/**/c/**/d", "lib?/x*", "**", "plain/file", "we**ird/x", "src/**x.ts"]
    paths = ["src/a.ts", "src/a/b.ts", "src/a/b/c.tsx", "src", "x/test/y", "test/y", "readme.md", "d/readme.md", "a/b/c", "a/c", "a/b/b/c", "a/c/d", "a/x/c/y/z/d", "lib1/xy", "lib/x", "plain/file", "weqq/rird/x", "src/q/x.ts"]

    def regex(g):
        return re.compile("^" + g.replace(".", r"\.").replace("**/", "\1").replace("**", "\2").replace("*", "[^/]*").replace("?", "[^/]").replace("\1", "(?:.*/)?").replace("\2", ".*") + "$")

    got = joins.glob_join(spark.createDataFrame([(p,) for p in paths], "path string"), "path", spark.createDataFrame([(g, i) for i, g in enumerate(globs)], "glob string, id int"), "glob")
    assert sorted((r["path"], r["glob"]) for r in got.collect()) == sorted((p, g) for p in paths for g in globs if regex(g).match(p))


@pytest.mark.parametrize("budget", [1, 7, 20, 500])
def test_shared_budget(spark, budget):
    from lattice.operators import bounds

    rng = random.Random(budget)
    rows = [(s, g, rng.randint(0, 50), i) for s in range(4) for g in "abcdef" for i in range(rng.choice([0, 1, 2, 9, 30]))]
    want = set()
    for s in range(4):
        groups = {}
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[2], r[3])):
            groups.setdefault(r[1], []).append(r)
        turns = sorted(groups, key=lambda g: (-max(r[2] for r in groups[g]), g))
        out = []
        for k in range(50):
            out += [groups[g][k] for g in turns if k < len(groups[g])]
        want |= {(*r, i) for i, r in enumerate(out[:budget])}
    df = spark.createDataFrame(rows, "s int, g string, v int, i int")
    got = bounds.shared_budget(df, ["s"], ["g"], [F.desc("v"), F.col("i")], F.max("v"), budget)
    assert {tuple(r) for r in got.select("s", "g", "v", "i", "position").collect()} == want
