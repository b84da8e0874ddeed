import pytest

from lattice.plans import lenses
from lattice.plans.fact_base import FactBase
from lattice.sources.repo_files import from_texts

TREE = {
    "api/schema.graphql": "type User {\n  id: ID\n}\ninput New { a: Int }\n",
    "api/user.proto": "message User {}\nservice Users {\n  rpc Get(User) returns (User);\n}\n",
    "api/schema.prisma": "model Account {\n  id Int @id\n}\n",
    "api/event.avsc": '{"type": "record", "name": "Event", "fields": [{"name": "id", "type": "long"}]}',
    "api/user.schema.json": '{"$schema": "x", "properties": {"name": {}, "age": {}}}',
    "api/openapi.yaml": "openapi: 3.0.0\npaths:\n  /users:\n    get: {}\n  /users/{id}:\n    get: {}\n",
    "package.json": '{"name": "r", "scripts": {"test": "vitest", "lint": "eslint ."}}',
    "Makefile": "VAR := 1\nbuild: dep\n\tgcc x\n.PHONY: build\ncheck-all:\n\ttrue\n",
    ".github/workflows/ci.yml": "name: ci\njobs:\n  unit:\n    runs-on: x\n    steps:\n      - uses: actions/checkout@v4\n      - run: npm run test\n      - name: many\n        run: |\n          # comment\n          make check-all\n          echo done\n      - run: npm publish\n",
    "src/a.py": "def a():\n    pass\n",
    "src/b.py": "def b():\n    pass\n",
    "tests/test_a.py": "from src.a import a\ndef test_a():\n    a()\n",
}


@pytest.fixture(scope="module")
def facts(spark):
    return FactBase(from_texts(spark, TREE))


def test_contracts(facts):
    got = {tuple(r) for r in facts.contracts.select("kind", "name").collect()}
    assert got == {("type", "User"), ("type", "New"), ("service", "Users"), ("rpc", "Get"), ("type", "Account"), ("type", "Event"), ("field", "id"), ("field", "name"), ("field", "age"), ("path", "/users"), ("path", "/users/{id}")}


def test_scripts_and_steps(facts):
    assert {r["name"] for r in facts.scripts.collect()} == {"npm run test", "npm run lint", "make build", "make check-all"}
    steps = [(r["job"], r["step"], r["kind"], r["command"], r["purpose"]) for r in facts.ci_steps.orderBy("line").collect()]
    assert steps == [
        ("unit", 0, "uses", "actions/checkout@v4", "setup"),
        ("unit", 1, "run", "npm run test", "validation"),
        ("unit", 2, "run", "make check-all", "validation"),
        ("unit", 3, "run", "echo done", "control"),
        ("unit", 4, "run", "npm publish", "release"),
    ]
    ran = {(r["name"], r["job"]) for r in lenses.ci_coverage(facts).collect()}
    assert ran == {("npm run test", "unit"), ("make check-all", "unit"), ("npm run lint", None), ("make build", None)}


def test_more_lenses(spark, facts):
    paths = spark.createDataFrame([("src/a.py",)], "path string")
    assert [tuple(r) for r in lenses.proof_commands(facts, paths).select("test", "command").collect()] == [("tests/test_a.py", "python -m pytest tests/test_a.py")]
    config = spark.createDataFrame([("sources", "src/**"), ("nothing", "lib/**")], "name string, glob string")
    assert {(r["name"], r["files"]) for r in lenses.anchors(facts, config).collect()} == {("sources", 2), ("nothing", 0)}
    first = lenses.files(facts, 3).collect()
    assert len(first) == 3 and first[0]["observed"] == len(TREE) and first[0]["hidden"] == len(TREE) - 3
    assert lenses.place(facts, "source").first()["directory"] == "src"
    assert lenses.teach(facts).count() >= 0
    table = spark.createDataFrame([("a|b", 1)], "x string, y int")
    assert [r["line"] for r in lenses.markdown(table, "T").orderBy("part").collect()] == ["# T", "| x | y |", "| --- | --- |", "| a\\|b | 1 |"]
