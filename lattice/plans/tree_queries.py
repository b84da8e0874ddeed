"""Operators on source trees over bodies that Spark derives from the relational tables, each with SQL over those tables.

Parts, suppliers, nations and regions become modules that export and re-export each other's names; customers' orders become workflows with
jobs and steps. The bodies are read by the library's own extraction, nothing is handed past it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import proofs
from ..functions.text import normalized_path, parent
from ..operators import bindings, bounds, brackets, extract, inherit, names, tries, walks, workflow
from ..session import cut
from .driver_queries import Tables, node_id, node_name, query

c, lit = F.col, F.lit


def _text(*parts):
    return F.concat(*[lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def raw_files(rel, text, rows: DataFrame) -> DataFrame:
    """rel, size and content of one file for each row."""
    return rows.select(rel.alias("rel"), F.octet_length(text).cast("long").alias("size"), text.cast("binary").alias("content"))


def modules(t: Tables) -> DataFrame:
    """A module for each part, and barrels above: suppliers re-export their parts, nations their suppliers, regions their nations."""
    key = c("p_partkey")
    part = raw_files(_text("part/p", key, ".ts"), _text("function make_", key, "() {\n  return ", key, ";\n}\n\nexport { make_", key, " as item_", key % 40, " };\nexport const price_", key, " = 1;\n"), t.part.select("p_partkey").repartition(_tasks(t, t.part), "p_partkey"))
    p, s = c("l_partkey"), c("l_suppkey")
    line = F.concat(_text("export * from '../part/p", p, "';\n"), F.when(p % 10 == 3, _text("export { price_", p, " as cheapest } from '../part/p", p, "';\n")).otherwise(""))
    barrels = t.lineitem.select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("text"))
    supplier = raw_files(_text("supplier/s", s, ".ts"), c("text"), barrels)

    def above(rows, own, below, folder, letter, under, under_letter, more):
        text = F.concat(F.array_join(F.sort_array(F.collect_list(_text(f"export * from '../{under}/{under_letter}", c(below), "';\n"))), ""), more)
        return raw_files(_text(f"{folder}/{letter}", c(own), ".ts"), c("text"), rows.groupBy(own).agg(text.alias("text")))

    nation = above(t.supplier, "s_nationkey", "s_suppkey", "nation", "n", "supplier", "s", F.when(c("s_nationkey") % 5 == 0, "export const cheapest = 0;\n").otherwise("// nothing of its own\n"))
    region = above(t.nation, "n_regionkey", "n_nationkey", "region", "r", "nation", "n", lit(""))
    return part.unionByName(supplier).unionByName(nation).unionByName(region)


@query("""
WITH sp AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
l0 AS (
  SELECT p_partkey AS p, 'part/p' || p_partkey || '.ts' AS file, 'item_' || p_partkey % 40 AS name, 'make_' || p_partkey AS symbol FROM part
  UNION ALL SELECT p_partkey, 'part/p' || p_partkey || '.ts', 'price_' || p_partkey, 'price_' || p_partkey FROM part
), m1 AS (
  SELECT s, name, count(*) AS n, min(file) AS owner, min(symbol) AS symbol FROM sp JOIN l0 USING (p) GROUP BY ALL
  UNION ALL SELECT s, 'cheapest', count(*), min('part/p' || p || '.ts'), min('price_' || p) FROM sp WHERE p % 10 = 3 GROUP BY s
), l1 AS (
  SELECT s, 'supplier/s' || s || '.ts' AS file, name, n = 1 AS one, owner, symbol, 1 AS hops FROM m1
), l2 AS (
  SELECT s_nationkey AS nation, 'nation/n' || s_nationkey || '.ts' AS file, name, count(*) = 1 AND bool_and(one) AS one, min(owner) AS owner, min(symbol) AS symbol, min(hops) + 1 AS hops
  FROM supplier JOIN l1 ON s = s_suppkey WHERE NOT (name = 'cheapest' AND s_nationkey % 5 = 0) GROUP BY ALL
  UNION ALL SELECT DISTINCT s_nationkey, 'nation/n' || s_nationkey || '.ts', 'cheapest', true, 'nation/n' || s_nationkey || '.ts', 'cheapest', 0 FROM supplier WHERE s_nationkey % 5 = 0
), l3 AS (
  SELECT 'region/r' || n_regionkey || '.ts' AS file, name, count(*) = 1 AND bool_and(one) AS one, min(owner) AS owner, min(symbol) AS symbol, min(hops) + 1 AS hops FROM nation JOIN l2 ON nation = n_nationkey GROUP BY ALL
)
SELECT file, name, CASE WHEN one THEN 'one' ELSE 'ambiguous' END AS status, CASE WHEN one THEN owner END AS owner, CASE WHEN one THEN symbol END AS symbol, CASE WHEN one THEN hops END::INT AS hops FROM (
  SELECT file, name, true AS one, file AS owner, symbol, 0 AS hops FROM l0 UNION ALL SELECT file, name, one, owner, symbol, hops FROM l1
  UNION ALL SELECT file, name, one, owner, symbol, hops FROM l2 UNION ALL SELECT file, name, one, owner, symbol, hops FROM l3)
""")
def q_public_names(spark, d):
    """What each public name of each module means, through barrels."""
    files = modules(Tables(spark, d)).select("rel", lit("javascript/typescript").alias("language"), c("content").cast("string").alias("text"))
    # all specifiers are relative and without an ending
    js = cut(bindings.bindings(files).withColumn("target", normalized_path(F.concat(parent(c("rel")), lit("/"), "spec", lit(".ts")))))
    again = js.filter("form = 'reexport'").select(c("rel").alias("file"), c("local").alias("name"), c("target").alias("source"), c("name").alias("source_name"))
    stars = js.filter("form = 'star'").select(c("rel").alias("file"), c("target").alias("source"))
    # declarations are asked only of files that export something of their own
    own = js.filter("form IN ('export', 'default')").select("rel").distinct()
    return names.public_names(names.exported(js, extract.declared_names(extract.lines(files.join(own, "rel", "left_semi")))), again, stars)


def supply_chain(t: Tables) -> DataFrame:
    """src, dst and rank: parts lead to the orders that hold them, these to customers, nations and regions. Nodes are numbers (``node_id``)."""
    edge = lambda rows, a, b, x, y: rows.select(node_id(a, x).alias("src"), node_id(b, y).alias("dst"), c(y).cast("long").alias("rank"))
    parts = edge(t.lineitem, "part", "order", "l_partkey", "l_orderkey")
    rest = [edge(t.orders, "order", "customer", "o_orderkey", "o_custkey"), edge(t.customer, "customer", "nation", "c_custkey", "c_nationkey"), edge(t.nation, "nation", "region", "n_nationkey", "n_regionkey")]
    for x in rest:
        parts = parts.unionByName(x)
    return parts


_BUDGET = 24
_WALK = f"""
WITH e1 AS (SELECT DISTINCT l_partkey AS p, l_orderkey AS o FROM lineitem),
v1 AS (SELECT p, o, row_number() OVER (PARTITION BY p ORDER BY o) AS k FROM e1 QUALIFY k < {_BUDGET}),
f1 AS (SELECT p, 1 + count(*) AS n FROM v1 GROUP BY p),
v2 AS (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY place) + n - 1 AS k FROM (SELECT p, o_custkey AS x, min(k) AS place FROM v1 JOIN orders ON o_orderkey = o GROUP BY ALL) JOIN f1 USING (p) QUALIFY k < {_BUDGET}),
f2 AS (SELECT p, max(n) + count(x) AS n FROM f1 LEFT JOIN v2 USING (p) GROUP BY p),
v3 AS (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY place) + n - 1 AS k FROM (SELECT p, c_nationkey AS x, min(k) AS place FROM v2 JOIN customer ON c_custkey = x GROUP BY ALL) JOIN f2 USING (p) QUALIFY k < {_BUDGET}),
f3 AS (SELECT p, max(n) + count(x) AS n FROM f2 LEFT JOIN v3 USING (p) GROUP BY p),
v4 AS (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY place) + n - 1 AS k FROM (SELECT p, n_regionkey AS x, min(k) AS place FROM v3 JOIN nation ON n_nationkey = x GROUP BY ALL) JOIN f3 USING (p) QUALIFY k < {_BUDGET}),
walk AS (
  SELECT p_partkey AS p, 'part:' || p_partkey AS node, 0 AS depth, 0 AS position FROM part UNION ALL SELECT p, 'order:' || o, 1, k FROM v1
  UNION ALL SELECT p, 'customer:' || x, 2, k FROM v2 UNION ALL SELECT p, 'nation:' || x, 3, k FROM v3 UNION ALL SELECT p, 'region:' || x, 4, k FROM v4)
"""


def _walked(t: Tables) -> tuple[DataFrame, DataFrame]:
    edges = supply_chain(t)
    seeds = t.part.select(c("p_partkey").cast("long").alias("seed"), node_id("part", "p_partkey").alias("node"))
    return edges, walks.budgeted_walk(edges, seeds, nodes=_BUDGET, depth=4)


@query(_WALK + "SELECT p::BIGINT AS seed, node, depth::INT AS depth, position::INT AS position FROM walk")
def q_lineage_walk(spark, d):
    """What is connected with each part, for all parts at once, each within its own budget."""
    return _walked(Tables(spark, d))[1].select("seed", node_name(c("node")).alias("node"), "depth", "position")


@query(
    _WALK
    + """, edges AS (
  SELECT 'part:' || p AS src, 'order:' || o AS dst FROM e1 UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)
SELECT w.p::BIGINT AS seed, count(DISTINCT w.node) AS visited, count(v.node) AS followed, count(dst) - count(v.node) AS unfollowed
FROM walk w LEFT JOIN edges ON src = w.node LEFT JOIN walk v ON v.p = w.p AND v.node = dst GROUP BY 1"""
)
def q_lineage_cut(spark, d):
    """How much of each part's surroundings its budget cut off."""
    return walks.unfollowed(*_walked(Tables(spark, d)))


def workflows(t: Tables, with_steps: bool = True) -> DataFrame:
    """rel and text of a workflow for each customer with orders: an order is a job, its lines are steps, the k-th job waits for the job k/2. Of every tenth
    customer the first job waits for the last one, so that none can begin."""
    step = lambda l: _text(
        "      - name: line ", l["l_linenumber"], "\n        run: |\n          bash scripts/p", l["l_partkey"] % 7, ".sh --quantity ", l["l_quantity"].cast("int"),
        " \\\n            --note 'a; b && c' # why\n          cat <<'EOF' > out.txt && ./scripts/p0.sh\n          ./scripts/p1.sh\n          EOF\n      - uses: ./.github/actions/a", l["l_suppkey"] % 5, "\n",
    )
    jobs = t.orders.select("o_custkey", "o_orderkey")
    if with_steps:
        steps = t.lineitem.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity", "l_suppkey"))).alias("steps"))
        jobs = jobs.join(steps, "o_orderkey", "left")
    # numbers are shuffled, and texts made where they are read; reading them is more work than their bytes say
    jobs = jobs.repartition(_tasks(t, t.orders), "o_custkey")
    rows = jobs.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(*[x for x in jobs.columns if x != "o_custkey"]))).alias("jobs"))

    def job(x, i):
        first = (c("o_custkey") % 10 == 0) & (i == 0)
        needed = F.when(first, F.element_at("jobs", -1)).when(i > 0, F.element_at("jobs", F.floor((i + 1) / 2).cast("int")))["o_orderkey"]
        steps = F.coalesce(F.concat(lit("    steps:\n"), F.array_join(F.transform(x["steps"], step), "")), lit("")) if with_steps else lit("")
        return F.concat(_text("  o", x["o_orderkey"], ":\n"), F.when(needed.isNotNull(), _text("    needs: [o", needed, "]\n")).otherwise(""), steps)

    return rows.select(_text(".github/workflows/c", c("o_custkey"), ".yml").alias("rel"), _text("name: orders\non: push\njobs:\n", F.array_join(F.transform("jobs", job), "")).alias("text"))


def _tasks(t: Tables, rows: DataFrame) -> int:
    """How many tasks read the bodies that are made of rows: two for each core, and more where there are more rows."""
    return max(2 * t.spark.sparkContext.defaultParallelism, rows.count() // 50_000)


@query("""
SELECT '.github/workflows/c' || o_custkey || '.yml' AS scope, 'o' || o_orderkey AS node, CASE WHEN o_custkey % 10 <> 0 THEN floor(log2(k + 0.5))::INT END AS level
FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
""")
def q_ci_levels(spark, d):
    """In which step of its workflow each job can run; null where jobs wait for each other."""
    return workflow.job_levels(workflow.workflow_facts(workflows(Tables(spark, d), with_steps=False)))


@query("""
WITH l AS (SELECT '.github/workflows/c' || o_custkey || '.yml' AS path, o_orderkey, l_partkey % 7 AS script, l_suppkey % 5 AS action, l_quantity::INT AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
j AS (SELECT '.github/workflows/c' || o_custkey || '.yml' AS path, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT path, 'declares_job' AS type, 'hard' AS strength, count(*) AS edges, count(*) AS targets FROM j GROUP BY path
UNION ALL SELECT path, 'needs_job', 'hard', count(*), count(DISTINCT CASE WHEN k = 1 THEN n ELSE k // 2 END) FROM j WHERE k > 1 OR o_custkey % 10 = 0 GROUP BY path
UNION ALL SELECT path, 'contains_step', 'hard', 2 * count(*), 2 * count(*) FROM l GROUP BY path
UNION ALL SELECT path, 'invokes_action', CASE WHEN action < 3 THEN 'hard' ELSE 'medium' END, count(*), count(DISTINCT action) FROM l GROUP BY ALL
UNION ALL SELECT path, 'runs_command', 'hard', 2 * count(*), count(DISTINCT (script, quantity)) + 1 FROM l GROUP BY path
UNION ALL SELECT path, 'invokes_script', 'hard', 2 * count(*), count(DISTINCT script) + CASE WHEN bool_or(script = 0) THEN 0 ELSE 1 END FROM l GROUP BY path
""")
def q_ci_chain(spark, d):
    """The edges from workflows through jobs and steps to actions and scripts, counted by workflow, type and strength."""
    t = Tables(spark, d)
    # all facts of a file meet in one task, so that what they lead to is counted where it is
    facts = workflow.workflow_facts(workflows(t)).repartition(_tasks(t, t.orders), "rel")
    scripts = t.lineitem.select(_text("scripts/p", c("l_partkey") % 7, ".sh").alias("rel")).distinct()
    actions = t.lineitem.filter("l_suppkey % 5 < 3").select(_text(".github/actions/a", c("l_suppkey") % 5, "/action.yml").alias("rel")).distinct()
    return workflow.execution_edges(facts, scripts.unionByName(actions)).groupBy("path", "type", "strength").agg(F.count("*").alias("edges"), F.countDistinct("to").alias("targets"))


def talks(t: Tables) -> DataFrame:
    """rel, language and text of a file for each conversation: a user's turn opens a function, any other closes one, whether it is open or not."""
    piece = F.when(c("role") == "user", _text("function t", c("turn"), "() { // } not here\n")).otherwise("  work(\"}\", '{');\n}\n")
    texts = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", piece.alias("text")))), lambda x: x["text"]), "").alias("text"))
    return texts.select(_text("talk/c", c("conv_id"), ".ts").alias("rel"), lit("javascript/typescript").alias("language"), "text")


_RANGES = """
WITH t AS (SELECT 'talk/c' || conv_id || '.ts' AS rel, turn, role = 'user' AS opens, CASE WHEN role = 'user' THEN 1 ELSE 2 END AS n FROM conversations),
placed AS (SELECT *, sum(n) OVER w AS upto, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER w + CASE WHEN opens THEN 0 ELSE 1 END AS depth, sum(n) OVER (PARTITION BY rel) + 1 AS last
  FROM t WINDOW w AS (PARTITION BY rel ORDER BY turn ROWS UNBOUNDED PRECEDING)),
ranges AS (SELECT rel, 't' || turn AS name, upto::INT AS line_start, coalesce(closed, last)::INT AS line_end FROM (
  SELECT *, lead(upto) OVER (PARTITION BY rel, depth ORDER BY upto) AS closed FROM placed) WHERE opens)
"""


@query(_RANGES + "SELECT rel, name, line_start, line_end FROM ranges")
def q_bracket_ranges(spark, d):
    """The lines of each declaration, by the brackets of its body."""
    return extract.symbols(extract.lines(talks(Tables(spark, d)))).select("rel", "name", "line_start", "line_end")


@query(
    _RANGES
    + """, lines AS (SELECT rel, unnest(range(1, max(last)::BIGINT + 1))::INT AS line FROM placed GROUP BY rel)
SELECT l.rel, line, max(line_start)::INT AS scope_start, min(line_end)::INT AS scope_end FROM lines l LEFT JOIN ranges r ON r.rel = l.rel AND line BETWEEN line_start AND line_end GROUP BY ALL"""
)
def q_innermost_scope(spark, d):
    """The innermost declaration around each line."""
    lines = extract.lines(talks(Tables(spark, d))).persist()
    return brackets.innermost(lines.select("rel", c("line_no").alias("line")), extract.symbols(lines))


def route_patterns(t: Tables) -> DataFrame:
    """pattern: one for the pages of each language, one of its own for each page whose number ends in 0, some for every page and below."""
    path = F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1)
    first, second = F.regexp_extract(path, "^/([^/]+)", 1), F.regexp_extract(path, "^/[^/]+/([^/]+)", 1)
    rows = t.pages.select(first.alias("a"), second.alias("b")).filter("a <> '' AND b <> ''")
    own = rows.filter(c("b").rlike("0$")).select(_text("/", c("a"), "/", c("b")).alias("pattern"))
    return rows.select(_text("/", c("a"), "/:page").alias("pattern")).filter("pattern <> '/de/:page'").unionByName(own).unionByName(t.region.limit(1).select(F.explode(F.array(lit("/:lang/[id]"), lit("/[...rest]"))).alias("pattern"))).distinct()


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages), s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS l FROM p),
f AS (SELECT DISTINCT regexp_extract(path, '^/([^/]+)', 1) AS a, regexp_extract(path, '^/[^/]+/([^/]+)', 1) AS b FROM p)
SELECT page_id, path, CASE WHEN len(l) = 2 AND EXISTS (SELECT 1 FROM f WHERE a = l[1] AND b = l[2] AND b LIKE '%0') THEN '/' || l[1] || '/' || l[2]
  WHEN len(l) = 2 AND l[1] <> 'de' AND EXISTS (SELECT 1 FROM f WHERE a = l[1] AND b <> '') THEN '/' || l[1] || '/:page' WHEN len(l) = 2 THEN '/:lang/[id]' WHEN len(l) > 0 THEN '/[...rest]' END AS pattern FROM s
""")
def q_route_trie(spark, d):
    """The most specific of a table of route patterns that each path fits."""
    t = Tables(spark, d)
    paths = t.pages.select("page_id", F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1).alias("path"))
    return tries.most_specific(paths, "path", route_patterns(t), tries.route_kinds(c("pattern"))).select("page_id", "path", "pattern")


@query("""
WITH RECURSIVE chain(node, up, k) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT node, p_partkey, k + 1 FROM chain JOIN part ON p_partkey = up - 30 WHERE up % 150 <> 7),
nearest AS (SELECT node, up % 7 AS key, arg_min(up, k) AS value FROM chain WHERE up % 3 <> 1 GROUP BY ALL), depth AS (SELECT node, max(k) AS length FROM chain GROUP BY 1)
SELECT 'part' || d.node AS node, d.length::BIGINT AS length, coalesce(string_agg('k' || key || '=' || value, ' ' ORDER BY key) FILTER (key IS NOT NULL), '') AS settings FROM depth d LEFT JOIN nearest USING (node) GROUP BY ALL
""")
def q_config_chain(spark, d):
    """What each configuration inherits along its chain, the nearest value of each key."""
    key = c("p_partkey")
    parent = F.when(key % 150 != 7, _text("part", key - 30))
    settings = F.when(key % 3 != 1, F.create_map(_text("k", key % 7), key.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    got = inherit.inherited(Tables(spark, d).part.select(_text("part", key).alias("node"), parent.alias("parent"), settings.alias("settings")))
    pairs = F.array_sort(F.transform(F.map_entries("settings"), lambda e: F.concat(e["key"], lit("="), e["value"])))
    return got.select("node", "length", F.array_join(pairs, " ").alias("settings"))


@query("""
WITH r AS (SELECT l_suppkey, bin, l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_suppkey, bin ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS rank, max(l_quantity) OVER (PARTITION BY l_suppkey, bin) AS best FROM (SELECT *, l_partkey % 7 AS bin FROM lineitem))
SELECT l_suppkey, bin, l_orderkey, l_linenumber, position::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY rank, best DESC, bin) - 1 AS position FROM r) WHERE position < 25
""")
def q_shared_budget(spark, d):
    """The first lines of each supplier, taken in turns from bins of parts under one budget; bins with larger lines come first."""
    rows = Tables(spark, d).lineitem.select("l_suppkey", (c("l_partkey") % 7).alias("bin"), "l_orderkey", "l_linenumber", "l_quantity")
    return bounds.shared_budget(rows, ["l_suppkey"], ["bin"], [F.desc("l_quantity"), c("l_orderkey"), c("l_linenumber")], F.max("l_quantity"), 25).drop("l_quantity")


_EVIDENCE = ("test_import", "test_name", "test_import_via_direct_consumer", "test_name_via_direct_dependency", "ci_setup_step", "test_support_import", "e2e_route_owning_file", "script_path_token", "ci_run_validation")
_COMMANDS = (None, "npm test", "npm run dev", "pnpm prisma migrate status", "pnpm db:migrate", "yarn 'lint'")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, ['test_import', 'test_name', 'test_import_via_direct_consumer', 'test_name_via_direct_dependency', 'ci_setup_step', 'test_support_import', 'e2e_route_owning_file', 'script_path_token', 'ci_run_validation'][1 + l_partkey % 9] AS evidence,
  l_suppkey % 6 AS k, l_linenumber % 4 >= 2 AS strong, l_orderkey % 50 AS target FROM lineitem),
c AS (SELECT *, CASE WHEN evidence = 'ci_setup_step' OR k IN (2, 4) THEN 'setup_support' WHEN evidence LIKE '%\\_via\\_%' ESCAPE '\\' OR evidence IN ('test_support_import', 'e2e_route_owning_file') THEN 'mediated_evidence'
    WHEN evidence IN ('test_name', 'script_path_token') OR (NOT strong AND evidence <> 'test_import') THEN 'soft_evidence' WHEN k <> 0 THEN 'hard' ELSE 'direct_evidence' END AS class,
  CASE evidence WHEN 'test_import' THEN 6 WHEN 'test_name' THEN 3 WHEN 'test_import_via_direct_consumer' THEN 4 WHEN 'test_name_via_direct_dependency' THEN 1 WHEN 'test_support_import' THEN 5 WHEN 'e2e_route_owning_file' THEN 5 ELSE 0 END AS precedence FROM p)
SELECT target, class, count(*) AS proofs, max(precedence)::INT AS precedence, arg_max(evidence, (precedence, evidence)) AS evidence FROM c GROUP BY ALL
""")
def q_proof_classes(spark, d):
    """The classes of each target's proofs, with the evidence that counts most."""
    of = lambda values, k: F.element_at(F.array(*[lit(v).cast("string") for v in values]), (k % len(values) + 1).cast("int"))
    strength = F.element_at(F.array(*map(lit, ("low", "medium", "high", "hard"))), (c("l_linenumber") % 4 + 1).cast("int"))
    rows = Tables(spark, d).lineitem.select((c("l_orderkey") % 50).alias("target"), of(_EVIDENCE, c("l_partkey")).alias("evidence"), of(_COMMANDS, c("l_suppkey")).alias("command"), strength.alias("strength"))
    judged = rows.select("target", "evidence", proofs.proof_class(c("evidence"), c("strength"), c("command")).alias("class"), proofs.precedence(c("evidence")).alias("precedence"))
    return judged.groupBy("target", "class").agg(F.count("*").alias("proofs"), F.max("precedence").alias("precedence"), F.max_by("evidence", F.struct("precedence", "evidence")).alias("evidence"))
