"""Questions to a fact base. Each answer is a DataFrame; limits say what they hide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bounds, certify, delta, extract, joins, traverse, walks
from ..schema import RISKS, name_of, rank_of
from .fact_base import FactBase


def where(facts: FactBase, name: str, kind: str | None = None, limit: int = 4) -> DataFrame:
    """Definitions of a symbol by its exact name, bounded before their consumers are counted."""
    hit = facts.symbols.filter(F.col("name") == name)
    hit = hit.filter(F.col("kind") == kind) if kind else hit
    some = bounds.top_k(hit.withColumn("g", F.lit(1)), ["g"], [F.col("rel"), F.col("line_start")], limit).drop("g")
    users = facts.imports.join(facts.references.filter(F.col("name") == name).select("rel").distinct(), "rel", "left_semi").filter("target IS NOT NULL").groupBy(F.col("target").alias("rel")).agg(F.count_distinct("rel").alias("consumers"))
    return some.join(users, "rel", "left").withColumn("consumers", F.coalesce("consumers", F.lit(0)))


def where_suggestions(facts: FactBase, name: str, limit: int = 10) -> DataFrame:
    return facts.symbols.filter(F.lower("name").contains(name.lower())).groupBy("name").agg(F.min("rel").alias("first_file"), F.count("*").alias("n")).orderBy("name").limit(limit)


def _links(facts: FactBase) -> DataFrame:
    return facts.imports.filter("target IS NOT NULL").select(F.col("rel").alias("src"), F.col("target").alias("dst")).distinct()


def cone(facts: FactBase, anchor: str, depth: int = 1) -> DataFrame:
    """What a file imports, up to a depth: src, dst, depth, strength and evidence."""
    links = _links(facts)
    seeds = facts.files.filter(F.col("rel") == anchor).select(F.col("rel").alias("node"))
    return traverse.cone_edges(links, traverse.bfs_depths(links, seeds, depth - 1))


def consumers(facts: FactBase, anchor: str, depth: int = 1, tests: bool = False) -> DataFrame:
    """Files that import a file, directly or through others, with the least number of steps."""
    back = _links(facts).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = facts.files.filter(F.col("rel") == anchor).select(F.col("rel").alias("node"))
    found = traverse.bfs_depths(back, seeds, depth).filter("depth > 0").withColumnRenamed("node", "rel")
    return found if tests else found.join(facts.files.filter(F.array_contains("roles", "test")).select("rel"), "rel", "left_anti")


def symbol_references(facts: FactBase, rel: str, name: str) -> DataFrame:
    """Files that use a symbol of a file: they import the file and name the symbol in code."""
    users = facts.imports.filter(F.col("target") == rel).select("rel").distinct()
    return facts.references.filter(F.col("name") == name).join(users, "rel", "left_semi").filter(F.col("rel") != rel)


def impact(facts: FactBase, changed: DataFrame) -> DataFrame:
    """Level, reasons and counts of each changed path (path)."""
    paths = changed.select(F.col("path").alias("rel")).distinct()
    uses = _links(facts).groupBy(F.col("dst").alias("rel")).agg(F.count("*").alias("consumers"))
    crossing = boundary_map(facts).groupBy(F.col("dst").alias("rel")).agg(F.count("*").alias("cross_boundary"))
    tests = facts.tests.groupBy("rel").agg(F.count("*").alias("tests"))
    rows = paths.join(facts.files.select("rel", "roles"), "rel", "left").join(uses, "rel", "left").join(crossing, "rel", "left").join(tests, "rel", "left").na.fill(0, ["consumers", "cross_boundary", "tests"])
    has = lambda r: F.coalesce(F.array_contains("roles", r), F.lit(False))
    rules = [("consumers", F.col("consumers") > 0, 1), ("many consumers", F.col("consumers") >= 10, 3), ("crosses a boundary", F.col("cross_boundary") > 0, 3), ("public boundary", has("public_boundary"), 2), ("schema contract", has("schema_contract"), 3), ("migration", has("migration"), 4), ("manifest", has("manifest"), 2), ("no test", (F.col("tests") == 0) & ~has("test") & ~has("docs"), 1)]
    return rows.select("rel", "consumers", "cross_boundary", "tests", name_of(F.greatest(*[F.when(c, r).otherwise(0) for _, c, r in rules]), RISKS).alias("level"), F.array_compact(F.array(*[F.when(c, n) for n, c, _ in rules])).alias("reasons"))


def boundary_map(facts: FactBase) -> DataFrame:
    """Imports between files of different domains (or packages, where there is no domain), and whether a test makes them."""
    at = facts.files.select("rel", "domain", F.array_contains("roles", "test").alias("is_test"))
    homes = joins.longest_prefix(at, "rel", ["rel"], facts.packages.filter("path <> '.'").select(F.col("path").alias("package")), "package").select("rel", F.coalesce("domain", "package").alias("home"), "is_test")
    a, b = homes.select(F.col("rel").alias("src"), F.col("home").alias("from_home"), "is_test"), homes.select(F.col("rel").alias("dst"), F.col("home").alias("to_home"))
    return _links(facts).join(a, "src").join(b, "dst").filter(~F.col("from_home").eqNullSafe(F.col("to_home"))).select("src", "dst", "from_home", "to_home", "is_test")


def boundaries(facts: FactBase, rules: DataFrame) -> DataFrame:
    """Imports that a rule (from_glob, to_glob, reason, status) forbids; hard ones first."""
    met = joins.glob_join(_links(facts), "src", rules.withColumn("id", F.monotonically_increasing_id()), "from_glob")
    return met.filter(F.rlike(F.col("dst"), T.glob_regex(F.col("to_glob")))).select("src", "dst", "from_glob", "to_glob", "reason", "status")


def package_paths(facts: FactBase, depth: int = 4) -> DataFrame:
    """Chains of packages that depend on one another, without cycles."""
    return traverse.simple_paths(facts.package_edges.select(F.col("from").alias("src"), F.col("to").alias("dst")), depth)


def delete(facts: FactBase, anchor: str, limit: int = 20) -> DataFrame:
    """What would break without a file: groups of edges to it, each with its limit."""
    rows = facts.edges.filter((F.col("to") == anchor) | (F.col("type") == "tests") & (F.col("from") == anchor))
    group = F.when(F.col("type") == "imports", "consumers").when(F.col("type") == "tests", "tests").otherwise(F.col("type"))
    return bounds.top_k(rows.withColumn("group", group), ["group"], [F.col("from"), F.col("to"), F.col("evidence")], limit)


def proof(facts: FactBase, paths: DataFrame) -> DataFrame:
    """How each path (path) is verified: the best class of what tests it, else missing."""
    t = facts.tests.select("rel", "test", "score", "evidence")
    rows = paths.select(F.col("path").alias("rel")).distinct().join(t, "rel", "left")
    klass = F.when(F.col("score") >= 70, 0).when(F.col("score").isNotNull(), 3).otherwise(4)
    best = rows.groupBy("rel").agg(F.min(klass).alias("rank"), F.count("test").alias("tests"))
    names = F.array(*map(F.lit, ("runnable", "evidence", "setup", "soft", "missing")))
    return best.select("rel", F.element_at(names, F.col("rank") + 1).alias("class"), "tests")


def runtime(facts: FactBase) -> DataFrame:
    """Counts of runtime facts by file: routes, environment reads, side effects and unknowns."""
    parts = [
        facts.routes.select(F.col("file").alias("rel"), F.lit("routes").alias("what")),
        facts.env.select(F.col("used_by").alias("rel"), F.lit("env_reads").alias("what")),
        facts.side_effects.select("rel", F.col("kind").alias("what")),
        facts.unknowns.select(F.col("path").alias("rel"), F.lit("unknowns").alias("what")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("rel").pivot("what", ["routes", "env_reads", "network", "storage", "db_write", "unknowns"]).count().na.fill(0)


def contract(facts: FactBase, anchor: str) -> DataFrame:
    """Who declares and who uses a pseudo-node such as table:x or env:X."""
    return facts.edges.filter(F.col("to") == anchor).select("from", "type", "evidence", "strength", "locations")


def lineage(facts: FactBase, seeds: DataFrame, nodes: int = 128, depth: int = 6) -> DataFrame:
    """seed, from, to, type and evidence of what is connected with each seed (seed, node: a file): who consumes it, directly or through others, which topics and settings
    these files name, and the tests that import the seed or a file that nobody else consumes. Each seed has a budget of nodes and depth; tests aren't
    walked through."""
    tests = facts.files.filter(F.array_contains("roles", "test")).select(F.col("rel").alias("src"))
    links = _links(facts)
    used = links.join(tests, "src", "left_anti").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("rank"))
    visited = walks.budgeted_walk(used, seeds, nodes, depth)
    here = visited.select("seed", F.col("node").alias("rel"), "depth")
    consumed = here.join(used.select(F.col("src").alias("rel"), "dst"), "rel").select("seed", F.col("dst").alias("from"), F.col("rel").alias("to"), F.lit("consumes").alias("type"), F.when(F.col("depth") == 0, "direct_static_consumer").otherwise("mediated_static_consumer").alias("evidence"))
    emitted = here.join(extract.topics(facts.lines).filter("topic IS NOT NULL"), "rel").select("seed", F.col("rel").alias("from"), F.concat(F.lit("topic:"), "topic").alias("to"), F.lit("emits").alias("type"), F.lit("static_topic_literal").alias("evidence"))
    read = here.join(facts.env.withColumnRenamed("used_by", "rel"), "rel").select("seed", F.col("rel").alias("from"), F.concat(F.lit("config:"), "name").alias("to"), F.lit("reads_config").alias("type"), F.when(F.col("declaration").isNull(), "static_env_reference").otherwise("env_declaration").alias("evidence"))
    last = here.join(used.select(F.col("src").alias("rel")).distinct().withColumn("consumed", F.lit(True)), "rel", "left").filter("depth = 0 OR consumed IS NULL")
    proven = last.join(facts.tests.filter("evidence = 'test_import'"), "rel").select("seed", F.col("test").alias("from"), F.col("rel").alias("to"), F.lit("verifies_directly").alias("type"), F.col("evidence"))
    return consumed.unionByName(emitted).unionByName(read).unionByName(proven).distinct()


def flow(facts: FactBase, method: str, path: str) -> DataFrame:
    """Ordered steps of a route: the route, its file's imports, environment reads and side effects."""
    file = facts.routes.filter((F.col("method") == method) & (F.col("path") == path))
    ambiguous = file.agg(F.count_distinct("file").alias("n"))
    one = file.select("file").distinct()
    parts = [
        file.select(F.lit(0).alias("phase"), F.col("file").alias("anchor"), F.concat_ws(" ", "method", "path").alias("what"), "line"),
        facts.imports.filter("target IS NOT NULL").join(one, F.col("rel") == F.col("file"), "left_semi").select(F.lit(1), F.col("target"), F.lit("imports"), "line"),
        facts.env.join(one, F.col("used_by") == F.col("file"), "left_semi").select(F.lit(2), "used_by", F.concat(F.lit("env:"), "name"), "line"),
        facts.side_effects.join(one, F.col("rel") == F.col("file"), "left_semi").select(F.lit(3), "rel", "kind", "line"),
    ]
    steps = parts[0]
    for p in parts[1:]:
        steps = steps.union(p)
    stopped = steps.crossJoin(F.broadcast(ambiguous)).withColumn("status", F.when(F.col("n") > 1, "ambiguous").otherwise("resolved"))  # one row
    return stopped.filter("n = 1 OR phase = 0").withColumn("step", F.row_number().over(Window.orderBy("phase", "anchor", "line", "what")) - 1).drop("n")


def siblings(facts: FactBase, directory: str) -> DataFrame:
    """Files of a directory by kind, with examples."""
    return bounds.group_examples(facts.files.filter(T.parent(F.col("rel")) == directory).select("kind", "rel"), ["kind"], "rel")


def ls(facts: FactBase, directory: str = ".") -> DataFrame:
    """Entries of a directory: files with their kinds, and directories with their number of files."""
    rel = F.col("rel") if directory == "." else F.expr(f"substring(rel, {len(directory) + 2})")
    under = facts.files if directory == "." else facts.files.filter(F.col("rel").startswith(directory + "/"))
    named = under.withColumn("entry", F.substring_index(rel, "/", 1)).withColumn("is_dir", rel.contains("/"))
    return named.groupBy("entry", "is_dir").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max(F.when(~F.col("is_dir"), F.col("kind"))).alias("kind"))


def directory_edges(facts: FactBase, depth: int = 1) -> DataFrame:
    """Imports rolled up to directories of a depth, with counts."""
    top = lambda c: F.substring_index(F.col(c), "/", depth)
    rolled = _links(facts).select(top("src").alias("from"), top("dst").alias("to")).filter("`from` <> `to`")
    return rolled.groupBy("from", "to").agg(F.count("*").alias("count"))


def graph(facts: FactBase, limit: int = 12) -> DataFrame:
    """Edges among the files with the most edges."""
    links = _links(facts)
    top = links.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").count().orderBy(F.desc("count"), "node").limit(limit)
    return traverse.induced(links, top)


def status(facts: FactBase) -> DataFrame:
    """Counts of everything, in one row."""
    counts = {"files": facts.files, "symbols": facts.symbols, "imports": facts.imports, "unresolved": facts.unresolved, "packages": facts.packages, "routes": facts.routes, "unknowns": facts.unknowns}
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def changed(before: FactBase, after: FactBase) -> DataFrame:
    """path and status (added, removed, modified, renamed) between two states, with old_path of renames."""
    a, b = before.files.select("rel", "content_hash"), after.files.select("rel", "content_hash")
    diff = delta.fingerprint_diff(a, b, "rel", "content_hash").filter("status <> 'unchanged'")
    moved = delta.renames(diff.filter("status = 'removed'"), diff.filter("status = 'added'").withColumn("before", F.col("after")), "rel", "before")
    rows = diff.join(moved.select(F.col("new").alias("rel"), F.col("old").alias("old_path")), "rel", "left").join(moved.select(F.col("old").alias("rel")), "rel", "left_anti")
    return rows.select(F.col("rel").alias("path"), F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("status")).alias("status"), "old_path")


def changed_symbols(before: FactBase, after: FactBase) -> DataFrame:
    """Symbols of the later state whose ranges hold an added line, with how many."""
    texts = changed(before, after).filter("status = 'modified'").select(F.col("path").alias("rel")).join(before.files.select("rel", F.col("text").alias("before")), "rel").join(after.files.select("rel", F.col("text").alias("after")), "rel")
    added = delta.line_deltas(texts).filter("side = 'added'").select("rel", "line")
    return joins.range_join(added, F.col("line"), after.symbols.select("rel", "name", "kind", "line_start", "line_end"), F.col("line_start"), F.col("line_end"), 64, on=["rel"]).groupBy("rel", "name", "kind", "line_start").agg(F.count("*").alias("added_lines"))


def coverage(facts: FactBase) -> DataFrame:
    """What a count over bodies rests on, by language: eligible, visited, closure and reasons."""
    seen = facts.files.groupBy("language").agg(F.count("*").alias("eligible"), F.count("content_hash").alias("visited"))
    c = certify.closure(F.col("eligible") == F.col("visited"), F.when(F.col("eligible") > F.col("visited"), F.array(F.lit("unread_body"))).otherwise(F.array().cast("array<string>")))
    return seen.withColumn("c", c).select("language", "eligible", "visited", "c.closure", "c.reasons")


def max_risk(levels: DataFrame) -> DataFrame:
    """The highest of the levels (level)."""
    return levels.agg(name_of(F.max(rank_of(F.col("level"), RISKS)), RISKS).alias("level"))


def files(facts: FactBase, limit: int = 200) -> DataFrame:
    """The first files by path, with how many there are."""
    return bounds.top_k(facts.files.select("rel", "kind", "language").withColumn("g", F.lit(1)), ["g"], [F.col("rel")], limit).drop("g")


def place(facts: FactBase, kind: str, limit: int = 10) -> DataFrame:
    """Where files of a kind live: directories with the most of them, the usual extension and an example."""
    at = facts.files.filter(F.col("kind") == kind).select(T.parent(F.col("rel")).alias("directory"), "ext", "rel")
    exts = at.groupBy("directory", "ext").agg(F.count("*").alias("n"), F.min("rel").alias("example"))
    best = exts.groupBy("directory").agg(F.sum("n").alias("files"), F.max_by("ext", F.struct("n", "ext")).alias("ext"), F.min("example").alias("example"))
    return best.orderBy(F.desc("files"), "directory").limit(limit)


def teach(facts: FactBase, least: int = 2) -> DataFrame:
    """A draft of role patterns: for each role, the directories that hold at least so many of its files and no others."""
    rows = facts.files.select(T.parent(F.col("rel")).alias("directory"), "rel", F.explode_outer("roles").alias("role"))
    totals = rows.groupBy("directory").agg(F.count_distinct("rel").alias("files"))
    by_role = rows.filter("role IS NOT NULL").groupBy("role", "directory").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return by_role.join(totals, "directory").filter("n = files").select("role", F.concat("directory", F.lit("/**")).alias("glob"), "n")


def anchors(facts: FactBase, config: DataFrame) -> DataFrame:
    """How many files each configured pattern (name, glob) matches; 0 is a finding."""
    met = joins.glob_join(facts.files.select("rel"), "rel", config, "glob").groupBy("name", "glob").agg(F.count("*").alias("files"))
    return config.join(met, ["name", "glob"], "left").withColumn("files", F.coalesce("files", F.lit(0)))


def proof_commands(facts: FactBase, paths: DataFrame) -> DataFrame:
    """A command for each test of the paths (path), by ecosystem."""
    tests = paths.select(F.col("path").alias("rel")).distinct().join(facts.tests, "rel")
    t = F.col("test")
    command = F.when(t.endswith(".py"), F.concat(F.lit("python -m pytest "), t)).when(t.endswith(".go"), F.concat(F.lit("go test ./"), T.parent(t))).when(t.endswith(".rs"), F.concat(F.lit("cargo test --test "), F.regexp_extract(t, r"([^/]+)\.rs$", 1))).when(t.rlike(r"\.(ts|tsx|js|jsx|mjs)$"), F.concat(F.lit("npx vitest run "), t))
    return tests.select("rel", "test", "evidence", command.alias("command"))


def ci_coverage(facts: FactBase) -> DataFrame:
    """Which declared scripts a workflow runs."""
    ran = facts.ci_steps.filter("kind = 'run'").select("command", F.col("rel").alias("workflow"), "job")
    words = ran.withColumn("name", F.explode(F.array(F.regexp_extract("command", r"^((?:npm run|make|just) [\w:-]+)", 1), F.regexp_replace(F.regexp_extract("command", r"^((?:pnpm|yarn|npm) (?:run )?[\w:-]+)", 1), r"^(pnpm|yarn|npm) (run )?", "npm run ")))).filter("name <> ''")
    return facts.scripts.join(words.select("name", "workflow", "job").distinct(), "name", "left").select("name", "rel", "workflow", "job")


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """A table as lines of Markdown, with their order: one row for the head and one for each row, sorted by all columns."""
    cells = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([|\\])", r"\\$1"), F.lit("")) for c in rows.columns]
    body = rows.select(F.lit(2).alias("part"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    names = "| " + " | ".join(rows.columns) + " |"
    head = rows.sparkSession.createDataFrame([(0, f"# {title}"), (1, names), (1, "|" + " --- |" * len(rows.columns))], "part int, line string")
    return head.unionByName(body)
