"""The facts of a source tree, each a DataFrame that is built when it is first asked for."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import text as T
from ..operators import bindings, declarations, extract, inherit, names, resolve, workflow


class FactBase:
    """Facts of raw_files(rel, size, content). A file whose body was not read has no content hash and no body facts."""

    def __init__(self, raw_files: DataFrame):
        self.raw = raw_files

    @cached_property
    def inventory(self) -> DataFrame:
        """Every candidate, with the reason why it is left out, or null."""
        rows = self.raw.withColumn("rel", T.normalized_path(F.col("rel")))
        return rows.select("rel", "size", "content", C.reject_reason(F.col("rel"), F.col("size")).alias("reject_reason"))

    @cached_property
    def scan_stats(self) -> DataFrame:
        reason = F.coalesce("reject_reason", F.when(F.col("content").isNull(), "unreadable"), F.lit("scanned"))
        rows = self.inventory.select("rel", reason.alias("reason"))
        from ..operators.bounds import group_examples

        return group_examples(rows, ["reason"], "rel")

    @cached_property
    def files(self) -> DataFrame:
        text = F.when(~C.language(F.col("rel")).isin("asset"), F.col("content").cast("string"))
        rows = self.inventory.filter("reject_reason IS NULL").select("rel", "size", T.extension(F.col("rel")).alias("ext"), C.language(F.col("rel")).alias("language"), text.alias("text"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))
        rows = rows.withColumn("roles", C.roles(F.col("rel"), F.col("text")))
        return rows.withColumn("kind", C.kind(F.col("roles"), F.col("rel"), F.col("language"))).withColumn("line_count", T.line_count(F.col("text"))).withColumn("domain", C.domain(F.col("rel"))).persist()

    @cached_property
    def lines(self) -> DataFrame:
        return extract.lines(self.files.filter("text IS NOT NULL")).persist()

    @cached_property
    def symbols(self) -> DataFrame:
        return extract.symbols(self.lines).persist()

    @cached_property
    def references(self) -> DataFrame:
        return extract.references(self.lines)

    @cached_property
    def packages(self) -> DataFrame:
        """path, name, manifest and ecosystem of every manifest."""
        name = F.lower(T.base_name(F.col("rel")))
        quoted = F.regexp_extract("text", r"(?m)^\s*name\s*=\s*\"([^\"]+)\"", 1)
        named = {
            "package.json": ("js", F.get_json_object("text", "$.name")),
            "cargo.toml": ("rust", quoted),
            "pyproject.toml": ("python", quoted),
            "go.mod": ("go", F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)),
            "package.swift": ("swift", F.regexp_extract("text", r"name:\s*\"([^\"]+)\"", 1)),
        }
        found = F.coalesce(*[F.when(name == file, F.struct(F.lit(e).alias("ecosystem"), n.alias("name"))) for file, (e, n) in named.items()])
        return self.files.withColumn("p", found).filter("p IS NOT NULL AND p.name <> ''").select(T.parent(F.col("rel")).alias("path"), "p.name", F.col("rel").alias("manifest"), "p.ecosystem")

    @cached_property
    def package_edges(self) -> DataFrame:
        """from and to (paths) of packages that depend on each other by name or by path, with the manifest and the name."""
        js = self.files.filter(F.lower(T.base_name(F.col("rel"))) == "package.json")
        kinds = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
        names = [F.transform(F.map_keys(F.from_json(F.get_json_object("text", f"$.{k}"), "map<string,string>")), lambda x: F.struct(x.alias("dependency"), F.lit(k).alias("kind"))) for k in kinds]  # noqa: B023
        deps = js.select(T.parent(F.col("rel")).alias("from"), F.col("rel").alias("manifest"), F.explode(F.flatten(F.array_compact(F.array(*names)))).alias("d")).select("from", "manifest", "d.*")
        by_name = deps.join(self.packages.filter("ecosystem = 'js'").select(F.col("name").alias("dependency"), F.col("path").alias("to")), "dependency")
        toml = self.files.filter(F.lower(T.base_name(F.col("rel"))).isin("cargo.toml", "pyproject.toml"))
        path_of = r"(?m)^\s*([\w.-]+)\s*=\s*\{[^}\n]*path\s*=\s*\"[^\"]+\""
        target = r"(?m)^\s*[\w.-]+\s*=\s*\{[^}\n]*path\s*=\s*\"([^\"]+)\""
        pairs = toml.select(T.parent(F.col("rel")).alias("from"), F.col("rel").alias("manifest"), F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(path_of), 1).alias("dependency"), F.regexp_extract_all("text", F.lit(target), 1).alias("p"))).alias("d"))
        by_path = pairs.select("from", "manifest", "d.dependency", F.lit("path").alias("kind"), T.normalized_path(F.concat("from", F.lit("/"), "d.p")).alias("to"))
        go = self.files.filter(F.lower(T.base_name(F.col("rel"))) == "go.mod").select(T.parent(F.col("rel")).alias("from"), F.col("rel").alias("manifest"), F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require\s+)?([\w.\-]+(?:/[\w.\-]+)+)\s+v"), 1)).alias("dependency"))
        by_module = go.join(self.packages.filter("ecosystem = 'go'").select(F.col("name").alias("dependency"), F.col("path").alias("to")), "dependency").withColumn("kind", F.lit("require"))
        columns = ["from", "to", "dependency", "kind", "manifest"]
        return by_name.select(columns).unionByName(by_path.select(columns)).unionByName(by_module.select(columns)).filter("`from` <> `to`").distinct()

    @cached_property
    def ts_configs(self) -> DataFrame:
        """node (the file), settings (paths and baseUrl with the directories that they are relative to), length and cyclic of each tsconfig or jsconfig, with what it
        inherits; comments and trailing commas are allowed."""
        ts = self.files.filter(F.lower(T.base_name(F.col("rel"))).rlike(r"^[tj]sconfig[\w.-]*\.json$") & F.col("text").isNotNull())
        bare, here = inherit.plain_json(F.col("text")), T.parent(F.col("rel"))
        named = F.get_json_object(bare, "$.extends")
        above = F.regexp_replace(T.normalized_path(F.concat(here, F.lit("/"), F.when(named.endswith(".json"), named).otherwise(F.concat(named, F.lit(".json"))))), r"^\./", "")
        own = {"paths": F.get_json_object(bare, "$.compilerOptions.paths"), "baseUrl": F.get_json_object(bare, "$.compilerOptions.baseUrl")}
        settings = F.map_filter(F.create_map(*[x for k, v in own.items() for x in (F.lit(k), v, F.lit(k + " of"), F.when(v.isNotNull(), here))]), lambda k, v: v.isNotNull())
        return inherit.inherited(ts.select(F.col("rel").alias("node"), F.when(named.startswith("."), above).alias("parent"), settings.alias("settings")))

    @cached_property
    def aliases(self) -> DataFrame:
        """prefix, open (the pattern has a star), target_prefix, position and dir of the path aliases that hold in a directory: those of its own
        tsconfig.json, inherited ones among them. Paths are relative to the base URL, or else to the configuration that states them."""
        own = self.ts_configs.filter(F.lower(T.base_name(F.col("node"))).isin("tsconfig.json", "jsconfig.json") & ~F.col("cyclic"))
        value = lambda k: F.try_element_at("settings", F.lit(k))
        base = F.coalesce(F.concat(value("baseUrl of"), F.lit("/"), value("baseUrl")), value("paths of"))
        mapped = own.select(T.parent(F.col("node")).alias("dir"), base.alias("base"), F.explode(F.from_json(value("paths"), "map<string,array<string>>")).alias("pattern", "targets"))
        each = mapped.select("dir", "base", "pattern", F.posexplode("targets").alias("position", "target"))
        place = F.concat("base", F.lit("/"), F.regexp_replace("target", r"\*.*$", ""))
        full = F.regexp_replace(T.normalized_path(place), r"^\./", "")
        return each.select(F.regexp_replace("pattern", r"\*.*$", "").alias("prefix"), F.col("pattern").contains("*").alias("open"), F.when(place.endswith("/"), F.concat(full, F.lit("/"))).otherwise(full).alias("target_prefix"), "position", "dir")

    @cached_property
    def workflow_facts(self) -> DataFrame:
        return workflow.workflow_facts(self.files.filter(F.col("rel").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))).persist()

    @cached_property
    def execution_edges(self) -> DataFrame:
        """The chain from workflows to jobs, steps, actions, commands, and what commands run: scripts, package scripts, recipes and other workflows."""
        return workflow.execution_edges(self.workflow_facts, self.files, self.scripts)

    @cached_property
    def imports(self) -> DataFrame:
        """rel, language, spec, line and target (null: unresolved)."""
        return resolve.resolve(extract.imports(self.lines), self.files, self.packages, self.aliases).persist()

    @cached_property
    def bindings(self) -> DataFrame:
        """Names that files import and export, each with target, the file of its spec (null: none, or outside)."""
        found = bindings.bindings(self.files.filter("text IS NOT NULL")).persist()
        specs = found.filter("spec IS NOT NULL").select("rel", "language", "spec").distinct().withColumn("line", F.lit(0))
        known = resolve.resolve(specs, self.files, self.packages, self.aliases).select("rel", "spec", "target")
        return found.join(known, ["rel", "spec"], "left").persist()

    @cached_property
    def public_names(self) -> DataFrame:
        """What each public name of a JavaScript file means."""
        js = self.bindings.filter("language = 'javascript/typescript'")
        again = js.filter("form = 'reexport'").select(F.col("rel").alias("file"), F.col("local").alias("name"), F.col("target").alias("source"), F.col("name").alias("source_name"))
        return names.public_names(names.exported(js, self.symbols), again, js.filter("form = 'star'").select(F.col("rel").alias("file"), F.col("target").alias("source")))

    @cached_property
    def symbol_consumers(self) -> DataFrame:
        """Imports of a name that means one symbol, directly or through other files."""
        return names.consumers(self.bindings, self.public_names)

    @cached_property
    def unresolved(self) -> DataFrame:
        """Unresolved imports that can only mean files of this tree."""
        return self.imports.filter("target IS NULL").filter(F.col("spec").startswith(".") | ((F.col("language") == "rust") & F.col("spec").rlike("^(crate|super|self)::")))

    @cached_property
    def routes(self) -> DataFrame:
        return extract.routes(self.lines)

    @cached_property
    def env(self) -> DataFrame:
        """Environment reads, each with the declaration nearest above it."""
        reads, declared = extract.env_reads(self.lines), extract.env_declarations(self.lines)
        spread = reads.withColumn("dir", F.explode(T.ancestors(T.parent(F.col("rel")))))
        met = spread.join(declared.select(F.col("key").alias("name"), T.parent(F.col("rel")).alias("dir"), F.col("rel").alias("declaration")), ["name", "dir"])
        best = met.groupBy("name", "rel", "line").agg(F.max_by("declaration", F.when(F.col("dir") == ".", 0).otherwise(F.length("dir"))).alias("declaration"))
        return reads.join(best, ["name", "rel", "line"], "left").select("name", F.col("rel").alias("used_by"), "line", "declaration")

    @cached_property
    def side_effects(self) -> DataFrame:
        return extract.side_effects(self.lines)

    @cached_property
    def unknowns(self) -> DataFrame:
        missing = self.unresolved.select(F.lit("unresolved_import").alias("kind"), F.col("rel").alias("path"), F.col("line").alias("line_start"), F.concat(F.lit("no file for "), "spec").alias("reason"))
        unread = self.files.filter("content_hash IS NULL").select(F.lit("unread_body").alias("kind"), F.col("rel").alias("path"), F.lit(None).cast("int").alias("line_start"), F.lit("the body was not read").alias("reason"))
        return extract.unknowns(self.lines).unionByName(missing).unionByName(unread)

    @cached_property
    def tables(self) -> DataFrame:
        return extract.sql_tables(self.lines)

    @cached_property
    def tests(self) -> DataFrame:
        """rel (a file), test, score and evidence: the first step of a ladder that a test meets; where any is high (70 or more),
        the others go."""
        roles = self.files.select("rel", "roles")
        is_test = roles.filter(F.array_contains("roles", "test")).select(F.col("rel").alias("test"))
        direct = self.imports.filter("target IS NOT NULL").join(is_test, F.col("rel") == F.col("test"), "left_semi").select(F.col("target").alias("rel"), F.col("rel").alias("test"), F.lit(80).alias("score"), F.lit("test_import").alias("evidence"))
        visited = self.lines.join(is_test, F.col("rel") == F.col("test")).select("test", F.explode(F.regexp_extract_all("text", F.lit(r"\.(?:goto|visit|get)\(\s*[\"'](/[^\"']*)[\"']"), 1)).alias("path"))
        routed = visited.join(self.routes.select("path", F.col("file").alias("rel")), "path").select("rel", "test", F.lit(76).alias("score"), F.lit("e2e_route").alias("evidence"))
        stem = F.regexp_replace(F.lower(T.base_name(F.col("rel"))), r"^test_|(_test|\.test|\.spec|\.e2e)?\.[a-z]+$", "")
        named = roles.filter(~F.array_contains("roles", "test")).withColumn("stem", stem)
        by_name = named.join(is_test.withColumn("rel", F.col("test")).select("test", stem.alias("stem")), "stem").select("rel", "test", F.lit(50).alias("score"), F.lit("test_name").alias("evidence"))
        both = direct.unionByName(routed).unionByName(by_name).filter("rel <> test")
        best = both.groupBy("rel", "test").agg(F.max_by("evidence", "score").alias("evidence"), F.max("score").alias("score"))
        from pyspark.sql import Window

        return best.withColumn("top", F.max("score").over(Window.partitionBy("rel"))).filter("top < 70 OR score >= 70").drop("top")

    @cached_property
    def edges(self) -> DataFrame:
        """All typed edges: from, to, type, evidence, strength and locations."""
        place = lambda path, line, kind: F.array(F.struct(F.col(path).alias("path"), line.alias("line_start"), line.alias("line_end"), F.lit(kind).alias("kind")))
        none = F.lit(None).cast("int")

        def edge(df, a, b, type_, evidence, strength, locations):
            return df.select(F.col(a).alias("from"), F.col(b).alias("to"), F.lit(type_).alias("type"), evidence.alias("evidence"), strength.alias("strength"), locations.alias("locations"))

        parts = [
            edge(self.imports.filter("target IS NOT NULL"), "rel", "target", "imports", F.lit("resolved_import"), F.lit("high"), place("rel", F.col("line"), "import")),
            edge(self.package_edges, "from", "to", "package_dependency", F.col("kind"), F.lit("high"), place("manifest", none, "manifest")),
            edge(self.tests, "rel", "test", "tests", F.col("evidence"), F.when(F.col("score") >= 70, "high").otherwise("medium"), place("test", none, "test")),
            edge(self.env.withColumn("to", F.concat(F.lit("env:"), "name")), "used_by", "to", "reads_env", F.when(F.col("declaration").isNull(), "undeclared").otherwise("declared"), F.lit("high"), place("used_by", F.col("line"), "env")),
            edge(self.routes.withColumn("to", F.concat_ws(" ", F.lit("route:"), "method", "path")), "file", "to", "serves", F.col("evidence"), F.lit("high"), place("file", F.col("line"), "route")),
            edge(self.tables, "rel", "table", "declares_table", F.lit("create_table"), F.lit("hard"), place("rel", none, "sql")),
            edge(self.table_uses, "rel", "table", "reads_table", F.lit("table_name"), F.lit("low"), place("rel", F.col("line"), "sql")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    @cached_property
    def table_uses(self) -> DataFrame:
        """rel, table and first line of files that name a declared table outside its declaration."""
        words = self.lines.filter("language <> 'sql'").select("rel", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z_][a-z0-9_]*)"), 1))).alias("word"))
        return words.join(self.tables.select(F.expr("substring(table, 7)").alias("word"), "table").distinct(), "word").groupBy("rel", "table").agg(F.min("line_no").alias("line"))

    @cached_property
    def contracts(self) -> DataFrame:
        return declarations.contracts(self.files)

    @cached_property
    def scripts(self) -> DataFrame:
        return declarations.scripts(self.files)

    @cached_property
    def ci_steps(self) -> DataFrame:
        return declarations.ci_steps(self.lines).withColumn("purpose", declarations.step_kind(F.col("command")))
