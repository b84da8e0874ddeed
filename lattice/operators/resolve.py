"""Which file an import means: candidates with ranks, joined to the files that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized_path, parent
from .bounds import first_by

#: What is tried after a path, in order.
JS_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".json", ".css", ".scss", ".mts", ".cts", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs", "/index.mts", "/index.vue")
#: Where packages keep what they export.
PACKAGE_ENTRIES = ("/src/index.ts", "/src/index.tsx", "/src/index.js", "/index.ts", "/index.tsx", "/index.js", "/src/main.ts")


#: Ranks of aliases lie this far before those of packages.
BEHIND = 10**12


def lit_long(n: int) -> Column:
    return F.lit(n).cast("long")


def _ranked(paths: list[Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("rank"), normalized_path(p).alias("target")) for k, p in enumerate(paths)])


def candidates(imports: DataFrame, packages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """rel, spec, line, rank and target of every place where an import could lead. packages: path, name and ecosystem; aliases: prefix and
    target_prefix of path aliases (without their stars), open (there was a star), position of the target, and dir, where they hold. What an alias
    says goes before packages."""
    spec, here = F.col("spec"), parent(F.col("rel"))
    js = imports.filter("language IN ('javascript/typescript', 'style')")
    relative = js.filter(spec.startswith(".")).withColumn("c", F.explode(_ranked([F.concat(here, F.lit("/"), spec, F.lit(e)) for e in JS_ENDINGS])))
    keyed = js.filter(~spec.startswith("."))
    named = packages.filter("ecosystem = 'js'").select(F.col("name").alias("package"), F.col("path").alias("at"))
    # a specifier's package is its first segment, or its first two if scoped
    own = keyed.withColumn("package", F.regexp_extract("spec", r"^(@[^/]+/[^/]+|[^/]+)", 1)).join(named, "package")
    rest = F.expr("substring(spec, length(package) + 1)")
    base = F.concat("at", rest)
    inner = F.concat(F.col("at"), F.lit("/src"), rest)
    package = own.withColumn("c", F.explode(_ranked([F.when(rest == "", F.concat("at", F.lit(e))).otherwise(base) for e in PACKAGE_ENTRIES] + [F.concat(p, F.lit(e)) for p in (base, inner) for e in JS_ENDINGS[1:]])))
    python = imports.filter("language = 'python'")
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    up = F.concat(here, F.when(dots > 1, F.repeat(F.lit("/.."), dots - 1)).otherwise(""))
    tail = F.regexp_replace(F.regexp_replace("spec", r"^\.+", ""), r"\.", "/")
    roots = [F.when(dots > 0, up).otherwise(here), *[F.when(dots > 0, up).otherwise(F.lit(r)) for r in (".", "src", "app")]]
    py = python.withColumn("c", F.explode(_ranked([F.concat(r, F.lit("/"), tail, F.lit(e)) for r in roots for e in (".py", "/__init__.py")])))
    rust = imports.filter("language = 'rust'")
    segments = F.split(F.regexp_replace("spec", r"^(crate|super|self)::", ""), "::")
    stem = F.regexp_replace(F.col("rel"), r"/(mod|lib|main)\.rs$|\.rs$", "")
    module_dir = F.when(F.col("rel").rlike(r"(^|/)(mod|lib|main)\.rs$"), here).otherwise(stem)
    crate = F.regexp_extract("rel", r"^((?:.*/)?src)/", 1)
    root = F.when(spec.startswith("crate::"), crate).when(spec.startswith("super::"), parent(module_dir)).otherwise(module_dir)
    deep = [F.when(F.size(segments) >= n, F.concat(root, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), F.lit(n)), "/"))) for n in (4, 3, 2, 1)]
    rs = rust.withColumn("c", F.explode(F.filter(_ranked([F.concat(d, F.lit(e)) for d in deep for e in (".rs", "/mod.rs")]), lambda x: x["target"].isNotNull())))
    # the longest module that an import's path begins with
    modules = packages.filter("ecosystem = 'go'").select(F.col("name").alias("module"), F.col("path").alias("at"))
    go = imports.filter("language = 'go'")
    prefixes = go.withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("spec", "/"))), lambda n: F.array_join(F.slice(F.split("spec", "/"), F.lit(1), n), "/"))))
    found = prefixes.join(modules, "module").withColumn("dir", normalized_path(F.concat("at", F.expr("substring(spec, length(module) + 1)"))))
    gone = found.withColumn("c", F.struct((-F.length("module")).alias("rank"), F.concat("dir", F.lit("/*")).alias("target")))
    parts = [relative, package, py, rs, gone]
    if aliases is not None:
        # an alias is met by the beginnings of a specifier, so no import is tried with every alias
        begins = keyed.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("spec")), lambda n: F.substring(spec, F.lit(1), n))))
        a = begins.join(aliases, "prefix").filter((F.col("dir") == ".") | F.col("rel").startswith(F.concat("dir", F.lit("/")))).filter(F.col("open") | (spec == F.col("prefix")))
        place = F.when(F.col("open"), F.concat(F.col("target_prefix"), F.expr("substring(spec, length(prefix) + 1)"))).otherwise(F.col("target_prefix"))
        # the configuration that is nearest, then the longest pattern, an exact one first, then its targets in order
        near = F.when(F.col("dir") == ".", 0).otherwise(F.length("dir")) * 1000 + F.length("prefix")
        order = (lit_long(1_000_000) - F.least(near, F.lit(999_999))) * 2 + F.when(F.col("open"), 1).otherwise(0)
        tried = a.withColumn("c", F.explode(_ranked([F.concat(place, F.lit(e)) for e in JS_ENDINGS])))
        parts.append(tried.withColumn("c", F.struct(((order * 100 + F.least("position", F.lit(99))) * 100 + F.col("c.rank") - BEHIND).alias("rank"), F.col("c.target").alias("target"))).drop("prefix", "target_prefix", "dir", "open", "position"))
    out = None
    for p in parts:
        one = p.select("rel", "language", "spec", "line", F.col("c.rank").cast("long").alias("rank"), "c.target")
        out = one if out is None else out.unionByName(one)
    return out


def resolve(imports: DataFrame, files: DataFrame, packages: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Each import (rel, language, spec, line) with target: the first candidate that is a file, or null. A Go package means
    the first of its files that is no test."""
    named = files.select(F.col("rel").alias("target"))
    go = files.filter("language = 'go'").filter(~F.col("rel").endswith("_test.go")).groupBy(F.concat(parent(F.col("rel")), F.lit("/*")).alias("target")).agg(F.min("rel").alias("file"))
    both = named.withColumn("file", F.col("target")).unionByName(go)
    met = candidates(imports, packages, aliases).join(both, "target").filter("file <> rel")
    best = first_by(met.select("rel", "spec", "line", "rank", "file"), ["rel", "spec", "line"], [F.col("rank"), F.col("file")])
    return imports.join(best.select("rel", "spec", "line", F.col("file").alias("target")), ["rel", "spec", "line"], "left")
