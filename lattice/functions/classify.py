"""Languages, roles and kinds of files, as column expressions over path, extension and body."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V
from .text import base_name, extension, parent, path_tokens


def _in(c: Column, names) -> Column:
    return c.isin(*names)


def is_env_name(name: Column) -> Column:
    return (name == ".env") | name.startswith(".env.") | name.endswith(".env")


def language(rel: Column) -> Column:
    name, ext = F.lower(base_name(rel)), extension(rel)
    out = F.when(is_env_name(name), "env").when(_in(name, V.LOCKFILES), "lockfile").when(_in(name, ("dockerfile", "jenkinsfile", "earthfile")), "config")
    for lang, exts in V.LANGUAGES.items():
        out = out.when(_in(ext, exts), lang)
    return out.otherwise("unknown")


def reject_reason(rel: Column, size: Column) -> Column:
    """Why a file is left out of the scan; null if it is not."""
    name, ext = F.lower(base_name(rel)), extension(rel)
    asset = _in(ext, V.ASSET_EXTS)
    known = _in(ext, (*V.SOURCE_EXTS, *V.TEXT_EXTS, *V.ASSET_EXTS, *V.SNAPSHOT_EXTS))
    return (
        F.when(F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, V.IGNORED_DIRS))), "ignored_dir")
        .when(is_env_name(name) | _in(name, V.LOCKFILES), F.lit(None))
        .when((size > 900_000) & ~asset, "too_large")
        .when((size > 5_000_000) & asset, "too_large_asset")
        .when(_in(name, V.STRUCTURAL_NAMES), F.lit(None))
        .when(_in(ext, V.BINARY_EXTS) & ~asset, "binary_extension")
        .when(~known, "unsupported_extension")
    )


def is_test_path(rel: Column) -> Column:
    return rel.rlike(r"(?i)(^|/)(tests?|__tests__|spec|e2e)/|[._-](test|spec|e2e)\.[a-z]+$|_test\.(go|py|rs)$|(^|/)test_[^/]*\.py$|(^|/)tests?\.(rs|py)$")


def roles(rel: Column, text: Column) -> Column:
    """All roles of a file, in order of name. The text may be null: what a body alone can show is then not claimed."""
    low, ext = F.lower(rel), extension(rel)
    name = F.lower(base_name(rel))
    source, docs = _in(ext, V.SOURCE_EXTS), _in(ext, ("md", "txt", "rst", "mdx"))
    under = lambda *dirs: low.rlike(rf"(^|/)({'|'.join(dirs)})/")
    test = is_test_path(rel) & source
    support = test & (low.rlike(r"(^|/)(support|helpers?|fixtures?|utils?|setup)([./_-]|$)") | _in(name, ("__init__.py", "conftest.py"))) & ~F.coalesce(text.rlike(r"(?m)^\s*(def test_|#\[test\]|func Test|(it|test|describe)\()"), F.lit(False))
    manifest = _in(name, V.MANIFESTS)
    env = is_env_name(name)
    head = F.coalesce(F.substring_index(text, "\n", 8), F.lit(""))
    boundary = _in(name, V.PUBLIC_BOUNDARY_NAMES)
    schema = ~manifest & (_in(ext, ("prisma", "graphql", "gql", "proto", "avsc")) | (_in(ext, ("json", "yaml", "yml", "ts", "py", "rs", "go")) & low.rlike(r"(^|[/._-])(schemas?|contracts?|openapi|swagger)([/._-]|$)")))
    flags = {
        "generated": under("generated", "gen", "__generated__") | low.rlike(r"[._-](generated|gen|pb)\.") | head.rlike(r"(?i)@generated|code generated .*do not edit|auto-?generated"),
        "asset": _in(ext, V.ASSET_EXTS),
        "snapshot": _in(ext, V.SNAPSHOT_EXTS) | under("__snapshots__", "snapshots"),
        "golden": under("golden", "goldens") | low.contains(".golden."),
        "fixture": under("fixtures"),
        "example": under("examples", "samples"),
        "test_support": support,
        "test": test & ~support,
        "e2e_test": test & ~support & low.rlike(r"(^|/)e2e/|\.e2e\.|playwright|cypress"),
        "public_boundary": boundary,
        "public_api": boundary,
        "manifest": manifest,
        "env_config": env,
        "runtime_config": env | low.rlike(r"(^|/)config/|\.config\.(js|ts|mjs|cjs|json)$"),
        "lockfile": _in(name, V.LOCKFILES),
        "docs": docs | under("docs", "doc"),
        "script": _in(ext, V.SCRIPT_EXTS) | under("scripts", "bin") & source,
        "receipt": low.rlike(r"(^|[/._-])receipts?([/._-]|$)") & ~source,
        "witness": low.rlike(r"(^|[/._-])witness(es)?([/._-]|$)") & ~source,
        "owner_doc": _in(name, ("agents.md", "owners.md", "codeowners", "maintainers.md", "contributing.md")),
        "proof_runner": source & low.rlike(r"(^|[/._-])(smoke|verify|proof|validate|check)([/._-][^/]*)?\.[a-z]+$"),
        "migration": under("migrations?", "migrate") & _in(ext, ("sql", "ts", "js", "py", "rs", "go")),
        "deploy": under("deploy", "deployment", "k8s", "helm", "terraform", "infra") | _in(name, ("dockerfile", "docker-compose.yml", "docker-compose.yaml")),
        "entrypoint": _in(name, ("main.rs", "main.go", "main.py", "__main__.py", "main.ts", "main.js", "server.ts", "server.js", "cli.ts", "cli.js", "main.swift")),
        "schema_contract": schema,
        "schema": schema,
        "renderer_ui": _in(ext, ("tsx", "jsx", "vue", "svelte", "css", "scss")) | (source & low.rlike(r"(^|[/._-])(ui|views?|components?|render(er)?|pages?)([/._-]|$)")),
        "build_ci": under(r"\.github/workflows", r"\.circleci", "ci") | _in(name, ("makefile", "gnumakefile", "justfile", "jenkinsfile", ".gitlab-ci.yml", "dockerfile")),
        "runtime_surface": source & (under("workers?", "jobs?", "crons?") | low.rlike(r"(^|[/._-])(workers?|jobs?|crons?)\.[a-z]+$") | F.coalesce(text.rlike(r"process\.env|os\.getenv|env::var|app\.(get|post|put|delete)\("), F.lit(False))),
        "internal_api": under("internal") & source,
        "doctor": low.rlike(r"(^|[/._-])doctor([/._-]|$)"),
        "agent_bootstrap": name == "agents.md",
    }
    tokens = path_tokens(rel)
    for role, words in V.TOKEN_ROLES.items():
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for x in words for w in (x, x + "s")]))
        flags[role] = hit & (source if role in V.SOURCE_TOKEN_ROLES else ~docs)
    all_ = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in sorted(flags.items())]))
    return F.when(test & ~support, F.array_except(all_, F.array(*map(F.lit, V.NOT_OF_TESTS)))).otherwise(all_)


def kind(roles_: Column, rel: Column, lang: Column) -> Column:
    """The first role of the priority list; else by language."""
    by_language = F.when(_in(extension(rel), V.SOURCE_EXTS), "source")
    for k, v in V.LANGUAGE_KINDS.items():
        by_language = by_language.when(lang == k, v)
    return F.coalesce(F.get(F.array_intersect(F.array(*map(F.lit, V.KIND_ROLES)), roles_), F.lit(0)), by_language.otherwise("file"))


def domain(rel: Column) -> Column:
    """The directory below a domain directory (packages/x), or null."""
    return F.nullif(F.regexp_extract(rel, rf"^((?:.*?/)?(?:{'|'.join(V.DOMAIN_DIRS)})/[^/]+)/", 1), F.lit(""))


__all__ = ["domain", "is_env_name", "is_test_path", "kind", "language", "parent", "reject_reason", "roles"]
