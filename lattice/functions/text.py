"""Column expressions over paths, patterns and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_tokens(c: Column, least: int = 2) -> Column:
    """Distinct lower-case tokens of letters, digits and underscores, of at least ``least`` characters, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"[/\-_.]", " ")), r"[^a-z0-9_]+"), lambda t: F.length(t) >= least))


def words(c: Column, pattern: str = r"[a-z0-9_]{2,}") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({pattern})"), 1)


def normalized_path(c: Column) -> Column:
    """With / for \\, without empty and . segments, .. resolved; . if nothing is left. Most paths are done when a leading ./ and each name that a .. follows
    are taken out; segments are folded only of the others."""
    c = F.regexp_replace(F.regexp_replace(c, r"^(?:\./)+", ""), r"(^|/)(?!\.{1,2}/)[^/\\]+/\.\./", "$1")
    parts = F.filter(F.split(F.regexp_replace(c, r"\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    joined = F.array_join(folded, "/")
    return F.when(~F.rlike(c, F.lit(r"\\|(?:^|/)\.{0,2}(?:/|$)")), c).when(joined == "", ".").otherwise(joined)


def normalized_route(c: Column) -> Column:
    """A path that begins with one /, without query, fragment and trailing /; null for anything else."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"(.)/+$", "$1")
    return F.when(c.startswith("/") & ~c.startswith("//") & ~c.contains("${"), bare)


def ancestors(c: Column) -> Column:
    """The path itself, each directory above it, and ``.``; longest first."""
    parts = F.split(c, "/")
    return F.concat(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(".")))


def glob_regex(c: Column) -> Column:
    """A glob as a regex over the whole path: ** for any segments, * within one, ? for a character."""
    quoted = F.regexp_replace(c, r"([.+^$(){}|\[\]\\])", r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"\*\*/", "\x01"), r"\*\*", "\x02"), r"\*", "[^/]*")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, r"\?", "[^/]"), "\x01", "(?:.*/)?"), "\x02", ".*"), F.lit("$"))


def parent(c: Column) -> Column:
    return F.when(c.contains("/"), F.regexp_replace(c, r"/[^/]*$", "")).otherwise(".")


def base_name(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)$", 1)


def extension(c: Column) -> Column:
    """Lower-case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(c), r".\.([^.]+)$", 1))


def short_hash(c: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def line_count(c: Column) -> Column:
    """Lines of a text; a last line feed ends a line and begins none."""
    return F.when(c == "", 0).otherwise(F.size(F.split(c, "\n")) - F.when(c.endswith("\n"), 1).otherwise(0))
