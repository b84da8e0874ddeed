"""What a public name of a file means: a fixpoint over export and re-export edges.

The states of a (file, name) form a small lattice: missing, then one owner, then ambiguous. A name that a file exports explicitly
is decided by that alone: one local declaration, or whatever the one file that it is taken from means by its name there; two
explicit exports are ambiguous, and an explicit one that leads nowhere is missing. Other names but ``default`` come through stars: from
exactly one of them they keep its meaning, from several they are ambiguous. What leads back to a file that it came through counts as missing.

States only grow, so a round joins only the names that have changed since the round before with the edges that lead away from them. What comes
to a name that is known already makes it ambiguous, from whichever file it comes, so that nothing has to be kept but the states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .joins import small

ONE, AMBIGUOUS = 1, 2
_STATE = ["file", "name", "kind", "owner", "symbol", "path"]


def public_names(exports: DataFrame, reexports: DataFrame, stars: DataFrame, rounds: int = 200) -> DataFrame:
    """file, name, status (one or ambiguous), owner, symbol and hops of each public name that isn't missing.

    exports: file, name, symbol (null: it names nothing, which still hides what stars bring); reexports: file, name, source, source_name (a
    null source is outside); stars: file, source. An ambiguous name has no owner. hops counts the files between. Repeated rows of exports and
    reexports are two exports of one name; repeated stars are one. A name is settled after as many rounds as its longest chain of files has.
    """
    own = exports.select("file", "name", F.struct(F.col("symbol"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("source_name")).alias("e"))
    taken = reexports.select("file", "name", F.struct(F.lit(None).cast("string").alias("symbol"), "source", "source_name").alias("e"))
    explicit = cut(own.unionByName(taken).groupBy("file", "name").agg(F.count("*").alias("n"), F.min("e").alias("e")))
    links = cut(stars.filter("source IS NOT NULL AND source <> file").select("file", "source").distinct())
    aliases = cut(explicit.filter("n = 1 AND e.source IS NOT NULL").select("file", "name", "e.source", "e.source_name"))
    none = F.lit(None).cast("string")
    clashing = explicit.filter("n > 1").select("file", "name", F.lit(AMBIGUOUS).alias("kind"), none.alias("owner"), none.alias("symbol"), F.array("file").alias("path"))
    local = explicit.filter("n = 1 AND e.symbol IS NOT NULL").select("file", "name", F.lit(ONE).alias("kind"), F.col("file").alias("owner"), "e.symbol", F.array("file").alias("path"))
    # all of a module under one name: the module itself
    whole = aliases.filter("source_name = '*'").select("file", "name", F.lit(ONE).alias("kind"), F.col("source").alias("owner"), F.lit("*").alias("symbol"), F.array("source", "file").alias("path"))
    states = cut(clashing.unionByName(local).unionByName(whole))
    # what has come to be known, round by round; a name comes at most twice, and then stays ambiguous
    log, again, changed = states, None, states
    for _ in range(rounds):
        # what comes to a name meets what is known of it in one shuffle and one sort: whether its file exports it explicitly, and which kind it had, from another
        # file, or from this one, which has become ambiguous since
        rows = _arrived(_through_stars(changed, links), "star").unionByName(_arrived(_through_aliases(changed, aliases), "alias"), allowMissingColumns=True)
        rows = rows.unionByName(explicit.select("file", "name", F.lit(True).alias("said")), allowMissingColumns=True).unionByName(log.select("file", "name", F.col("kind").alias("was")), allowMissingColumns=True)
        of = lambda way: F.any_value(F.when(F.col(way).isNotNull(), F.col("x")), ignoreNulls=True).alias(f"x_{way}")
        met = rows.repartition("file", "name").groupBy("file", "name").agg(F.count("star").alias("n"), F.max("star").alias("star"), F.max("alias").alias("alias"), F.max("said").alias("said"), F.max("was").alias("was"), of("star"), of("alias"))
        # an explicit name has only what it is taken from
        by = lambda taken, starred: F.when(F.col("said"), taken).otherwise(starred)
        met = met.select("file", "name", by(F.lit(1).cast("long"), F.col("n")).alias("n"), by(F.col("alias"), F.col("star")).alias("kind"), by(F.col("x_alias"), F.col("x_star")).alias("x"), "was")
        met = met.filter(F.col("kind").isNotNull() & (F.col("was").isNull() | (F.col("was") == ONE)))
        several = (F.col("n") > 1) | (F.col("kind") == AMBIGUOUS) | F.col("was").isNotNull()
        only = lambda c, nothing: F.when(~several, F.concat(F.col("x.path"), F.array("file")) if c == "path" else F.col(f"x.{c}")).otherwise(nothing).alias(c)
        now = met.select("file", "name", F.when(several, AMBIGUOUS).otherwise(ONE).alias("kind"), only("owner", none), only("symbol", none), only("path", F.array("file")), F.col("was").isNotNull().alias("again"))
        now = cut(now)
        if now.isEmpty():
            return _named(log if again is None else log.join(small(again.withColumn("kind", F.lit(ONE))), ["file", "name", "kind"], "left_anti"))
        more = now.filter("again").select("file", "name")
        if not more.isEmpty():
            again = more if again is None else again.unionByName(more)
        changed = now.select(*_STATE)
        log = log.unionByName(changed)
    raise RuntimeError(f"names did not settle in {rounds} rounds")


def _named(states: DataFrame) -> DataFrame:
    return states.select("file", "name", F.when(F.col("kind") == ONE, "one").otherwise("ambiguous").alias("status"), "owner", "symbol", F.when(F.col("kind") == ONE, F.size("path") - 1).alias("hops"))


def _arrived(rows: DataFrame, way: str) -> DataFrame:
    """What comes to names on this way, with its kind under that name; what leads back to a file that it came through doesn't."""
    rows = rows.filter(~F.array_contains("path", F.col("file")) | (F.col("kind") == AMBIGUOUS))
    return rows.select("file", "name", F.col("kind").alias(way), F.struct("owner", "symbol", "path").alias("x"))


def _through_aliases(changed: DataFrame, aliases: DataFrame) -> DataFrame:
    met = changed.withColumnsRenamed({"file": "source", "name": "source_name"}).join(aliases.filter("source_name <> '*'"), ["source", "source_name"])
    return met.select(*_STATE)


def _through_stars(changed: DataFrame, links: DataFrame) -> DataFrame:
    return changed.filter("name <> 'default'").withColumnRenamed("file", "source").join(links, "source").select(*_STATE)


def exported(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """file, name and symbol of what ``bindings`` say that files export themselves. An entry of an export list that names no declaration of its
    file has a null symbol; a default without a name is called default."""
    rows = bindings.filter("form IN ('export', 'default')").select(F.col("rel").alias("file"), F.col("local").alias("public"), "name")
    declared = symbols.select(F.col("rel").alias("file"), "name", F.lit(True).alias("declared")).distinct()
    symbol = F.when(F.col("name").isNull(), "default").when(F.col("declared"), F.col("name"))
    return rows.join(declared, ["file", "name"], "left").select("file", F.col("public").alias("name"), symbol.alias("symbol"))


def consumers(bindings: DataFrame, public: DataFrame) -> DataFrame:
    """rel, line, local, owner, symbol, through (the file that the import names) and evidence of each import of a name that means one symbol.
    bindings: with target, the file of their spec."""
    asked = bindings.filter("form = 'import' AND name <> '*' AND target IS NOT NULL").select("rel", "line", "local", F.col("target").alias("file"), "name")
    met = asked.join(public.filter("status = 'one'"), ["file", "name"]).filter("owner <> rel")
    evidence = F.when(F.col("owner") == F.col("file"), "imported_symbol_reference").otherwise("reexported_symbol_reference")
    return met.select("rel", "line", "local", "owner", "symbol", F.col("file").alias("through"), evidence.alias("evidence"))
