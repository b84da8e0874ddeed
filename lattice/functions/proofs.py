"""Classes and precedence of proofs, from their evidence, strength and command."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import STRENGTHS, rank_of

#: How evidence says that it is about another file than the one in question.
THROUGH = ("_via_direct_consumer", "_via_direct_dependency", "_via_local_symbol_consumer")
OWNING = "_owning_file"
#: Kinds of evidence that prepare or release, that match by likeness only, and that validate the thing itself.
SETUP = ("ci_run_setup", "ci_setup_step", "ci_run_release", "ci_release_step", "manifest_script_setup")
SOFT = ("script_path_token", "script_surface_match", "test_name", "e2e_surface_phrase", "e2e_path_surface", "test_surface_phrase", "test_surface_tokens", "test_role_surface_match")
DIRECT = ("test_import", "test_imported_symbol_reference", "test_reexported_symbol_reference", "test_symbol_reference", "e2e_route", "current_level_proof_container")
#: Parts of commands that prepare, watch, serve or release.
SETUP_PARTS = (
    " install", ":install", " setup", " watch", ":watch", "-watch", " run dev", " run start", " run serve", " run preview", " codegen", ":codegen", " generate", ":generate",
    " seed", ":seed", " studio", ":studio", " db push", " db:push", ":db:push", "db:push", "db:normalize", "prisma/normalize", " deploy", ":deploy", " release", ":release",
    " publish", ":publish", " destroy", ":destroy", " delete", ":delete", " drop", ":drop", " prune", ":prune", " reset", ":reset",
)
MIGRATES = ("db:migrate", " migrate", ":migrate", "migration run")
ONLY_READS = ("migrate status", "migrate:status")
#: Precedence of evidence, 0 for all other.
PRECEDENCE = {
    "test_import": 6, "test_imported_symbol_reference": 6, "test_reexported_symbol_reference": 6, "e2e_route": 5, "test_support_import": 5, "test_symbol_reference": 4,
    "test_name": 3, "e2e_surface_phrase": 3, "e2e_path_surface": 2, "test_surface_phrase": 2, "test_role_surface_match": 1, "test_surface_tokens": 1,
}


def _ends(c: Column, endings: tuple[str, ...]) -> Column:
    return F.rlike(c, F.lit("(?:" + "|".join(endings) + ")$"))


def base_evidence(evidence: Column) -> Column:
    """Evidence without what it says about another file."""
    return F.regexp_replace(evidence, "(?:" + "|".join((*THROUGH, OWNING)) + ")$", "")


def _holds(c: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(c, F.lit(p))
    return out


def prepares(command: Column) -> Column:
    """Whether a command prepares, serves or releases instead of validating; one that only reads the state of migrations doesn't."""
    plain = F.trim(F.regexp_replace(F.translate(F.lower(command), "'\"`", "   "), r"\s+", " "))
    return F.coalesce(_holds(plain, SETUP_PARTS) | (_holds(plain, MIGRATES) & ~_holds(plain, ONLY_READS)), F.lit(False))


def proof_class(evidence: Column, strength: Column, command: Column) -> Column:
    """setup_support, mediated_evidence, soft_evidence, hard or direct_evidence: the first that fits. hard is what can be run and validates the thing itself; a
    null command can't be run; a null strength is the weakest."""
    base, through = base_evidence(evidence), _ends(evidence, THROUGH)
    strong = rank_of(strength, STRENGTHS) >= STRENGTHS.index("high")
    direct = base.isin(*DIRECT) & ~through
    return (
        F.when(base.isin(*SETUP) | prepares(command), "setup_support")
        .when(through | (base == "test_support_import") | evidence.endswith(OWNING), "mediated_evidence")
        .when(base.isin(*SOFT) | (~strong & ~direct), "soft_evidence")
        .when(command.isNotNull(), "hard")
        .otherwise("direct_evidence")
    )


def precedence(evidence: Column) -> Column:
    """How much evidence counts, two less (0 at least) where it is about another file that leads here. What follows a colon doesn't count."""
    through = _ends(evidence, THROUGH)
    base = base_evidence(F.substring_index(evidence, ":", 1))
    rank = F.lit(0)
    for name, n in PRECEDENCE.items():
        rank = F.when(base == name, n).otherwise(rank)
    return F.when(through, F.greatest(rank - 2, F.lit(0))).otherwise(rank)
