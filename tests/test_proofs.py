from pyspark.sql import functions as F

from lattice.functions import proofs


def test_classes_and_precedence(spark):
    cases = [
        ("test_import", "high", "npm test", "hard", 6),
        ("test_import", "low", "npm test", "hard", 6),
        ("test_import", "high", None, "direct_evidence", 6),
        ("test_import_via_direct_consumer", "high", "npm test", "mediated_evidence", 4),
        ("test_surface_tokens_via_direct_dependency", "medium", None, "mediated_evidence", 0),
        ("test_support_import", "high", "npm test", "mediated_evidence", 5),
        ("e2e_route_owning_file", "high", "npx playwright test", "mediated_evidence", 5),
        ("test_name", "hard", "npm test", "soft_evidence", 3),
        ("script_path_token", "hard", None, "soft_evidence", 0),
        ("ci_run_validation", "medium", "npm run lint", "soft_evidence", 0),
        ("ci_run_validation", "hard", "npm run lint", "hard", 0),
        ("ci_setup_step", "hard", "npm test", "setup_support", 0),
        ("test_import", "high", "NPM  'run'   dev", "setup_support", 6),
        ("ci_run_validation", "hard", "pnpm db:migrate", "setup_support", 0),
        ("ci_run_validation", "hard", "pnpm prisma migrate status", "hard", 0),
        ("ci_run_validation", "hard", "pnpm db:migrate:status && pnpm db:seed", "setup_support", 0),
        ("e2e_route:/users", "high", "npm test", "hard", 5),
        ("anything", None, None, "soft_evidence", 0),
    ]
    df = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(cases)], "i int, evidence string, strength string, command string")
    got = {r["i"]: (r["c"], r["p"]) for r in df.select("i", proofs.proof_class(F.col("evidence"), F.col("strength"), F.col("command")).alias("c"), proofs.precedence(F.col("evidence")).alias("p")).collect()}
    assert got == {i: x[3:] for i, x in enumerate(cases)}
