"""Counts and absences with their certainty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_fact(n: Column, eligible: Column, visited: Column) -> list[Column]:
    """status (counted, proven_zero or unknown), value (null if unknown) and lower_bound of a count among what was visited."""
    known = (n > 0) | (eligible == visited)
    status = F.when(n > 0, "counted").when(eligible == visited, "proven_zero").otherwise("unknown")
    return [status.alias("status"), F.when(known, n).alias("value"), n.alias("lower_bound")]


def closure(closed: Column, reasons: Column) -> Column:
    """closure and reasons that agree: with a reason nothing is closed, and what is not closed has a reason."""
    open_ = ~closed | (F.size(reasons) > 0)
    why = F.when(open_ & (F.size(reasons) == 0), F.array(F.lit("unclassified_coverage_gap"))).otherwise(F.array_sort(reasons))
    return F.struct(F.when(open_, "open").otherwise("closed").alias("closure"), why.alias("reasons"))


def certificate_id(*parts: Column) -> Column:
    return F.concat(F.lit("cov-"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 16))


def horizons(rows: DataFrame, group: list[str], limit: int, command: str) -> DataFrame:
    """observed, shown and hidden of each group under a limit, and the command that shows more where something is hidden."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("observed"))
    shown = F.least(F.col("observed"), F.lit(limit).cast("long"))
    return counts.withColumn("shown", shown).withColumn("hidden", F.col("observed") - shown).withColumn("expand", F.when(F.col("observed") > limit, F.concat(F.lit(command + " --limit "), F.col("observed").cast("string"))))
