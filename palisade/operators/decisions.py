"""Whether an installation may go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guard_inputs(results: DataFrame, keys: list[str]) -> DataFrame:
    """Per ``keys``: counts of critical, high and unknown results, ``has_vulns``, ``complete``. ``results(risk_level, vulns, covered, warnings)``."""
    level = F.col("risk_level")
    return results.groupBy(*keys).agg(
        F.count_if(level == "CRITICAL").alias("critical"),
        F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "UNKNOWN").alias("unknown"),
        F.bool_or(F.coalesce("vulns", F.lit(0)) > 0).alias("has_vulns"),
        F.bool_and(F.col("covered") & (F.coalesce("warnings", F.lit(0)) == 0) & (level != "UNKNOWN")).alias("complete"),
    )


def decision(force: Column) -> Column:
    """allow, allow_forced, prompt or block. Critical results and known vulnerabilities block even if forced."""
    return (
        F.when((F.col("critical") > 0) | F.col("has_vulns"), "block")
        .when(~F.col("complete"), F.when(force, "allow_forced").otherwise("block"))
        .when(F.col("high") > 0, F.when(force, "allow_forced").otherwise("prompt"))
        .otherwise("allow")
    )
