"""What every pipeline returns: rows, and a verdict that never calls an incomplete answer clean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators import relational

KEYS = ["ecosystem", "name", "version"]


@dataclass
class Report:
    """Rows of findings, and a one-row verdict: counts, ``complete``, ``exit_code``."""

    rows: DataFrame
    verdict: DataFrame


def verdict(coverage: DataFrame, failures: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Of ``coverage(covered)``, one row per thing that had to be looked at, files that failed, and the findings."""
    parts = relational.completeness(coverage).drop("failed")
    failed = failures.agg(F.count("*").alias("failed")) if failures is not None else coverage.sparkSession.range(1).select(F.lit(0).cast("long").alias("failed"))
    found = rows.agg(F.count("*").alias("findings"))
    one = parts.crossJoin(failed).crossJoin(found)  # one row each
    one = one.withColumn("complete", F.col("complete") & (F.col("failed") == 0))
    return one.withColumn("exit_code", relational.exit_code(F.col("complete"), F.col("findings")))
