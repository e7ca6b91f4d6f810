"""What build attestations say of a package: present, known to be absent, or unknown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATEMENT = "predicate struct<buildType: string, invocation: struct<configSource: struct<uri: string>>>"


def provenance(packages: DataFrame, attestations: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``has_provenance`` (true, false, null: unknown), ``build_type``, ``source_repo``, ``transparency``.

    ``attestations(keys, ord, payload, tlog_entries, fetched)``: rows with ``fetched`` false say that the lookup failed. A package
    without rows has none. Payloads that can't be read prove nothing; the last value that isn't null counts.
    """
    said = F.try_to_binary(F.col("payload"), F.lit("base64")).cast("string")
    read = attestations.withColumn("statement", F.from_json(said, STATEMENT))
    fine = F.col("statement.predicate").isNotNull() | said.rlike(r"^\s*\{")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ord")))
    flat = read.withColumns({"fine": F.coalesce(fine, F.lit(False)), "build": F.col("statement.predicate.buildType"), "uri": F.col("statement.predicate.invocation.configSource.uri")})
    found = flat.groupBy(*keys).agg(
        F.bool_or(~F.coalesce("fetched", F.lit(True))).alias("failed"), F.bool_or("fine").alias("any_fine"), last("build").alias("build_type"), last("uri").alias("source_repo"), F.bool_or(F.col("fine") & (F.col("tlog_entries") > 0)).alias("logged")
    )
    joined = packages.join(found, keys, "left")
    has = F.when(F.col("failed").isNull(), F.lit(False)).when(F.col("failed"), F.lit(None)).when(F.col("any_fine"), F.lit(True))
    return joined.select(*keys, has.alias("has_provenance"), "build_type", "source_repo", F.when(F.col("logged"), "verified").alias("transparency"))
