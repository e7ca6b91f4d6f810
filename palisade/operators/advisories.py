"""Advisory lookups as joins, and vulnerabilities in one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.severity import advisory_severity, display_id, fixed_version, named, order_of
from palisade.operators.relational import bitmap_filtered, left_coverage
from palisade.schema import ECOSYSTEMS, SEVERITIES


def advisory_ecosystem(ecosystem: Column) -> Column:
    """The advisory data's name of an ecosystem; names that aren't known pass through, those without advisories are null."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for own, theirs, _, _ in ECOSYSTEMS:
        out = out.when(ecosystem.isin(own, theirs) if theirs else ecosystem == own, F.lit(theirs).cast("string"))
    return out.otherwise(ecosystem)


def supported(deps: DataFrame) -> DataFrame:
    """Dependencies whose ecosystem has advisories."""
    return deps.filter(advisory_ecosystem(F.col("ecosystem")).isNotNull())


def lookup(deps: DataFrame, index: DataFrame, checked: DataFrame | None = None, narrow: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hits ``ecosystem, name, version, id`` and coverage of each distinct package.

    ``index`` holds the packages' advisory ids, ``checked`` the packages that the source has answered for. Without it, all are. With ``narrow``, an
    index much larger than ``deps`` is filtered by a bitmap of their keys where it is read.
    """
    keys = ["ecosystem", "name", "version"]
    wanted = deps.select(advisory_ecosystem(F.col("ecosystem")).alias("ecosystem"), "name", "version").filter("ecosystem is not null").distinct()
    known = index.select(*keys, "id").filter("id is not null and id != ''")
    known = bitmap_filtered(known, wanted, keys) if narrow else known
    hits = wanted.join(known.distinct(), keys)
    coverage = wanted.withColumn("covered", F.lit(True)) if checked is None else left_coverage(wanted, checked.select(*keys).distinct(), keys)
    return hits, coverage


def vulnerabilities(hits: DataFrame, details: DataFrame) -> DataFrame:
    """One row per package and advisory. An advisory without details counts as CRITICAL and is marked, never left out."""
    joined = left_coverage(hits, details, ["id"])
    scores = F.filter(F.col("severity")["score"], lambda s: s.isNotNull())
    severity = advisory_severity(F.col("database_specific.severity"), F.col("affected")["ecosystem_specific"]["severity"], scores)
    return joined.select(
        "id",
        F.when(F.col("covered"), display_id(F.col("aliases"), F.col("id"))).otherwise(F.col("id")).alias("display_id"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(F.nullif("summary", F.lit("")), F.lit("No description available")).alias("summary"),
        F.when(F.col("covered"), severity).otherwise("CRITICAL").alias("severity"),
        F.col("name").alias("package"),
        "version",
        "ecosystem",
        fixed_version(F.col("affected"), F.col("name")).alias("fixed"),
        F.concat(F.lit("https://osv.dev/vulnerability/"), F.url_encode("id")).alias("url"),
        F.filter(F.coalesce(F.col("references")["url"], F.array().cast("array<string>")), lambda u: F.coalesce(u, F.lit("")) != "").alias("references"),
        (~F.col("covered")).alias("details_missing"),
    )


def filter_by_severity(rows: DataFrame, least: str | None, column: str = "severity") -> DataFrame:
    """Rows of ``least`` or worse. Rows of unknown severity stay, and an unknown ``least`` keeps all."""
    bound = {s: o for s, o, _ in SEVERITIES}.get((least or "").upper(), 0)
    order = order_of(F.col(column))
    return rows.filter(order.isNull() | (order >= bound))


def count_by_severity(rows: DataFrame, column: str = "severity") -> DataFrame:
    """One row with the number of rows of each of the four severities."""
    return rows.agg(*[F.count_if(F.col(column) == s).alias(s.lower()) for s, _, _ in SEVERITIES])


def worst(column: str = "severity") -> Column:
    """An aggregate: the worst severity, LOW if there is none."""
    return F.coalesce(named(F.max(order_of(F.col(column)))), F.lit("LOW"))


def best_fixes(vulns: DataFrame) -> DataFrame:
    """Of each package, the highest version that fixes something."""
    from palisade.functions.versions import semver_key

    version = F.regexp_replace("fixed", r"^>=\s*", "")
    return vulns.filter("fixed is not null").withColumn("v", version).groupBy("ecosystem", "package").agg(F.max_by("v", F.struct(semver_key(F.col("v")), "v")).alias("best_fix"))


def verified_fixes(vulns: DataFrame, known_bad: DataFrame, keys: list[str] | None = None, checked: DataFrame | None = None) -> DataFrame:
    """Of each package, the highest fixing version that isn't vulnerable itself; null if there is none. ``known_bad(keys, version)``.

    ``checked(keys, version)`` are the versions that the source has answered for; others are no candidates, and ``unverified`` counts them.
    """
    from palisade.functions.versions import semver_key

    keys = keys or ["package"]
    version = F.regexp_replace("fixed", r"^>=\s*", "")
    candidates = vulns.filter("fixed is not null").select(*keys, version.alias("version")).distinct()
    safe = candidates.join(known_bad.select(*keys, "version").distinct(), [*keys, "version"], "left_anti")
    safe = safe.withColumn("covered", F.lit(True)) if checked is None else left_coverage(safe, checked.select(*keys, "version").distinct(), [*keys, "version"])
    best = safe.groupBy(*keys).agg(F.max_by(F.when(F.col("covered"), F.col("version")), F.when(F.col("covered"), F.struct(semver_key(F.col("version")), "version"))).alias("fix"), F.count_if(~F.col("covered")).alias("unverified"))
    counted = vulns.groupBy(*keys).agg(F.count("*").alias("vuln_count"), F.array_sort(F.collect_set("id")).alias("vuln_ids"))
    return counted.join(best, keys, "left").withColumn("unverified", F.coalesce("unverified", F.lit(0).cast("long")))
