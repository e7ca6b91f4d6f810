"""The library's questions as pipelines of its operators. Inputs and results are DataFrames; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.severity import order_of
from palisade.functions.text import shell_quoted
from palisade.operators import advisories, decisions, relational, store
from palisade.options import Options
from palisade.plans.analysis import analyze, analyze_cached, flagged  # noqa: F401
from palisade.plans.verdicts import KEYS, Report, verdict
from palisade.schema import ECOSYSTEMS
from palisade.scratch import written
from palisade.sources import discovery, parsers


def dependencies(files: DataFrame, opts: Options) -> tuple[DataFrame, DataFrame]:
    """All dependencies of ``files(path, dir, file, content)`` in the chosen ecosystems, and the files that couldn't be parsed."""
    chosen = discovery.preferred_files(files).filter(F.col("ecosystem").isin(list(opts.ecosystems)))
    return parsers.parse_all(chosen.select("path", "content"), every=files), parsers.parse_failures(chosen.select("path", "content"))


def watched(files: DataFrame, opts: Options) -> DataFrame:
    """What the lockfiles of a folder, or its manifests, hold at this moment, for streaming.watch.write_snapshot()."""
    return relational.snapshot(dependencies(files, opts)[0])


def scan(deps: DataFrame, index: DataFrame, details: DataFrame, opts: Options, checked: DataFrame | None = None, failures: DataFrame | None = None) -> Report:
    """Known vulnerabilities of dependencies at or above a severity, the worst first, and whether the answer is complete.

    They are written once, for rows, verdict and reports. With ``narrow_lookup``, an index much larger than ``deps`` loses other packages' rows where it is read.
    """
    unique = relational.first_wins(deps, KEYS, ["source_file", "ord"])
    hits, coverage = advisories.lookup(advisories.supported(unique), index, checked, opts.narrow_lookup)
    vulns = advisories.filter_by_severity(written(advisories.vulnerabilities(hits, details), "vulnerabilities"), opts.least_severity)
    ranked = vulns.orderBy(F.coalesce(order_of(F.col("severity")), F.lit(99)).desc(), "package", "version", "id")
    return Report(ranked, verdict(coverage, failures, vulns))


def scan_cached(deps: DataFrame, cached: DataFrame, index: DataFrame, details: DataFrame, opts: Options, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """As scan(), where fresh entries of ``cached(ecosystem, name, version, fetched_at, vulns)`` answer first: vulnerabilities, new cache."""
    wanted = deps.select(advisories.advisory_ecosystem(F.col("ecosystem")).alias("ecosystem"), "name", "version").filter("ecosystem is not null").distinct()
    parted = store.partition_by_cache(wanted, cached, KEYS, as_of, None if opts.any_age else opts.advisory_ttl_ms)
    old = parted.filter("hit").select(F.inline("vulns"))
    missed = parted.filter("not hit").select(*KEYS)
    hits, coverage = advisories.lookup(missed, index)
    new = written(advisories.vulnerabilities(hits, details), "vulnerabilities")
    shape = F.struct(*[F.col(c) for c in new.columns])
    per_package = new.filter("not details_missing").groupBy("ecosystem", F.col("package").alias("name"), "version").agg(F.collect_list(shape).alias("vulns"))
    partial = new.filter("details_missing").select("ecosystem", F.col("package").alias("name"), "version").distinct()
    fresh = coverage.filter("covered").join(partial, KEYS, "left_anti").join(per_package, KEYS, "left").select(*KEYS, as_of.alias("fetched_at"), F.coalesce("vulns", F.array().cast(per_package.schema["vulns"].dataType)).alias("vulns"))
    return old.unionByName(new), store.upsert(cached, fresh, KEYS)


def fix(vulns: DataFrame, index: DataFrame, current: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Of each vulnerable package the highest fixing version without known problems, and the command to get it.

    ``current(package, ecosystem, version)`` is what is installed; ``index`` has the ids of vulnerable versions, ``checked`` the package versions that the
    source has answered for (without it, all). A version without an answer is never recommended. Packages are told apart by ecosystem
    where ``vulns`` has it.
    """
    keys = ["ecosystem", "package"] if "ecosystem" in vulns.columns else ["package"]
    of = lambda rows: _own(rows).select(*keys, "version")
    best = advisories.verified_fixes(_own(vulns, "package"), of(index), keys, of(checked) if checked is not None else None)
    package, version = shell_quoted(F.col("package")), shell_quoted(F.col("fix"))
    command = (
        F.when(F.col("ecosystem") == "npm", F.concat(F.lit("npm install "), package, F.lit("@"), version))
        .when(F.col("ecosystem") == "pypi", F.concat(F.lit("pip install "), package, F.lit("=="), version))
        .when(F.col("ecosystem") == "cargo", F.concat(F.lit("cargo update -p "), package, F.lit(" --precise "), version))
        .otherwise(F.concat(F.lit("# upgrade "), package, F.lit(" to "), version))
    )
    reason = F.when(F.col("fix").isNull(), F.when(F.col("unverified") > 0, "unverified fix").otherwise("no verified fix"))
    return best.join(current, keys, "left").select("package", "ecosystem", F.col("version").alias("current_version"), "vuln_count", "vuln_ids", "fix", F.when(F.col("fix").isNotNull(), command).alias("command"), reason.alias("reason"), "unverified")


def _own(rows: DataFrame, name: str = "name") -> DataFrame:
    """With the library's names of ecosystems, and the name as ``package``."""
    out = rows.withColumn("package", F.col(name))
    if "ecosystem" not in rows.columns:
        return out
    theirs = {e[1]: e[0] for e in ECOSYSTEMS if e[1]}
    return out.withColumn("ecosystem", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in theirs.items() for x in pair]), F.col("ecosystem")), "ecosystem"))


def fix_all(deps: DataFrame, index: DataFrame, details: DataFrame, opts: Options, checked: DataFrame | None = None, failures: DataFrame | None = None) -> Report:
    """Fixes for the vulnerable packages of ``deps``, and a verdict: complete if all packages and all fixing versions had an answer and all files could be parsed.

    Findings are the packages without a recommendation.
    """
    unique = relational.first_wins(deps, KEYS, ["source_file", "ord"])
    hits, coverage = advisories.lookup(advisories.supported(unique), index, checked)
    vulns = advisories.filter_by_severity(written(advisories.vulnerabilities(hits, details), "vulnerabilities"), opts.least_severity)
    current = unique.groupBy("ecosystem", F.col("name").alias("package")).agg(F.min("version").alias("version"))
    rows = written(fix(vulns, index, current, checked), "fixes")
    asked = coverage.select("covered").unionByName(rows.select((F.col("unverified") == 0).alias("covered")))
    return Report(rows, verdict(asked, failures, rows.filter("fix is null")))


def guard(before: DataFrame, after: DataFrame, results: DataFrame, opts: Options) -> DataFrame:
    """One row: counts and the decision on the packages that an installation adds or changes. ``results`` has their levels by KEYS."""
    diff = relational.diff_snapshots(before, after)
    todo = relational.changed_packages(diff)
    judged = relational.left_coverage(todo, results.select(*KEYS, "risk_level", "vulns", "warnings"), KEYS).withColumn("risk_level", F.coalesce("risk_level", F.lit("UNKNOWN")))
    inputs = decisions.guard_inputs(judged, [])
    filled = inputs.withColumns({"has_vulns": F.coalesce("has_vulns", F.lit(False)), "complete": F.coalesce("complete", F.lit(True))})
    return relational.diff_summary(diff).crossJoin(filled).withColumn("decision", decisions.decision(F.lit(opts.force)))  # one row each


def monitor_ci(deps: DataFrame, index: DataFrame, details: DataFrame, opts: Options, checked: DataFrame | None = None, failures: DataFrame | None = None) -> Report:
    """As scan(), for build servers: HIGH and worse unless a severity is given; sinks.reports writes it."""
    return scan(deps, index, details, opts, checked, failures)
