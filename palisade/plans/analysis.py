"""Risk of packages by all layers of rules, for each ecosystem, name and version.

What the registry says belongs to a name in an ecosystem, and known vulnerabilities to a version of it. Both come together in one row per
package, whose signals are one array, so the rules run in one pass and the score is computed from that array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.severity import level_of, weight_of
from palisade.functions.text import inline_js
from palisade.operators import advisories, code_rules, registry, relational, rules, store
from palisade.operators.provenance import provenance
from palisade.options import Options
from palisade.plans.verdicts import KEYS, Report, verdict
from palisade.schema import SEVERITIES
from palisade.scratch import written

PACKAGE_KEYS = ["ecosystem", "name"]
#: What is kept of a result in a cache.
RESULT = "signals array<struct<signal: string, severity: string, description: string, evidence: string, layer: int>>, risk_score double, risk_level string, warnings array<string>"
#: Scores from which build attestations are asked for, and from which archives are looked into.
PROVENANCE_SCORE, ARCHIVE_SCORE = 5, 15
LOOKUP_INCOMPLETE, NO_METADATA = "vulnerability lookup incomplete", "metadata unavailable"
_HIGH = next(w for s, _, w in SEVERITIES if s == "HIGH")


def _with_ecosystem(rows: DataFrame) -> DataFrame:
    """Registry rows without an ecosystem are npm's."""
    return rows if "ecosystem" in rows.columns else rows.withColumn("ecosystem", F.lit("npm"))


def script_findings(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """Findings in the JavaScript of install scripts: ``keys, pattern, severity, hits``."""
    scripts = profiles.select(*keys, F.explode("install_scripts").alias("script", "body")).withColumn("source", inline_js(F.col("body"))).filter("source is not null")
    return code_rules.js_findings(scripts.select(*keys, "script", "source")).drop("script")


def _code_items(findings: DataFrame, keys: list[str], signal: str, what: str, into: str) -> DataFrame:
    """``keys``, ``into`` (an array of a signal for each hit), ``patterns``."""
    one = rules.item(signal, F.col("severity"), F.concat(F.lit(what), "pattern"), 1, F.struct("pattern"))
    each = findings.select(*keys, "pattern", F.array_repeat(one, F.col("hits").cast("int")).alias("items"))
    return each.groupBy(*keys).agg(F.flatten(F.array_sort(F.collect_list("items"))).alias(into), F.collect_set("pattern").alias("patterns"))


def signal_keys(opts: Options) -> list[str]:
    """What the registry's signals belong to: a name, as its latest version is now, or each version, as it was when it was the latest."""
    return KEYS if opts.as_of_version else PACKAGE_KEYS


def named_signals(wanted: DataFrame, packages: DataFrame, versions: DataFrame, opts: Options, as_of: Column) -> DataFrame:
    """Of each package of ``wanted(KEYS)`` that the registry knows, by signal_keys(): ``items`` (signals without vulnerabilities), ``package_age_ms``, ``maintainer_count``.

    Only the histories of wanted packages, and of dependencies that their latest versions added, are sorted. The profiles of both are
    written once.
    """
    none = F.array().cast("array<string>")
    of = lambda names, keys: (packages.join(names, keys, "left_semi"), versions.join(names, keys, "left_semi"))
    keys, pair = signal_keys(opts), tuple(PACKAGE_KEYS)
    versioned, wanted = wanted, written(wanted.select(*PACKAGE_KEYS).distinct(), "wanted")
    if opts.as_of_version:
        found = registry.version_profiles(*of(wanted, PACKAGE_KEYS), as_of, pair).withColumn("version", F.col("latest_version"))
        mine = written(found.join(versioned.select(*KEYS).distinct(), KEYS, "left_semi"), "profiles")
    else:
        mine = written(registry.profiles(*of(wanted, PACKAGE_KEYS), as_of, pair), "profiles")
    npm = mine.filter("ecosystem = 'npm'")
    added = written(npm.select(F.lit("npm").alias("ecosystem"), F.explode("added_deps").alias("name")).distinct(), "added")
    deps = rules.dependency_signals(npm, registry.profiles(*of(added, PACKAGE_KEYS), as_of, pair), keys)
    popular = [(e, n) for e, names in (("npm", opts.popular_npm), ("pypi", opts.popular_pypi)) for n in names]
    listed = wanted.sparkSession.createDataFrame(popular, "ecosystem string, name string")
    matches = rules.matches_of(rules.typosquats(wanted, listed, ["ecosystem"]), PACKAGE_KEYS)
    shown = _code_items(script_findings(mine, keys), keys, "AST_DANGEROUS_PATTERN", "install script: ", "code_items")
    row = mine.join(deps, keys, "left").join(matches, PACKAGE_KEYS, "left").join(shown, keys, "left")
    count = F.coalesce(F.size("maintainers"), F.lit(0))
    row = row.withColumns(
        {
            "capabilities": F.array_sort(F.concat(code_rules.capability_names(F.coalesce("patterns", none)), F.when(F.col("has_install_scripts"), F.array(F.lit("install_scripts"))).otherwise(none))),
            "dependency_count": F.size("dependencies"),
            "maintainer_count": count,
            "has_repository": F.coalesce("repository", F.lit("")) != "",
            # of the version before, only its dependencies are known
            "p_capabilities": none,
            "p_dependency_count": F.size(F.array_except("dependencies", "added_deps")) + F.size("removed_deps"),
            "p_maintainer_count": count,
            "p_has_repository": F.coalesce("repository", F.lit("")) != "",
        }
    )
    known_good = F.col("name").isin(list(opts.known_install_scripts))
    items = F.concat(
        rules.registry_rules(as_of, known_good),
        F.transform(F.coalesce("code_items", rules.no_items()), lambda x: x.withField("known_good", known_good)),
        F.coalesce("dep_signals", rules.no_items()),
        rules.change_items(F.col("previous_version").isNotNull()),
    )
    return row.select(*keys, items.alias("items"), "package_age_ms", F.size("maintainers").alias("maintainer_count"))


def judged(unique: DataFrame, vulns: DataFrame, packages: DataFrame, versions: DataFrame, opts: Options, as_of: Column, checked: DataFrame | None = None) -> DataFrame:
    """``KEYS, is_direct, signals, risk_score, risk_level, warnings`` of each row of ``unique``: what a cache may keep.

    ``vulns(ecosystem, package, version, id)`` are those of packages that the source has answered for, which ``checked(KEYS)`` lists; without it, all are.
    Ecosystems of both may have their own names or those of the advisory data.
    """
    adv = advisories.advisory_ecosystem
    theirs = ["adv", "name", "version"]
    ids = vulns.groupBy(adv(F.col("ecosystem")).alias("adv"), F.col("package").alias("name"), "version").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    named = named_signals(unique.select(*KEYS), _with_ecosystem(packages), _with_ecosystem(versions), opts, as_of)
    rows = unique.select(*KEYS, "is_direct", adv(F.col("ecosystem")).alias("adv")).join(ids, theirs, "left")
    if checked is None:
        rows = rows.withColumn("covered", F.lit(True))
    else:
        answered = checked.select(adv(F.col("ecosystem")).alias("adv"), "name", "version").distinct()
        rows = relational.left_coverage(rows, answered, theirs)
    rows = rows.join(named, signal_keys(opts), "left")
    rows = rows.withColumn("known", F.col("items").isNotNull())
    n = F.when(F.col("covered"), F.coalesce(F.size("ids"), F.lit(0))).otherwise(0)
    every = F.concat(rules.compromised(n, F.struct(n.alias("vulns"), F.col("ids").alias("ids"))), F.col("items"))
    rows = rows.withColumn("items", F.when(F.col("known"), rules.enabled_items(every, list(opts.switched_off))).otherwise(rules.no_items()))
    score = rules.risk_score_of(F.col("items"), F.col("package_age_ms"), F.col("maintainer_count"))
    rows = rows.withColumn("risk_score", F.when(F.col("known"), score).otherwise(0.0))
    warnings = F.array_compact(F.array(F.when(~F.col("known"), NO_METADATA), F.when(~F.col("covered"), LOOKUP_INCOMPLETE)))
    signals = F.transform("items", lambda x: x.dropFields("known_good"))
    return rows.select(*KEYS, "is_direct", signals.alias("signals"), "risk_score", F.when(F.col("known"), level_of(F.col("risk_score"))).otherwise("UNKNOWN").alias("risk_level"), warnings.alias("warnings"))


def with_attestations(rows: DataFrame, attestations: DataFrame) -> DataFrame:
    """``rows`` of judged(), where risky npm packages without a build attestation have one signal more; it raises the score, not ``risk_level``."""
    keys = ["name", "version"] if "version" in attestations.columns else ["name"]
    asked = rows.filter((F.col("ecosystem") == "npm") & (F.col("risk_score") >= PROVENANCE_SCORE)).select(*keys).distinct()
    absent = provenance(asked, attestations, keys).filter("has_provenance = false").select(*keys, F.lit(True).alias("absent"))
    joined = rows.join(absent, keys, "left")
    hit = F.coalesce("absent", F.lit(False)) & (F.col("ecosystem") == "npm") & (F.col("risk_score") >= PROVENANCE_SCORE)
    severity = F.when(F.size("signals") > 0, "MODERATE").otherwise("LOW")
    one = rules.item("MISSING_PROVENANCE", severity, "no build attestation", 4).dropFields("known_good")
    return joined.withColumns({"signals": F.when(hit, F.array_append("signals", one)).otherwise(F.col("signals")), "risk_score": F.col("risk_score") + F.when(hit, weight_of(severity)).otherwise(0)}).select(*rows.columns)


def with_archives(rows: DataFrame, archive_files: DataFrame, opts: Options) -> DataFrame:
    """``rows`` with what the code in packages' archives shows: those of high risk, with ``deep`` all. Each finding raises the score by that of a high one.

    ``archive_files(name, text)`` may have ``ecosystem`` and ``version``, and ``problem``: an archive that could not be read, or not whole, is a warning of its package.
    """
    keys = [k for k in KEYS if k in archive_files.columns]
    chosen = F.col("risk_level") != "UNKNOWN" if opts.deep else (F.col("ecosystem") == "npm") & (F.col("risk_score") >= ARCHIVE_SCORE) & (F.size("signals") > 0)
    mine = archive_files.join(rows.filter(chosen).select(*keys).distinct(), keys, "left_semi")
    whole = "problem" in archive_files.columns
    texts = (mine.filter("problem is null") if whole else mine).filter("text is not null")
    found = _code_items(code_rules.js_findings(texts.select(*keys, F.col("text").alias("source"))), keys, "TARBALL_DANGEROUS_PATTERN", "package file: ", "file_items").drop("patterns")
    out = rows.join(found, keys, "left")
    if whole:
        out = out.join(mine.filter("problem is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("problem")).alias("problems")), keys, "left")
    else:
        out = out.withColumn("problems", F.lit(None).cast("array<string>"))
    more = F.when(chosen, F.transform("file_items", lambda x: x.dropFields("known_good")))
    return out.select(
        *KEYS,
        "is_direct",
        F.when(more.isNotNull(), F.concat("signals", more)).otherwise(F.col("signals")).alias("signals"),
        (F.col("risk_score") + F.coalesce(F.size(more), F.lit(0)) * _HIGH).alias("risk_score"),
        "risk_level",
        F.when(chosen & F.col("problems").isNotNull(), F.concat("warnings", "problems")).otherwise(F.col("warnings")).alias("warnings"),
    )


def flagged(rows: DataFrame, opts: Options) -> DataFrame:
    """Results of a risk at or above the severity; with ``verbose``, all of them."""
    return rows if opts.verbose else advisories.filter_by_severity(rows.filter("risk_level not in ('NONE', 'UNKNOWN')"), opts.least_severity, "risk_level")


def to_analyze(deps: DataFrame, opts: Options) -> DataFrame:
    """The npm and PyPI dependencies, each once: of each file the direct ones if it has any, with ``verbose`` all."""
    mine = deps.filter("ecosystem in ('npm', 'pypi')")
    if not opts.verbose:
        mine = relational.prefer(mine, ["source_file"], F.coalesce(F.col("is_direct"), F.lit(False))).drop("fallback")
    return relational.first_wins(mine, KEYS, ["source_file", "ord"])


def _report(rows: DataFrame, opts: Options, failures: DataFrame | None) -> Report:
    rows = written(rows, "analyzed").withColumn("risk_level_final", F.when(F.col("risk_level") != "UNKNOWN", level_of(F.col("risk_score"))).otherwise("UNKNOWN"))
    shown = flagged(rows, opts)
    return Report(shown, verdict(rows.select((F.size("warnings") == 0).alias("covered")), failures, shown.filter("risk_level not in ('NONE', 'UNKNOWN')")))


def analyze(deps: DataFrame, vulns: DataFrame, packages: DataFrame, versions: DataFrame, opts: Options, as_of: Column, attestations: DataFrame | None = None, archive_files: DataFrame | None = None, checked: DataFrame | None = None, failures: DataFrame | None = None) -> Report:
    """Risk of each npm or PyPI dependency by ecosystem, name and version. ``rows``: one per package, with its signals and warnings.

    A package that the registry doesn't know has level UNKNOWN. Such packages, those whose vulnerability lookup had no answer, those whose archives could not
    be read, and files that could not be parsed (``failures``) make the verdict incomplete. What attestations and archives add
    raises the score, not ``risk_level``; ``risk_level_final`` counts it. ``packages`` and ``versions`` without ``ecosystem`` are npm's.
    """
    rows = judged(to_analyze(deps, opts), vulns, packages, versions, opts, as_of, checked)
    return _report(_enriched(rows, opts, attestations, archive_files), opts, failures)


def _enriched(rows: DataFrame, opts: Options, attestations: DataFrame | None, archive_files: DataFrame | None) -> DataFrame:
    steps = []
    if attestations is not None:
        steps.append(lambda r: with_attestations(r, attestations))
    if archive_files is not None:
        steps.append(lambda r: with_archives(r, archive_files, opts))
    return reduce(lambda r, step: step(r), steps, rows)


def analyze_cached(deps: DataFrame, cached: DataFrame, vulns: DataFrame, packages: DataFrame, versions: DataFrame, opts: Options, as_of: Column, attestations: DataFrame | None = None, archive_files: DataFrame | None = None, checked: DataFrame | None = None, failures: DataFrame | None = None) -> tuple[Report, DataFrame]:
    """As analyze(), where fresh entries of ``cached(KEYS, data, analyzed_at)`` answer first; also the cache with what is new.

    Only complete results are kept: no warnings, no unknown level. Entries that can't be read count as missing. What
    attestations and archives add is never cached.
    """
    unique = to_analyze(deps, opts)
    wanted = unique.select(*KEYS, "is_direct")
    readable = store.parsed(cached, RESULT, "data").select(*KEYS, "value", "analyzed_at")
    parted = store.partition_by_cache(wanted, readable, KEYS, as_of, None if opts.any_age else opts.metadata_ttl_ms, at="analyzed_at")
    old = parted.filter("hit").select(*KEYS, "is_direct", "value.*")
    missed = parted.filter("not hit").select(*KEYS, "is_direct")
    new = written(judged(missed, vulns, packages, versions, opts, as_of, checked), "judged")
    data = F.to_json(F.struct("signals", "risk_score", "risk_level", "warnings"))
    kept = store.cacheable(new.withColumns({"covered": F.lit(True), "details_missing": F.lit(False)})).select(*KEYS, data.alias("data"), as_of.alias("analyzed_at"))
    rows = _enriched(old.unionByName(new), opts, attestations, archive_files)
    return _report(rows, opts, failures), store.upsert(cached.select(*KEYS, "data", "analyzed_at"), kept, KEYS)
