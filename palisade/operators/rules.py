"""The rule engine: rules turn a profile into an array of signals, all in one pass, and the array is scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.severity import level_of, weight_of
from palisade.functions.text import homoglyphs, typosquat_limit
from palisade.operators.registry import millis_between
from palisade.schema import DANGEROUS, DAY_MS, PROTECTED_SIGNALS

TEN_MINUTES_MS, TWO_DAYS_MS, WEEK_MS, MONTH_MS, YEAR_MS = 600_000, 2 * DAY_MS, 7 * DAY_MS, 30 * DAY_MS, 365 * DAY_MS

#: Rows of popular names' deletions up to which they are broadcast, about 50 bytes each.
MOST_BROADCAST = 200_000


def maintainer_severity(since: Column, maintainers: Column) -> Column:
    """A change of publisher is critical for 90 days from ``since`` (ms ago; null: now); then low in teams, else moderate."""
    recent = F.coalesce(since, F.lit(0)) < 90 * DAY_MS
    return F.when(recent, "CRITICAL").when(F.coalesce(maintainers, F.lit(0)) >= 3, "LOW").otherwise("MODERATE")


def rapid_severity(interval: Column, maintainers: Column, known_good: Column) -> Column:
    """Of a version that follows the last one within ten minutes; null for others. Automated releases are low."""
    automated = (interval == 0) & (F.coalesce(maintainers, F.lit(0)) >= 2)
    return F.when((interval >= 0) & (interval < TEN_MINUTES_MS), F.when(automated | known_good, "LOW").otherwise("HIGH"))


#: Letters of a word that its deletion neighbourhood is made of.
PREFIX = 12


def _deletions(word: Column, most: Column) -> Column:
    """Hashes of ``word``'s first PREFIX letters with up to ``most`` (0 to 2) of them left out.

    Two words within that distance share one of them: an alignment leaves out or replaces at most so many letters of either prefix.
    At most 1 + 12 + 66 hashes, however long the word is.
    """
    head = F.substring(word, 1, PREFIX)
    without = lambda w, from_: F.transform(F.sequence(from_, F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.lit(PREFIX))))
    none = F.array().cast("array<string>")
    one = F.when((most >= 1) & (F.length(head) >= 1), without(head, F.lit(1))).otherwise(none)
    two = F.when((most >= 2) & (F.length(head) >= 2), F.flatten(F.transform(one, lambda w: without(w, F.lit(1))))).otherwise(none)
    return F.transform(F.array_distinct(F.concat(F.array(head), one, two)), lambda w: F.xxhash64(w))


def squat_candidates(names: DataFrame, popular: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, name, low, limit, similar`` of the names that share a deletion with a popular one; a pair may come more than once."""
    low = names.select(*keys, "name", F.lower("name").alias("low")).distinct().withColumn("limit", typosquat_limit(F.col("low"))).filter("limit > 0")
    keyed = low.withColumn("key", F.explode(_deletions(F.col("low"), F.col("limit"))))
    known = popular.select(*keys, F.lower("name").alias("similar")).distinct().filter("similar is not null")
    known = known.withColumn("key", F.explode(_deletions(F.col("similar"), F.lit(2))))
    few = known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return keyed.join(F.broadcast(known) if few else known, [*keys, "key"]).drop("key")


def typosquats(names: DataFrame, popular: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys``, ``name``, ``similar``, ``distance`` of names within a small edit distance of a popular one with the same ``keys``.

    Only pairs that share a deletion are compared. The popular names' deletions are broadcast if they are at most MOST_BROADCAST rows, else
    joined. A null name imitates nothing.
    """
    keys = keys or []
    met = squat_candidates(names, popular, keys).filter(~((F.length("similar") <= 3) & (F.length("low") <= 5)))
    distance = F.levenshtein("low", "similar", 2)
    return met.withColumn("distance", distance).filter((F.col("distance") > 0) & (F.col("distance") <= F.col("limit"))).select(*keys, "name", "similar", "distance").distinct()


#: A signal on its own.
ITEM = "struct<signal: string, severity: string, description: string, evidence: string, layer: int, known_good: boolean>"


def item(signal: Column | str, severity: Column | str, description: Column | str, layer: int, evidence: Column | None = None, known_good: Column | None = None) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        as_col(signal).alias("signal"),
        as_col(severity).alias("severity"),
        as_col(description).alias("description"),
        (F.to_json(evidence) if evidence is not None else F.lit("{}")).alias("evidence"),
        F.lit(layer).alias("layer"),
        (known_good if known_good is not None else F.lit(False)).alias("known_good"),
    ).cast(ITEM)


def no_items() -> Column:
    return F.array().cast(f"array<{ITEM}>")


def compromised(vulns: Column, evidence: Column) -> Column:
    """An array with the signal of a package version that has known vulnerabilities, ``vulns`` of them."""
    return F.when(vulns > 0, F.array(item("KNOWN_COMPROMISED", "CRITICAL", F.concat(vulns.cast("string"), F.lit(" known vulnerabilities")), 4, evidence))).otherwise(no_items())


def registry_rules(as_of: Column, known_good: Column) -> Column:
    """The signals of a row of profiles() as one array, so all rules are evaluated in one pass; ``matches(distance, similar)`` are of typosquats()."""
    c, team = F.col, F.coalesce(F.size("maintainers"), F.lit(0))
    since = millis_between(as_of, c("latest_publish_time"))
    rapid = rapid_severity(c("publish_interval_ms"), team, known_good)
    rules = [
        (c("maintainer_changed"), item("MAINTAINER_CHANGE", maintainer_severity(since, team), F.concat(F.lit("publisher changed from "), "previous_publisher", F.lit(" to "), "latest_publisher"), 4, F.struct("previous_publisher", "latest_publisher"))),
        (c("has_install_scripts"), item("POSTINSTALL_SCRIPT", F.when(known_good, "LOW").otherwise("HIGH"), F.concat(F.lit("install scripts: "), F.array_join(F.array_sort(F.map_keys("install_scripts")), ", ")), 4, F.struct("install_scripts"), known_good)),
        (rapid.isNotNull(), item("RAPID_PUBLISH", rapid, F.concat(F.lit("published "), F.floor(c("publish_interval_ms") / 1000).cast("string"), F.lit(" s after the previous version")), 4, F.struct("publish_interval_ms"), known_good)),
        (c("major_jump") >= 3, item("VERSION_ANOMALY", "MODERATE", F.concat(F.lit("major version jumped by "), c("major_jump").cast("string")), 4, F.struct("major_jump"))),
        (c("dormancy_ms") > YEAR_MS, item("VERSION_ANOMALY", "HIGH", F.concat(F.lit("dormant for days: "), F.floor(c("dormancy_ms") / DAY_MS).cast("string")), 4, F.struct("dormancy_ms"))),
        (F.coalesce("repository", F.lit("")) == "", item("NO_REPOSITORY", "LOW", "no source repository", 4)),
        (F.size("matches") > 0, item("TYPOSQUAT", "HIGH", F.concat(F.lit("similar to "), F.array_join(c("matches.similar"), ", ")), 4, F.struct("matches"))),
    ]
    odd = F.transform(homoglyphs(c("name")), lambda kind: item("HOMOGLYPH", "CRITICAL", F.concat(F.lit("suspicious characters: "), kind), 4, F.struct(kind.alias("kind"))))
    return F.concat(F.array_compact(F.array(*[F.when(when, what) for when, what in rules])), odd)


def matches_of(imitations: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``matches``: the names that a name imitates, the nearest first."""
    return imitations.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("distance", "similar"))).alias("matches"))


def metadata_signals(profiles: DataFrame, vuln_counts: DataFrame, known_install: DataFrame, imitations: DataFrame, as_of: Column) -> DataFrame:
    """Signals of the registry's data. ``vuln_counts(name, vulns)``, ``known_install(name)``, ``imitations`` of typosquats()."""
    good = known_install.select("name", F.lit(True).alias("known")).distinct()
    p = profiles.join(vuln_counts, "name", "left").join(good, "name", "left").join(matches_of(imitations, ["name"]), "name", "left")
    known_good = F.coalesce("known", F.lit(False))
    found = F.concat(compromised(F.coalesce("vulns", F.lit(0)), F.struct("vulns")), registry_rules(as_of, known_good))
    return p.select("name", F.col("latest_version").alias("version"), F.inline(found))


def new_dependency_findings(pairs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Findings on dependencies that the latest version added: the columns of ``pairs``, ``signal``, ``severity``.

    ``pairs`` has ``known`` (whether the dependency has a profile), ``dep_age_ms``, ``dep_maintainers``, ``dep_versions``,
    ``dep_publisher``, ``dep_publish_time``, ``publisher``, ``publish_time``, ``dep_scripts``.
    """
    gap = F.abs(millis_between(F.col("publish_time"), F.col("dep_publish_time")))
    finding = lambda cond, signal, severity: F.when(cond, F.struct(F.lit(signal).alias("signal"), F.lit(severity).alias("severity")))
    known = F.col("known")
    found = F.array_compact(
        F.array(
            finding(known & (F.col("dep_age_ms") < WEEK_MS), "PHANTOM_DEPENDENCY", "CRITICAL"),
            finding(known & (F.col("dep_maintainers") <= 1) & (F.col("dep_versions") <= 2), "PHANTOM_DEPENDENCY", "HIGH"),
            finding(known & (F.col("dep_publisher") == F.col("publisher")) & (gap < TWO_DAYS_MS), "CIRCULAR_STAGING", "CRITICAL"),
            finding(known & F.col("dep_scripts"), "NEW_DEP_HAS_INSTALL_SCRIPTS", "HIGH"),
        )
    )
    plain = F.array(F.struct(F.lit("NEW_DEPENDENCY").alias("signal"), F.when(known, "MODERATE").otherwise("HIGH").alias("severity")))
    every = F.when(F.size(found) > 0, found).otherwise(plain)
    return pairs.withColumn("finding", F.explode(every)).select(*pairs.columns, "finding.signal", "finding.severity")


def dependency_signals(profiles: DataFrame, dep_profiles: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``dep_signals``: what newly added dependencies bring; ``dep_profiles`` has the columns of profiles()."""
    edges = profiles.select(*keys, F.col("latest_publisher").alias("publisher"), F.col("latest_publish_time").alias("publish_time"), F.explode("added_deps").alias("dep"))
    d = dep_profiles.select(
        F.col("name").alias("dep"),
        F.lit(True).alias("known"),
        F.col("package_age_ms").alias("dep_age_ms"),
        F.size("maintainers").alias("dep_maintainers"),
        F.col("version_count").alias("dep_versions"),
        F.col("latest_publisher").alias("dep_publisher"),
        F.col("latest_publish_time").alias("dep_publish_time"),
        F.col("has_install_scripts").alias("dep_scripts"),
    )
    found = new_dependency_findings(edges.join(d, "dep", "left").withColumn("known", F.coalesce("known", F.lit(False))))
    one = item(F.col("signal"), F.col("severity"), F.concat(F.lit("new dependency "), "dep"), 2, F.struct("dep"))
    return found.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("dep_signals"))


def _changes(had: Column) -> Column:
    """An array of what changed between the columns of a profile and those prefixed p_ of the one before: ``signal, severity, detail``."""
    new = F.array_except("capabilities", F.coalesce("p_capabilities", F.array().cast("array<string>")))
    danger = F.array_intersect(new, F.array(*[F.lit(d) for d in DANGEROUS]))
    one = lambda signal, severity, detail: F.struct(F.lit(signal).alias("signal"), F.lit(severity).alias("severity"), detail.alias("detail"))
    escalated = F.transform(danger, lambda c: F.when(had, one("CAPABILITY_ESCALATION", "CRITICAL", c)).otherwise(one("INITIAL_DANGEROUS_CAPABILITY", "MODERATE", c)))
    n, m = F.col("dependency_count"), F.col("p_dependency_count")
    nothing = F.lit(None).cast("string")
    rest = F.array_compact(
        F.array(
            F.when(had & (m > 0) & (n > 2 * m) & (n > 5), one("DEPENDENCY_SPIKE", "HIGH", nothing)),
            F.when(had & (F.col("p_maintainer_count") > 0) & (F.col("maintainer_count") < F.col("p_maintainer_count")), one("MAINTAINER_REDUCTION", "MODERATE", nothing)),
            F.when(had & F.col("p_has_repository") & ~F.col("has_repository"), one("REPOSITORY_REMOVED", "MODERATE", nothing)),
        )
    )
    return F.concat(escalated, rest)


def change_items(had: Column) -> Column:
    """As _changes(), as signals of layer 3."""
    return F.transform(_changes(had), lambda x: item(x["signal"], x["severity"], F.concat_ws(" ", x["signal"], x["detail"]), 3, F.struct(x["detail"].alias("detail"))))


def diff_profiles(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings ``name, signal, severity, detail`` of behaviour that changed.

    Both have ``name, capabilities, dependency_count, maintainer_count, has_repository``; a name without a previous profile only has its
    dangerous capabilities reported.
    """
    old = previous.select("name", F.lit(True).alias("had"), *[F.col(c).alias(f"p_{c}") for c in ("capabilities", "dependency_count", "maintainer_count", "has_repository")])
    both = current.join(old, "name", "left").withColumn("had", F.coalesce("had", F.lit(False)))
    return both.select("name", F.inline(_changes(F.col("had"))))


def enabled(signals: DataFrame, switched_off: list[str]) -> DataFrame:
    """Without signals that configuration switches off; protected ones and homoglyphs stay."""
    off = _kept(switched_off)
    return signals.filter(~F.col("signal").isin(off)) if off else signals


def _kept(switched_off: list[str]) -> list[str]:
    return [s for s in switched_off if s not in PROTECTED_SIGNALS and s != "HOMOGLYPH"]


def enabled_items(items: Column, switched_off: list[str]) -> Column:
    """As enabled(), of an array of signals."""
    off = _kept(switched_off)
    return F.filter(items, lambda x: ~x["signal"].isin(off)) if off else items


def _scored(weight: Column, distinct: Column, age_ms: Column, maintainers: Column) -> Column:
    young = F.when(age_ms < MONTH_MS, 2.0).otherwise(1.0)
    lonely = F.when(maintainers <= 1, 1.5).otherwise(1.0)
    many = F.when(distinct >= 3, 1.5).otherwise(1.0) * F.when(distinct >= 5, 2.0).otherwise(1.0)
    return F.floor(weight * young * lonely * many * 10 + 0.5) / 10


def _weight(severity: Column, known_good: Column) -> Column:
    return weight_of(severity) * F.when(known_good, 0.2).otherwise(1.0)


def risk_score_of(items: Column, age_ms: Column, maintainers: Column) -> Column:
    """The risk score of an array of signals, as in risk_scores()."""
    weight = F.aggregate(items, F.lit(0.0), lambda total, x: total + _weight(x["severity"], x["known_good"]))
    return _scored(weight, F.size(F.array_distinct(F.transform(items, lambda x: x["signal"]))), age_ms, maintainers)


def risk_scores(signals: DataFrame, context: DataFrame, key: str = "name") -> DataFrame:
    """``key``, ``n_signals``, ``distinct_signals``, ``risk_score``, ``risk_level`` of each row of ``context``.

    ``context(key, package_age_ms, maintainer_count)``: packages under 30 days count double, with at most one maintainer 1.5 times;
    a null counts for neither. Known-good signals count a fifth. Three distinct signals give 1.5 times, five twice that.
    """
    weight = _weight(F.col("severity"), F.col("known_good"))
    sums = signals.groupBy(key).agg(F.count("*").alias("n_signals"), F.count_distinct("signal").alias("distinct_signals"), F.sum(weight).alias("weight"))
    joined = context.join(sums, key, "left").fillna({"n_signals": 0, "distinct_signals": 0, "weight": 0.0})
    score = _scored(F.col("weight"), F.col("distinct_signals"), F.col("package_age_ms"), F.col("maintainer_count"))
    return joined.withColumn("risk_score", score).select(key, "n_signals", "distinct_signals", "risk_score", level_of(score).alias("risk_level"))
