"""Queries: whole pipelines over the test tables, from files or packages to verdicts and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators import registry, rules
from palisade.options import Options
from palisade.plans import pipelines
from palisade.queries.tables import dealt, orders, table
from palisade.schema import ADVISORY, DAY_MS, ECOSYSTEMS, VULNERABILITY
from palisade.scratch import root
from palisade.sinks import reports
from palisade.sources import discovery, parsers
from palisade.streaming import watch


def _scan(spark, d, **given):
    """Parts as installed packages, orders as advisories of packages' versions; every seventh advisory has no details, every thirteenth package no answer."""
    p = table(spark, d, "part")
    deps = p.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.expr("p_partkey % 150")).alias("name"), F.col("p_size").cast("string").alias("version"), F.lit("f").alias("source_file"), F.col("p_partkey").cast("bigint").alias("ord"))
    o = orders(spark, d)
    ident = F.concat(F.lit("V"), F.expr("o_custkey % 90"))
    index = o.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.expr("o_custkey % 150")).alias("name"), F.expr("cast(o_orderkey % 50 as string)").alias("version"), ident.alias("id"))
    ids = o.select(F.expr("o_custkey % 90").alias("k")).distinct().filter("k % 7 != 0")
    level = F.get(F.array(*[F.lit(s) for s in ("LOW", "medium", "Important", "CRITICAL")]), (F.col("k") % 4).cast("int"))
    fields = {
        "id": F.concat(F.lit("V"), "k"),
        "summary": F.when(F.col("k") % 5 == 0, "").otherwise(F.concat(F.lit("s"), "k")),
        "aliases": F.array(F.concat(F.lit("CVE-"), "k"), F.concat(F.lit("GHSA-"), "k")),
        "database_specific": F.struct(level.alias("severity")),
        "references": F.array(*[F.struct(F.lit(u).alias("url")) for u in ("u1", "")]),
    }
    schema = spark.createDataFrame([], ADVISORY).schema
    details = ids.select(*[(fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    checked = p.filter("p_partkey % 150 % 13 != 0").select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.expr("p_partkey % 150")).alias("name"), F.col("p_size").cast("string").alias("version"))
    return pipelines.scan(deps, index, details, Options(least_severity="MODERATE", **given), checked)


_SCAN = """
WITH w AS (SELECT DISTINCT p_partkey % 150 AS n, p_size::VARCHAR AS version FROM part),
i AS (SELECT DISTINCT o_custkey % 150 AS n, (o_orderkey % 50)::VARCHAR AS version, o_custkey % 90 AS k FROM orders),
v AS (
  SELECT 'V' || k AS id, CASE WHEN k % 7 = 0 THEN 'V' || k ELSE 'GHSA-' || k END AS display_id, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'No description available' ELSE 's' || k END AS summary,
         CASE WHEN k % 7 = 0 THEN 'CRITICAL' ELSE ['LOW', 'MODERATE', 'HIGH', 'CRITICAL'][k % 4 + 1] END AS severity, 'p' || n AS package, version, k % 7 = 0 AS details_missing
  FROM w JOIN i USING (n, version)
),
f AS (SELECT * FROM v WHERE severity <> 'LOW')
"""


def scan_findings(spark, d):
    return _scan(spark, d).rows.select("id", "display_id", "summary", "severity", "package", "version", "details_missing")


def scan_narrowed(spark, d):
    """As scan_findings, with the index filtered by a bitmap before the lookup."""
    return _scan(spark, d, narrow_lookup=True).rows.select("id", "package", "version", "severity")


def report_document(spark, d):
    """The elements of one JSON document of all findings, read back from its parts: each as it stands there, and whether a comma is before it."""
    scan = _scan(spark, d)
    folder = f"{root(spark)}/document-{uuid.uuid4().hex}"
    reports.write_document(reports.scan_report(scan.rows, scan.verdict), folder)
    lines = spark.read.text(folder)
    element = F.from_json(F.regexp_replace("value", "^,", ""), "id string, package string, version string, severity string")
    kind = F.when(F.col("value").startswith('{"command"'), "head").when(F.col("value") == "]}", "tail").when(F.col("value").startswith(","), "next").otherwise("first")
    out = lines.select(kind.alias("kind"), element.alias("e"))
    inner = F.col("kind").isin("next", "first")
    counted = out.groupBy(F.when(inner, "element").otherwise(F.col("kind")).alias("kind"), *[F.when(inner, F.col(f"e.{c}")).alias(c) for c in ("id", "package", "version", "severity")])
    return counted.agg(F.count("*").alias("n")).unionByName(out.filter("kind = 'first'").select(F.lit("first").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("id", "package", "version", "severity")], F.lit(1).cast("long").alias("n")))


def scan_verdict(spark, d):
    return _scan(spark, d).verdict


SCAN_VERDICT = _SCAN + """, c AS (SELECT count(*) AS expected, count(*) FILTER (n % 13 <> 0) AS checked FROM w)
SELECT expected, checked, 0::BIGINT AS failed, expected = checked AS complete, (SELECT count(*) FROM f) AS findings, CASE WHEN expected <> checked THEN 2 WHEN (SELECT count(*) FROM f) > 0 THEN 1 ELSE 0 END AS exit_code FROM c"""


REPORT_DOCUMENT = _SCAN + """SELECT 'element' AS kind, id, package, version, severity, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT k, NULL, NULL, NULL, NULL, 1 FROM (VALUES ('head'), ('tail')) t(k)
UNION ALL SELECT 'first', NULL, NULL, NULL, NULL, 1 WHERE EXISTS (SELECT 1 FROM f)"""


def report_rows(spark, d):
    """Rows of the reports of a scan, a build server's check and an analysis, by part, with what their heads say."""
    scan = _scan(spark, d)
    rows = reports.scan_report(scan.rows, scan.verdict).withColumn("report", F.lit("scan")).unionByName(reports.ci_report(scan.rows, scan.verdict).withColumn("report", F.lit("ci")))
    results = scan.rows.select("package", F.col("severity").alias("risk_level"))
    rows = rows.unionByName(reports.analyze_report(results, scan.verdict).withColumn("report", F.lit("analyze")))
    said = F.coalesce(F.get_json_object("value", "$.summary.critical"), F.get_json_object("value", "$.summary.vulnerable"))
    return rows.groupBy("report", "part").agg(F.count("*").alias("n"), F.max(F.when(F.col("part") == "head", said)).cast("long").alias("said"), F.bool_and(F.json_object_keys("value").isNotNull()).alias("valid"))


REPORT_ROWS = _SCAN + """, n AS (SELECT count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS c FROM f)
SELECT r AS report, p AS part, CASE WHEN p = 'head' THEN 1 ELSE n END::BIGINT AS n, CASE WHEN p <> 'head' THEN NULL WHEN r = 'ci' THEN n ELSE c END::BIGINT AS said, true AS valid
FROM n, (VALUES ('scan', 'head'), ('scan', 'vulnerabilities'), ('ci', 'head'), ('ci', 'vulnerabilities'), ('analyze', 'head'), ('analyze', 'results')) t(r, p) WHERE p = 'head' OR n > 0"""


def _installed(spark, d):
    o = table(spark, d, "orders")
    deps = o.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("c"), "o_custkey").alias("name"), F.substring("o_orderpriority", 1, 1).alias("version"), F.lit(None).cast("string").alias("integrity"), F.col("o_orderkey").cast("bigint").alias("ord"), "o_orderdate", "o_orderkey")
    cut = F.col("o_orderdate") < F.lit("1997-06-01").cast("timestamp_ntz")
    return deps.filter(cut).drop("o_orderdate"), deps.filter(~cut).drop("o_orderdate")


def guard_plan(spark, d):
    """What guards of an installation say: packages' versions are priorities, which are levels too; version 4 has no answer."""
    before, after = _installed(spark, d)
    results = after.select("ecosystem", "name", "version").distinct().filter("version != '4'")
    level = F.get(F.array(*[F.lit(s) for s in ("NONE", "HIGH", "HIGH", "MODERATE", "NONE", "LOW")]), F.col("version").cast("int"))
    return pipelines.guard(before, after, results.withColumns({"risk_level": level, "vulns": F.lit(0), "warnings": F.lit(0)}), Options(force=True))


GUARD_PLAN = """
WITH x AS (SELECT o_custkey AS c, substr(o_orderpriority, 1, 1) AS v, o_orderkey, o_orderdate < TIMESTAMP '1997-06-01' AS old FROM orders),
l AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY c, old ORDER BY o_orderkey DESC) = 1),
d AS (SELECT c, a.v AS now, b.v AS was FROM (SELECT * FROM l WHERE NOT old) a FULL JOIN (SELECT * FROM l WHERE old) b USING (c)),
n AS (
  SELECT count(*) FILTER (was IS NULL) AS added, count(*) FILTER (now IS NULL) AS removed, count(*) FILTER (now <> was) AS changed, count(*) FILTER (now = was) AS unchanged,
         count(*) FILTER (now IN ('1', '2') AND (was IS NULL OR now <> was)) AS high, count(*) FILTER (now = '4' AND (was IS NULL OR now <> was)) AS unknown FROM d
)
SELECT added, removed, changed, unchanged, added + removed + changed > 0 AS has_changes,
       CASE WHEN added + removed + changed = 0 THEN 'no changes' ELSE concat_ws(', ', CASE WHEN added > 0 THEN added || ' added' END, CASE WHEN removed > 0 THEN removed || ' removed' END, CASE WHEN changed > 0 THEN changed || ' changed' END) END AS summary,
       0::BIGINT AS critical, high, unknown, false AS has_vulns, unknown = 0 AS complete, CASE WHEN unknown > 0 OR high > 0 THEN 'allow_forced' ELSE 'allow' END AS decision FROM n
"""


def fix_plan(spark, d):
    """Fixes of brands: each part names a fixing version, and versions of parts of size 50 are vulnerable themselves."""
    v = F.concat_ws(".", "p_size", F.col("p_partkey") % 9, F.col("p_partkey") % 4)
    p = table(spark, d, "part").withColumn("v", v)
    vulns = p.select(F.col("p_brand").alias("package"), F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit(">= "), "v")).alias("fixed"))
    index = p.filter("p_size = 50").select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.col("v").alias("version"), F.lit("V").alias("id"))
    kind = F.when(F.col("p_brand").endswith("1"), "pypi").when(F.col("p_brand").endswith("2"), "cargo").when(F.col("p_brand").endswith("3"), "go").otherwise("npm")
    current = p.select(F.col("p_brand").alias("package"), kind.alias("ecosystem"), F.lit("0.1").alias("version")).distinct()
    return pipelines.fix(vulns, index, current).select("package", "current_version", "vuln_count", "fix", "command", "reason")


FIX_PLAN = """
WITH p AS (SELECT p_brand AS package, p_partkey, p_size || '.' || (p_partkey % 9) || '.' || (p_partkey % 4) AS v, p_size * 100 + p_partkey % 9 * 10 + p_partkey % 4 AS o, p_size = 50 AS bad FROM part),
s AS (SELECT package, arg_max(v, o) AS fix FROM p WHERE p_partkey % 3 <> 0 AND (package, v) NOT IN (SELECT (package, v) FROM p WHERE bad) GROUP BY package),
g AS (SELECT package, count(*) AS vuln_count FROM p GROUP BY package)
SELECT package, '0.1' AS current_version, vuln_count, fix, CASE WHEN fix IS NULL THEN 'no verified fix' END AS reason,
       CASE WHEN fix IS NULL THEN NULL ELSE CASE right(package, 1) WHEN '1' THEN 'pip install ' || q || '==' || fix WHEN '2' THEN 'cargo update -p ' || q || ' --precise ' || fix WHEN '3' THEN '# upgrade ' || q || ' to ' || fix ELSE 'npm install ' || q || '@' || fix END END AS command
FROM (SELECT *, '''' || package || '''' AS q FROM g) LEFT JOIN s USING (package)
"""


def _history(spark, d):
    e = table(spark, d, "events")
    name = F.concat(F.lit("u"), "user_id")
    packages = e.select("user_id").distinct().select(name.alias("name"), F.lit(None).cast("string").alias("latest_tag"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("user_id") % 4).cast("int")).alias("maintainers"), F.when(F.col("user_id") % 3 != 0, "git").alias("repository"), F.lit("MIT").alias("license"))
    w = "row_number() over (partition by user_id order by ts, event_id)"
    versions = e.withColumn("n", F.expr(w)).select(name.alias("name"), F.concat(F.expr("cast(event_id % 9 as string)"), F.lit(".0."), "n").alias("version"), F.expr("ts + n * interval '1' microsecond").cast("timestamp_ntz").alias("published_at"), F.col("event_type").alias("publisher"), F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("postinstall"), F.lit("x"), F.lit("test"), F.lit("y"))).alias("scripts"), F.create_map(F.concat(F.lit("d"), F.expr("event_id % 3")), F.lit("1")).alias("dependencies"))
    return registry.profiles(packages, versions, F.lit("2025-01-01").cast("timestamp_ntz"))


_HISTORY = f"""
WITH v AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stamp, count(*) OVER (PARTITION BY user_id) AS total FROM events),
g AS (SELECT user_id, max((stamp - before) // 1000) FILTER ((stamp - before) // 1000 > 0) AS dormancy_ms FROM (SELECT *, lag(stamp) OVER (PARTITION BY user_id ORDER BY n) AS before FROM v WHERE n > total - 5) GROUP BY user_id),
h AS (
  SELECT user_id, any_value(total)::INT AS version_count, max(event_id) FILTER (n = total) AS le, max(event_id) FILTER (n = total - 1) AS pe, max(event_type) FILTER (n = total) AS lp, max(event_type) FILTER (n = total - 1) AS pp,
         max(stamp) FILTER (n = total) AS la, max(stamp) FILTER (n = total - 1) AS pa, min(stamp) AS fa FROM v GROUP BY user_id
),
x AS (
  SELECT h.*, dormancy_ms, 'u' || h.user_id AS name, (le % 9) || '.0.' || version_count AS latest_version, coalesce(lp <> pp, false) AS maintainer_changed, le % 4 = 0 AS has_install_scripts,
         (la - pa) // 1000 AS publish_interval_ms, (epoch_us(TIMESTAMP '2025-01-01') - fa) // 1000 AS package_age_ms, (epoch_us(TIMESTAMP '2025-01-01') - la) // 1000 AS since,
         CASE WHEN pe IS NULL THEN 0 ELSE le % 9 - pe % 9 END AS major_jump, user_id % 4 AS team
  FROM h LEFT JOIN g USING (user_id)
)
"""


def package_profiles(spark, d):
    p = _history(spark, d)
    return p.select("name", "latest_version", "latest_publisher", "previous_publisher", "maintainer_changed", "has_install_scripts", F.array_join("added_deps", ",").alias("added"), "publish_interval_ms", "package_age_ms", "major_jump", "dormancy_ms", "version_count")


PROFILES = _HISTORY + """SELECT name, latest_version, lp AS latest_publisher, pp AS previous_publisher, maintainer_changed, has_install_scripts, CASE WHEN pe IS NULL OR pe % 3 = le % 3 THEN '' ELSE 'd' || (le % 3) END AS added,
       publish_interval_ms, package_age_ms, major_jump::INT AS major_jump, dormancy_ms, version_count FROM x"""


def metadata_signals(spark, d):
    """All signals of the users' histories; every fifth user has a known problem, every sixth is a known installer, u7 imitates another."""
    p = _history(spark, d)
    number = F.substring("name", 2, 99).cast("long")
    counts = p.filter(number % 5 == 0).select("name", F.lit(2).cast("long").alias("vulns"))
    known = p.filter(number % 6 == 0).select("name")
    imitations = p.filter(number % 7 == 0).select("name", F.lit("other").alias("similar"), F.lit(1).alias("distance"))
    return rules.metadata_signals(p, counts, known, imitations, F.lit("2025-01-01").cast("timestamp_ntz")).select("name", "version", "signal", "severity", "layer", "known_good")


SIGNALS = _HISTORY + f""", s AS (
  SELECT name, latest_version AS version, 'KNOWN_COMPROMISED' AS signal, 'CRITICAL' AS severity, false AS known_good FROM x WHERE user_id % 5 = 0
  UNION ALL SELECT name, latest_version, 'MAINTAINER_CHANGE', CASE WHEN since < {90 * DAY_MS} THEN 'CRITICAL' WHEN team >= 3 THEN 'LOW' ELSE 'MODERATE' END, false FROM x WHERE maintainer_changed
  UNION ALL SELECT name, latest_version, 'POSTINSTALL_SCRIPT', CASE WHEN user_id % 6 = 0 THEN 'LOW' ELSE 'HIGH' END, user_id % 6 = 0 FROM x WHERE has_install_scripts
  UNION ALL SELECT name, latest_version, 'RAPID_PUBLISH', CASE WHEN user_id % 6 = 0 OR (publish_interval_ms = 0 AND team >= 2) THEN 'LOW' ELSE 'HIGH' END, user_id % 6 = 0 FROM x WHERE publish_interval_ms >= 0 AND publish_interval_ms < 600000
  UNION ALL SELECT name, latest_version, 'VERSION_ANOMALY', 'MODERATE', false FROM x WHERE major_jump >= 3
  UNION ALL SELECT name, latest_version, 'VERSION_ANOMALY', 'HIGH', false FROM x WHERE dormancy_ms > {365 * DAY_MS}
  UNION ALL SELECT name, latest_version, 'NO_REPOSITORY', 'LOW', false FROM x WHERE user_id % 3 = 0
  UNION ALL SELECT name, latest_version, 'TYPOSQUAT', 'HIGH', false FROM x WHERE user_id % 7 = 0
)
SELECT *, 4 AS layer FROM s"""

def _analysis(spark, d):
    """Users as npm packages with their events as versions; every third one is a PyPI package too, with those of its events that are clicks.

    Two versions of each package are installed. Every fifth npm package has a known vulnerability in version 1, no answer came for every eleventh
    package's version 2, and every thirteenth isn't in the registry.
    """
    e = table(spark, d, "events")
    name = F.concat(F.lit("pkg-u"), "user_id")
    ecosystems = F.explode(F.when(F.col("user_id") % 3 == 0, F.array(F.lit("npm"), F.lit("pypi"))).otherwise(F.array(F.lit("npm")))).alias("ecosystem")
    users = e.select("user_id").distinct()
    both = users.select("user_id", name.alias("name"), ecosystems)
    team = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("user_id") % 4).cast("int"))
    packages = both.filter("user_id % 13 != 0").select("ecosystem", "name", F.lit(None).cast("string").alias("latest_tag"), F.lit(None).cast("timestamp_ntz").alias("created_at"), team.alias("maintainers"), F.when(F.col("user_id") % 3 != 0, "git").alias("repository"), F.lit("MIT").alias("license"))
    each = e.select("*", ecosystems).filter("ecosystem = 'npm' or event_type = 'click'").withColumn("n", F.expr("row_number() over (partition by ecosystem, user_id order by ts, event_id)"))
    versions = each.select("ecosystem", name.alias("name"), F.concat(F.expr("cast(event_id % 9 as string)"), F.lit(".0."), "n").alias("version"), F.expr("ts + n * interval '1' microsecond").cast("timestamp_ntz").alias("published_at"), F.col("event_type").alias("publisher"), F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("postinstall"), F.lit("node -e 'eval(x)'"))).alias("scripts"), F.lit(None).cast("map<string,string>").alias("dependencies"))
    versions_of = both.withColumn("version", F.explode(F.array(F.lit("1"), F.lit("2"))))
    deps = versions_of.select("ecosystem", "name", "version", F.lit(True).alias("is_direct"), F.lit("f").alias("source_file"), F.col("user_id").cast("bigint").alias("ord"))
    vulns = users.filter("user_id % 5 = 0").select(F.lit("npm").alias("ecosystem"), name.alias("package"), F.lit("1").alias("version"), F.lit("V").alias("id"))
    checked = versions_of.filter("not (user_id % 11 = 0 and version = '2')").select("ecosystem", "name", "version")
    return pipelines.analyze(deps, vulns, packages, versions, Options(verbose=True), F.lit("2025-01-01").cast("timestamp_ntz"), checked=checked)


def analyze_results(spark, d):
    """Signals, scores and warnings of each installed version."""
    rows = _analysis(spark, d).rows
    names = F.array_join(F.array_sort(F.transform("signals", lambda s: F.concat_ws("/", s["signal"], s["severity"]))), ",")
    return rows.select("ecosystem", "name", "version", names.alias("signals"), "risk_score", "risk_level", F.array_join("warnings", ",").alias("warnings"))


def analyze_verdict(spark, d):
    return _analysis(spark, d).verdict


_ANALYSIS = f"""
WITH v AS (
  SELECT eco, user_id, event_id, event_type, row_number() OVER w AS n, epoch_us(ts) + row_number() OVER w AS stamp, count(*) OVER (PARTITION BY eco, user_id) AS total
  FROM (SELECT *, unnest(CASE WHEN user_id % 3 = 0 THEN ['npm', 'pypi'] ELSE ['npm'] END) AS eco FROM events) WHERE eco = 'npm' OR event_type = 'click'
  WINDOW w AS (PARTITION BY eco, user_id ORDER BY ts, event_id)
),
g AS (SELECT eco, user_id, max((stamp - before) // 1000) FILTER ((stamp - before) // 1000 > 0) AS dormancy FROM (SELECT *, lag(stamp) OVER (PARTITION BY eco, user_id ORDER BY n) AS before FROM v WHERE n > total - 5) GROUP BY eco, user_id),
h AS (
  SELECT eco, user_id, max(event_id) FILTER (n = total) AS le, max(event_id) FILTER (n = total - 1) AS pe, max(event_type) FILTER (n = total) AS lp, max(event_type) FILTER (n = total - 1) AS pp,
         max(stamp) FILTER (n = total) AS la, max(stamp) FILTER (n = total - 1) AS pa, min(stamp) AS fa FROM v GROUP BY eco, user_id
),
b AS (SELECT DISTINCT user_id, unnest(CASE WHEN user_id % 3 = 0 THEN ['npm', 'pypi'] ELSE ['npm'] END) AS eco FROM events),
x AS (
  SELECT b.eco, b.user_id, user_id % 4 AS team, le, pe, coalesce(lp <> pp, false) AS handed, le % 4 = 0 AS scripts, (la - pa) // 1000 AS gap, dormancy,
         (epoch_us(TIMESTAMP '2025-01-01') - la) // 1000 AS since, (epoch_us(TIMESTAMP '2025-01-01') - fa) // 1000 AS age, CASE WHEN pe IS NULL THEN 0 ELSE le % 9 - pe % 9 END AS jump
  FROM b LEFT JOIN h USING (eco, user_id) LEFT JOIN g USING (eco, user_id)
),
i AS (SELECT x.*, unnest(['1', '2']) AS version FROM x),
s AS (
  SELECT eco, user_id, version, unnest(list_filter([
    CASE WHEN eco = 'npm' AND user_id % 5 = 0 AND version = '1' THEN ['KNOWN_COMPROMISED', 'CRITICAL', '10'] END,
    CASE WHEN handed THEN CASE WHEN since < {90 * DAY_MS} THEN ['MAINTAINER_CHANGE', 'CRITICAL', '10'] WHEN team >= 3 THEN ['MAINTAINER_CHANGE', 'LOW', '1'] ELSE ['MAINTAINER_CHANGE', 'MODERATE', '2'] END END,
    CASE WHEN scripts THEN ['POSTINSTALL_SCRIPT', 'HIGH', '5'] END,
    CASE WHEN scripts THEN ['AST_DANGEROUS_PATTERN', 'CRITICAL', '10'] END,
    CASE WHEN scripts AND pe IS NOT NULL THEN ['CAPABILITY_ESCALATION', 'CRITICAL', '10'] WHEN scripts THEN ['INITIAL_DANGEROUS_CAPABILITY', 'MODERATE', '2'] END,
    CASE WHEN gap >= 0 AND gap < 600000 THEN CASE WHEN gap = 0 AND team >= 2 THEN ['RAPID_PUBLISH', 'LOW', '1'] ELSE ['RAPID_PUBLISH', 'HIGH', '5'] END END,
    CASE WHEN jump >= 3 THEN ['VERSION_ANOMALY', 'MODERATE', '2'] END,
    CASE WHEN dormancy > {365 * DAY_MS} THEN ['VERSION_ANOMALY', 'HIGH', '5'] END,
    CASE WHEN user_id % 3 = 0 THEN ['NO_REPOSITORY', 'LOW', '1'] END
  ], lambda z: z IS NOT NULL)) AS z FROM i WHERE user_id % 13 <> 0
),
q AS (SELECT eco, user_id, version, string_agg(z[1] || '/' || z[2], ',' ORDER BY z[1], z[2]) AS signals, sum(z[3]::DOUBLE) AS weight, count(DISTINCT z[1]) AS kinds FROM s GROUP BY ALL),
r AS (
  SELECT eco AS ecosystem, 'pkg-u' || user_id AS name, version, user_id % 13 <> 0 AS known, NOT (user_id % 11 = 0 AND version = '2') AS covered, coalesce(signals, '') AS signals,
         floor(coalesce(weight, 0) * CASE WHEN age < {30 * DAY_MS} THEN 2 ELSE 1 END * CASE WHEN team <= 1 THEN 1.5 ELSE 1 END * CASE WHEN kinds >= 5 THEN 3 WHEN kinds >= 3 THEN 1.5 ELSE 1 END * 10 + 0.5) / 10 AS score
  FROM i LEFT JOIN q USING (eco, user_id, version)
),
f AS (
  SELECT ecosystem, name, version, signals, score::DOUBLE AS risk_score, CASE WHEN NOT known THEN 'UNKNOWN' WHEN score >= 30 THEN 'CRITICAL' WHEN score >= 15 THEN 'HIGH' WHEN score >= 5 THEN 'MODERATE' WHEN score > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level,
         concat_ws(',', CASE WHEN NOT known THEN 'metadata unavailable' END, CASE WHEN NOT covered THEN 'vulnerability lookup incomplete' END) AS warnings FROM r
)
"""
ANALYZE_VERDICT = _ANALYSIS + """, c AS (SELECT count(*) AS expected, count(*) FILTER (warnings = '') AS checked, count(*) FILTER (risk_level NOT IN ('NONE', 'UNKNOWN')) AS findings FROM f)
SELECT expected, checked, 0::BIGINT AS failed, expected = checked AS complete, findings, CASE WHEN expected <> checked THEN 2 WHEN findings > 0 THEN 1 ELSE 0 END AS exit_code FROM c"""


def fix_verdict(spark, d):
    """Brands as packages, part sizes as their versions, those over 25 vulnerable. The source has answered for what is installed and for fixing versions below 5."""
    p = table(spark, d, "part")
    deps = p.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"), F.lit("f").alias("source_file"), F.col("p_partkey").cast("bigint").alias("ord"))
    ident = F.concat(F.lit("V"), F.expr("p_size % 7"))
    index = p.filter("p_size > 25").select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("version"), ident.alias("id"))
    fixed = F.concat(F.col("k").cast("string"), F.lit(".0.0"))
    none = F.lit(None).cast("string")
    affected = F.transform("brands", lambda b: F.struct(F.struct(b.alias("name")).alias("package"), F.array(F.struct(F.array(F.struct(fixed.alias("fixed"))).alias("events"))).alias("ranges"), F.struct(none.alias("severity")).alias("ecosystem_specific")))
    schema = spark.createDataFrame([], ADVISORY).schema
    given = {"id": F.concat(F.lit("V"), "k"), "affected": affected, "database_specific": F.struct(F.lit("HIGH").alias("severity"))}
    ids = p.groupBy(F.expr("p_size % 7").alias("k")).agg(F.collect_set("p_brand").alias("brands"))  # there are 25 brands
    details = ids.select(*[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
    answered = p.select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.explode(F.array(F.col("p_size").cast("string"), *[F.lit(f"{k}.0.0") for k in range(5)])).alias("version"))
    return pipelines.fix_all(deps, index, details, Options(), answered).verdict


FIX_VERDICT = """
WITH u AS (SELECT DISTINCT p_brand AS b, p_size AS v FROM part),
k AS (SELECT DISTINCT b, v % 7 AS k FROM u WHERE v > 25 AND (b, v % 7) IN (SELECT (b, v % 7) FROM u)),
p AS (SELECT b, count(*) FILTER (k >= 5) AS unverified, max(k) FILTER (k < 5) AS fix FROM k GROUP BY b),
c AS (SELECT (SELECT count(*) FROM u) + (SELECT count(*) FROM p) AS expected, (SELECT count(*) FROM u) + (SELECT count(*) FROM p WHERE unverified = 0) AS checked, (SELECT count(*) FROM p WHERE fix IS NULL) AS findings)
SELECT expected, checked, 0::BIGINT AS failed, expected = checked AS complete, findings, CASE WHEN expected <> checked THEN 2 WHEN findings > 0 THEN 1 ELSE 0 END AS exit_code FROM c
"""


#: Files of a folder: name, content ({k} stands for a number), and the dependencies in it: ecosystem, name, version, dev, direct.
_FORMATS = [
    ("package-lock.json", '{{"packages": {{"": {{"version": "1"}}, "node_modules/Exp{k}": {{"version": "4.{k}.0"}}, "node_modules/x/node_modules/@s/dev{k}": {{"version": "1.0.0", "dev": true}}}}}}', [("npm", "exp{k}", "4.{k}.0", 0, 1), ("npm", "@s/dev{k}", "1.0.0", 1, 0)]),
    ("package.json", '{{"dependencies": {{"exp{k}": "^4"}}, "devDependencies": {{}}}}', []),
    ("pnpm-lock.yaml", "lockfileVersion: '9.0'\n\npackages:\n\n  '@pn/a{k}@1.2.{k}':\n    resolution: {{integrity: sha512-x}}\n\n  pnb{k}@2.0.0:\n    dev: true\n", [("npm", "@pn/a{k}", "1.2.{k}", 0, 0), ("npm", "pnb{k}", "2.0.0", 1, 0)]),
    ("yarn.lock", '# yarn lockfile v1\n\nya{k}@^1.0.0, ya{k}@^1.1.0:\n  version "1.1.{k}"\n  integrity sha512-y\n', [("npm", "ya{k}", "1.1.{k}", 0, 0)]),
    ("Pipfile.lock", '{{"default": {{"Pip_A{k}": {{"version": "==1.{k}"}}}}, "develop": {{"pipb{k}": {{}}}}}}', [("pypi", "pip-a{k}", "1.{k}", 0, 0), ("pypi", "pipb{k}", "latest", 1, 0)]),
    ("poetry.lock", '[[package]]\nname = "Po.A{k}"\nversion = "2.{k}"\n\n[metadata]\nname = "no"\n', [("pypi", "po-a{k}", "2.{k}", 0, 0)]),
    ("requirements.txt", "Req_A{k}==3.{k}\n-r more/base.txt\n", [("pypi", "req-a{k}", "3.{k}", 0, 1), ("pypi", "base{k}", "1.5", 0, 1)]),
    ("more/base.txt", "base{k}>=1.5,<2\n-r ../requirements.txt\n", []),
    ("pyproject.toml", '[project]\nname = "n"\ndependencies = [\n  "pj-a{k}>=1.{k}",\n]\n[tool.poetry.dependencies]\npython = "^3"\npj-b{k} = "^2.0"\n', [("pypi", "pj-a{k}", "1.{k}", 0, 1), ("pypi", "pj-b{k}", "2.0", 0, 1)]),
    ("Cargo.lock", '[[package]]\nname = "ca{k}"\nversion = "0.{k}.1"\n', [("cargo", "ca{k}", "0.{k}.1", 0, 0)]),
    ("Cargo.toml", '[package]\nversion = "9.9"\n[dependencies]\nct{k} = {{ version = "1.{k}", features = ["x"] }}\nlocal = {{ path = "../l" }}\n[dev-dependencies]\ncd{k} = "=2.1"\n', [("cargo", "ct{k}", "1.{k}", 0, 1), ("cargo", "cd{k}", "2.1", 1, 1)]),
    ("go.sum", "ex.com/s{k} v1.{k}.0 h1:a=\nex.com/s{k} v1.{k}.0/go.mod h1:b=\n", [("go", "ex.com/s{k}", "v1.{k}.0", 0, 0)]),
    ("go.mod", "module m\n\nrequire (\n\tex.com/m{k} v1.{k}.0\n\tex.com/i{k} v0.1.0 // indirect\n)\n", [("go", "ex.com/m{k}", "v1.{k}.0", 0, 1), ("go", "ex.com/i{k}", "v0.1.0", 0, 0)]),
    ("Gemfile.lock", "GEM\n  remote: https://r/\n  specs:\n    ga{k} (7.{k})\n      sub (>= 1)\n    gb{k} (1.0)\n\nDEPENDENCIES\n  ga{k} (~> 7)\n", [("ruby", "ga{k}", "7.{k}", 0, 1), ("ruby", "gb{k}", "1.0", 0, 0)]),
    ("Gemfile", "source 'https://r'\ngem 'gf{k}', '~> 6.{k}'\ngem 'none'\n", [("ruby", "gf{k}", "6.{k}", 0, 1)]),
    ("composer.lock", '{{"packages": [{{"name": "v/a{k}", "version": "v1.{k}"}}], "packages-dev": [{{"name": "v/b{k}", "version": "2.0"}}]}}', [("php", "v/a{k}", "1.{k}", 0, 0), ("php", "v/b{k}", "2.0", 1, 0)]),
    ("composer.json", '{{"require": {{"php": ">=8", "v/c{k}": "^3.{k}", "ext-x": "*"}}, "require-dev": {{"v/d{k}": "4.0"}}}}', [("php", "v/c{k}", "3.{k}", 0, 1), ("php", "v/d{k}", "4.0", 1, 1)]),
    ("packages.lock.json", '{{"dependencies": {{"net8": {{"Nu{k}": {{"type": "Direct", "resolved": "5.{k}"}}, "Nt{k}": {{"type": "Transitive", "resolved": "1.0"}}}}}}}}', [("nuget", "Nu{k}", "5.{k}", 0, 1), ("nuget", "Nt{k}", "1.0", 0, 0)]),
    ("app.csproj", '<Project><ItemGroup><PackageReference Include="Cs{k}" Version="6.{k}" /><PackageReference Include="Ce{k}"><Version>[1.1]</Version></PackageReference></ItemGroup></Project>', [("nuget", "Cs{k}", "6.{k}", 0, 1), ("nuget", "Ce{k}", "1.1", 0, 1)]),
    ("gradle.lockfile", "# c\norg.g:gr{k}:1.{k}=compileClasspath\nempty=x\n", [("java", "org.g:gr{k}", "1.{k}", 0, 0)]),
    ("pom.xml", "<project><dependency><groupId>g</groupId><artifactId>po{k}</artifactId><version>2.{k}</version></dependency></project>", [("java", "g:po{k}", "2.{k}", 0, 1)]),
    ("Brewfile.lock.json", '{{"entries": {{"brew": {{"bl{k}": {{"version": "1.{k}"}}}}, "cask": {{"bc{k}": {{}}}}}}}}', [("brew", "bl{k}", "1.{k}", 0, 1), ("brew", "bc{k}", "latest", 0, 1)]),
    ("Brewfile", "brew \"bf{k}\"\ncask 'bk{k}'\n", [("brew", "bf{k}", "latest", 0, 1), ("brew", "bk{k}", "latest", 0, 1)]),
]
#: A lockfile of the older kind: {k} and a tree 20 levels deep.
_DEEP = '{{"dependencies": ' + "".join(f'{{{{"t{n}x{{k}}": {{{{"version": "{n}.0", "requires": {{{{"t0": "1"}}}}, "dependencies": ' for n in range(20)) + "{{}}" + "}}}}" * 20 + "}}"


def _format_files(spark, d, chosen=None):
    """A folder a part; ``chosen``, a condition on its number ``k`` and the file's number ``at``, leaves out some of its files."""
    every = [(n, c.replace("{{", "{").replace("}}", "}")) for n, c, _ in _FORMATS] + [("old/package-lock.json", _DEEP.replace("{{", "{").replace("}}", "}"))]
    files = F.posexplode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in every])).alias("at", "f")
    each = dealt(table(spark, d, "part").select(F.col("p_partkey").alias("k"))).select("k", files)
    each = each if chosen is None else each.filter(chosen)
    return each.select(F.concat(F.lit("/r/"), F.col("k").cast("string"), F.lit("/"), "f.n").alias("path"), F.replace("f.c", F.lit("{k}"), F.col("k").cast("string")).alias("content"))


def parse_all_formats(spark, d):
    """All dependencies of a folder a part that has a file of each format; a lockfile's tree is 20 levels deep."""
    found = parsers.parse_all(_format_files(spark, d), [n for n in parsers.PARSERS if n != "package.json"])
    return found.select("ecosystem", "name", "version", "is_dev", "is_direct")


_EXPECTED = [row for _, _, found in _FORMATS for row in found] + [("npm", f"t{n}x{{k}}", f"{n}.0", 0, 0) for n in range(20)]
PARSE_ALL = (
    "WITH w(e, n, v, dev, direct) AS (VALUES "
    + ", ".join(f"('{e}', '{n}', '{v}', {dev}, {direct})" for e, n, v, dev, direct in _EXPECTED)
    + ")\nSELECT e AS ecosystem, replace(n, '{k}', p_partkey::VARCHAR) AS name, replace(v, '{k}', p_partkey::VARCHAR) AS version, dev = 1 AS is_dev, direct = 1 AS is_direct FROM part, w"
)


def parse_failures(spark, d):
    """Files of each format cut off after 12 characters, the whole ones beside them."""
    files = _format_files(spark, d)
    cut = files.select(F.replace("path", F.lit("/r/"), F.lit("/cut/")).alias("path"), F.substring("content", 1, 12).alias("content"))
    return parsers.parse_failures(files.unionByName(cut)).groupBy("reason").agg(F.count("*").alias("n"))


_CUT = {n: c.format(k="1")[:12] for n, c, _ in _FORMATS if n.rsplit("/", 1)[-1] in {*parsers.JSON_FILES, *parsers.MARKS} or n.endswith(".csproj")}
_REASONS = [f"{'invalid JSON in' if n in parsers.JSON_FILES else 'unknown form of'} {n}" for n in _CUT if n in parsers.JSON_FILES or n in ("pnpm-lock.yaml", "gradle.lockfile", "yarn.lock")]
PARSE_FAILURES = (
    "WITH w(reason) AS (VALUES " + ", ".join(f"('{r}')" for r in [*_REASONS, "invalid JSON in package-lock.json"]) + ") SELECT reason, count(*) AS n FROM part, w GROUP BY reason"
)


def latest_tags(spark, d):
    p = table(spark, d, "part")
    packages = p.filter("p_size > 10").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("string").alias("latest_tag"))
    wanted = p.select(F.when(F.col("p_partkey") % 4 == 0, "pypi").otherwise("npm").alias("ecosystem"), F.col("p_partkey").cast("string").alias("name"))
    return registry.latest_versions(wanted, packages).select("ecosystem", "name", "latest")


LATEST = "SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem, p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 4 <> 0 AND p_size > 10 THEN p_size::VARCHAR END AS latest FROM part"


def url_quoting(spark, d):
    """Commands with names that need quotes."""
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("a b'"), "p_partkey").alias("name"))
    return p.select("p_partkey", text.shell_quoted(F.col("name")).alias("quoted"))


QUOTING = "SELECT p_partkey, '''a b''\\''''' || p_partkey || '''' AS quoted FROM part"

def scan_cached(spark, d):
    """As scan_findings, where a cache answers for packages of even size: those of sizes divisible by 4 it knows to be fine, entries of the others are too old."""
    p = table(spark, d, "part")
    deps = p.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.expr("p_partkey % 150")).alias("name"), F.col("p_size").cast("string").alias("version"))
    index = orders(spark, d).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.expr("o_custkey % 150")).alias("name"), F.expr("cast(o_orderkey % 50 as string)").alias("version"), F.concat(F.lit("V"), F.expr("o_custkey % 90")).alias("id"))
    now = F.lit("2026-01-02").cast("timestamp_ntz")
    size = F.col("version").cast("int")
    kind = ", ".join(c.strip().replace(" ", ": ", 1) for c in VULNERABILITY.split(","))
    cached = deps.distinct().filter(size % 2 == 0).select("ecosystem", "name", "version", F.when(size % 4 == 0, now).otherwise(F.lit("2026-01-01").cast("timestamp_ntz")).alias("fetched_at"), F.array().cast(f"array<struct<{kind}>>").alias("vulns"))
    vulns, cache = pipelines.scan_cached(deps, cached, index, spark.createDataFrame([], ADVISORY), Options(), now)
    found = vulns.select(F.lit("found").alias("kind"), "package", "version", "id", "severity")
    none = F.lit(None).cast("string")
    return found.unionByName(cache.select(F.when(F.col("fetched_at") == now, "fresh").otherwise("old").alias("kind"), F.col("name").alias("package"), "version", none.alias("id"), none.alias("severity")))


SCAN_CACHED = """
WITH w AS (SELECT DISTINCT 'p' || p_partkey % 150 AS package, p_size AS size FROM part),
i AS (SELECT DISTINCT 'p' || o_custkey % 150 AS package, o_orderkey % 50 AS size, 'V' || o_custkey % 90 AS id FROM orders),
f AS (SELECT w.package, w.size, i.id FROM w JOIN i USING (package, size) WHERE w.size % 4 <> 0)
SELECT 'found' AS kind, package, size::VARCHAR AS version, id, 'CRITICAL' AS severity FROM f
UNION ALL SELECT CASE WHEN size % 4 = 0 OR NOT bad THEN 'fresh' ELSE 'old' END, package, size::VARCHAR, NULL, NULL
FROM (SELECT *, EXISTS (SELECT 1 FROM f WHERE f.package = w.package AND f.size = w.size) AS bad FROM w) WHERE NOT bad OR size % 2 = 0
"""


def npm_manifests(spark, d):
    """A package.json for each part: exact versions, ranges, what comes from elsewhere, and developers' dependencies."""
    content = """{"name": "n", "version": "9.9.9", "dependencies": {"Exact{k}": "1.{k}.0", "caret{k}": "^2.{k}.1", "git{k}": "git+https://x/y.git#1.0.0", "any{k}": "*"}, "devDependencies": {"dev{k}": ">= 3.0.{k}-rc.1", "file{k}": "file:../x"}, "optionalDependencies": {"opt{k}": "4.0.0+b{k}"}}"""
    k = F.col("p_partkey").cast("string")
    files = dealt(table(spark, d, "part").select("p_partkey"), 50_000).select(F.concat(F.lit("/r/"), k, F.lit("/package.json")).alias("path"), F.replace(F.lit(content), F.lit("{k}"), k).alias("content"))
    return parsers.npm_manifest(files).select("source_file", "name", "version", "is_dev", "is_direct", "is_range", "is_pinned")


NPM_MANIFESTS = """
SELECT '/r/' || p_partkey || '/package.json' AS source_file, replace(n, '{k}', p_partkey::VARCHAR) AS name, replace(v, '{k}', p_partkey::VARCHAR) AS version, dev AS is_dev, true AS is_direct, range AS is_range, NOT range AS is_pinned
FROM part, (VALUES ('exact{k}', '1.{k}.0', false, false), ('caret{k}', '2.{k}.1', false, true), ('dev{k}', '3.0.{k}-rc.1', true, true), ('opt{k}', '4.0.0+b{k}', false, false)) t(n, v, dev, range)
"""


def yarn_berry(spark, d):
    """A yarn.lock of the newer kind for each part; the project itself is no dependency."""
    content = """__metadata:\n  version: 6\n\n"@s/a{k}@npm:^1.0.0, @s/a{k}@npm:^1.1.0":\n  version: 1.1.{k}\n  resolution: "@s/a{k}@npm:1.1.{k}"\n  checksum: c{k}\n  languageName: node\n\n"b{k}@npm:2.0.0":\n  version: 2.0.0\n\n"app@workspace:.":\n  version: 0.0.0-use.local\n"""
    k = F.col("p_partkey").cast("string")
    files = dealt(table(spark, d, "part").select("p_partkey"), 50_000).select(F.concat(F.lit("/r/"), k, F.lit("/yarn.lock")).alias("path"), F.replace(F.lit(content), F.lit("{k}"), k).alias("content"))
    return parsers.yarn_lock(files).select("source_file", "name", "version", "integrity")


YARN_BERRY = """
SELECT '/r/' || p_partkey || '/yarn.lock' AS source_file, replace(n, '{k}', p_partkey::VARCHAR) AS name, replace(v, '{k}', p_partkey::VARCHAR) AS version, replace(i, '{k}', p_partkey::VARCHAR) AS integrity
FROM part, (VALUES ('@s/a{k}', '1.1.{k}', 'c{k}'), ('b{k}', '2.0.0', NULL)) t(n, v, i)
"""


def npm_documents(spark, d):
    """Registry documents of customers, whose orders are their versions; every ninth order has no time, every tenth document is broken."""
    o = table(spark, d, "orders")
    version = F.concat(F.lit("1.0."), "o_orderkey")
    time = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.struct(F.struct(F.concat(F.lit("clerk"), F.col("o_orderkey") % 3).alias("name")).alias("_npmUser"), F.create_map(F.lit("install"), F.lit("x")).alias("scripts"))
    each = o.select("o_custkey", version.alias("v"), F.when(F.col("o_orderkey") % 9 != 0, time).alias("t"), entry.alias("e"))
    docs = each.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("v", "e"))).alias("versions"), F.map_from_entries(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("v", "t")))).alias("time"), F.max("v").alias("latest"))
    text = F.to_json(F.struct(F.concat(F.lit("c"), "o_custkey").alias("name"), F.struct("latest").alias("dist-tags"), "time", "versions", F.array(F.struct(F.lit("m").alias("name"))).alias("maintainers"), F.struct(F.lit("git").alias("url")).alias("repository")))
    content = F.when(F.col("o_custkey") % 10 == 0, F.concat(F.lit("<"), text)).otherwise(text)
    packages, versions = registry.npm_tables(docs.select(content.alias("content")))
    return versions.join(packages, "name").select("name", "version", "published_at", "publisher", F.col("scripts")["install"].alias("script"), (F.col("version") == F.col("latest_tag")).alias("is_latest"), F.array_join("maintainers", ",").alias("maintainers"), "repository")


NPM_DOCUMENTS = """
SELECT 'c' || o_custkey AS name, '1.0.' || o_orderkey AS version, o_orderdate::TIMESTAMP AS published_at, 'clerk' || o_orderkey % 3 AS publisher, 'x' AS script,
       '1.0.' || o_orderkey = max('1.0.' || o_orderkey) OVER (PARTITION BY o_custkey) AS is_latest, 'm' AS maintainers, 'git' AS repository
FROM orders WHERE o_custkey % 10 <> 0 QUALIFY o_orderkey % 9 <> 0
"""


def poll_worst(spark, d):
    """The ten worst findings on the installed parts of scan_findings, as the watch's timer reports them."""
    p = table(spark, d, "part")
    deps = p.select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.expr("p_partkey % 150")).alias("name"), F.col("p_size").cast("string").alias("version"))
    index = orders(spark, d).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.expr("o_custkey % 150")).alias("name"), F.expr("cast(o_orderkey % 50 as string)").alias("version"), F.concat(F.lit("V"), F.expr("o_custkey % 90"), F.lit("-"), F.expr("o_orderkey % 50")).alias("id"))
    return watch.poll(deps, index, spark.createDataFrame([], ADVISORY), "HIGH").select("package", "version", "id", "severity", "total")


POLL_WORST = """
WITH f AS (SELECT DISTINCT 'p' || p_partkey % 150 AS package, p_size::VARCHAR AS version, 'V' || o_custkey % 90 || '-' || o_orderkey % 50 AS id FROM part JOIN orders ON p_partkey % 150 = o_custkey % 150 AND p_size = o_orderkey % 50)
SELECT package, version, id, 'CRITICAL' AS severity, (SELECT count(*) FROM f) AS total FROM f ORDER BY package, id LIMIT 10
"""


def discovered_files(spark, d):
    """Which of a folder's files are read: its lockfiles, or the manifests of ecosystems without one. Folders lack some formats each."""
    files = _format_files(spark, d, (F.col("at") < len(_FORMATS)) & ((F.col("k") + F.col("at") + 1) % 3 != 0))
    shaped = files.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), text.base_name(F.col("path")).alias("file"), "content")
    return discovery.preferred_files(shaped).select("path", "ecosystem", "kind", "fallback")


_PLACES = ", ".join(f"({n}, '{f}', '{e}', '{kind}')" for n, (f, *_) in enumerate(_FORMATS, 1) for e, _, locks, manifests in ECOSYSTEMS for kind, names in (("lock", locks), ("manifest", manifests)) if f in names or ("*.csproj" in names and f.endswith(".csproj")))
DISCOVERED = f"""
WITH f(n, file, ecosystem, kind) AS (VALUES {_PLACES}),
x AS (SELECT p_partkey, f.*, bool_or(kind = 'lock') OVER (PARTITION BY p_partkey, ecosystem) AS locked FROM part, f WHERE (p_partkey + n) % 3 <> 0)
SELECT '/r/' || p_partkey || '/' || file AS path, ecosystem, kind, NOT locked AS fallback FROM x WHERE NOT locked OR kind = 'lock'
"""


QUERIES = {
    "scan_cached": (scan_cached, SCAN_CACHED),
    "npm_manifests": (npm_manifests, NPM_MANIFESTS),
    "yarn_berry": (yarn_berry, YARN_BERRY),
    "npm_documents": (npm_documents, NPM_DOCUMENTS),
    "poll_worst": (poll_worst, POLL_WORST),
    "discovered_files": (discovered_files, DISCOVERED),
    "scan_findings": (scan_findings, _SCAN + "SELECT * FROM f"),
    "scan_verdict": (scan_verdict, SCAN_VERDICT),
    "scan_narrowed": (scan_narrowed, _SCAN + "SELECT id, package, version, severity FROM f"),
    "report_document": (report_document, REPORT_DOCUMENT),
    "report_rows": (report_rows, REPORT_ROWS),
    "guard_plan": (guard_plan, GUARD_PLAN),
    "fix_plan": (fix_plan, FIX_PLAN),
    "package_profiles": (package_profiles, PROFILES),
    "metadata_signals": (metadata_signals, SIGNALS),
    "parse_all_formats": (parse_all_formats, PARSE_ALL),
    "parse_failures": (parse_failures, PARSE_FAILURES),
    "analyze_results": (analyze_results, _ANALYSIS + "SELECT * FROM f"),
    "analyze_verdict": (analyze_verdict, ANALYZE_VERDICT),
    "fix_verdict": (fix_verdict, FIX_VERDICT),
    "latest_tags": (latest_tags, LATEST),
    "url_quoting": (url_quoting, QUOTING),
}
