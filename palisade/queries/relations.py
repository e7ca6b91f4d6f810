"""Queries: lookups, dedup, diffs, caches, severities, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.severity import canonical, order_of
from palisade.operators import advisories, decisions, relational, store
from palisade.queries.tables import ORDER_SQL, SEVERITY_SQL, events_with_end, orders, table
from palisade.sinks import reports


def flagship(spark, d):
    """Packages of customers by severity of their known problems, moderate or worse."""
    o = orders(spark, d).select("o_orderkey", "o_custkey", "severity")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, d, "part").select("p_partkey", "p_brand")
    found = items.join(o, items["l_orderkey"] == o["o_orderkey"]).join(parts, items["l_partkey"] == parts["p_partkey"])
    deps = found.select("o_custkey", "p_brand", "severity").distinct()
    return advisories.filter_by_severity(deps, "MODERATE").groupBy("severity").agg(F.count("*").alias("n"))


FLAGSHIP = f"""
SELECT severity, count(*) AS n FROM (
  SELECT DISTINCT o_custkey, p_brand, {SEVERITY_SQL} AS severity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
) WHERE severity <> 'LOW' GROUP BY severity
"""


def dedup_first_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return relational.first_wins(e, ["user_id", "event_type"], ["event_id"])


DEDUP_FIRST = "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1"


def dedup_last_wins(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return relational.last_wins(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


DEDUP_LAST = "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def severity_filter(spark, d):
    return advisories.filter_by_severity(orders(spark, d).select("o_orderkey", "severity"), "HIGH")


SEVERITY_FILTER = f"SELECT o_orderkey, severity FROM (SELECT o_orderkey, {SEVERITY_SQL} AS severity FROM orders) WHERE severity IN ('CRITICAL', 'HIGH', 'UNKNOWN')"


def severity_counts(spark, d):
    return advisories.count_by_severity(orders(spark, d))


SEVERITY_COUNTS = "SELECT count(*) FILTER (o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '3-MEDIUM') AS moderate, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders"


def severity_rank_topk(spark, d):
    """The ten worst; unknown severities come first, as they may be anything."""
    o = orders(spark, d).select("o_orderkey", "severity", F.coalesce(order_of(F.col("severity")), F.lit(99)).alias("rank"))
    return o.orderBy(F.desc("rank"), "o_orderkey").limit(10)


SEVERITY_TOPK = f"SELECT o_orderkey, severity, coalesce({ORDER_SQL.format('severity')}, 99) AS rank FROM (SELECT o_orderkey, {SEVERITY_SQL} AS severity FROM orders) ORDER BY rank DESC, o_orderkey LIMIT 10"


def severity_synonyms(spark, d):
    name = F.regexp_replace("o_orderpriority", "^[0-9]-", "")
    o = table(spark, d, "orders").select(F.lower(name).alias("given"))
    return o.groupBy("given").agg(F.count("*").alias("n")).select("given", canonical(F.col("given")).alias("severity"), "n")


SYNONYMS = """
SELECT given, CASE upper(given) WHEN 'MEDIUM' THEN 'MODERATE' WHEN 'HIGH' THEN 'HIGH' WHEN 'LOW' THEN 'LOW' END AS severity, n
FROM (SELECT lower(regexp_replace(o_orderpriority, '^[0-9]-', '')) AS given, count(*) AS n FROM orders GROUP BY 1)
"""


def _snapshots(spark, d):
    o = table(spark, d, "orders")
    deps = o.select(F.col("o_custkey").alias("name"), F.lit("npm").alias("ecosystem"), F.col("o_orderpriority").alias("version"), F.col("o_orderstatus").alias("integrity"), F.struct("o_orderdate", "o_orderkey").alias("ord"))
    cut = F.col("ord.o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return deps.filter(cut), deps.filter(~cut)


def snapshot_diff(spark, d):
    return relational.diff_snapshots(*_snapshots(spark, d))


_DIFF = """
WITH x AS (SELECT *, o_orderdate < TIMESTAMP '1998-01-01' AS old FROM orders),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY old, o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
b AS (SELECT o_custkey AS name, o_orderpriority AS v, o_orderstatus AS i FROM y WHERE old),
a AS (SELECT o_custkey AS name, o_orderpriority AS v, o_orderstatus AS i FROM y WHERE NOT old),
diff AS (
  SELECT 'npm' AS ecosystem, coalesce(a.name, b.name) AS name, b.v AS "from", a.v AS "to",
         CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' WHEN a.v <> b.v OR a.i <> b.i THEN 'changed' ELSE 'unchanged' END AS status,
         coalesce(a.v = b.v AND a.i <> b.i, false) AS integrity_changed
  FROM a FULL JOIN b ON a.name = b.name
)
"""
SNAPSHOT_DIFF = _DIFF + "SELECT * FROM diff"


def snapshot_diff_summary(spark, d):
    return relational.diff_summary(snapshot_diff(spark, d))


SNAPSHOT_SUMMARY = (
    _DIFF
    + """, n AS (SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged FROM diff)
SELECT *, added + removed + changed > 0 AS has_changes,
       CASE WHEN added + removed + changed = 0 THEN 'no changes' ELSE concat_ws(', ', CASE WHEN added > 0 THEN added || ' added' END, CASE WHEN removed > 0 THEN removed || ' removed' END, CASE WHEN changed > 0 THEN changed || ' changed' END) END AS summary FROM n"""
)


def changed_packages(spark, d):
    return relational.changed_packages(snapshot_diff(spark, d))


CHANGED = _DIFF + """SELECT ecosystem, name, "to" AS version, status = 'added' AS is_new FROM diff WHERE status IN ('added', 'changed')"""


def lookup_left_coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    both = relational.left_coverage(docs, labels, ["doc_id"])
    return both.select("doc_id", "covered", F.when(~F.col("covered"), "CRITICAL").when(F.col("toxic") == 1, "HIGH").otherwise("LOW").alias("severity"))


COVERAGE = "SELECT d.doc_id, l.doc_id IS NOT NULL AS covered, CASE WHEN l.doc_id IS NULL THEN 'CRITICAL' WHEN l.toxic = 1 THEN 'HIGH' ELSE 'LOW' END AS severity FROM documents d LEFT JOIN labels l USING (doc_id)"


def completeness_verdict(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    both = relational.left_coverage(docs, table(spark, d, "labels").select("doc_id", "toxic"), ["doc_id"])
    verdict = relational.completeness(both)
    findings = both.agg(F.count_if(F.col("toxic") == 1).alias("findings"))
    return verdict.crossJoin(findings).withColumn("exit_code", relational.exit_code(F.col("complete"), F.col("findings")))  # one row each


COMPLETENESS = """
SELECT *, CASE WHEN NOT complete THEN 2 WHEN findings > 0 THEN 1 ELSE 0 END AS exit_code FROM (
  SELECT count(*) AS expected, count(l.doc_id) AS checked, 0::BIGINT AS failed, count(*) = count(l.doc_id) AS complete, count(*) FILTER (toxic = 1) AS findings
  FROM documents d LEFT JOIN labels l USING (doc_id)
)
"""


def cache_partition(spark, d):
    e = events_with_end(spark, d)
    cached = e.groupBy("user_id").agg(F.max("ts").alias("fetched_at"))
    wanted = table(spark, d, "events").select((F.col("user_id") + F.expr("event_id % 2 * 1000")).alias("user_id")).distinct()
    end = e.select("as_of").limit(1)
    return store.partition_by_cache(wanted.crossJoin(F.broadcast(end)), cached, ["user_id"], F.col("as_of"), 86_400_000).select("user_id", "fetched_at", "hit")


CACHE_PARTITION = """
WITH c AS (SELECT user_id, max(ts) AS fetched_at FROM events GROUP BY user_id), w AS (SELECT DISTINCT user_id + event_id % 2 * 1000 AS user_id FROM events)
SELECT w.user_id, fetched_at, coalesce((SELECT max(ts) FROM events) - fetched_at <= INTERVAL 24 HOUR, false) AS hit FROM w LEFT JOIN c USING (user_id)
"""


def cache_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    last = lambda rows: relational.last_wins(rows, ["user_id", "event_type"], ["event_id"])
    return store.upsert(last(e.filter(F.col("ts") < cut)), last(e.filter(F.col("ts") >= cut)), ["user_id", "event_type"])


CACHE_UPSERT = """
WITH o AS (SELECT user_id, event_type, event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
n AS (SELECT user_id, event_type, event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM n)
"""


def cache_prune_stats(spark, d):
    """Entries before and after pruning, beside a cache that knows nothing."""
    e = events_with_end(spark, d)
    return store.stats(entries=e, kept=store.prune(e, F.col("as_of"), 7 * 86_400_000, "ts"), none=store.empty(spark, "signals"))


CACHE_PRUNE = "SELECT count(*) AS entries, count(*) FILTER ((SELECT max(ts) FROM events) - ts <= INTERVAL 168 HOUR) AS kept, 0::BIGINT AS none FROM events"


def lock_over_manifest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return relational.prefer(o, ["o_custkey"], F.col("o_orderstatus") == "F")


LOCK = "SELECT o_custkey, o_orderkey, o_orderstatus, NOT has AS fallback FROM (SELECT *, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS has FROM orders) WHERE NOT has OR o_orderstatus = 'F'"


def fix_candidates_verified(spark, d):
    o = orders(spark, d)
    built = F.concat_ws(".", F.expr("o_orderkey % 4"), F.expr("o_orderkey % 7"), F.expr("o_custkey % 5"))
    vulns = o.select(F.expr("o_custkey % 200").alias("package"), F.col("o_orderkey").alias("id"), F.concat(F.lit(">= "), built).alias("fixed"))
    bad = o.filter("severity = 'CRITICAL'").select(F.expr("o_custkey % 200").alias("package"), built.alias("version"))
    return advisories.verified_fixes(vulns, bad).select("package", "vuln_count", F.size("vuln_ids").cast("long").alias("distinct_ids"), "fix")


FIXES = """
WITH v AS (SELECT o_custkey % 200 AS package, o_orderkey AS id, (o_orderkey % 4) || '.' || (o_orderkey % 7) || '.' || (o_custkey % 5) AS ver, o_orderpriority = '1-URGENT' AS bad FROM orders),
safe AS (SELECT DISTINCT package, ver FROM v ANTI JOIN (SELECT DISTINCT package, ver FROM v WHERE bad) b USING (package, ver)),
best AS (SELECT package, arg_max(ver, split_part(ver, '.', 1)::INT * 10000 + split_part(ver, '.', 2)::INT * 100 + split_part(ver, '.', 3)::INT) AS fix FROM safe GROUP BY package)
SELECT package, count(*) AS vuln_count, count(DISTINCT id) AS distinct_ids, any_value(fix) AS fix FROM v LEFT JOIN best USING (package) GROUP BY package
"""


def guard_decision(spark, d):
    o = orders(spark, d)
    level = F.when(F.col("severity") == "MODERATE", "MODERATE").otherwise(F.col("severity"))
    results = o.select("o_custkey", level.alias("risk_level"), F.expr("if(o_orderkey % 11 = 0 and o_orderstatus = 'F', 1, 0)").alias("vulns"), F.expr("o_orderkey % 29 <> 0").alias("covered"), F.lit(0).alias("warnings"))
    force = F.col("o_custkey") % 2 == 0
    return decisions.guard_inputs(results, ["o_custkey"]).withColumn("decision", decisions.decision(force))


GUARD = f"""
SELECT *, CASE WHEN critical > 0 OR has_vulns THEN 'block' WHEN NOT complete THEN CASE WHEN o_custkey % 2 = 0 THEN 'allow_forced' ELSE 'block' END
               WHEN high > 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'allow_forced' ELSE 'prompt' END ELSE 'allow' END AS decision
FROM (
  SELECT o_custkey, count(*) FILTER (s = 'CRITICAL') AS critical, count(*) FILTER (s = 'HIGH') AS high, count(*) FILTER (s = 'UNKNOWN') AS unknown,
         bool_or(o_orderkey % 11 = 0 AND o_orderstatus = 'F') AS has_vulns, bool_and(o_orderkey % 29 <> 0 AND s <> 'UNKNOWN') AS complete
  FROM (SELECT *, {SEVERITY_SQL} AS s FROM orders) GROUP BY o_custkey
)
"""


def _vulns(spark, d):
    o = orders(spark, d).filter("severity <> 'UNKNOWN'")
    ident = F.concat(F.lit("GHSA-"), F.expr("cast(o_custkey % 50 as string)"))
    return o.select(F.concat(F.lit("pkg:"), F.col("o_custkey").cast("string")).alias("package"), F.col("o_orderkey").cast("string").alias("version"), "severity", ident.alias("display_id"), F.concat(F.lit("100% of "), "o_orderstatus").alias("summary"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(">= "), "o_orderkey")).alias("fixed"), F.lit(None).cast("string").alias("source_file"), F.col("o_orderkey"))


def ci_annotations(spark, d):
    return reports.annotations(_vulns(spark, d))


ANNOTATIONS = f"""
SELECT '::' || CASE WHEN s IN ('CRITICAL', 'HIGH') THEN 'error' ELSE 'warning' END || ' title=' || s || '%3A pkg%3A' || o_custkey || '@' || o_orderkey || '::GHSA-' || (o_custkey % 50) || ' 100%25 of ' || o_orderstatus
       || CASE WHEN o_orderstatus = 'F' THEN ' (fix: >= ' || o_orderkey || ')' ELSE '' END AS value
FROM (SELECT *, {SEVERITY_SQL} AS s FROM orders) WHERE s <> 'UNKNOWN'
"""


def sarif_rules(spark, d):
    return reports.sarif_rules(_vulns(spark, d))


SARIF_RULES = f"""
SELECT 'GHSA-' || (o_custkey % 50) AS id, CASE WHEN s IN ('CRITICAL', 'HIGH') THEN 'error' WHEN s = 'LOW' THEN 'note' ELSE 'warning' END AS level, '100% of ' || o_orderstatus AS text
FROM (SELECT *, {SEVERITY_SQL} AS s FROM orders) WHERE s <> 'UNKNOWN'
QUALIFY row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY 'pkg:' || o_custkey, o_orderkey::VARCHAR) = 1
"""


def sarif_document(spark, d):
    """What all documents hold together, of at most 1000 results each."""
    docs = reports.sarif(_vulns(spark, d), F.lit(True), most=1000)
    read = F.from_json("value", "version string, runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<ruleId: string, level: string>>>>")
    parts = docs.select(read.alias("x")).select("x.version", F.col("x.runs")[0]["results"].alias("results"), F.col("x.runs")[0]["tool"]["driver"]["rules"]["id"].alias("rules"))
    # Told of each document before its results become rows: beside each row, the whole document would be checked again.
    told = parts.select("version", "results", F.forall("results", lambda r: F.array_contains("rules", r["ruleId"])).alias("known"))
    each = told.select("version", "known", F.explode("results").alias("r"))
    return each.groupBy("version").agg(F.count_distinct("r.ruleId").alias("n_rules"), F.count("*").alias("n_results"), F.count_if(F.col("r.level") == "error").alias("n_errors"), F.bool_and("known").alias("known"))


SARIF = f"SELECT '2.1.0' AS version, count(DISTINCT o_custkey % 50) AS n_rules, count(*) AS n_results, count(*) FILTER (s IN ('CRITICAL', 'HIGH')) AS n_errors, true AS known FROM (SELECT *, {SEVERITY_SQL} AS s FROM orders) WHERE s <> 'UNKNOWN'"


def severity_sections(spark, d):
    return reports.sections(_vulns(spark, d))


SECTIONS = f"""
SELECT s AS severity, 'pkg:' || o_custkey || '@' || o_orderkey || '  GHSA-' || (o_custkey % 50) || ' 100% of ' || o_orderstatus || CASE WHEN o_orderstatus = 'F' THEN '  fix: >= ' || o_orderkey ELSE '' END AS line
FROM (SELECT *, {SEVERITY_SQL} AS s FROM orders) WHERE s <> 'UNKNOWN'
"""

QUERIES = {
    "flagship": (flagship, FLAGSHIP),
    "dedup_first_wins": (dedup_first_wins, DEDUP_FIRST),
    "dedup_last_wins": (dedup_last_wins, DEDUP_LAST),
    "severity_filter": (severity_filter, SEVERITY_FILTER),
    "severity_counts": (severity_counts, SEVERITY_COUNTS),
    "severity_rank_topk": (severity_rank_topk, SEVERITY_TOPK),
    "severity_synonyms": (severity_synonyms, SYNONYMS),
    "snapshot_diff": (snapshot_diff, SNAPSHOT_DIFF),
    "snapshot_diff_summary": (snapshot_diff_summary, SNAPSHOT_SUMMARY),
    "changed_packages": (changed_packages, CHANGED),
    "lookup_left_coverage": (lookup_left_coverage, COVERAGE),
    "completeness_verdict": (completeness_verdict, COMPLETENESS),
    "cache_partition": (cache_partition, CACHE_PARTITION),
    "cache_upsert": (cache_upsert, CACHE_UPSERT),
    "cache_prune_stats": (cache_prune_stats, CACHE_PRUNE),
    "lock_over_manifest": (lock_over_manifest, LOCK),
    "fix_candidates_verified": (fix_candidates_verified, FIXES),
    "guard_decision": (guard_decision, GUARD),
    "ci_annotations": (ci_annotations, ANNOTATIONS),
    "sarif_rules": (sarif_rules, SARIF_RULES),
    "sarif_document": (sarif_document, SARIF),
    "severity_sections": (severity_sections, SECTIONS),
}
