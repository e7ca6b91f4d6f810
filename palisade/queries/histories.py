"""Queries: publish histories, behaviour, rules and scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palisade.functions.severity import level_of
from palisade.operators import provenance as attested
from palisade.operators import code_rules, registry, relational, rules
from palisade.options import Options
from palisade.plans import pipelines
from palisade.queries.tables import events_with_end, table
from palisade.schema import DAY_MS, HOUR_MS

KEY = dict(key="user_id", at="ts", tie=["event_id"])
_RANKED = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)"
_PAIR = (
    _RANKED
    + """, p AS (
  SELECT user_id, max(event_type) FILTER (back = 1) AS latest_event_type, max(event_type) FILTER (back = 2) AS previous_event_type,
         max(ts) FILTER (back = 1) AS latest_ts, max(ts) FILTER (back = 2) AS previous_ts FROM r WHERE back <= 2 GROUP BY user_id)
"""
)


def _ms(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) // 1000)"


def _pair(spark, d):
    return registry.latest_and_previous(table(spark, d, "events"), ["event_type", "ts"], **KEY)


def version_latest_previous(spark, d):
    return _pair(spark, d)


def publish_interval(spark, d):
    return registry.publish_interval(_pair(spark, d), "ts").select("user_id", "interval_ms")


def package_age(spark, d):
    e = events_with_end(spark, d)
    return e.groupBy("user_id").agg(registry.millis_between(F.max("as_of"), F.min("ts")).alias("age_ms"))


def dormancy_last5(spark, d):
    out = registry.dormancy(table(spark, d, "events"), 5, **KEY)
    return out.withColumn("dormant", F.coalesce(F.col("dormancy_ms") > DAY_MS, F.lit(False)))


DORMANCY = (
    _RANKED
    + f""", g AS (SELECT user_id, {_ms('ts', 'lag(ts) OVER (PARTITION BY user_id ORDER BY back DESC)')} AS gap FROM r WHERE back <= 5)
SELECT user_id, max(gap) FILTER (gap > 0) AS dormancy_ms, coalesce(max(gap) FILTER (gap > 0) > {DAY_MS}, false) AS dormant FROM g GROUP BY user_id"""
)


def rapid_publish(spark, d):
    """Every event that follows its user's last one within ten minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("interval_ms", registry.millis_between(F.col("ts"), F.lag("ts").over(w)))
    team = F.when(F.col("event_type") == "view", 2).otherwise(1)
    return e.select("event_id", "interval_ms", rules.rapid_severity(F.col("interval_ms"), team, F.col("user_id") % 10 == 0).alias("severity")).filter("severity is not null")


RAPID = f"""
SELECT event_id, interval_ms, CASE WHEN user_id % 10 = 0 OR (interval_ms = 0 AND event_type = 'view') THEN 'LOW' ELSE 'HIGH' END AS severity
FROM (SELECT *, {_ms('ts', 'lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS interval_ms FROM events) WHERE interval_ms >= 0 AND interval_ms < 600000
"""


def maintainer_change(spark, d):
    """The last event's type differs from the one before: critical if it is less than 90 hours old (hours stand for days)."""
    end = table(spark, d, "events").agg(F.max("ts").alias("as_of"))
    p = _pair(spark, d).crossJoin(F.broadcast(end))  # one row
    since = registry.millis_between(F.col("as_of"), F.col("latest_ts")) * 24
    hit = p.filter(registry.changed_publisher(F.col("latest_event_type"), F.col("previous_event_type")))
    return hit.select("user_id", "previous_event_type", "latest_event_type", rules.maintainer_severity(since, F.col("user_id") % 5).alias("severity"))


MAINTAINER = _PAIR + f"""
SELECT user_id, previous_event_type, latest_event_type,
       CASE WHEN {_ms('(SELECT max(ts) FROM events)', 'latest_ts')} * 24 < {90 * DAY_MS} THEN 'CRITICAL' WHEN user_id % 5 >= 3 THEN 'LOW' ELSE 'MODERATE' END AS severity
FROM p WHERE latest_event_type <> previous_event_type"""


def major_jump(spark, d):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    version = F.concat(F.col("p_size").cast("string"), F.lit(".0.1"))
    p = table(spark, d, "part").select("p_brand", "p_partkey", version.alias("v")).withColumn("before", F.lag("v").over(w))
    return p.select("p_brand", "p_partkey", registry.major_jump(F.col("v"), F.col("before")).alias("jump")).filter("jump >= 3")


MAJOR = "SELECT p_brand, p_partkey, jump FROM (SELECT p_brand, p_partkey, (p_size - lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey))::BIGINT AS jump FROM part) WHERE jump >= 3"


def _order_parts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    recent = registry.ranked(o, "o_custkey", "o_orderdate", ["o_orderkey"]).filter("back <= 2")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return recent.join(items, recent["o_orderkey"] == items["l_orderkey"], "left")


_ORDERS = "WITH o AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 2), b AS (SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM o), x AS (SELECT b.*, l_partkey FROM b LEFT JOIN lineitem ON l_orderkey = o_orderkey)"


def added_removed_deps(spark, d):
    x = _order_parts(spark, d).groupBy("o_custkey").agg(*[F.collect_set(F.when(F.col("back") == n, F.col("l_partkey").cast("string"))).alias(c) for n, c in ((1, "now"), (2, "old"))], F.max("back").alias("backs"))
    added, removed = registry.added_and_removed(F.col("now"), F.when(F.col("backs") == 2, F.col("old")))
    return x.select("o_custkey", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"))


ADDED = _ORDERS + """,
s AS (SELECT o_custkey, max(back) AS backs, coalesce(list(DISTINCT l_partkey::VARCHAR) FILTER (back = 1 AND l_partkey IS NOT NULL), []) AS n, coalesce(list(DISTINCT l_partkey::VARCHAR) FILTER (back = 2 AND l_partkey IS NOT NULL), []) AS p FROM x GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN backs < 2 THEN '' ELSE array_to_string(list_sort(list_filter(n, lambda e: NOT list_contains(p, e))), ',') END AS added,
       CASE WHEN backs < 2 THEN '' ELSE array_to_string(list_sort(list_filter(p, lambda e: NOT list_contains(n, e))), ',') END AS removed FROM s"""


def new_dep_profile(spark, d):
    """Findings on the parts that a customer's last order has and the one before hasn't."""
    x = _order_parts(spark, d).filter("l_partkey is not null").groupBy("o_custkey", "l_partkey").agg(F.min("back").alias("first"), F.max("back").alias("last"), F.max("o_orderdate").alias("publish_time"))
    new = x.filter("first = 1 and last = 1")
    parts = table(spark, d, "part").filter("p_size <> 13").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"), (F.col("p_size").cast("bigint") * DAY_MS).alias("dep_age_ms"), (F.col("p_partkey") % 4).cast("int").alias("dep_maintainers"), (F.col("p_size") % 5).alias("dep_versions"), (F.col("p_partkey") % 3).cast("string").alias("dep_publisher"), (F.col("p_partkey") % 7 == 0).alias("dep_scripts"))
    pairs = new.join(parts, "l_partkey", "left").withColumns({"known": F.coalesce("known", F.lit(False)), "publisher": (F.col("o_custkey") % 3).cast("string"), "dep_publish_time": F.expr("publish_time + interval '1' day * cast(l_partkey % 5 as int)")})
    return rules.new_dependency_findings(pairs).select("o_custkey", "l_partkey", "signal", "severity")


NEW_DEPS = _ORDERS + """,
n AS (SELECT o_custkey, l_partkey FROM x WHERE l_partkey IS NOT NULL GROUP BY ALL HAVING min(back) = 1 AND max(back) = 1),
j AS (SELECT n.*, p_partkey IS NOT NULL AS known, p_size, p_partkey FROM n LEFT JOIN (SELECT * FROM part WHERE p_size <> 13) p ON p_partkey = l_partkey),
f AS (
  SELECT o_custkey, l_partkey, 'PHANTOM_DEPENDENCY' AS signal, 'CRITICAL' AS severity FROM j WHERE known AND p_size < 7
  UNION ALL SELECT o_custkey, l_partkey, 'PHANTOM_DEPENDENCY', 'HIGH' FROM j WHERE known AND p_partkey % 4 <= 1 AND p_size % 5 <= 2
  UNION ALL SELECT o_custkey, l_partkey, 'CIRCULAR_STAGING', 'CRITICAL' FROM j WHERE known AND p_partkey % 3 = o_custkey % 3 AND l_partkey % 5 < 2
  UNION ALL SELECT o_custkey, l_partkey, 'NEW_DEP_HAS_INSTALL_SCRIPTS', 'HIGH' FROM j WHERE known AND p_partkey % 7 = 0
)
SELECT * FROM f UNION ALL SELECT o_custkey, l_partkey, 'NEW_DEPENDENCY', CASE WHEN known THEN 'MODERATE' ELSE 'HIGH' END FROM j ANTI JOIN f USING (o_custkey, l_partkey)"""


def circular_staging(spark, d):
    """A user and the next one as package and dependency: same type on the last event, within 48 hours."""
    last = _pair(spark, d).select("user_id", F.col("latest_event_type").alias("publisher"), F.col("latest_ts").alias("publish_time"))
    dep = last.select((F.col("user_id") - 1).alias("user_id"), F.col("publisher").alias("dep_publisher"), F.col("publish_time").alias("dep_publish_time"))
    old = {"known": F.lit(True), "dep_age_ms": F.lit(400 * DAY_MS), "dep_maintainers": F.lit(9), "dep_versions": F.lit(9), "dep_scripts": F.lit(False)}
    found = rules.new_dependency_findings(last.join(dep, "user_id").withColumns(old))
    return found.select("user_id", F.col("publisher").alias("latest_event_type"), "signal", "severity")


STAGING = _PAIR + f"""SELECT a.user_id, a.latest_event_type, CASE WHEN hit THEN 'CIRCULAR_STAGING' ELSE 'NEW_DEPENDENCY' END AS signal, CASE WHEN hit THEN 'CRITICAL' ELSE 'MODERATE' END AS severity
FROM (SELECT a.*, coalesce(a.latest_event_type = b.latest_event_type AND abs({_ms('a.latest_ts', 'b.latest_ts')}) < {48 * HOUR_MS}, false) AS hit FROM p a JOIN p b ON b.user_id = a.user_id + 1) a"""

#: Event types as capabilities; the third and fifth are dangerous ones.
_CAPS = {"click": "filesystem_write", "view": "dynamic_loading", "purchase": "network", "signup": "install_scripts", "error": "process_spawn"}
_CAP_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CAPS.items()) + " ELSE event_type END"


def _days(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.expr(_CAP_SQL).alias("cap"))
    return e.groupBy("user_id", "day").agg(F.array_sort(F.collect_set("cap")).alias("capabilities"), F.count("*").alias("n"))


#: Event types as findings in code, and the capabilities that these show.
_PATTERNS = {"click": ("FILESYSTEM_WRITE", "filesystem_write"), "view": ("DYNAMIC_IMPORT", "dynamic_loading"), "purchase": ("NETWORK_ACCESS", "network"), "signup": ("BASE64_DECODE", "payload_decode"), "error": ("PROCESS_SPAWN", "process_spawn")}


def capability_profile(spark, d):
    pattern = F.create_map(*[F.lit(x) for kind, (p, _) in _PATTERNS.items() for x in (kind, p)])
    found = table(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), pattern[F.col("event_type")].alias("pattern"), F.lit("HIGH").alias("severity"))
    return code_rules.profile(found, ["user_id", "day"]).select("user_id", "day", F.array_join("capabilities", ",").alias("capabilities"))


_SHOWN = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, (_, c) in _PATTERNS.items()) + " END"
CAPABILITY = f"SELECT user_id, ts::DATE::VARCHAR AS day, coalesce(string_agg(DISTINCT {_SHOWN}, ',' ORDER BY {_SHOWN}), '') AS capabilities FROM events GROUP BY user_id, ts::DATE"


def behaviour_diff(spark, d):
    """What changed from a user's day to the next day with events: capabilities, number of events, of types, whether any is a view."""
    w = Window.partitionBy("user_id").orderBy("day")
    x = _days(spark, d).withColumn("before", F.lag("day").over(w))
    shape = lambda key: x.select(F.struct("user_id", key).alias("name"), "capabilities", F.col("n").alias("dependency_count"), F.size("capabilities").alias("maintainer_count"), F.array_contains("capabilities", "dynamic_loading").alias("has_repository"))
    now = x.select(F.struct("user_id", F.col("before").alias("day")).alias("name"), "day", "capabilities", F.col("n").alias("dependency_count"), F.size("capabilities").alias("maintainer_count"), F.array_contains("capabilities", "dynamic_loading").alias("has_repository"))
    keyed = now.withColumn("name", F.struct(F.col("name.user_id").alias("user_id"), F.coalesce("name.day", F.lit("1900-01-01").cast("date")).alias("day")))
    out = rules.diff_profiles(keyed.drop("day"), shape("day"))
    return out.select(F.col("name.user_id").alias("user_id"), F.col("name.day").cast("string").alias("since"), "signal", "severity", "detail")


_DANGER = "('network', 'process_spawn')"
BEHAVIOUR = f"""
WITH d AS (SELECT user_id, ts::DATE AS day, list(DISTINCT {_CAP_SQL}) AS caps, count(*) AS n FROM events GROUP BY 1, 2),
x AS (SELECT *, lag(day) OVER w AS before, lag(caps) OVER w AS pcaps, lag(n) OVER w AS pn FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day)),
y AS (SELECT *, coalesce(before, DATE '1900-01-01') AS since FROM x),
f AS (
  SELECT user_id, since, CASE WHEN before IS NULL THEN 'INITIAL_DANGEROUS_CAPABILITY' ELSE 'CAPABILITY_ESCALATION' END AS signal, CASE WHEN before IS NULL THEN 'MODERATE' ELSE 'CRITICAL' END AS severity, c AS detail
  FROM (SELECT *, unnest(caps) AS c FROM y) WHERE c IN {_DANGER} AND (before IS NULL OR NOT list_contains(pcaps, c))
  UNION ALL SELECT user_id, since, 'DEPENDENCY_SPIKE', 'HIGH', NULL FROM y WHERE before IS NOT NULL AND n > 2 * pn AND n > 5
  UNION ALL SELECT user_id, since, 'MAINTAINER_REDUCTION', 'MODERATE', NULL FROM y WHERE before IS NOT NULL AND len(caps) < len(pcaps)
  UNION ALL SELECT user_id, since, 'REPOSITORY_REMOVED', 'MODERATE', NULL FROM y WHERE before IS NOT NULL AND list_contains(pcaps, 'dynamic_loading') AND NOT list_contains(caps, 'dynamic_loading')
)
SELECT * REPLACE (since::VARCHAR AS since) FROM f
"""


def dependency_spike(spark, d):
    """Customers whose last order has over twice the lines of the one before, and over five."""
    x = _order_parts(spark, d).groupBy("o_custkey").agg(*[F.count(F.when(F.col("back") == n, F.col("l_partkey"))).alias(c) for n, c in ((1, "now"), (2, "old"))])
    shape = lambda count: x.select(F.col("o_custkey").alias("name"), F.array().cast("array<string>").alias("capabilities"), F.col(count).alias("dependency_count"), F.lit(1).alias("maintainer_count"), F.lit(True).alias("has_repository"))
    return rules.diff_profiles(shape("now"), shape("old")).select(F.col("name").alias("o_custkey"), "signal", "severity")


SPIKE = _ORDERS + """, c AS (SELECT o_custkey, count(l_partkey) FILTER (back = 1) AS now, count(l_partkey) FILTER (back = 2) AS old FROM x GROUP BY 1) SELECT o_custkey, 'DEPENDENCY_SPIKE' AS signal, 'HIGH' AS severity FROM c WHERE old > 0 AND now > 2 * old AND now > 5"""


def risk_score(spark, d):
    """Scores of users: their events as signals of severities by type; errors of every tenth user are known to be good."""
    e = table(spark, d, "events")
    kind = F.create_map(*[F.lit(x) for kv in {"click": "LOW", "view": "LOW", "purchase": "MODERATE", "signup": "HIGH", "error": "CRITICAL"}.items() for x in kv])
    signals = e.select(F.col("user_id").alias("name"), F.col("event_type").alias("signal"), F.coalesce(kind[F.col("event_type")], F.lit("OTHER")).alias("severity"), ((F.col("user_id") % 10 == 0) & (F.col("event_type") == "error")).alias("known_good"))
    context = table(spark, d, "events").groupBy(F.col("user_id").alias("name")).agg((F.col("name") % 60 * DAY_MS).alias("package_age_ms"), F.expr("cast(nullif(name % 4, 3) as int)").alias("maintainer_count"))
    return rules.risk_scores(signals, context)


RISK = f"""
WITH s AS (SELECT user_id, event_type, CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 5 WHEN 'error' THEN 10 ELSE 1 END * CASE WHEN user_id % 10 = 0 AND event_type = 'error' THEN 0.2 ELSE 1.0 END::DOUBLE AS w FROM events),
g AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS k, sum(w::DOUBLE) AS w FROM s GROUP BY 1),
c AS (
  SELECT u.user_id AS name, coalesce(n, 0) AS n_signals, coalesce(k, 0) AS distinct_signals,
         floor(coalesce(w, 0) * CASE WHEN u.user_id % 60 < 30 THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN u.user_id % 4 <= 1 THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN k >= 3 THEN 1.5 ELSE 1.0 END::DOUBLE * CASE WHEN k >= 5 THEN 2.0 ELSE 1.0 END::DOUBLE * 10 + 0.5) / 10 AS risk_score
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g USING (user_id)
)
SELECT *, CASE WHEN risk_score >= 30 THEN 'CRITICAL' WHEN risk_score >= 15 THEN 'HIGH' WHEN risk_score >= 5 THEN 'MODERATE' WHEN risk_score > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level FROM c
"""


def flagged_results(spark, d):
    """Users by level of their errors, without those of no or unknown risk."""
    x = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"))
    level = F.when(F.col("user_id") % 17 == 0, "UNKNOWN").otherwise(level_of(F.col("errors")))
    return pipelines.flagged(x.select("user_id", "errors", level.alias("risk_level")), Options(least_severity="MODERATE"))


FLAGGED = "SELECT * FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS errors, CASE WHEN user_id % 17 = 0 THEN 'UNKNOWN' WHEN errors >= 30 THEN 'CRITICAL' WHEN errors >= 15 THEN 'HIGH' WHEN errors >= 5 THEN 'MODERATE' WHEN errors > 0 THEN 'LOW' ELSE 'NONE' END AS risk_level FROM events GROUP BY 1) WHERE risk_level IN ('CRITICAL', 'HIGH', 'MODERATE')"


def provenance_status(spark, d):
    """Users' events as attestations: some lookups of errors fail, payloads of clicks can't be read. Every other user has none."""
    e = table(spark, d, "events")
    doc = F.when(F.col("event_type") == "click", F.lit("not json")).otherwise(F.concat(F.lit('{"predicate":{"buildType":"'), "event_type", F.lit('","invocation":{"configSource":{"uri":"git+'), F.col("user_id").cast("string"), F.lit('"}}}}')))
    failed = (F.col("event_type") == "error") & (F.col("event_id") % 20 == 0)
    rows = e.select("user_id", F.col("event_id").alias("ord"), F.base64(F.encode(doc, "utf-8")).alias("payload"), (F.col("event_id") % 3).cast("int").alias("tlog_entries"), (~failed).alias("fetched"))
    users = e.select((F.col("user_id") + F.expr("event_id % 2 * 100000")).alias("user_id")).distinct()
    return attested.provenance(users, rows, ["user_id"])


PROVENANCE = """
WITH g AS (
  SELECT user_id, bool_or(event_type = 'error' AND event_id % 20 = 0) AS failed, bool_or(event_type <> 'click') AS fine, arg_max(event_type, event_id) FILTER (event_type <> 'click') AS build,
         bool_or(event_type <> 'click' AND event_id % 3 > 0) AS logged
  FROM events GROUP BY user_id
),
u AS (SELECT DISTINCT user_id + event_id % 2 * 100000 AS user_id FROM events)
SELECT u.user_id, CASE WHEN g.user_id IS NULL THEN false WHEN failed THEN NULL WHEN fine THEN true END AS has_provenance, build AS build_type,
       CASE WHEN build IS NOT NULL THEN 'git+' || u.user_id END AS source_repo, CASE WHEN logged THEN 'verified' END AS transparency
FROM u LEFT JOIN g USING (user_id)
"""


def direct_preferred(spark, d):
    """Orders as files: their returned lines if they have any, else all."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return relational.prefer(items, ["l_orderkey"], F.col("l_returnflag") == "R")


DIRECT = "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, NOT has AS fallback FROM (SELECT *, bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS has FROM lineitem) WHERE NOT has OR l_returnflag = 'R'"


def release_history(spark, d):
    """Brands as packages, parts as releases, dated by size; the tagged release is the one of the largest key but one."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    at = F.concat(F.lit("2024-01-01T00:"), F.lpad((F.col("p_size") % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0"), F.lit("Z"))
    tag = p.groupBy("p_brand").agg(F.max(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey"))).cast("string").alias("latest"))
    releases = p.join(tag, "p_brand").select(F.col("p_brand").alias("name"), "latest", F.col("p_partkey").cast("string").alias("version"), at.alias("uploaded"), (F.col("p_size") == 7).alias("yanked"))
    out = registry.pypi_profiles(releases, F.lit("2024-01-02").cast("timestamp_ntz"))
    return out.select("name", "latest_version", "previous_version", "publish_interval_ms", "package_age_ms", "version_count", F.array_join("yanked_versions", ",").alias("yanked"))


RELEASES = """
WITH r AS (SELECT p_brand AS name, p_partkey::VARCHAR AS version, p_size % 60 * 60 + p_partkey % 60 AS s, p_size = 7 AS yanked, max(p_partkey) FILTER (p_partkey % 2 = 0) OVER (PARTITION BY p_brand)::VARCHAR AS latest FROM part),
x AS (SELECT *, lag(version) OVER w AS pv, lag(s) OVER w AS ps, row_number() OVER w AS n FROM r WINDOW w AS (PARTITION BY name ORDER BY s, version)),
g AS (
  SELECT name, any_value(latest) AS latest, max(pv) FILTER (version = latest) AS pv, max(ps) FILTER (version = latest) AS ps, max(s) FILTER (version = latest) AS ls, arg_max(version, n) AS lv, arg_max(s, n) AS lls,
         arg_max(pv, n) AS pv2, arg_max(ps, n) AS ps2, min(s) AS first_s, count(*)::INT AS version_count, coalesce(string_agg(version, ',' ORDER BY version) FILTER (yanked), '') AS yanked
  FROM x GROUP BY name
)
SELECT name, coalesce(latest, lv) AS latest_version, coalesce(pv, pv2) AS previous_version,
       (CASE WHEN latest IS NULL THEN lls ELSE ls END - CASE WHEN pv IS NULL THEN ps2 ELSE ps END) * 1000::BIGINT AS publish_interval_ms, (86400 - first_s) * 1000::BIGINT AS package_age_ms, version_count, yanked FROM g
"""

def version_in_use(spark, d):
    """Of each event the user's last purchase up to then, as the version in use, and the one before it."""
    events = table(spark, d, "events").select(F.col("user_id").alias("name"), "event_id", "event_type", "ts")
    versions = events.filter("event_type = 'purchase'").select("name", F.col("event_id").alias("version"), F.col("ts").alias("published_at"))
    return registry.versions_in_use(events.select("name", "event_id", "ts"), versions, at="ts")


VERSION_IN_USE = """
WITH p AS (SELECT user_id, event_id, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS at FROM events WHERE event_type = 'purchase'),
f AS (SELECT p.*, (SELECT arg_max(q.event_id, (q.ts, q.event_id)) FROM p AS q WHERE q.user_id = p.user_id AND q.ts < p.ts) AS previous FROM p)
SELECT e.user_id AS name, e.event_id, e.ts, arg_max(f.event_id, (f.ts, f.event_id)) AS version, arg_max(coalesce(f.previous, -1), (f.ts, f.event_id)) AS previous
FROM events e LEFT JOIN f ON f.user_id = e.user_id AND f.ts <= e.ts GROUP BY ALL
"""
VERSION_IN_USE = f"SELECT * REPLACE (nullif(previous, -1) AS previous) FROM ({VERSION_IN_USE})"


QUERIES = {
    "version_in_use": (version_in_use, VERSION_IN_USE),
    "direct_preferred": (direct_preferred, DIRECT),
    "release_history": (release_history, RELEASES),
    "version_latest_previous": (version_latest_previous, _PAIR + "SELECT * FROM p"),
    "publish_interval": (publish_interval, _PAIR + f"SELECT user_id, {_ms('latest_ts', 'previous_ts')} AS interval_ms FROM p"),
    "package_age": (package_age, f"SELECT user_id, {_ms('(SELECT max(ts) FROM events)', 'min(ts)')} AS age_ms FROM events GROUP BY user_id"),
    "dormancy_last5": (dormancy_last5, DORMANCY),
    "rapid_publish": (rapid_publish, RAPID),
    "maintainer_change": (maintainer_change, MAINTAINER),
    "major_jump": (major_jump, MAJOR),
    "added_removed_deps": (added_removed_deps, ADDED),
    "new_dep_profile": (new_dep_profile, NEW_DEPS),
    "circular_staging": (circular_staging, STAGING),
    "capability_profile": (capability_profile, CAPABILITY),
    "behaviour_diff": (behaviour_diff, BEHAVIOUR),
    "dependency_spike": (dependency_spike, SPIKE),
    "risk_score": (risk_score, RISK),
    "flagged_results": (flagged_results, FLAGGED),
    "provenance_status": (provenance_status, PROVENANCE),
}
