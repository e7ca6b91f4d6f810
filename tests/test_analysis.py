import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from palisade.operators import registry as registry_ops
from palisade.operators import rules
from palisade.options import Options
from palisade.plans import analysis, pipelines
from palisade.schema import ADVISORY, PACKAGE, PACKAGE_VERSION

DEPS = "ecosystem string, name string, version string, is_direct boolean, source_file string, ord bigint"
VULNS = "ecosystem string, package string, version string, id string"
NOW = dt.datetime(2026, 1, 1)


@pytest.fixture(scope="module")
def as_of(spark):
    return F.lit(NOW).cast("timestamp_ntz")


def at(days):
    return NOW + dt.timedelta(days=days)


@pytest.fixture(scope="module")
def registry(spark):
    """foo in two ecosystems, of which the PyPI one changed hands; bar with install scripts."""
    packages = [("npm", "foo", None, None, ["a", "b"], "git", "MIT"), ("pypi", "foo", None, None, ["a", "b"], "git", "MIT"), ("npm", "bar", None, None, ["a"], None, "MIT")]
    history = [
        ("npm", "foo", "1.0.0", at(-900), "ann", {}, {}),
        ("npm", "foo", "9.0.0", at(-800), "ann", {}, {}),
        ("pypi", "foo", "1.0.0", at(-900), "ann", {}, {}),
        ("pypi", "foo", "2.0.0", at(-10), "eve", {}, {}),
        ("npm", "bar", "1.0.0", at(-20), "ann", {}, {}),
        ("npm", "bar", "1.0.1", at(-10), "ann", {"postinstall": "node -e \"eval(x)\""}, {"foo": "1"}),
    ]
    return spark.createDataFrame(packages, f"ecosystem string, {PACKAGE}"), spark.createDataFrame(history, f"ecosystem string, {PACKAGE_VERSION}")


@pytest.fixture(scope="module")
def deps(spark):
    rows = [("npm", "foo", "1.0.0"), ("npm", "foo", "9.0.0"), ("pypi", "foo", "2.0.0"), ("npm", "bar", "1.0.1")]
    return spark.createDataFrame([(*r, True, "f", i) for i, r in enumerate(rows)], DEPS)


def levels(report):
    return {(r["ecosystem"], r["name"], r["version"]): ({s["signal"] for s in r["signals"]}, r["risk_level"]) for r in report.rows.collect()}


def test_ecosystems_and_versions_apart(spark, registry, deps, as_of):
    vulns = spark.createDataFrame([("npm", "foo", "1.0.0", "V1"), ("npm", "foo", "1.0.0", "V2"), ("PyPI", "foo", "1.0.0", "V3")], VULNS)
    report = pipelines.analyze(deps, vulns, *registry, Options(verbose=True), as_of)
    got = levels(report)
    assert "KNOWN_COMPROMISED" in got["npm", "foo", "1.0.0"][0] and got["npm", "foo", "1.0.0"][1] == "MODERATE"
    # the only known problem of npm foo 9.0.0 and of PyPI foo 2.0.0 is what their own registries say
    assert got["npm", "foo", "9.0.0"][0] == {"VERSION_ANOMALY"}
    assert got["pypi", "foo", "2.0.0"][0] == {"MAINTAINER_CHANGE", "VERSION_ANOMALY"}
    assert {"POSTINSTALL_SCRIPT", "AST_DANGEROUS_PATTERN", "CAPABILITY_ESCALATION", "NO_REPOSITORY", "NEW_DEPENDENCY"} <= got["npm", "bar", "1.0.1"][0]
    row = report.verdict.first()
    assert row["complete"] and row["expected"] == 4 and row["exit_code"] == 1


def test_incomplete_lookup_and_failed_files(spark, registry, deps, as_of):
    vulns = spark.createDataFrame([], VULNS)
    checked = deps.filter("name = 'foo'").select("ecosystem", "name", "version")
    report = pipelines.analyze(deps, vulns, *registry, Options(verbose=True), as_of, checked=checked)
    warned = {r["name"]: r["warnings"] for r in report.rows.collect() if r["warnings"]}
    assert warned == {"bar": [analysis.LOOKUP_INCOMPLETE]}
    row = report.verdict.first()
    assert (row["expected"], row["checked"], row["complete"], row["exit_code"]) == (4, 3, False, 2)
    failures = spark.createDataFrame([("/x/package-lock.json", "invalid")], "path string, reason string")
    row = pipelines.analyze(deps, vulns, *registry, Options(verbose=True), as_of, failures=failures).verdict.first()
    assert (row["failed"], row["complete"], row["exit_code"]) == (1, False, 2)
    # an answer for another version, or another ecosystem, is none
    other = spark.createDataFrame([("pypi", "bar", "1.0.1"), ("npm", "bar", "1.0.0")], "ecosystem string, name string, version string").union(checked)
    assert pipelines.analyze(deps, vulns, *registry, Options(verbose=True), as_of, checked=other).verdict.first()["checked"] == 3


def test_vulnerabilities_without_an_answer_do_not_count(spark, registry, deps, as_of):
    vulns = spark.createDataFrame([("npm", "foo", "9.0.0", "V1")], VULNS)
    checked = deps.filter("version != '9.0.0'").select("ecosystem", "name", "version")
    got = levels(pipelines.analyze(deps, vulns, *registry, Options(verbose=True), as_of, checked=checked))
    assert "KNOWN_COMPROMISED" not in got["npm", "foo", "9.0.0"][0]


def test_archives_and_attestations(spark, registry, deps, as_of):
    vulns = spark.createDataFrame([], VULNS)
    files = spark.createDataFrame([("npm", "bar", "1.0.1", "eval(a); eval(b)", None), ("npm", "foo", "1.0.0", None, "archive too large"), ("npm", "bar", "1.0.0", "eval(z)", None)], "ecosystem string, name string, version string, text string, problem string")
    plain = {r["name"] + r["version"]: r for r in pipelines.analyze(deps, vulns, *registry, Options(verbose=True), as_of).rows.collect()}
    report = pipelines.analyze(deps, vulns, *registry, Options(verbose=True, deep=True), as_of, archive_files=files)
    rows = {r["ecosystem"] + r["name"] + r["version"]: r for r in report.rows.collect()}
    bar = rows["npmbar1.0.1"]
    assert [s["signal"] for s in bar["signals"]].count("TARBALL_DANGEROUS_PATTERN") == 2 and bar["risk_score"] == plain["bar1.0.1"]["risk_score"] + 10
    assert rows["npmfoo1.0.0"]["warnings"] == ["archive too large"] and rows["npmfoo9.0.0"]["warnings"] == [] and not report.verdict.first()["complete"]
    # without deep only what is risky already is looked into
    quick = pipelines.analyze(deps, vulns, *registry, Options(verbose=True), as_of, archive_files=files)
    assert quick.verdict.first()["complete"]
    said = spark.createDataFrame([], "name string, version string, ord int, payload string, tlog_entries int, fetched boolean")
    proved = {r["name"] + r["version"]: r for r in pipelines.analyze(deps, vulns, *registry, Options(verbose=True), as_of, attestations=said).rows.collect()}
    assert proved["bar1.0.1"]["risk_score"] == plain["bar1.0.1"]["risk_score"] + 2
    assert proved["foo2.0.0"]["risk_score"] == plain["foo2.0.0"]["risk_score"]  # not npm


def test_cache_of_results(spark, registry, deps, as_of):
    empty = spark.createDataFrame([], "ecosystem string, name string, version string, data string, analyzed_at timestamp_ntz")
    vulns = spark.createDataFrame([("npm", "foo", "1.0.0", "V1")], VULNS)
    checked = deps.filter("name = 'foo'").select("ecosystem", "name", "version")
    opts = Options(verbose=True)
    report, cache = pipelines.analyze_cached(deps, empty, vulns, *registry, opts, as_of, checked=checked)
    fresh = spark.createDataFrame(cache.collect(), cache.schema)
    assert {(r["ecosystem"], r["name"], r["version"]) for r in fresh.collect()} == {("npm", "foo", "1.0.0"), ("npm", "foo", "9.0.0"), ("pypi", "foo", "2.0.0")}  # bar had no answer
    later = F.lit(NOW + dt.timedelta(hours=23)).cast("timestamp_ntz")
    gone = (registry[0].limit(0), registry[1].limit(0))  # only what is cached is known now
    again, kept = pipelines.analyze_cached(deps, fresh, vulns.limit(0), *gone, opts, later, checked=checked)
    assert {k: v for k, v in levels(again).items() if k[1] == "foo"} == {k: v for k, v in levels(report).items() if k[1] == "foo"}
    assert levels(again)["npm", "bar", "1.0.1"][1] == "UNKNOWN" and kept.count() == 3
    old, _ = pipelines.analyze_cached(deps, fresh, vulns, *gone, opts, F.lit(NOW + dt.timedelta(hours=25)).cast("timestamp_ntz"), checked=checked)
    assert {v[1] for v in levels(old).values()} == {"UNKNOWN"}


def test_plan_has_few_exchanges(spark, registry, deps, as_of):
    report = pipelines.analyze(deps, spark.createDataFrame([], VULNS), *registry, Options(verbose=True), as_of)
    plan = report.rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 20


def test_fix_has_a_verdict(spark):
    deps = spark.createDataFrame([("npm", "a", "1.0.0", True, "f", 1), ("npm", "b", "1.0.0", True, "f", 2), ("pypi", "a", "1.0.0", True, "f", 3)], DEPS)
    index = spark.createDataFrame([("npm", "a", "1.0.0", "V1"), ("npm", "a", "1.9.0", "V9"), ("PyPI", "a", "1.0.0", "V2")], "ecosystem string, name string, version string, id string")
    detail = lambda i, *fixed: (i, "s", [], [], [(("a",), [([(f,) for f in fixed],)], ("HIGH",))], ("HIGH",), [], None, None)
    details = spark.createDataFrame([detail("V1", "1.9.0"), detail("V2", "1.9.0")], ADVISORY)
    report = pipelines.fix_all(deps, index, details, Options())
    got = {r["ecosystem"]: r for r in report.rows.collect()}
    assert got["npm"]["fix"] is None and got["pypi"]["fix"] == "1.9.0" and got["pypi"]["command"] == "pip install a==1.9.0"
    row = report.verdict.first()
    assert (row["complete"], row["findings"], row["exit_code"]) == (True, 1, 1)
    checked = deps.select("ecosystem", "name", "version")  # nobody has answered for 1.9.0
    report = pipelines.fix_all(deps, index, details, Options(), checked)
    got = {r["ecosystem"]: (r["fix"], r["reason"]) for r in report.rows.collect()}
    assert got == {"npm": (None, "no verified fix"), "pypi": (None, "unverified fix")} and report.verdict.first()["exit_code"] == 2


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_typosquats_against_all_pairs(spark):
    rng = random.Random(4)
    popular = ["".join(rng.choice("abcd") for _ in range(rng.choice([2, 3, 4, 6, 7, 9, 12, 14, 30]))) for _ in range(60)]
    names = []
    for w in popular * 6:
        x = list(w)
        for _ in range(rng.randrange(0, 4)):
            k, op = rng.randrange(len(x) + 1), rng.randrange(3)
            x[k : k + (op != 0)] = [] if op == 1 else [rng.choice("abcde")]
        names.append("".join(x).upper() if rng.random() < 0.1 else "".join(x))
    names += ["", "zz"]
    want = set()
    for n in set(names):
        limit = 0 if len(n) <= 3 else 1 if len(n) <= 6 else 2
        for p in set(popular):
            d = _distance(n.lower(), p)
            if 0 < d <= limit and not (len(p) <= 3 and len(n) <= 5):
                want.add((n, p, d))
    df, known = spark.createDataFrame([(n,) for n in [*names, None]], "name string"), spark.createDataFrame([(p,) for p in [*popular, None]], "name string")
    assert {tuple(r) for r in rules.typosquats(df, known).collect()} == want and want


def test_typosquat_join_is_small(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))
    names, popular = [word() for _ in range(3000)], [word() for _ in range(300)]
    df = lambda w: spark.createDataFrame([(x,) for x in w], "name string")
    # all words have one length, so a join by length would make 900,000 rows
    assert rules.squat_candidates(df(names), df(popular), []).count() < 100


def test_as_of_join_against_loop(spark):
    rng = random.Random(8)
    day = lambda: at(rng.randrange(-6, 6)).replace(hour=rng.choice([0, 0, 12]), minute=rng.choice([0, 30]))
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(k, key(), None if k % 17 == 0 else day()) for k in range(150)]
    right = [(key(), None if k % 19 == 0 else day(), f"v{k}") for k in range(60)]
    a, b = spark.createDataFrame(left, "id int, k string, at timestamp_ntz"), spark.createDataFrame(right, "k string, at timestamp_ntz, v string")
    for strict in (False, True):
        for bucket in ("day", "year", "hour"):
            got = {r["id"]: r["value"]["v"] if r["value"] else None for r in registry_ops.as_of_join(a, b, ["k"], "at", "at", ["v"], ["v"], strict, bucket).collect()}
            want = {}
            for i, k, t in left:
                fit = [(u, v) for kk, u, v in right if kk == k and t and u and (u < t or (u == t and not strict))]
                want[i] = max(fit)[1] if fit else None
            assert got == want and any(want.values())
    assert registry_ops.as_of_join(a, b.limit(0), ["k"], "at", "at", ["v"]).filter("value is not null").count() == 0
    assert registry_ops.as_of_join(a.limit(0), b, ["k"], "at", "at", ["v"]).count() == 0


def test_signals_of_the_version_in_use(spark, registry, deps, as_of):
    packages, history = registry
    per_version = {(r["ecosystem"], r["name"], r["latest_version"]): r for r in registry_ops.version_profiles(packages, history, as_of, ("ecosystem", "name")).collect()}
    last = {(r["ecosystem"], r["name"], r["latest_version"]): r for r in registry_ops.profiles(packages, history, as_of, ("ecosystem", "name")).collect()}
    assert len(per_version) == 6 and all(per_version[k].asDict(True) == r.asDict(True) for k, r in last.items())
    assert per_version["npm", "foo", "1.0.0"]["previous_version"] is None and per_version["npm", "foo", "1.0.0"]["version_count"] == 1
    got = levels(pipelines.analyze(deps, spark.createDataFrame([], VULNS), packages, history, Options(verbose=True, as_of_version=True), as_of))
    assert got["npm", "foo", "1.0.0"][0] == set() and got["npm", "foo", "9.0.0"][0] == {"VERSION_ANOMALY"}
    unknown = deps.withColumn("version", F.lit("7.7.7"))
    assert {v[1] for v in levels(pipelines.analyze(unknown, spark.createDataFrame([], VULNS), packages, history, Options(verbose=True, as_of_version=True), as_of)).values()} == {"UNKNOWN"}


def test_hot_packages_send_few_rows(spark, as_of):
    n = 50_000
    history = spark.range(n).select(F.lit("npm").alias("ecosystem"), F.when(F.col("id") >= 0, "hot").alias("name"), F.concat(F.col("id").cast("string"), F.lit(".0.0")).alias("version"), (F.lit(NOW) - F.make_interval(mins=(n - F.col("id")).cast("int"))).cast("timestamp_ntz").alias("published_at"), F.lit("ann").alias("publisher"), F.lit(None).cast("map<string,string>").alias("scripts"), F.lit(None).cast("map<string,string>").alias("dependencies")).repartition(8)
    packages = spark.createDataFrame([("npm", "hot", "7.0.0", None, ["a"], "git", "MIT")], f"ecosystem string, {PACKAGE}")
    found = registry_ops.profiles(packages, history, as_of, ("ecosystem", "name"))
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    row = found.first()
    assert (row["latest_version"], row["previous_version"], row["version_count"], row["dormancy_ms"]) == ("7.0.0", f"{n - 2}.0.0", n, 60_000)
    assert registry_ops.profiles(packages.withColumn("latest_tag", F.lit("gone")), history, as_of, ("ecosystem", "name")).first()["latest_version"] == f"{n - 1}.0.0"


def test_bitmap_filter(spark):
    from palisade.operators import advisories, relational

    keys = ["ecosystem", "name", "version"]
    large = spark.range(40_000).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "id").alias("name"), F.when(F.col("id") % 1000 != 0, (F.col("id") % 3).cast("string")).alias("version"), F.concat(F.lit("V"), "id").alias("id"))
    small = large.filter("name like '%77'").select(*keys)
    kept = relational.bitmap_filtered(large, small, keys)
    assert kept.columns == large.columns and small.count() <= kept.count() < small.count() + 40
    a, b = (advisories.lookup(small, large, narrow=narrow)[0] for narrow in (False, True))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect())) and a.count() == small.count()
    assert relational.bitmap_filtered(large, small, keys, bits=64).count() >= small.count()  # too small a map keeps too much, never too little
    assert relational.bitmap_filtered(large, small.limit(0), keys).count() == 0


def test_documents_of_any_size(spark, tmp_path):
    import json
    import os

    from palisade.sinks import reports

    n = 1_000_000
    rows = spark.range(n).select(F.concat(F.lit("p"), "id").alias("package"), F.lit("1").alias("version"), F.lit('HI"GH\n').alias("severity"))
    report = reports._report("scan", spark.range(1).select(F.lit(True).alias("complete")), rows, "vulnerabilities")
    reports.write_document(report, f"{tmp_path}/doc")
    assert len([f for f in os.listdir(tmp_path / "doc") if f.startswith("part-")]) > 5
    reports.merge(spark, f"{tmp_path}/doc", f"{tmp_path}/doc.json")
    doc = json.load(open(tmp_path / "doc.json"))
    assert doc["command"] == "scan" and doc["complete"] is True and len(doc["vulnerabilities"]) == n and len({v["package"] for v in doc["vulnerabilities"]}) == n
    reports.write_document(report.filter("part = 'head'"), f"{tmp_path}/none")
    reports.merge(spark, f"{tmp_path}/none", f"{tmp_path}/none.json")
    assert json.load(open(tmp_path / "none.json"))["results"] == []


def test_sarif_of_any_size(spark, tmp_path):
    import json

    from palisade.sinks import reports

    found = spark.range(25_000).select(F.concat(F.lit("V"), F.col("id") % 40).alias("display_id"), F.lit("HIGH").alias("severity"), F.concat(F.lit("p"), "id").alias("package"), F.lit("1").alias("version"), F.lit("s").alias("summary"), F.lit("f").alias("source_file"))
    reports.write_sarif(found, False, f"{tmp_path}/s")
    reports.merge(spark, f"{tmp_path}/s", f"{tmp_path}/s.json")
    run = json.load(open(tmp_path / "s.json"))["runs"][0]
    assert len(run["results"]) == 25_000 and len(run["tool"]["driver"]["rules"]) == 40 and run["invocations"] == [{"executionSuccessful": False}]
    small = json.loads(reports.sarif(found.limit(5), F.lit(False)).first()["value"])["runs"][0]
    assert set(small["results"][0]) == set(run["results"][0]) and set(small["tool"]["driver"]["rules"][0]) == set(run["tool"]["driver"]["rules"][0])
    reports.write_sarif(found.limit(0), True, f"{tmp_path}/e")
    reports.merge(spark, f"{tmp_path}/e", f"{tmp_path}/e.json")
    assert json.load(open(tmp_path / "e.json"))["runs"][0]["results"] == []
