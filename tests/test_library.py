import datetime as dt
import gzip
import io
import random
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from palisade.functions import severity as sev
from palisade.functions import text, versions
from palisade.operators import advisories, code_rules, provenance, registry, relational, rules
from palisade.options import Options, merged, validated
from palisade.plans import pipelines
from palisade.sinks import reports
from palisade.sources import archives, discovery
from palisade.streaming import watch


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_cvss(spark):
    assert one(spark, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", sev.cvss_base_score) == 9.8
    assert one(spark, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", sev.cvss_base_score) == 6.1
    assert one(spark, "AV:L", sev.cvss_base_score) == 4.0
    assert one(spark, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:N", sev.cvss_base_score) == 0.0


@pytest.mark.parametrize(("spec", "want"), [("^1.2.3", "1.2.3"), (" '~> v2.0' ", "2.0"), (">=1.0,<2", "1.0"), ("[13.0.3]", "13.0.3"), ("*", None), ("1.0.0-beta+x", "1.0.0-beta+x")])
def test_version_of(spark, spec, want):
    assert one(spark, spec, versions.version_of) == want


def test_sanitize_and_names(spark):
    assert one(spark, "a\x1b]0;t\x07b\x1b[31mc\x9bd\x00e\tf", text.sanitize) == "abcde\tf"
    assert one(spark, " My_Pkg.X ", text.normalize_name) == "my-pkg-x"
    assert one(spark, "ab\u200bс", text.homoglyphs) == ["INVISIBLE_CHARS", "NON_ASCII"]
    assert one(spark, "@a/b c", text.encode_package) == "@a%2Fb%20c"


@pytest.mark.parametrize(("name", "want"), [("axioss", {"axios"}), ("axois", set()), ("expresss", {"express"}), ("axios", set()), ("qs", set()), ("tar", set()), ("reqeusts", {"requests"})])
def test_typosquat(spark, name, want):
    names = spark.createDataFrame([(name,)], "name string")
    popular = spark.createDataFrame([("axios",), ("express",), ("requests",), ("qs",)], "name string")
    assert {r["similar"] for r in rules.typosquats(names, popular).collect()} == want


def test_diff_properties(spark):
    kind = "ecosystem string, name string, version string, integrity string, ord bigint"
    a = spark.createDataFrame([("npm", "a", "1", "x", 1), ("npm", "a", "2", "x", 2), ("npm", "b", "1", "i", 3), ("npm", "c", "1", None, 4)], kind)
    b = spark.createDataFrame([("npm", "a", "2", "x", 1), ("npm", "b", "1", "j", 2), ("npm", "d", "1", None, 3)], kind)
    got = {r["name"]: (r["status"], r["integrity_changed"]) for r in relational.diff_snapshots(a, b).collect()}
    assert got == {"a": ("unchanged", False), "b": ("changed", True), "c": ("removed", False), "d": ("added", False)}
    assert {r["status"] for r in relational.diff_snapshots(a, a).collect()} == {"unchanged"}
    assert relational.diff_summary(relational.diff_snapshots(a, b)).first()["summary"] == "1 added, 1 removed, 1 changed"


def test_lookup_never_clean_when_incomplete(spark):
    deps = spark.createDataFrame([("npm", "a", "1", "f", 1), ("npm", "b", "1", "f", 2), ("brew", "w", "1", "f", 3)], "ecosystem string, name string, version string, source_file string, ord bigint")
    index = spark.createDataFrame([("npm", "a", "1", "V1"), ("npm", "a", "1", "V2")], "ecosystem string, name string, version string, id string")
    from palisade.schema import ADVISORY

    details = spark.createDataFrame([("V1", "bad", ["CVE-1", "GHSA-1"], [("CVSS_V3", "5.0")], [((("a"),), [([(None,), ("1.1",)],)], (None,))], (None,), [("u",), ("",)], None, None)], ADVISORY)
    report = pipelines.scan(deps, index, details, Options(), index.limit(0).select("ecosystem", "name", "version"))
    assert report.verdict.first()["exit_code"] == 2
    full = pipelines.scan(deps, index, details, Options())
    rows = {r["id"]: r for r in full.rows.collect()}
    assert full.verdict.first()["exit_code"] == 1 and full.verdict.first()["expected"] == 2
    assert rows["V1"]["severity"] == "MODERATE" and rows["V1"]["display_id"] == "GHSA-1" and rows["V1"]["fixed"] == ">= 1.1" and rows["V1"]["references"] == ["u"]
    assert rows["V2"]["severity"] == "CRITICAL" and rows["V2"]["details_missing"]
    assert full.rows.collect()[0]["id"] == "V2"
    line = reports.annotations(full.rows.filter("id = 'V1'")).first()["value"]
    assert line == "::warning title=MODERATE%3A a@1::GHSA-1 bad (fix: >= 1.1)"
    clean = pipelines.scan(deps.filter("name = 'b'"), index, details, Options())
    assert clean.verdict.first()["exit_code"] == 0


def _registry(spark):
    t = lambda d, h=0, m=0: dt.datetime(2026, 1, 1) + dt.timedelta(days=d, hours=h, minutes=m)
    versions_ = [
        ("good", "1.0.0", t(-900), "ann", {}, {}),
        ("good", "1.0.1", t(-600), "ann", {}, {}),
        ("good", "1.0.2", t(-300), "ann", {}, {}),
        ("chalk", "5.3.0", t(-1), "bob", {}, {}),
        ("chalk", "5.3.1", t(-1, 0, 2), "bob", {"postinstall": "node -e \"eval(x)\"", "test": "t"}, {}),
        ("parent", "1.0.0", t(-400), "ann", {}, {"old": "1"}),
        ("parent", "1.0.1", t(-1), "eve", {}, {"child": "1"}),
        ("child", "0.0.1", t(-2), "eve", {"postinstall": "x"}, {}),
    ]
    packages = [(n, None, None, m, r, "MIT") for n, m, r in (("good", ["ann", "bea"], "git"), ("chalk", ["bob"], "git"), ("parent", ["ann", "eve", "flo"], None), ("child", ["eve"], None))]
    from palisade.schema import PACKAGE, PACKAGE_VERSION

    return spark.createDataFrame(packages, PACKAGE), spark.createDataFrame(versions_, PACKAGE_VERSION), F.lit(t(0)).cast("timestamp_ntz")


def test_analyze(spark):
    packages, history, as_of = _registry(spark)
    deps = spark.createDataFrame([("npm", n, "1", True, "f", i) for i, n in enumerate(("good", "chalk", "parent", "ghost"))], "ecosystem string, name string, version string, is_direct boolean, source_file string, ord bigint")
    vulns = spark.createDataFrame([], "ecosystem string, package string, version string, id string")
    report = pipelines.analyze(deps, vulns, packages, history, Options(verbose=True), as_of)
    rows = {r["name"]: r for r in report.rows.collect()}
    signals = {n: {s["signal"] for s in r["signals"] or []} for n, r in rows.items()}
    assert rows["good"]["risk_level"] == "NONE"
    assert rows["ghost"]["risk_level"] == "UNKNOWN" and report.verdict.first()["exit_code"] == 2
    assert {"RAPID_PUBLISH", "POSTINSTALL_SCRIPT", "AST_DANGEROUS_PATTERN", "CAPABILITY_ESCALATION"} <= signals["chalk"]
    assert rows["chalk"]["risk_level"] == "CRITICAL" and rows["chalk"]["risk_score"] >= 67.5
    assert {"MAINTAINER_CHANGE", "PHANTOM_DEPENDENCY", "CIRCULAR_STAGING", "NEW_DEP_HAS_INSTALL_SCRIPTS", "NO_REPOSITORY"} <= signals["parent"]


def test_known_good_score(spark):
    signals = spark.createDataFrame([("esbuild", "POSTINSTALL_SCRIPT", "LOW", True)], "name string, signal string, severity string, known_good boolean")
    context = spark.createDataFrame([("esbuild", 10**12, 1)], "name string, package_age_ms bigint, maintainer_count int")
    row = rules.risk_scores(signals, context).first()
    assert (row["risk_score"], row["risk_level"]) == (0.3, "LOW")


def test_provenance_three_values(spark):
    import base64
    import json

    good = base64.b64encode(json.dumps({"predicate": {"buildType": "b", "invocation": {"configSource": {"uri": "u"}}}}).encode()).decode()
    rows = spark.createDataFrame([("a", 1, good, 1, True), ("c", 1, "!!", 0, True), ("d", 1, None, 0, False)], "name string, ord int, payload string, tlog_entries int, fetched boolean")
    names = spark.createDataFrame([(n,) for n in "abcd"], "name string")
    got = {r["name"]: (r["has_provenance"], r["build_type"], r["transparency"]) for r in provenance.provenance(names, rows, ["name"]).collect()}
    assert got == {"a": (True, "b", "verified"), "b": (False, None, None), "c": (None, None, None), "d": (None, None, None)}


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("const { exec } = require('child_process'); exec('x')", {"PROCESS_SPAWN"}),
        ("const cp = require('node:child_process');\ncp.spawn('x')", {"PROCESS_SPAWN"}),
        ("import https from 'https'; https.get(u)", {"NETWORK_ACCESS"}),
        ("const fs = require('fs'); fs.unlinkSync(__filename)", {"SELF_DELETION"}),
        ("const fs = require('fs'); fs.readFileSync('/home/x/.ssh/id')", {"ENV_HARVESTING"}),
        ("const fs = require('fs'); fs.writeFileSync('out.txt', 'y')", {"FILESYSTEM_WRITE"}),
        ("require(name)", {"DYNAMIC_REQUIRE"}),
        ("import(name)", {"DYNAMIC_IMPORT"}),
        ("setTimeout('x()', 1)", {"CODE_EXECUTION"}),
        ("Buffer.from(x, 'base64')", {"BASE64_DECODE"}),
        ("new Function('x')", {"CODE_EXECUTION"}),
        ("// eval(x)\nconst s = \"eval(y)\"; foo.exec(z); /a/.exec(b)", set()),
        ("setTimeout(() => f(), 10); obj.get('k')", set()),
        ("function broken( {", {"UNPARSEABLE_CODE"}),
        ("const s = `${eval(x)}`", {"CODE_EXECUTION"}),
        ("const s = `eval(x)`; const t = `it's ${a['eval(x)']}`", set()),
        ("import cp, {exec} from 'child_process'; exec('a')", {"PROCESS_SPAWN"}),
        ("import d, * as cp from 'child_process'; cp.exec('a')", {"PROCESS_SPAWN"}),
        ("x.replace(/[/'\"]/g, ''); y = /it's/g; z = a / b; // it's", set()),
        ("`${ {a:{b:{c:eval(q)}}} }`", {"CODE_EXECUTION"}),
        ("`a${`b${`c${`d${fetch(q)}`}`}`}`", {"NETWORK_ACCESS"}),
        ("`a${`b${'}`eval(x)`'}`}`", set()),
        ("a = \"require('child_process').exec(1)\"; b = 'use cp.exec(1)'; c = 'process.env.NPM_TOKEN'; d = \"Buffer.from(x,'base64')\"", set()),
        ("const cp = require('child_process'); log(\"cp.exec('x')\")", set()),
        ("if (a) /it's/.test(b)", set()),
        ("x = (a) / b; y = 'c' / d; // it's", set()),
        ("x = f(a)[0] / 2; s = \"it's\"", set()),
        ("Buffer.from(a); f(b, 'base64')", set()),
        ("Buffer.from(f(a, g(b)), 'base64')", {"BASE64_DECODE"}),
        ("require('child\\x5fprocess').exec(c)", {"PROCESS_SPAWN"}),
        ("const cp = require('child_process'), x = 1; cp\n.exec(c)", {"PROCESS_SPAWN"}),
        ("`${a", {"UNPARSEABLE_CODE"}),
        ("/* open", {"UNPARSEABLE_CODE"}),
        ("s = 'open", {"UNPARSEABLE_CODE"}),
        ("#!/usr/bin/env node's\nfetch(u)", {"NETWORK_ACCESS"}),
        ("import('./a.js'); require(`./b`); import.meta.url; require()", set()),
        ("x\u0001eval(y)\u0002", {"CODE_EXECUTION"}),
        ("", set()),
        (None, {"ANALYSIS_ERROR"}),
    ],
)
def test_js_rules(spark, source, want):
    files = spark.createDataFrame([(1, source)], "id int, source string")
    assert {r["pattern"] for r in code_rules.js_findings(files).collect()} == want


def test_js_of_long_strings(spark):
    source = "const a = '" + "ab\\n" * 200_000 + "'; eval(x); `" + "y" * 300_000 + "`"
    files = spark.createDataFrame([(1, source)], "id int, source string")
    assert {r["pattern"] for r in code_rules.js_findings(files).collect()} == {"CODE_EXECUTION"}


def test_js_hits_once(spark):
    files = spark.createDataFrame([(1, "(0, eval)('x'); then(eval); f(0, Function); eval(a)")], "id int, source string")
    assert [(r["pattern"], r["hits"]) for r in code_rules.js_findings(files).collect()] == [("CODE_EXECUTION", 4)]


def test_js_from_token_lists(spark):
    """Sources put together from parts of which it is known what they hold, nested in templates, strings and comments."""
    rng = random.Random(11)
    calls = [("eval(a)", "CODE_EXECUTION"), ("fetch(b)", "NETWORK_ACCESS"), ("new Function('c')", "CODE_EXECUTION"), ("y.toString('base64')", "BASE64_DECODE"), ("require(d)", "DYNAMIC_REQUIRE")]

    def part(depth):
        kind = rng.randrange(8 if depth else 5)
        text, pattern = rng.choice(calls)
        if kind == 0:
            return text, [pattern]
        if kind == 1:
            return '"' + text.replace("'", "\\'") + '"', []
        if kind == 2:
            return "/* " + text + " ' */ 1", []
        if kind == 3:
            return "`" + text + " \\` ${'}'} '`", []
        if kind == 4:
            return "g(1) / 2", []
        inner, found = expression(depth - 1)
        shape = ["`x ${%s} ' y`", "({k: {l: [%s]}})", "h(%s, /['`\"{]/g)"][kind - 5]
        return shape % inner, found

    def expression(depth):
        parts = [part(depth) for _ in range(rng.randrange(1, 4))]
        return " + ".join(p for p, _ in parts), [f for _, found in parts for f in found]

    made = [expression(6) for _ in range(150)]
    rows = [(k, f"const v = {text}; // it's") for k, (text, _) in enumerate(made)]
    got = {}
    for r in code_rules.js_findings(spark.createDataFrame(rows, "id int, source string")).collect():
        got[r["id"], r["pattern"]] = got.get((r["id"], r["pattern"]), 0) + r["hits"]
    want = {(k, p): found.count(p) for k, (_, found) in enumerate(made) for p in found}
    assert got == want and any(text.count("${") > 5 for text, _ in made)


def test_js_paths_in_long_strings(spark):
    pad = "word, " * 200
    sources = [f"const fs = require('fs'); fs.readFileSync('{pad} /home/x/.ssh/id {pad}')", f"const fs = require('fs'); fs.writeFileSync('/etc/x {pad}', y)", f"const fs = require('fs'); fs.writeFileSync(' {pad} /etc/x', y)"]
    files = spark.createDataFrame(list(enumerate(sources)), "id int, source string")
    assert {r["id"]: r["pattern"] for r in code_rules.js_findings(files).collect()} == {0: "ENV_HARVESTING", 1: "SYSTEM_PATH_WRITE", 2: "FILESYSTEM_WRITE"}


def test_inline_js_of_nested_shells(spark):
    script = "run(1)"
    for k in range(6):
        script = f"""sh -c {'"' if k % 2 else "'"}{script}{'"' if k % 2 else "'"}"""
    assert one(spark, script, text.inline_js) == "run(1)"
    assert one(spark, "true; node --eval 'a(1)' | x", text.inline_js) == "a(1)"
    assert one(spark, "bash -c 'node x.js'", text.inline_js) is None and one(spark, "npm run x; y()", text.inline_js) is None


@pytest.mark.parametrize(("spec", "version", "pinned"), [("=1.0", "1.0", True), ("==1.0", "1.0", True), ("===1.0", "1.0", False), ("[1.0]", "1.0", True), ("'1.0'", "1.0", True), ("1.0", "1.0", True), ("^1.0", "1.0", False), ("'1.0]", "1.0", False), ("", None, False)])
def test_pinned(spark, spec, version, pinned):
    df = spark.createDataFrame([(spec, version)], "s string, v string")
    assert df.select(versions.is_pinned(F.col("s"), F.col("v"))).first()[0] == pinned


def test_reports(spark):
    import json

    vulns = spark.createDataFrame([(f"V{k}", f"V{k % 3}", "s", "HIGH" if k % 2 else "LOW", "p", f"{k}", "cargo", None, None, [f"u{j}" for j in range(7)]) for k in range(25)], "id string, display_id string, summary string, severity string, package string, version string, ecosystem string, fixed string, source_file string, references array<string>")
    verdict = spark.createDataFrame([(30, 30, 0, True, 25, 1)], "expected long, checked long, failed long, complete boolean, findings long, exit_code int")
    whole = json.loads(reports.document(reports.scan_report(vulns, verdict)).first()["value"])
    assert whole["command"] == "scan" and whole["summary"]["high"] == 12 and len(whole["vulnerabilities"]) == 25 and whole["complete"]
    ci = json.loads(reports.document(reports.ci_report(vulns, verdict)).first()["value"])
    assert ci["summary"] == {"total": 30, "vulnerable": 25, "scanned": 30, "failed": 0}
    assert reports.notice(verdict, "HIGH").first()["value"] == "::notice::Scanned 30 packages, found 25 vulnerabilities at HIGH+ severity"
    with pytest.raises(ValueError, match="more than 5"):
        reports.document(reports.scan_report(vulns, verdict), most=5)
    docs = [json.loads(r["value"]) for r in reports.sarif(vulns, F.lit(True), most=10).collect()]
    results = [r for d in docs for r in d["runs"][0]["results"]]
    assert 1 < len(docs) <= 3 and len(results) == 25 and all(len(r["relatedLocations"]) == 5 for r in results)
    assert results[0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "Cargo.lock"
    assert all({r["ruleId"] for r in d["runs"][0]["results"]} == {r["id"] for r in d["runs"][0]["tool"]["driver"]["rules"]} for d in docs)
    empty = json.loads(reports.sarif(vulns.limit(0), F.lit(True)).first()["value"])
    assert empty["runs"][0]["results"] == []
    fixes = spark.createDataFrame([("p", 2, None, "no verified fix")], "package string, vuln_count long, fix string, reason string")
    assert json.loads(reports.document(reports.fix_report(fixes, F.lit(False))).first()["value"])["fixable"] == 0
    decision = spark.createDataFrame([(1, 0, 0, 0, 1, 0, False, True, "prompt")], "added long, changed long, removed long, critical long, high long, unknown long, has_vulns boolean, complete boolean, decision string")
    guard = json.loads(reports.document(reports.guard_report(decision, fixes)).first()["value"])
    assert guard["blocked"] is False and guard["diff"]["added"] == 1 and guard["decision"] == "prompt"


def test_typosquats_of_many_popular_names(spark, monkeypatch):
    names = spark.createDataFrame([("expresss",)], "name string")
    popular = spark.createDataFrame([("express",), ("axios",)], "name string")
    monkeypatch.setattr(rules, "MOST_BROADCAST", 1)
    assert [r["similar"] for r in rules.typosquats(names, popular).collect()] == ["express"]


def packed_files(files):
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w") as tar:
        for name, body in files:
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return bytearray(gzip.compress(raw.getvalue()))


def test_archives(spark):
    plain = packed_files([("package/package.json", b'{"main": "./src/run.js"}'), ("package/index.js", b"eval(x)"), ("package/src/run.js", b"1"), ("package/other.js", b"2"), ("package/readme.md", b"3")])
    files = spark.createDataFrame([("a.tgz", plain), ("b.tgz", bytearray(b"no archive")), ("c.tgz", plain[: len(plain) // 2]), ("d.tgz", None)], "path string, content binary")
    entries = archives.untar(files).persist()
    assert [r["entry"] for r in archives.inspectable(entries).filter("path = 'a.tgz'").orderBy("ord").collect()] == ["index.js", "src/run.js"]
    assert entries.filter("path = 'b.tgz'").first()["problem"].startswith("unreadable")
    assert {r["path"] for r in entries.filter("problem is not null").select("path").distinct().collect()} == {"b.tgz", "c.tgz", "d.tgz"}


def test_archives_choose_paths_before_texts(spark):
    many = [(f"package/lib/x{k}.js", b"1") for k in range(60)]
    late = packed_files([*many, ("package/index.js", b"eval(x)"), ("package/deep/entry.mjs", b"2"), ("package/dist/a1.cjs", b"3"), ("package/dir/index.js", b"4"), ("package/package.json", b'{"bin": {"x": "lib/x40.js"}, "main": "dir", "exports": {".": [{"node": {"import": {"default": "./deep/entry.mjs"}}}, null, 3], "./*": "./dist/*.cjs"}}')])
    crowd = packed_files([(f"package/{k}/index.js", b"1") for k in range(14)])
    big = packed_files([("package/index.js", b" " * (archives.MOST_FILE + 1)), ("package/cli.js", b"5"), ("package/package.json", b"[" * 100_000)])
    files = spark.createDataFrame([("npm", "late", late), ("npm", "crowd", crowd), ("npm", "big", big)], "ecosystem string, name string, content binary")
    got = {}
    for r in archives.untar(files, ["ecosystem", "name"]).collect():
        got.setdefault(r["name"], []).append((r["entry"], r["problem"]))
    assert {e for e, _ in got["late"]} == {"index.js", "deep/entry.mjs", "dist/a1.cjs", "dir/index.js", "lib/x40.js"}
    assert len(got["crowd"]) == 11 and got["crowd"][-1] == (None, "files left out: 4")
    assert got["big"] == [("index.js", "file too large: index.js"), ("cli.js", None)]


def test_discovery_prefers_locks(spark):
    rows = [(f"/{d}/{f}", f"/{d}", f, "") for d, f in (("a", "go.mod"), ("a", "go.sum"), ("b", "go.mod"), ("b", "x.csproj"), ("b", "notes.txt"))]
    got = discovery.preferred_files(spark.createDataFrame(rows, "path string, dir string, file string, content string")).collect()
    assert {(r["path"], r["fallback"]) for r in got} == {("/a/go.sum", False), ("/b/go.mod", True), ("/b/x.csproj", True)}


def test_guard_and_fix(spark):
    kind = "ecosystem string, name string, version string, integrity string, ord bigint"
    before, after = spark.createDataFrame([("npm", "a", "1", None, 1)], kind), spark.createDataFrame([("npm", "a", "2", None, 1), ("npm", "b", "1", None, 2)], kind)
    result = lambda rows: spark.createDataFrame(rows, "ecosystem string, name string, version string, risk_level string, vulns int, warnings int")
    fine = [("npm", "a", "2", "NONE", 0, 0), ("npm", "b", "1", "LOW", 0, 0)]
    assert pipelines.guard(before, after, result(fine), Options()).first()["decision"] == "allow"
    assert pipelines.guard(before, after, result(fine[:1]), Options()).first()["decision"] == "block"
    assert pipelines.guard(before, after, result(fine[:1]), Options(force=True)).first()["decision"] == "allow_forced"
    assert pipelines.guard(before, after, result([fine[0], ("npm", "b", "1", "HIGH", 0, 0)]), Options()).first()["decision"] == "prompt"
    assert pipelines.guard(before, after, result([fine[0], ("npm", "b", "1", "LOW", 1, 0)]), Options(force=True)).first()["decision"] == "block"
    assert pipelines.guard(before, before, result(fine), Options()).first()["decision"] == "allow"
    vulns = spark.createDataFrame([("a", "V1", ">= 1.9.0"), ("a", "V2", ">= 1.10.0"), ("b", "V3", None)], "package string, id string, fixed string")
    index = spark.createDataFrame([("npm", "a", "1.10.0", "V9")], "ecosystem string, name string, version string, id string")
    current = spark.createDataFrame([("a", "npm", "1.0.0"), ("b", "npm", "1.0.0")], "package string, ecosystem string, version string")
    got = {r["package"]: r for r in pipelines.fix(vulns, index, current).collect()}
    assert got["a"]["fix"] == "1.9.0" and got["a"]["command"] == "npm install a@1.9.0" and got["b"]["reason"] == "no verified fix"


def test_scan_cached(spark):
    from palisade.schema import ADVISORY, VULNERABILITY

    now = dt.datetime(2026, 1, 1)
    deps = spark.createDataFrame([("npm", "a", "1"), ("npm", "b", "1"), ("npm", "c", "1")], "ecosystem string, name string, version string")
    old = ("V0", "V0", [], "s", "LOW", "a", "1", "npm", None, "u", [], False)
    cached = spark.createDataFrame([("npm", "a", "1", now - dt.timedelta(minutes=59), [old]), ("npm", "b", "1", now - dt.timedelta(minutes=61), [])], f"ecosystem string, name string, version string, fetched_at timestamp_ntz, vulns array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in VULNERABILITY.split(','))}>>")
    index = spark.createDataFrame([("npm", "b", "1", "V1")], "ecosystem string, name string, version string, id string")
    vulns, cache = pipelines.scan_cached(deps, cached, index, spark.createDataFrame([], ADVISORY), Options(), F.lit(now).cast("timestamp_ntz"))
    assert {r["id"] for r in vulns.collect()} == {"V0", "V1"}
    kept = {r["name"]: r["fetched_at"] for r in cache.collect()}
    assert kept == {"a": now - dt.timedelta(minutes=59), "b": now - dt.timedelta(minutes=61), "c": now}  # b lacks details, so its answer isn't kept


def test_history(spark):
    packages, history, as_of = _registry(spark)
    p = {r["name"]: r for r in registry.profiles(packages, history, as_of).collect()}
    assert p["chalk"]["publish_interval_ms"] == 120_000 and p["chalk"]["has_install_scripts"] and list(p["chalk"]["install_scripts"]) == ["postinstall"]
    assert p["parent"]["added_deps"] == ["child"] and p["parent"]["removed_deps"] == ["old"] and p["parent"]["maintainer_changed"]
    assert p["child"]["previous_version"] is None and p["child"]["added_deps"] == []
    assert p["good"]["dormancy_ms"] == 300 * 86_400_000


def test_registry_documents(spark):
    import json

    doc = {"name": "a", "dist-tags": {"latest": "1.1.0"}, "time": {"created": "2024-01-01T00:00:00.000Z", "1.0.0": "2024-01-01T00:00:00.000Z", "1.1.0": "2024-01-01T00:05:00.000Z"}, "versions": {"1.0.0": {"_npmUser": {"name": "x"}}, "1.1.0": {"_npmUser": {"name": "y"}, "scripts": {"install": "z", "test": "t"}, "dependencies": {"d": "1"}}, "9.9.9": {}}, "maintainers": [{"name": "x"}], "repository": {"url": "git"}}
    docs = spark.createDataFrame([(json.dumps(doc),), ("{bad",)], "content string")
    p = registry.profiles(*registry.npm_tables(docs), F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz")).collect()
    assert len(p) == 1 and p[0]["publish_interval_ms"] == 300_000 and p[0]["maintainer_changed"] and p[0]["added_deps"] == ["d"] and p[0]["repository"] == "git" and p[0]["package_age_ms"] == 86_400_000
    py = {"info": {"name": "b", "version": "2"}, "releases": {"1": [{"upload_time_iso_8601": "2024-01-01T00:00:00Z"}], "2": [{"upload_time_iso_8601": "2024-01-01T01:00:00Z", "yanked": True}], "0": []}}
    r = registry.pypi_profiles(registry.pypi_releases(spark.createDataFrame([(json.dumps(py),)], "content string")), F.lit(dt.datetime(2024, 1, 2)).cast("timestamp_ntz")).first()
    assert (r["previous_version"], r["publish_interval_ms"], r["version_count"], r["yanked_versions"]) == ("1", 3_600_000, 2, ["2"])
    assert one(spark, "@s/p", lambda c: registry.npm_archive_url(c, F.lit("1.0"))) == "https://registry.npmjs.org/@s/p/-/p-1.0.tgz"
    urls = [("http://files.pythonhosted.org/a", "sdist"), ("https://files.pythonhosted.org/b", "wheel")]
    kind = "array<struct<url: string, packagetype: string>>"
    from palisade.schema import ARCHIVE_HOSTS

    assert one(spark, urls, lambda c: registry.pypi_archive_url(c, ARCHIVE_HOSTS), kind) is None
    assert one(spark, urls[1:], lambda c: registry.pypi_archive_url(c, ARCHIVE_HOSTS), kind) == "https://files.pythonhosted.org/b"


def test_severity_threshold_is_monotone(spark):
    rows = spark.createDataFrame([(s,) for s in ("CRITICAL", "HIGH", "MODERATE", "LOW", "ODD")], "severity string")
    n = [advisories.filter_by_severity(rows, s).count() for s in ("CRITICAL", "HIGH", "MODERATE", "LOW", "what")]
    assert n == [2, 3, 4, 5, 5]


def test_options():
    assert "brew" not in Options().ecosystems
    with pytest.raises(ValueError, match="did you mean 'npm'"):
        validated(ecosystem="npn")
    with pytest.raises(ValueError, match="no valid"):
        validated(ecosystems=["x"])
    assert validated(ecosystems=["x", "go"]).ecosystems == ("go",)
    assert validated(severity="bad").least_severity == "MODERATE" and validated(severity="low").least_severity == "LOW"
    assert validated(advisory_ttl_ms=10**12).advisory_ttl_ms == 7 * 86_400_000
    assert merged({"a": {"b": 1}}, {"a": {"c": 2}, "__proto__": 3}) == {"a": {"b": 1, "c": 2}}


def test_watched_folder(spark):
    rows = [("/p/Cargo.lock", "/p", "Cargo.lock", '[[package]]\nname = "a"\nversion = "1.0"\n'), ("/p/Cargo.toml", "/p", "Cargo.toml", '[dependencies]\nb = "2"\n')]
    snap = pipelines.watched(spark.createDataFrame(rows, "path string, dir string, file string, content string"), Options())
    assert [(r["ecosystem"], r["name"], r["version"]) for r in snap.collect()] == [("cargo", "a", "1.0")]


def test_caches(spark):
    from palisade.operators import store

    assert store.stats(advisories=store.empty(spark, "advisories"), signals=store.empty(spark, "signals")).first().asDict() == {"advisories": 0, "signals": 0}
    wanted = spark.createDataFrame([("npm", "a", "1")], "ecosystem string, name string, version string")
    missed = store.partition_by_cache(wanted, store.empty(spark, "advisories"), ["ecosystem", "name", "version"], F.current_timestamp().cast("timestamp_ntz"), None)
    assert not missed.first()["hit"]


def test_stored_cache_touches_only_its_buckets(spark, tmp_path):
    import os

    from palisade.operators import store

    schema, keys, path = "ecosystem string, name string, vulns string, fetched_at timestamp_ntz", ["ecosystem", "name"], str(tmp_path / "cache")
    now = dt.datetime(2026, 1, 10)
    as_of = F.lit(now).cast("timestamp_ntz")
    assert store.read_stored(spark, path, schema).count() == 0
    rows = [("npm", f"p{k}", "v", now - dt.timedelta(days=k % 5)) for k in range(60)] + [(None, "n", "v", now)]
    store.upsert_stored(spark.createDataFrame(rows, schema), path, schema, keys, 16)
    files = lambda: {(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}
    before = files()
    store.upsert_stored(spark.createDataFrame([("npm", "p7", "new", now), ("npm", "p7", "new", now)], schema), path, schema, keys, 16)
    after = files()
    changed = {d for d, _ in set(before.items()) ^ set(after.items()) for d in [d[0]]}
    assert len(changed) == 1 and len({d for d, _ in before}) > 8
    got = {r["name"]: r["vulns"] for r in store.read_stored(spark, path, schema).collect()}
    assert len(got) == 61 and got["p7"] == "new" and sum(v == "new" for v in got.values()) == 1
    wanted = spark.createDataFrame([("npm", "p7"), ("npm", "p8"), ("npm", "none")], "ecosystem string, name string")
    found = store.lookup_stored(wanted, path, schema, keys, as_of, 86_400_000, buckets=16)
    assert {r["name"]: r["hit"] for r in found.collect()} == {"p7": True, "p8": False, "none": False}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store.prune_stored(spark, path, schema, keys, as_of, 2 * 86_400_000, buckets=16)
    left = {r["name"] for r in store.read_stored(spark, path, schema).collect()}
    assert left == {f"p{k}" for k in range(60) if k % 5 <= 2 or k == 7} | {"n"}


def test_poll_timer(spark, tmp_path):
    from palisade.schema import ADVISORY

    base = spark.createDataFrame([("npm", "a", "1", None, 1)], watch.BASE)
    watch.set_baseline(base, str(tmp_path / "base"), dt.datetime(2026, 1, 1))
    index = spark.createDataFrame([("npm", "a", "1", "V1")], "ecosystem string, name string, version string, id string")
    query = watch.poll_timer(spark, str(tmp_path / "base"), lambda: (index, spark.createDataFrame([], ADVISORY)), str(tmp_path / "out"), "LOW", 1).option("checkpointLocation", str(tmp_path / "ck")).start()
    for _ in range(60):
        if (tmp_path / "out" / "0" / "_SUCCESS").exists():
            break
        time.sleep(0.5)
    query.stop()
    row = spark.read.parquet(str(tmp_path / "out" / "0")).first()
    assert (row["id"], row["total"]) == ("V1", 1)


def test_watch(spark, tmp_path):
    snap = lambda n, rows: watch.write_snapshot(spark.createDataFrame([("npm", a, v, None, i) for i, (a, v) in enumerate(rows)], watch.BASE).repartition(3), str(tmp_path / "in"), dt.datetime(2026, 1, n))
    asked = []

    def complete(changed):
        asked.append({(r["name"], r["version"]) for r in changed.collect()})
        return len(asked) != 2

    def run():
        stream = watch.read_snapshots(spark, str(tmp_path / "in"))
        watch.watch(stream, str(tmp_path / "base"), str(tmp_path / "reports"), complete).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    snap(1, [("a", "1"), ("b", "1")])
    run()
    snap(2, [("a", "2"), ("b", "1")])
    run()
    snap(4, [("a", "2"), ("b", "1"), ("c", "1")])  # both at once, the later one first
    snap(3, [("a", "2"), ("b", "2")])
    run()
    assert asked == [{("a", "1"), ("b", "1")}, {("a", "2")}, {("a", "2"), ("b", "2")}, {("b", "1"), ("c", "1")}]
    assert {(r["name"], r["version"]) for r in watch.read_baseline(spark, str(tmp_path / "base")).collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
