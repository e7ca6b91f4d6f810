"""Queries: names, versions, advisories' fields, files and source code."""

from __future__ import annotations

import io
import tarfile

import pandas as pd
from pyspark.sql import functions as F

from palisade.functions import severity as sev
from palisade.functions import text, versions
from palisade.operators import advisories, code_rules, rules
from palisade.queries.tables import dealt, table
from palisade.sources import archives, parsers


def typosquat(spark, d):
    """Words of a-z of all documents within a small edit distance of part names."""
    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w.rlike("^[A-Za-z]+$"))
    names = table(spark, d, "documents").select(F.explode(words).alias("name")).select(F.lower("name").alias("name")).distinct()
    popular = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    return rules.typosquats(names, popular)


TYPOSQUAT = r"""
WITH w AS (SELECT DISTINCT lower(x) AS name FROM (SELECT unnest(regexp_split_to_array(text, '[^\p{L}]+')) AS x FROM documents) WHERE regexp_matches(x, '^[A-Za-z]+$')),
n AS (SELECT name, CASE WHEN length(name) <= 3 THEN 0 WHEN length(name) <= 6 THEN 1 ELSE 2 END AS lim FROM w),
p AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS "similar" FROM part)
SELECT name, "similar", levenshtein(name, "similar")::INT AS distance FROM n JOIN p ON abs(length(name) - length("similar")) <= lim
WHERE levenshtein(name, "similar") BETWEEN 1 AND lim AND NOT (length("similar") <= 3 AND length(name) <= 5)
"""


def homoglyph(spark, d):
    """How many words of each document have suspicious characters, by kind; every seventh and eleventh document gets one more such word."""
    given = F.concat("text", F.when(F.col("doc_id") % 7 == 0, F.lit(" na\u200bme")).when(F.col("doc_id") % 11 == 0, F.lit(" \u202ename")).otherwise(F.lit("")))
    words = F.filter(F.split(given, r"[\x20\x09-\x0D]+"), lambda w: F.size(text.homoglyphs(w)) > 0)
    names = table(spark, d, "documents").select("doc_id", F.explode(words).alias("name"))
    return names.select("doc_id", F.explode(text.homoglyphs(F.col("name"))).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


HOMOGLYPH = r"""
WITH g AS (SELECT doc_id, text || CASE WHEN doc_id % 7 = 0 THEN ' na' || chr(8203) || 'me' WHEN doc_id % 11 = 0 THEN ' ' || chr(8238) || 'name' ELSE '' END AS t FROM documents),
w AS (SELECT doc_id, unnest(regexp_split_to_array(t, '[\x20\x09-\x0D]+')) AS name FROM g),
k AS (
  SELECT doc_id, 'INVISIBLE_CHARS' AS kind FROM w WHERE regexp_matches(name, '[\x{200b}-\x{200f}\x{2060}\x{feff}]')
  UNION ALL SELECT doc_id, 'BIDI_OVERRIDE' FROM w WHERE regexp_matches(name, '[\x{202a}-\x{202e}\x{2066}-\x{2069}]')
  UNION ALL SELECT doc_id, 'NON_ASCII' FROM w WHERE regexp_matches(name, '[^\x00-\x7f]')
)
SELECT doc_id, kind, count(*) AS n FROM k GROUP BY ALL
"""

_ESCAPES = ["\x1b]0;title\x07", "\x1b[31m", "\x1bP1;2|data\x1b\\", "\x9b", "\x01\x07", "\x1bM", "\x7f\t"]


def sanitize_text(spark, d):
    """Each document with an escape sequence put in after its first 20 characters."""
    given = F.get(F.array(*[F.lit(x) for x in _ESCAPES]), (F.col("doc_id") % len(_ESCAPES)).cast("int"))
    dirty = F.concat(F.substring("text", 1, 20), given, F.substring("text", 21, 2**31 - 1))
    return table(spark, d, "documents").select("doc_id", F.md5(text.sanitize(dirty)).alias("clean"), F.length(text.sanitize(dirty)).cast("long").alias("n"))


_ESCAPES_SQL = "CASE doc_id % 7 WHEN 0 THEN chr(27) || ']0;title' || chr(7) WHEN 1 THEN chr(27) || '[31m' WHEN 2 THEN chr(27) || 'P1;2|data' || chr(27) || chr(92) WHEN 3 THEN chr(155) WHEN 4 THEN chr(1) || chr(7) WHEN 5 THEN chr(27) || 'M' ELSE chr(127) || chr(9) END"
SANITIZE = (
    "WITH x AS (SELECT doc_id, substr(text, 1, 20) || " + _ESCAPES_SQL + r""" || substr(text, 21) AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\x1b\][\s\S]*?(?:\x07|\x1b\\)', '', 'g'), '\x1b[PX^_][\s\S]*?\x1b\\', '', 'g'), '\x1b\[[\x20-\x2f]*[0-9;?]*[\x20-\x7e]', '', 'g'), '\x1b[\x40-\x7e]', '', 'g'), '\x1b', '', 'g'), '[\x{80}-\x{9f}]', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS c FROM x)
SELECT doc_id, md5(c) AS clean, length(c) AS n FROM s"""
)


def name_normalize(spark, d):
    given = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), "p_brand", F.lit("\t"))
    return table(spark, d, "part").select("p_partkey", text.normalize_name(given).alias("name"))


NORMALIZE = "SELECT p_partkey, regexp_replace(lower(replace(p_name, ' ', '_') || '.' || p_brand), '[._]', '-', 'g') AS name FROM part"


def version_from_spec(spark, d):
    forms = ["^{v}.0", "=={v}.1.2", "[{v}.3]", "~> v{v}.4", "{v}-beta.1+x", "* ", "\"{v}.5\"", ">={v}.6,<9"]
    form = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("p_partkey") % len(forms)).cast("int"))
    p = table(spark, d, "part").select("p_partkey", F.replace(form, F.lit("{v}"), F.col("p_size").cast("string")).alias("spec"))
    version = versions.version_of(F.col("spec"))
    return p.select("p_partkey", "spec", version.alias("version"), versions.is_pinned(F.col("spec"), version).alias("pinned"))


VERSION = """
WITH p AS (SELECT p_partkey, replace(['^{v}.0', '=={v}.1.2', '[{v}.3]', '~> v{v}.4', '{v}-beta.1+x', '* ', '"{v}.5"', '>={v}.6,<9'][p_partkey % 8 + 1], '{v}', p_size::VARCHAR) AS spec FROM part)
SELECT p_partkey, spec, CASE p_partkey % 8 WHEN 5 THEN NULL WHEN 4 THEN spec ELSE regexp_extract(spec, '[0-9]+(\\.[0-9]+)*') END AS version, p_partkey % 8 IN (1, 2, 4, 6) AS pinned FROM p
""".replace("\\\\", "\\")


def semver_order_best_fix(spark, d):
    v = F.concat_ws(".", "p_size", F.col("p_partkey") % 17, F.col("p_partkey") % 23)
    p = table(spark, d, "part").select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("package"), F.concat(F.lit(">= "), v).alias("fixed"))
    return advisories.best_fixes(p)


SEMVER = "SELECT 'npm' AS ecosystem, p_brand AS package, arg_max(p_size || '.' || (p_partkey % 17) || '.' || (p_partkey % 23), p_size * 10000 + (p_partkey % 17) * 100 + p_partkey % 23) AS best_fix FROM part GROUP BY p_brand"


def cvss_base_score(spark, d):
    pick = lambda values, by: F.get(F.array(*[F.lit(v) for v in values]), F.expr(by).cast("int"))
    vector = F.concat(
        F.lit("CVSS:3.1/AV:"), pick("NALP", "p_partkey % 4"), F.lit("/AC:"), pick("LH", "p_partkey div 4 % 2"), F.lit("/PR:"), pick("NLH", "p_partkey div 8 % 3"), F.lit("/UI:"), pick("NR", "p_partkey div 24 % 2"), F.lit("/S:"), pick("UC", "p_partkey div 48 % 2"),
        F.lit("/C:"), pick("HLN", "p_partkey div 96 % 3"), F.lit("/I:"), pick("HLN", "p_partkey div 288 % 3"), F.when(F.col("p_partkey") % 19 != 0, F.concat(F.lit("/A:"), pick("HLN", "p_partkey div 864 % 3"))).otherwise(F.lit("")),
    )
    return table(spark, d, "part").select("p_partkey", sev.cvss_base_score(vector).alias("score"))


CVSS = """
WITH m AS (
  SELECT p_partkey, list_extract([0.85, 0.62, 0.55, 0.20], p_partkey % 4 + 1)::DOUBLE AS av, list_extract([0.77, 0.44], p_partkey // 4 % 2 + 1)::DOUBLE AS ac, p_partkey // 48 % 2 = 1 AS ch,
         list_extract([0.85, CASE WHEN ch THEN 0.68 ELSE 0.62 END, CASE WHEN ch THEN 0.5 ELSE 0.27 END], p_partkey // 8 % 3 + 1)::DOUBLE AS pr, list_extract([0.85, 0.62], p_partkey // 24 % 2 + 1)::DOUBLE AS ui,
         list_extract([0.56, 0.22, 0], p_partkey // 96 % 3 + 1)::DOUBLE AS c, list_extract([0.56, 0.22, 0], p_partkey // 288 % 3 + 1)::DOUBLE AS i, list_extract([0.56, 0.22, 0], p_partkey // 864 % 3 + 1)::DOUBLE AS a FROM part
),
n AS (SELECT *, 1 - (1 - c) * (1 - i) * (1 - a) AS l, 8.22::DOUBLE * av * ac * pr * ui AS e, CASE WHEN ch THEN 7.52::DOUBLE * (l - 0.029::DOUBLE) - 3.25::DOUBLE * pow(l - 0.02::DOUBLE, 15) ELSE 6.42::DOUBLE * l END AS imp FROM m)
SELECT p_partkey, CASE WHEN p_partkey % 19 = 0 THEN list_extract([7.5, 5.0, 4.0, 5.0], p_partkey % 4 + 1)::DOUBLE WHEN imp <= 0 THEN 0 ELSE ceil(least((imp + e) * CASE WHEN ch THEN 1.08 ELSE 1.0 END::DOUBLE, 10) * 10) / 10 END::DOUBLE AS score FROM n
"""


def _advisory(spark, d):
    p = table(spark, d, "part")
    key = F.col("p_partkey")
    item = lambda prefix: F.concat(F.lit(prefix), key.cast("string"))
    aliases = F.array_compact(F.array(F.when(key % 3 == 0, item("CVE-")), F.when(key % 2 == 0, item("GHSA-")), F.when(key % 5 == 0, item("GHSA-x"))))
    ranges = lambda first: F.array(F.struct(F.array(F.struct(F.when(key % 4 == 0, F.lit(None)).otherwise(first).alias("fixed")), F.struct(item("9.").alias("fixed"))).alias("events")))
    affected = F.array(F.struct(F.struct(F.lit("other").alias("name")).alias("package"), ranges(item("1.")).alias("ranges"), F.struct(F.lit(None).cast("string").alias("severity")).alias("ecosystem_specific")), F.struct(F.struct(F.col("p_brand").alias("name")).alias("package"), ranges(item("2.")).alias("ranges"), F.struct(F.when(key % 7 == 0, "medium").alias("severity")).alias("ecosystem_specific")))
    scores = F.array(F.when(key % 2 == 0, F.concat((key % 100 / 10).cast("string"))).otherwise(F.lit("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H")))
    return p.select("p_partkey", "p_brand", aliases.alias("aliases"), affected.alias("affected"), F.when(key % 11 == 0, "Important").alias("database"), scores.alias("scores"))


def advisory_fields(spark, d):
    a = _advisory(spark, d)
    return a.select(
        "p_partkey",
        sev.display_id(F.col("aliases"), F.concat(F.lit("OSV-"), F.col("p_partkey").cast("string"))).alias("display_id"),
        sev.fixed_version(F.col("affected"), F.col("p_brand")).alias("fixed"),
        sev.advisory_severity(F.col("database"), F.col("affected")["ecosystem_specific"]["severity"], F.col("scores")).alias("severity"),
    )


ADVISORY = """
SELECT p_partkey, CASE WHEN k % 2 = 0 THEN 'GHSA-' || k WHEN k % 5 = 0 THEN 'GHSA-x' || k WHEN k % 3 = 0 THEN 'CVE-' || k ELSE 'OSV-' || k END AS display_id,
       '>= ' || CASE WHEN k % 4 = 0 THEN '9.' ELSE '2.' END || k AS fixed,
       CASE WHEN k % 11 = 0 THEN 'HIGH' WHEN k % 7 = 0 THEN 'MODERATE' WHEN k % 2 = 1 THEN 'CRITICAL' WHEN k % 100 >= 90 THEN 'CRITICAL' WHEN k % 100 >= 70 THEN 'HIGH' WHEN k % 100 >= 40 THEN 'MODERATE' WHEN k % 100 > 0 THEN 'LOW' ELSE 'CRITICAL' END AS severity
FROM (SELECT p_partkey, p_partkey AS k FROM part)
"""

_HOSTS = ["example.com", "example.org"]


def url_allowlist(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    given = F.when(F.col("page_id") % 9 == 0, "not a url").when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://example.com/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return p.select("page_id", F.coalesce(text.url_problem(given, _HOSTS), F.lit("OK")).alias("problem"))


URLS = """
WITH g AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'not a url' WHEN page_id % 5 = 0 THEN 'https://example.com/' || page_id ELSE url END AS u FROM pages)
SELECT page_id, CASE WHEN NOT regexp_matches(u, '^[a-z]+://[^/]+') THEN 'INVALID_URL' WHEN NOT starts_with(u, 'https://') THEN 'NOT_HTTPS' WHEN regexp_extract(u, '^https://([^/:?#]+)', 1) NOT IN ('example.com', 'example.org') THEN 'HOST_NOT_ALLOWED' ELSE 'OK' END AS problem FROM g
"""


def _files(spark, d, name, content):
    return dealt(table(spark, d, "part"), 50_000).select(F.concat(F.lit("/p/"), F.col("p_partkey").cast("string"), F.lit(f"/{name}")).alias("path"), content.alias("content"))


def requirements_parse(spark, d):
    k = F.col("p_partkey")
    lines = F.concat(F.lit("# list\nMy_"), "p_size", F.lit(".Pkg=="), k.cast("string"), F.lit(".1\nother[extra]>="), "p_size", F.lit(".0,<99\n-r more.txt\n"), F.when(k % 3 == 0, "git+https://x/y\n").otherwise("plain\n"))
    rows = parsers.requirements(_files(spark, d, "requirements.txt", lines))
    return rows.select(F.regexp_extract("source_file", r"/p/(\d+)/", 1).cast("long").alias("p_partkey"), "name", "version", "is_pinned")


REQUIREMENTS = """
SELECT p_partkey, 'my-' || p_size || '-pkg' AS name, p_partkey || '.1' AS version, true AS is_pinned FROM part
UNION ALL SELECT p_partkey, 'other', p_size || '.0', false FROM part UNION ALL SELECT p_partkey, 'plain', 'latest', false FROM part WHERE p_partkey % 3 <> 0
"""


def html_block_extract(spark, d):
    """Elements of build files: each page's links as dependencies with a version, a property and none."""
    block = lambda v: F.concat(F.lit("<dependency>\n <groupId>org.p"), F.col("page_id").cast("string"), F.lit("</groupId><artifactId>a</artifactId>"), v, F.lit("</dependency>"))
    content = F.concat(F.lit("<project><dependencies>"), block(F.concat(F.lit("<version> ["), F.col("page_id").cast("string"), F.lit(".1] </version>"))), block(F.lit("<version>${v}</version>")), block(F.lit("")), F.lit("</dependencies><!-- "), F.regexp_replace("html", "<dependency>|-->", ""), F.lit(" --></project>"))
    files = table(spark, d, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit("/pom.xml")).alias("path"), content.alias("content"))
    return parsers.pom(files).select("name", "version", "is_pinned", "source_file")


HTML = "SELECT 'org.p' || page_id || ':a' AS name, page_id || '.1' AS version, true AS is_pinned, '/p/' || page_id || '/pom.xml' AS source_file FROM pages"


def npm_lock_parse(spark, d):
    """Lockfiles built of events' properties, read as such."""
    e = dealt(table(spark, d, "events"), 50_000)
    k = F.get_json_object("props", "$.k")
    content = F.concat(F.lit('{"packages": {"": {"version": "1"}, "node_modules/A'), k, F.lit('": {"version": "'), F.col("user_id").cast("string"), F.lit('.0.0", "dev": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit('}, "node_modules/x/node_modules/@s/b": {"version": "2.0.0"}, "node_modules/none": {}}}'))
    files = e.select(F.concat(F.lit("/e/"), F.col("event_id").cast("string"), F.lit("/package-lock.json")).alias("path"), content.alias("content"))
    return parsers.npm_lock(files).select(F.regexp_extract("source_file", r"/e/(\d+)/", 1).cast("long").alias("event_id"), "name", "version", "is_dev")


NPM_LOCK = """
SELECT event_id, 'a' || (props::JSON->>'k') AS name, user_id || '.0.0' AS version, event_id % 2 = 0 AS is_dev FROM events
UNION ALL SELECT event_id, '@s/b', '2.0.0', false FROM events
"""


def gosum_parse(spark, d):
    k = F.col("p_partkey").cast("string")
    lines = F.concat(F.lit("example.com/m"), "p_size", F.lit(" v1."), k, F.lit(".0 h1:a=\nexample.com/m"), "p_size", F.lit(" v1."), k, F.lit(".0/go.mod h1:b=\nshort line\n"))
    return parsers.go_sum(_files(spark, d, "go.sum", lines)).select("name", "version", "integrity")


GOSUM = "SELECT 'example.com/m' || p_size AS name, 'v1.' || p_partkey || '.0' AS version, 'h1:a=' AS integrity FROM part"


def gradle_parse(spark, d):
    k = F.col("p_partkey").cast("string")
    lines = F.concat(F.lit("# c\norg."), F.lower("p_brand"), F.lit(":a:"), k, F.lit("=compileClasspath\nempty=x\n"))
    return parsers.gradle_lock(_files(spark, d, "gradle.lockfile", lines)).select("name", "version")


GRADLE = "SELECT 'org.' || lower(p_brand) || ':a' AS name, p_partkey::VARCHAR AS version FROM part"

_SNIPPETS = ["import os\nos.system('x')", "  # eval(x)\neval(y)", "pip exec(a)\nrequests.get(u)", "base64.b64decode(z); os.getenv('A')", "open('/etc/passwd')", "subprocess \\\n  .run(a)\nx = 1", "print('ok')"]
_SNIPPETS_SQL = "CASE doc_id % 7 WHEN 0 THEN 'import os' || chr(10) || 'os.system(''x'')' WHEN 1 THEN '  # eval(x)' || chr(10) || 'eval(y)' WHEN 2 THEN 'pip exec(a)' || chr(10) || 'requests.get(u)' WHEN 3 THEN 'base64.b64decode(z); os.getenv(''A'')' WHEN 4 THEN 'open(''/etc/passwd'')' WHEN 5 THEN 'subprocess \\' || chr(10) || '  .run(a)' || chr(10) || 'x = 1' ELSE 'print(''ok'')' END"


def _python_files(spark, d):
    snippet = F.get(F.array(*[F.lit(s) for s in _SNIPPETS]), (F.col("doc_id") % len(_SNIPPETS)).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(snippet, F.lit("\n"), "text").alias("source"))


def py_rules(spark, d):
    return code_rules.python_findings(_python_files(spark, d)).select("doc_id", F.col("line").cast("long").alias("line"), "pattern", "severity")


_PY = (
    "WITH s AS (SELECT doc_id, regexp_replace(" + _SNIPPETS_SQL + r""" || chr(10) || text, '\\\r?\n[\s\x0b]*', ' ', 'g') AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM s),
c AS (SELECT doc_id, line, regexp_replace(raw, '^[\s\x0b\x{a0}\x{feff}]+|[\s\x0b\x{a0}\x{feff}]+$', '', 'g') AS code FROM l),
f AS ("""
    + "\n  UNION ALL ".join(
        "SELECT doc_id, line, '{}' AS pattern, '{}' AS severity FROM c WHERE NOT starts_with(code, '#') AND regexp_matches(code, '{}'){}".format(p, s, y.replace("'", "''"), f" AND NOT regexp_matches(code, '{n}')" if n else "") for p, s, y, n in code_rules.PYTHON_RULES
    )
    + "\n)\n"
)
PY_RULES = _PY + "SELECT doc_id, line, pattern, severity FROM f"


def py_capabilities(spark, d):
    flat = code_rules.capabilities(code_rules.python_findings(_python_files(spark, d)), ["doc_id"])
    return flat.select("doc_id", "code_execution", "process_spawn", "network", "system_write", "credential_access", "payload_decode", "max_severity", "finding_count")


PY_CAPABILITIES = _PY + """SELECT doc_id, bool_or(pattern = 'CODE_EXECUTION') AS code_execution, bool_or(pattern = 'PROCESS_SPAWN') AS process_spawn, bool_or(pattern = 'NETWORK_ACCESS') AS network, bool_or(pattern = 'SYSTEM_PATH_WRITE') AS system_write, bool_or(pattern = 'ENV_HARVESTING') AS credential_access, bool_or(pattern = 'BASE64_DECODE') AS payload_decode,
       CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 ELSE 2 END) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' ELSE 'MODERATE' END AS max_severity, count(*) AS finding_count FROM f GROUP BY doc_id"""

#: Sources, and what is found in each; the same code stands plainly, in what a template fills in, and in strings.
_JS = [
    ("const cp = require('child_process'); cp.exec('x')", [("PROCESS_SPAWN", "CRITICAL", 1)]),
    ("eval(a); // fetch(b)", [("CODE_EXECUTION", "CRITICAL", 1)]),
    ("fetch('u'); process.env.NPM_TOKEN", [("NETWORK_ACCESS", "HIGH", 1), ("ENV_HARVESTING", "CRITICAL", 1)]),
    ("const fs = require('fs'); fs.writeFileSync('/etc/x', y)", [("SYSTEM_PATH_WRITE", "CRITICAL", 1)]),
    ("require('a' + b)", [("POSSIBLE_OBFUSCATION", "CRITICAL", 1)]),
    ("console.log('eval(x)'); const t = 'require(y)'; a = `new Function`; b = /it's eval(c)/g", []),
    ("function ( {", [("UNPARSEABLE_CODE", "HIGH", 1)]),
    ("const s = `${eval(x)} and ${fetch(u)}`", [("CODE_EXECUTION", "CRITICAL", 1), ("NETWORK_ACCESS", "HIGH", 1)]),
    ("import cp, {exec} from 'child_process'; exec('a')", [("PROCESS_SPAWN", "CRITICAL", 1)]),
    ("import d, * as net from 'net'; net.connect(1)", [("NETWORK_ACCESS", "HIGH", 1)]),
    ("setTimeout('x()', 1); new Function('y'); new Worker(f)", [("CODE_EXECUTION", "CRITICAL", 2), ("CODE_EXECUTION", "HIGH", 1)]),
    ("import(name); require(name)", [("DYNAMIC_IMPORT", "HIGH", 1), ("DYNAMIC_REQUIRE", "HIGH", 1)]),
    ("Buffer.from(x, 'base64'); y.toString('base64')", [("BASE64_DECODE", "HIGH", 2)]),
    ("const vm = require('vm'); vm.runInNewContext(x); process.binding('fs'); process.dlopen(m)", [("CODE_EXECUTION", "CRITICAL", 2), ("PROCESS_SPAWN", "CRITICAL", 1)]),
    ("globalThis['eval'](x); window[a + b](c)", [("CODE_EXECUTION", "CRITICAL", 1), ("POSSIBLE_OBFUSCATION", "HIGH", 1)]),
    ("WebAssembly.instantiate(b); [].filter.constructor('x')()", [("CODE_EXECUTION", "CRITICAL", 2)]),
    ("const {unlinkSync} = require('fs'); unlinkSync(__filename)", [("SELF_DELETION", "CRITICAL", 1)]),
    ("import fs from 'node:fs'; fs.readFileSync('/home/u/.ssh/id_rsa'); fs.writeFile('out', 1)", [("ENV_HARVESTING", "CRITICAL", 1), ("FILESYSTEM_WRITE", "MODERATE", 1)]),
    ("a[b](c); d[e](f); g[h](i)", [("POSSIBLE_OBFUSCATION", "HIGH", 1)]),
]


def _js_files(spark, d):
    """A source for each document, which also has its whole text as a string and in a comment."""
    snippet = F.get(F.array(*[F.lit(s) for s, _ in _JS]), (F.col("doc_id") % len(_JS)).cast("int"))
    return table(spark, d, "documents").select("doc_id", F.concat(snippet, F.lit("\nconst doc = "), F.to_json(F.struct("text")), F.lit(";\n/* "), F.replace("text", F.lit("*/"), F.lit("")), F.lit(" */")).alias("source"))


def js_rules(spark, d):
    return code_rules.js_findings(_js_files(spark, d))


_JS_FOUND = ", ".join(f"({m}, '{p}', '{s}', {n})" for m, (_, found) in enumerate(_JS) for p, s, n in found)
JS = f"""
WITH w(m, pattern, severity, hits) AS (VALUES {_JS_FOUND})
SELECT doc_id, pattern, severity, hits::BIGINT AS hits FROM documents JOIN w ON doc_id % {len(_JS)} = m
"""


def js_profiles(spark, d):
    """Capabilities of each document's source."""
    return code_rules.profile(js_rules(spark, d), ["doc_id"]).select("doc_id", F.array_join("capabilities", ",").alias("capabilities"))


def _caps(found):
    return ",".join(sorted(c for c, patterns in code_rules.CAPABILITIES[:9] if {p for p, *_ in found} & set(patterns)))


_JS_CAPS = ", ".join(f"({m}, '{_caps(found)}')" for m, (_, found) in enumerate(_JS) if found)
JS_PROFILES = f"WITH w(m, capabilities) AS (VALUES {_JS_CAPS}) SELECT doc_id, capabilities FROM documents JOIN w ON doc_id % {len(_JS)} = m"


def inline_js_extract(spark, d):
    forms = ["node -e 'run({n})'", 'sh -c "node --eval \'deep({n})\'"', "node scripts/{n}.js", "npm run build", "var a = {n};", "echo {n}", 'node -e "x({n})" && true']
    form = F.get(F.array(*[F.lit(f) for f in forms]), (F.col("p_partkey") % len(forms)).cast("int"))
    script = F.replace(form, F.lit("{n}"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", text.inline_js(script).alias("js"))


INLINE_JS = "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'run(' || p_partkey || ')' WHEN 1 THEN 'deep(' || p_partkey || ')' WHEN 4 THEN 'var a = ' || p_partkey || ';' WHEN 6 THEN 'x(' || p_partkey || ')' END AS js FROM part"


def name_encoding(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.when(F.col("p_partkey") % 2 == 0, "@s/").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("~")))
    return p.select("p_partkey", text.encode_package(name).alias("encoded"), text.shell_quoted(F.concat(name, F.when(F.col("p_partkey") % 3 == 0, "'s").otherwise(""))).alias("quoted"))


ENCODING = """
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '@s/' ELSE '' END AS a, replace(p_name, ' ', '~') AS b FROM part)
SELECT p_partkey, replace(a, '/', '%2F') || replace(b, '~', '%7E') AS encoded,
       CASE WHEN p_partkey % 3 = 0 THEN '''' || a || b || '''\\''''s''' WHEN contains(a || b, '~') THEN '''' || a || b || '''' ELSE a || b END AS quoted FROM n
"""

#: Documents in an archive.
_PACKED = 50


def _pack(rows):
    """An archive of documents as scripts; its package.json comes last and names two of them, one deep in its exports."""
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as tar:
        files = [("index" if n == _PACKED - 1 else f"part{n}", str(t or "").encode()) for n, t in sorted(zip(rows["doc_id"] % _PACKED, rows["text"], strict=True))]
        for name, body in [*[(f"{n}.js", b) for n, b in files], ("package.json", b'{"main": "part7", "exports": {"./a": {"node": [{"import": "./part40.js"}]}}}')]:
            info = tarfile.TarInfo(f"package/{name}")
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return pd.DataFrame({"path": [f"{rows['doc_id'].iloc[0] // _PACKED}.tgz"], "content": [raw.getvalue()]})


def archive_files(spark, d):
    """What is read of archives of documents: entries by name and by package.json, and how long they are."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    packed = docs.groupBy(F.expr(f"doc_id div {_PACKED}")).applyInPandas(_pack, "path string, content binary")
    return archives.untar(packed).select("path", "entry", F.octet_length("text").cast("long").alias("size"), F.sha2("text", 256).alias("sha"), "problem")


ARCHIVE_FILES = f"""
SELECT (doc_id // {_PACKED})::VARCHAR || '.tgz' AS path, CASE doc_id % {_PACKED} WHEN {_PACKED - 1} THEN 'index.js' ELSE 'part' || doc_id % {_PACKED} || '.js' END AS entry,
       CASE WHEN strlen(text) <= {archives.MOST_FILE} THEN strlen(text) END AS size, CASE WHEN strlen(text) <= {archives.MOST_FILE} THEN sha256(text) END AS sha,
       CASE WHEN strlen(text) > {archives.MOST_FILE} THEN 'file too large: part' || doc_id % {_PACKED} || '.js' END AS problem
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE doc_id % {_PACKED} IN (7, 40, {_PACKED - 1})
"""

QUERIES = {
    "archive_files": (archive_files, ARCHIVE_FILES),
    "typosquat": (typosquat, TYPOSQUAT),
    "homoglyph": (homoglyph, HOMOGLYPH),
    "sanitize_text": (sanitize_text, SANITIZE),
    "name_normalize": (name_normalize, NORMALIZE),
    "name_encoding": (name_encoding, ENCODING.replace("\\\\", "\\")),
    "version_from_spec": (version_from_spec, VERSION),
    "semver_order_best_fix": (semver_order_best_fix, SEMVER),
    "cvss_base_score": (cvss_base_score, CVSS),
    "advisory_fields": (advisory_fields, ADVISORY),
    "url_allowlist": (url_allowlist, URLS),
    "requirements_parse": (requirements_parse, REQUIREMENTS),
    "html_block_extract": (html_block_extract, HTML),
    "npm_lock_parse": (npm_lock_parse, NPM_LOCK),
    "gosum_parse": (gosum_parse, GOSUM),
    "gradle_parse": (gradle_parse, GRADLE),
    "py_rules": (py_rules, PY_RULES),
    "py_capabilities": (py_capabilities, PY_CAPABILITIES),
    "js_rules": (js_rules, JS),
    "js_profiles": (js_profiles, JS_PROFILES),
    "inline_js_extract": (inline_js_extract, INLINE_JS),
}
