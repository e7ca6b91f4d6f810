"""Patterns in source code, as built-in expressions: findings per line, capabilities, worst severity.

JavaScript is read as scanned text (functions.js_text), in which strings can't be taken for code and a call's arguments are told by the depth of their
parentheses. A text whose brackets, strings or templates don't close counts as unparseable, which is a finding of its own and never silence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.js_text import BROKEN, scanned
from palisade.functions.severity import named, order_of
from palisade.functions.text import trimmed
from palisade.schema import SENSITIVE_ENV_KEYS
from palisade.scratch import small_batches

#: Pattern, severity, what a line must match, what it must not.
PYTHON_RULES = [
    ("PROCESS_SPAWN", "CRITICAL", r"\bsubprocess\s*\.\s*(run|call|check_call|check_output|Popen)\b|\bos\s*\.\s*(system|popen|exec[lv]?[pe]?)\b", None),
    ("CODE_EXECUTION", "CRITICAL", r"\b(eval|exec)\s*\(", r"\b(pip|setuptools|distutils)\b"),
    ("NETWORK_ACCESS", "HIGH", r"\b(urllib\.request\.urlopen|requests\.(get|post|put|patch)|httpx\.(get|post)|socket\.socket)\b", None),
    ("BASE64_DECODE", "HIGH", r"\bbase64\.(b64decode|b64encode|decodebytes|encodebytes)\b", None),
    ("ENV_HARVESTING", "MODERATE", r"\bos\.environ\b|\bos\.getenv\b", None),
    ("SYSTEM_PATH_WRITE", "CRITICAL", r"""\bopen\s*\(\s*['"]/(?:usr|etc|bin|tmp|root)""", None),
]

#: Methods of modules, names of the global object.
_SPAWN = r"(?:exec|execSync|spawn|spawnSync|execFile|execFileSync|fork)"
_VM = r"(?:runInNewContext|runInThisContext|runInContext|compileFunction|createScript)"
_NET = r"(?:request|get|connect|createConnection|createServer|resolve|resolve4|resolve6|resolveTxt|lookup)"
_WRITE = r"(?:writeFile|writeFileSync|appendFile|appendFileSync|createWriteStream|rename|renameSync|copyFile|copyFileSync|rm|rmSync|rmdir|rmdirSync|unlink|unlinkSync)"
_READ = r"(?:readFile|readFileSync|createReadStream)"
_GLOBAL = r"(?:globalThis|global|window|self|GLOBAL|root)"
_ENV = "(?:" + "|".join(SENSITIVE_ENV_KEYS) + ")"
#: In scanned text: ( and ) with their depth, a string's start and end, a whole string, the string of a module.
_O, _C = r"\([\ue000-\uf8ff]", r"[\ue000-\uf8ff]\)"
_S, _E = r"\x01", r"\x02"
_STRING = r"\x01[^\x02]*\x02"
_NAMED = r"\x01(?:node\x06)?{}\x02"
_MODULE = rf"(?<![\w.$])require\s*{_O}\s*{_NAMED}\s*{_C}"
_BOUND = rf"(?:(?:const|let|var)\s+(\w+)\s*=\s*require\s*{_O}\s*{_NAMED}\s*{_C}|import\s+(\w+)\s*(?:,\s*(?:\{{{{[^}}}}]*\}}}}|\*\s+as\s+(\w+))\s*)?from\s+{_NAMED}|import\s+\*\s+as\s+(\w+)\s+from\s+{_NAMED})".replace("{}", "{m}")
_TAKEN = rf"(?:(?:const|let|var)\s*\{{{{[^}}}}]*\b{{f}}\b[^}}}}]*\}}}}\s*=\s*require\s*{_O}\s*{_NAMED}\s*{_C}|import\s*(?:\w+\s*,\s*)?\{{{{[^}}}}]*\b{{f}}\b[^}}}}]*\}}}}\s*from\s+{_NAMED})".replace("{}", "{m}")
#: A call's arguments before its last one: all up to a comma, but not past the ) of the depth that the pattern's group 1 holds.
_EARLIER = r"\(([\ue000-\uf8ff])(?:(?!\1\))[\s\S])*?,"

#: Pattern, severity, what scanned text must match, words of which it must hold one.
JS_RULES = [
    ("CODE_EXECUTION", "CRITICAL", rf"(?:{_O}|,)\s*(?:eval|Function)\s*(?:{_C}|,)", "eval|Function"),
    ("DYNAMIC_IMPORT", "HIGH", rf"\bimport\s*{_O}\s*(?!{_STRING}\s*{_C})(?!{_C})\S", "import"),
    ("CODE_EXECUTION", "CRITICAL", rf"(?<![\w.$])(?<!\bnew\s{{1,9}})(?:eval|Function)\s*{_O}", "eval|Function"),
    ("DYNAMIC_REQUIRE", "HIGH", rf"(?<![\w.$])require\s*{_O}\s*(?!{_C})[^\x01\s]", "require"),
    ("PROCESS_SPAWN", "CRITICAL", _MODULE.format("child_process") + rf"\s*\.\s*{_SPAWN}\s*{_O}", "child_process"),
    ("PROCESS_SPAWN", "CRITICAL", rf"\bprocess\s*\.\s*binding\s*{_O}", "binding"),
    ("CODE_EXECUTION", "CRITICAL", rf"\bprocess\s*\.\s*dlopen\s*{_O}", "dlopen"),
    ("PROCESS_SPAWN", "CRITICAL", rf"\bprocess\s*\.\s*mainModule\s*\.\s*require\s*{_O}", "mainModule"),
    ("CODE_EXECUTION", "CRITICAL", rf"\.\s*constructor\s*\.\s*_load\s*{_O}", "_load"),
    ("BASE64_DECODE", "HIGH", rf"\bBuffer\s*\.\s*from\s*{_EARLIER}\s*{_S}base64{_E}\s*\1\)", "base64"),
    ("BASE64_DECODE", "HIGH", rf"\.\s*toString\s*{_O}\s*{_S}base64{_E}\s*{_C}", "base64"),
    ("CODE_EXECUTION", "CRITICAL", rf"\bWebAssembly\s*\.\s*(?:instantiate|compile)(?:Streaming)?\s*{_O}", "WebAssembly"),
    ("CODE_EXECUTION", "CRITICAL", rf"\.\s*constructor\s*{_O}\s*{_S}", "constructor"),
    ("NETWORK_ACCESS", "HIGH", rf"(?<![\w.$])fetch\s*{_O}", "fetch"),
    ("CODE_EXECUTION", "CRITICAL", rf"(?<![\w$])(?:setTimeout|setInterval|setImmediate)\s*{_O}\s*{_S}", "setTimeout|setInterval|setImmediate"),
    ("CODE_EXECUTION", "CRITICAL", rf"(?<![\w.$]){_GLOBAL}\s*\[\s*{_S}(?:eval|Function){_E}\s*\]\s*{_O}", "["),
    ("POSSIBLE_OBFUSCATION", "HIGH", rf"(?<![\w.$]){_GLOBAL}\s*\[\s*[^\x01\]\s][^\]]*\]\s*{_O}", "["),
    ("CODE_EXECUTION", "CRITICAL", rf"\bnew\s+Function\s*{_O}", "Function"),
    ("CODE_EXECUTION", "HIGH", rf"\bnew\s+Worker\s*{_O}", "Worker"),
    ("CODE_EXECUTION", "CRITICAL", rf"\bnew\s+WebAssembly\s*\.\s*(?:Module|Instance)\s*{_O}", "WebAssembly"),
    ("ENV_HARVESTING", "CRITICAL", rf"\bprocess\s*(?:\.\s*env\b|\[\s*{_S}env{_E}\s*\])\s*(?:\.\s*{_ENV}\b|\[\s*{_S}{_ENV}{_E}\s*\])", "env"),
    ("POSSIBLE_OBFUSCATION", "CRITICAL", rf"(?<![\w.$])require\s*{_O}\s*{_STRING}\s*\+", "require"),
]
_SYSTEM = rf"\s*{_S}\x05(?:usr|etc|bin|sbin|var|tmp|root)\x05"
_ITSELF = r"\s*(?:__filename|__dirname)\b"
#: Pattern, severity, module, methods, first argument: a call of a module's method, through a name bound to the module or one taken from it.
JS_BOUND = [
    ("PROCESS_SPAWN", "CRITICAL", "child_process", _SPAWN, ""),
    ("CODE_EXECUTION", "CRITICAL", "vm", _VM, ""),
    ("NETWORK_ACCESS", "HIGH", "(?:https?|net|dgram|tls|http2|dns)", _NET, ""),
    ("SYSTEM_PATH_WRITE", "CRITICAL", r"fs(?:\x05promises)?", _WRITE, _SYSTEM),
    ("SELF_DELETION", "CRITICAL", r"fs(?:\x05promises)?", r"(?:unlink|unlinkSync|rm|rmSync)", _ITSELF),
    ("FILESYSTEM_WRITE", "MODERATE", r"fs(?:\x05promises)?", _WRITE, rf"(?!{_SYSTEM})(?!{_ITSELF})"),
    ("ENV_HARVESTING", "CRITICAL", r"fs(?:\x05promises)?", _READ, rf"\s*{_S}[^\x02]*(?:\x05etc\x05passwd|\x05etc\x05shadow|\x05etc\x05hosts|\x04ssh\x05|\x04aws\x05|\x04gnupg\x05|\x04npmrc|\x04netrc|\x04env|\x04git\x05config)"),
]

#: Statements that bind names to modules; patterns for single modules only look into these.
_STATEMENT = rf"\b(?:const|let|var)\s+(?:\w+|\{{[^}}]*\}})\s*=\s*require\s*{_O}\s*{_STRING}\s*{_C}|\bimport\b[^;\x01()]*{_STRING}|(?<![\w.$])require\s*{_O}\s*{_STRING}\s*{_C}\s*\.\s*(?:promises\s*\.\s*)?\w+\s*{_O}"

#: Capability, the patterns that show it.
CAPABILITIES = [
    ("code_execution", ["CODE_EXECUTION"]),
    ("process_spawn", ["PROCESS_SPAWN"]),
    ("network", ["NETWORK_ACCESS"]),
    ("filesystem_write", ["FILESYSTEM_WRITE", "SYSTEM_PATH_WRITE"]),
    ("system_write", ["SYSTEM_PATH_WRITE"]),
    ("credential_access", ["ENV_HARVESTING"]),
    ("payload_decode", ["BASE64_DECODE"]),
    ("self_deletion", ["SELF_DELETION"]),
    ("dynamic_loading", ["DYNAMIC_REQUIRE", "DYNAMIC_IMPORT"]),
    ("unparseable", ["UNPARSEABLE_CODE"]),
    ("obfuscation", ["POSSIBLE_OBFUSCATION"]),
    ("incomplete", ["ANALYSIS_ERROR"]),
]


def _finding(pattern: str, severity: str) -> Column:
    return F.struct(F.lit(pattern).alias("pattern"), F.lit(severity).alias("severity"))


def python_findings(files: DataFrame, source: str = "source") -> DataFrame:
    """The columns of ``files`` but ``source``, with ``line`` (from 1, continued lines joined), ``pattern``, ``severity``, ``code``."""
    joined = F.regexp_replace(F.col(source), r"\\\r?\n\s*", " ")
    lines = files.select(*[c for c in files.columns if c != source], F.posexplode(F.split(joined, "\n", -1)).alias("line", "code"))
    lines = lines.withColumns({"line": F.col("line") + 1, "code": trimmed(F.col("code"))}).filter(~F.col("code").startswith("#"))
    hits = []
    for pattern, severity, yes, no in PYTHON_RULES:
        matches = F.col("code").rlike(yes)
        hits.append(F.when(matches & ~F.col("code").rlike(no) if no else matches, _finding(pattern, severity)))
    found = lines.withColumn("finding", F.explode(F.array_compact(F.array(*hits))))
    return found.select(*[c for c in lines.columns if c != "code"], "finding.pattern", "finding.severity", F.substring("code", 1, 80).alias("code"))


def _through(code: Column, names: Column, methods: str, argument: str) -> Column:
    """Calls of ``methods`` on any of ``names``, found in one pass."""
    pattern = F.concat(F.lit(r"(?<![\w.$])(?:"), F.array_join(names, "|"), F.lit(rf")\s*\.\s*(?:promises\s*\.\s*)?{methods}\s*{_O}{argument}"))
    return F.when(F.size(names) > 0, F.regexp_count(code, pattern)).otherwise(0)


def js_hits(code: Column, bound: Column) -> list[tuple[str, str, Column]]:
    """``pattern, severity`` and the number of matches in scanned text ``code``, whose statements that bind modules are ``bound``."""
    count = lambda text, rx: F.regexp_count(text, F.lit(rx))
    has = lambda words: reduce(Column.__or__, [code.contains(w) for w in words.split("|")])
    out = [(p, s, F.when(has(words), count(code, rx)).otherwise(0)) for p, s, rx, words in JS_RULES]
    for pattern, severity, module, methods, argument in JS_BOUND:
        groups = [F.regexp_extract_all(bound, F.lit(_BOUND.format(m=module)), F.lit(group)) for group in (1, 2, 3, 4)]
        names = F.filter(F.array_distinct(F.concat(*groups)), lambda n: n != "")
        taken = F.when(bound.rlike(_TAKEN.format(f=methods, m=module)), count(code, rf"(?<![\w.$]){methods}\s*{_O}{argument}")).otherwise(0)
        called = _MODULE.format(module) + rf"\s*\.\s*(?:promises\s*\.\s*)?{methods}\s*{_O}"
        direct = F.when(bound.rlike(called), count(code, called + argument)).otherwise(0) if module != "child_process" else F.lit(0)
        out.append((pattern, severity, F.when(bound != "", _through(code, names, methods, argument) + taken + direct).otherwise(0)))
    computed = F.when(code.contains("["), count(code, rf"[\w$)\]]\s*\[\s*[A-Za-z_$][^\]]*\]\s*{_O}")).otherwise(0)
    out.append(("POSSIBLE_OBFUSCATION", "HIGH", F.when(computed >= 3, 1).otherwise(0)))
    pairs = [F.length(F.translate(code, a, "")) != F.length(F.translate(code, b, "")) for a, b in ("()", "{}", "[]")]
    out.append(("UNPARSEABLE_CODE", "HIGH", F.when(code.endswith(BROKEN) | pairs[0] | pairs[1] | pairs[2], 1).otherwise(0)))
    return out


def js_findings(files: DataFrame, source: str = "source") -> DataFrame:
    """The columns of ``files`` but ``source``, with ``pattern``, ``severity``, ``hits`` (matches of its rules).

    A file whose source is missing couldn't be analysed, which is a finding too.
    """
    scanned_files = small_batches(files).withColumn("__code", scanned(F.col(source)))
    scanned_files = scanned_files.withColumn("__bound", F.array_join(F.regexp_extract_all("__code", F.lit(_STATEMENT), F.lit(0)), "\n"))
    totals: dict = {}
    for pattern, severity, n in [*js_hits(F.col("__code"), F.col("__bound")), ("ANALYSIS_ERROR", "HIGH", F.when(F.col(source).isNull(), 1).otherwise(0))]:
        totals[pattern, severity] = totals[pattern, severity] + n if (pattern, severity) in totals else n
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(s).alias("severity"), n.cast("bigint").alias("hits")) for (p, s), n in totals.items()])
    found = scanned_files.withColumn("__f", F.explode(F.filter(rows, lambda r: r["hits"] > 0)))
    return found.select(*[c for c in files.columns if c != source], "__f.pattern", "__f.severity", "__f.hits")


def capabilities(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, one boolean per capability, ``max_severity``, ``finding_count``."""
    flags = [F.bool_or(F.col("pattern").isin(patterns)).alias(name) for name, patterns in CAPABILITIES]
    return findings.groupBy(*keys).agg(*flags, F.coalesce(named(F.max(order_of(F.col("severity")))), F.lit("LOW")).alias("max_severity"), F.count("*").alias("finding_count"))


def capability_names(patterns: Column) -> Column:
    """The sorted names of the capabilities that are dangerous or concern files and loading, of an array of patterns."""
    names = [F.when(F.arrays_overlap(patterns, F.array(*[F.lit(p) for p in shown])), F.lit(name)) for name, shown in CAPABILITIES[:9]]
    return F.array_sort(F.array_compact(F.array(*names)))


def profile(findings: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``capabilities``: capability_names() of all findings of the keys."""
    return findings.groupBy(*keys).agg(F.collect_set("pattern").alias("patterns")).select(*keys, capability_names(F.col("patterns")).alias("capabilities"))
