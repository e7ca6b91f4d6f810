"""Reports: JSON documents, sections by severity, annotation lines, SARIF.

A JSON report is rows of text: one head, then one row per result, written in parallel. write_document() and write_sarif() make one document of any size:
its parts are text files in order, written by as many tasks, and merge() puts them into one file. document() and sarif() give small documents as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.severity import order_of
from palisade.functions.text import sanitize
from palisade.operators.advisories import count_by_severity
from palisade.scratch import written

#: Results that one JSON document holds.
MOST_RESULTS = 10_000


def _report(command: str, head: DataFrame, results: DataFrame, field: str) -> DataFrame:
    """``part`` (head, or the field that the result belongs to) and ``value`` (JSON). ``head`` is one row."""
    first = head.select(F.lit("head").alias("part"), F.to_json(F.struct(F.lit(command).alias("command"), *head.columns)).alias("value"))
    return first.unionByName(results.select(F.lit(field).alias("part"), F.to_json(F.struct(*results.columns)).alias("value")))


def document(report: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """One row with the whole report as one JSON document. A report of over ``most`` results is an error: keep it as rows."""
    n = report.filter("part != 'head'").limit(most + 1).count()
    if n > most:
        raise ValueError(f"more than {most} results for one document")
    parts = report.agg(F.max(F.when(F.col("part") == "head", F.col("value"))).alias("head"), F.max(F.when(F.col("part") != "head", F.col("part"))).alias("field"), F.array_sort(F.collect_list(F.when(F.col("part") != "head", F.col("value")))).alias("items"))
    body = F.concat(F.lit(', "'), F.coalesce("field", F.lit("results")), F.lit('": ['), F.array_join("items", ","), F.lit("]}"))
    return parts.select(F.concat(F.expr("substring(head, 1, length(head) - 1)"), body).alias("value"))


#: Rows of a document in one of its files.
PART_ROWS = 100_000


def _write(spark: SparkSession, segments: list[str | DataFrame], folder: str) -> None:
    """Write a JSON text whose ``segments`` are literal texts and tables of list elements (``value``), as text files in order.

    Elements are sorted and numbered over all tasks; all but a list's first one have a comma before them.
    """
    rows, count = None, 0
    for k, segment in enumerate(segments):
        if isinstance(segment, str):
            one = spark.range(1).select(F.lit(k).alias("segment"), F.lit(0).cast("long").alias("at"), F.lit(segment).alias("text"))
        else:
            n = segment.count()
            count += n
            order = F.xxhash64("value")
            placed = segment.select("value", order.alias("h")).repartitionByRange(max(1, n // PART_ROWS + 1), "h").sortWithinPartitions("h", "value").select("value", F.monotonically_increasing_id().alias("at"))
            placed = written(placed, "document-list")
            first = placed.agg(F.min("at")).first()[0]
            one = placed.select(F.lit(k).alias("segment"), "at", F.concat(F.when(F.col("at") != F.lit(first), ",").otherwise(""), "value").alias("text"))
        rows = one if rows is None else rows.unionByName(one)
    rows.repartitionByRange(count // PART_ROWS + 1, "segment", "at").sortWithinPartitions("segment", "at").select("text").write.text(folder)


def merge(spark: SparkSession, folder: str, file: str) -> None:
    """Put the parts in ``folder`` into one ``file``, one after the other through a buffer."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    source, target = path(folder), path(file)
    fs = source.getFileSystem(conf)
    parts = sorted((s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    out = target.getFileSystem(conf).create(target, True)
    try:
        for part in parts:
            stream = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
    finally:
        out.close()


def write_document(report: DataFrame, folder: str) -> None:
    """Write a report of any number of results as one JSON document in text files in order. A report has one head; without results its list is empty."""
    report = report.select("part", "value")
    heads = report.filter("part = 'head'").select("value").collect()  # one row
    field = report.filter("part != 'head'").select("part").limit(1).collect()
    head = heads[0]["value"][:-1] + f', "{field[0]["part"] if field else "results"}": ['
    _write(report.sparkSession, [head, report.filter("part != 'head'").select("value"), "]}"], folder)


def scan_report(vulns: DataFrame, verdict: DataFrame) -> DataFrame:
    """Of a scan: verdict, counts by severity, all findings."""
    head = verdict.crossJoin(count_by_severity(vulns).select(F.struct("*").alias("summary")))  # one row each
    return _report("scan", head, vulns, "vulnerabilities")


def analyze_report(rows: DataFrame, verdict: DataFrame) -> DataFrame:
    """Of an analysis: how many packages there are, how many are flagged, and these with their signals."""
    n = rows.agg(F.count("*").alias("flagged"), F.count_if(F.col("risk_level") == "CRITICAL").alias("critical"), F.count_if(F.col("risk_level") == "HIGH").alias("high"))
    head = verdict.crossJoin(n)  # one row each
    return _report("analyze", head.select("complete", F.struct(F.col("expected").alias("total"), "flagged", "critical", "high").alias("summary")), rows, "results")


def fix_report(fixes: DataFrame, complete: Column) -> DataFrame:
    """Of fixes: each package's recommendation, or why it has none."""
    head = fixes.agg(F.count("*").alias("packages"), F.count("fix").alias("fixable")).withColumn("complete", complete)
    return _report("fix", head, fixes, "fixes")


def guard_report(decision: DataFrame, results: DataFrame) -> DataFrame:
    """Of pipelines.guard(): what an installation changes, whether it is blocked, and the packages' results."""
    blocked = (F.col("critical") > 0) | F.col("has_vulns") | ~F.col("complete")
    head = decision.select(F.struct("added", "changed", "removed").alias("diff"), blocked.alias("blocked"), (~F.col("complete")).alias("incomplete"), "decision")
    return _report("guard", head, results, "results")


def ci_report(vulns: DataFrame, verdict: DataFrame) -> DataFrame:
    """Of a build server's check: how many packages were looked up, failed or are vulnerable, and the findings."""
    head = verdict.select("complete", F.struct(F.col("expected").alias("total"), F.col("findings").alias("vulnerable"), F.col("checked").alias("scanned"), (F.col("expected") - F.col("checked")).alias("failed")).alias("summary"))
    return _report("monitor", head.withColumn("mode", F.lit("ci")), vulns, "vulnerabilities")


def sections(vulns: DataFrame) -> DataFrame:
    """Findings as sections of a listing, the worst severity first: ``severity``, ``line``. Severities without a section are left out."""
    line = F.concat("package", F.lit("@"), "version", F.lit("  "), sanitize(F.concat_ws(" ", "display_id", "summary")), F.coalesce(F.concat(F.lit("  fix: "), "fixed"), F.lit("")))
    return vulns.filter(order_of(F.col("severity")) >= 1).orderBy(order_of(F.col("severity")).desc(), "package", "version", "display_id").select("severity", line.alias("line"))


def _escaped(text: Column, of: str) -> Column:
    for c in of:
        text = F.replace(text, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return text


def annotations(vulns: DataFrame) -> DataFrame:
    """``value``: a line per finding, ::error for HIGH and worse, else ::warning."""
    kind = F.when(order_of(F.col("severity")) >= 3, "error").otherwise("warning")
    title = _escaped(F.concat("severity", F.lit(": "), "package", F.lit("@"), "version"), "%\r\n:,")
    text = _escaped(F.concat_ws(" ", sanitize(F.concat("display_id", F.lit(" "), "summary")), F.concat(F.lit("(fix: "), "fixed", F.lit(")"))), "%\r\n")
    return vulns.select(F.concat(F.lit("::"), kind, F.lit(" title="), title, F.lit("::"), text).alias("value"))


def notice(verdict: DataFrame, least: str) -> DataFrame:
    """``value``: the last line for a build server, which tells how much was looked up and found."""
    return verdict.select(F.concat(F.lit("::notice::Scanned "), F.col("expected").cast("string"), F.lit(" packages, found "), F.col("findings").cast("string"), F.lit(f" vulnerabilities at {least}+ severity")).alias("value"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "LOW", "note").otherwise("warning")


def sarif_rules(vulns: DataFrame) -> DataFrame:
    """One row per rule id, of the first finding by package and version: ``id``, ``level``, ``text``."""
    first = F.min_by(F.struct("severity", "summary"), F.struct("package", "version")).alias("f")
    return vulns.groupBy(F.col("display_id").alias("id")).agg(first).select("id", sarif_level(F.col("f.severity")).alias("level"), F.col("f.summary").alias("text"))


#: Where a finding of an ecosystem is shown, if its file isn't known.
LOCATIONS = {"pypi": "requirements.txt", "PyPI": "requirements.txt", "cargo": "Cargo.lock", "crates.io": "Cargo.lock"}
#: References that a finding shows.
REFERENCES = 5


SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def _sarif_rows(vulns: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``vulns`` with all columns that count, and a SARIF rule of sarif_rules() and a result of ``vulns`` as structs."""
    kept = vulns.withColumns({c: F.lit(None).cast(k) for c, k in (("ecosystem", "string"), ("references", "array<string>")) if c not in vulns.columns})
    rule = F.struct(F.col("id"), F.struct(F.col("text")).alias("shortDescription"), F.struct(F.col("level")).alias("defaultConfiguration")).alias("rule")
    message = F.struct(F.concat("package", F.lit("@"), "version", F.lit(": "), "summary").alias("text"))
    place = F.lit("package-lock.json")
    for name, file in LOCATIONS.items():
        place = F.when(F.col("ecosystem") == name, file).otherwise(place)
    where = F.array(F.struct(F.struct(F.struct(F.coalesce("source_file", place).alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    related = F.transform(F.slice(F.coalesce("references", F.array().cast("array<string>")), 1, REFERENCES), lambda u, i: F.struct(i.alias("id"), F.struct(u.alias("text")).alias("message")))
    result = F.struct(F.col("display_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), message.alias("message"), where.alias("locations"), F.when(F.size(related) > 0, related).alias("relatedLocations")).alias("result")
    return kept, rule, result


def write_sarif(vulns: DataFrame, complete: bool, folder: str, tool: str = "palisade") -> None:
    """Write any number of findings as one SARIF 2.1.0 document in text files in order."""
    kept, rule, result = _sarif_rows(vulns)
    rules = sarif_rules(vulns).select(F.to_json(rule).alias("value"))
    head = f'{{"version":"2.1.0","$schema":"{SCHEMA}","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":['
    tail = f']}}}},"invocations":[{{"executionSuccessful":{str(complete).lower()}}}],"results":['
    _write(vulns.sparkSession, [head, rules, tail, kept.select(F.to_json(result).alias("value")), "]}]}"], folder)


def sarif(vulns: DataFrame, complete: Column, tool: str = "palisade", most: int = MOST_RESULTS) -> DataFrame:
    """SARIF 2.1.0 documents of about ``most`` results each, each with the rules of its own results: ``part``, ``value``.

    ``vulns`` may have ``ecosystem``, which places findings without a ``source_file``, and ``references``, of which the first
    ones are shown.
    """
    n = vulns.count()
    parts = max(1, -(-n // most))
    kept, rule, result = _sarif_rows(vulns)
    part = F.pmod(F.xxhash64("package", "version", "display_id"), F.lit(parts)).alias("part")
    each = kept.select(part, result, F.col("display_id").alias("id")).join(sarif_rules(vulns).select("id", rule), "id")
    whole = each.groupBy("part").agg(F.array_sort(F.collect_set("rule")).alias("rules"), F.array_sort(F.collect_list("result")).alias("results"))
    if not n:
        none = each.select("rule", "result").schema
        whole = vulns.sparkSession.range(1).select(F.lit(0).cast("long").alias("part"), F.array().cast(f"array<{none['rule'].dataType.simpleString()}>").alias("rules"), F.array().cast(f"array<{none['result'].dataType.simpleString()}>").alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"), F.array(F.struct(complete.alias("executionSuccessful"))).alias("invocations"))
    return whole.select("part", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit(SCHEMA).alias("$schema"), F.array(run).alias("runs"))).alias("value"))
