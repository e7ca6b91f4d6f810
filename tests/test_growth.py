"""Steps whose cost must grow no faster than their input, told by their plans, and odd inputs of what replaced them."""

import os

import pytest

from palisade import queries as library
from tests.compare import DATA

tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@tables
def test_sarif_rules_are_told_once_a_document(spark):
    text = plan(library.queries()["sarif_document"](spark, DATA))
    assert text.index("forall") > text.index("Generate explode")  # below it


def test_failures_match_each_pattern_once(spark):
    from palisade.sources import parsers

    files = spark.createDataFrame([("/a/x.csproj", "<Project/>"), ("/b/x.csproj", "no"), ("plain.csproj", None)], "path string, content string")
    failed = parsers.parse_failures(files)
    assert "Filter" not in plan(failed)  # a filter would hold all patterns a second time
    assert {r["path"]: r["reason"] for r in failed.collect()} == {"/b/x.csproj": "unknown form of x.csproj", "plain.csproj": "unreadable plain.csproj"}


@tables
@pytest.mark.parametrize("name", ["parse_failures", "discovered_files"])
def test_files_of_small_tables_are_made_in_many_tasks(spark, name):
    assert "Repartition" in plan(library.queries()[name](spark, DATA))


def test_files_are_matched_with_names_once(spark):
    from palisade.sources import discovery

    files = spark.createDataFrame([("/a/Cargo.lock",), ("/a/b.csproj",), ("/a/.csproj",), ("/a/other",)], "path string").selectExpr("path", "'/a' as dir", "substring_index(path, '/', -1) as file", "'' as content")
    found = discovery.dependency_files(files)
    assert "Filter" not in plan(found)
    assert {(r["path"], r["ecosystem"], r["kind"]) for r in found.collect()} == {("/a/Cargo.lock", "cargo", "lock"), ("/a/b.csproj", "nuget", "manifest")}


def test_npm_manifests_are_deduplicated_in_their_rows(spark):
    import json

    from palisade.sources import parsers

    texts = [json.dumps({"dependencies": {"A": "^1.0.0", "b": "2.0.0"}, "devDependencies": {"a": "1.0.0", "b": "3.0.0", "none": None}}), "{}", "broken", None]
    found = parsers.npm_manifest(spark.createDataFrame([(f"/{k}/package.json", t) for k, t in enumerate(texts)], "path string, content string"))
    assert "Aggregate" not in plan(found)
    got = {(r["source_file"], r["name"], r["version"], r["is_dev"], r["is_range"], r["ord"]) for r in found.collect()}
    assert got == {("/0/package.json", "a", "1.0.0", False, True, 0), ("/0/package.json", "b", "2.0.0", False, False, 1), ("/0/package.json", "b", "3.0.0", True, False, 1_000_001)} and found.count() == 3


def test_trees_of_old_lockfiles_are_not_sorted(spark):
    from palisade.sources import parsers

    tree = '{"a\\"b": {"version": "1", "dev": true, "dependencies": {"c": {"version": "2", "requires": {"d": {"version": "9"}}}, "e": {}}}, "c": {"version": "2"}, "n": {"version": 3}, "v": "1"}'
    texts = ['{"dependencies": %s}' % tree, '{"dependencies": [1]}', '{"dependencies": {}, "packages": {}}', "{", None]
    found = parsers.npm_lock_v1(spark.createDataFrame([(f"/{k}", t) for k, t in enumerate(texts)], "path string, content string"))
    assert "Window" not in plan(found)
    assert sorted((r["source_file"], r["name"], r["version"], r["is_dev"], r["ord"]) for r in found.collect()) == [("/0", 'a"b', "1", True, 0), ("/0", "c", "2", False, 1)]


def test_parse_all_keeps_one_row_by_one_aggregate(spark, monkeypatch):
    from palisade.sources import parsers

    files = spark.createDataFrame([("/a/go.sum", "m v1 h1:x=\nm v1 h1:y=\n"), ("/b/go.sum", "m v1 h1:z=\n")], "path string, content string")
    found = parsers.parse_all(files, ["go.sum"])
    assert plan(found).count("Aggregate") == 1
    assert [(r["source_file"], r["integrity"]) for r in found.collect()] == [("/a/go.sum", "h1:x=")]


def test_sources_come_to_python_in_small_batches(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    from palisade.operators import code_rules

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    files = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("x = 1; "), 10_000).alias("source"))
    code_rules.js_findings(files)  # 28 MB of sources

    @F.pandas_udf("long")
    def rows(text: pd.Series) -> pd.Series:
        return pd.Series([len(text)] * len(text))

    assert files.select(rows("source").alias("n")).agg(F.max("n")).first()[0] < 200
