"""Watching snapshots of dependencies as a stream.

A snapshot is a folder of files, written in parallel; once it is complete, one row about it is added to a small table, which is the
stream. A micro-batch takes the new snapshots by time, compares each with the baseline, looks up what is new, and moves the
baseline on only if that lookup was complete; else the change is looked at again with the next snapshot.

The baseline is a changelog by package: a step writes the packages that it changed, and now and then all of them, whereupon older files go. A
folder of dependency files can be watched too: a timer lists it, and files whose size or time changed are read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators import advisories, relational
from palisade.sources import discovery

BASE = "ecosystem string, name string, version string, integrity string, ord bigint"
MARK = "snapshot string, taken_at timestamp_ntz"
#: Snapshots that one micro-batch takes at most, so what it knows of them is bounded.
SNAPSHOTS = 100
#: The shortest time between two polls.
LEAST_POLL_SECONDS = 60


def write_snapshot(rows: DataFrame, folder: str, taken_at: datetime) -> None:
    """Write ``rows`` (BASE columns) as a snapshot below ``folder``, and announce it when it is there."""
    spark, path = rows.sparkSession, f"{folder}/snapshots/{uuid.uuid4().hex}"
    rows.select("ecosystem", "name", "version", "integrity", "ord").write.parquet(path)
    spark.createDataFrame([(path, taken_at)], MARK).coalesce(1).write.mode("append").parquet(f"{folder}/ready")


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of snapshots that are complete."""
    return spark.readStream.schema(MARK).option("maxFilesPerTrigger", SNAPSHOTS).parquet(f"{folder}/ready")


#: Changes of the baseline between two full copies of it.
STEPS = 16
CHANGE = f"{BASE}, gone boolean"


def _kept(spark: SparkSession, folder: str, before: int | None) -> list[tuple[int, int, str]]:
    """Number, time in microseconds and path of the finished parts of a baseline, in order, from the last full copy on."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(conf)
    out = []
    for kind in ("full", "delta"):
        root = path(f"{folder}/{kind}")
        for s in fs.listStatus(root) if fs.exists(root) else []:
            number, _, micros = s.getPath().getName().partition("-")
            if fs.exists(path(s.getPath(), "_SUCCESS")) and (before is None or int(number) < before):
                out.append((int(number), int(micros), f"{folder}/{kind}/{s.getPath().getName()}"))
    full = max((p for p in out if "/full/" in p[2][len(folder) :]), default=None)
    return ([full] if full else []) + sorted(p for p in out if "/delta/" in p[2][len(folder) :] and (full is None or p[0] > full[0]))


def _folded(spark: SparkSession, parts: list[tuple[int, int, str]]) -> DataFrame:
    """The packages that ``parts`` come down to: of each the last change."""
    out = spark.createDataFrame([], f"{CHANGE}, step long")
    for number, _, path in parts:  # STEPS and a few at most
        out = out.unionByName(spark.read.schema(CHANGE).parquet(path).withColumn("step", F.lit(number).cast("long")))
    return relational.last_wins(out, ["ecosystem", "name"], ["step"]).filter("not gone").drop("gone", "step")


def read_baseline(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The last row by ``ord`` of each package of the baseline, empty at first; with ``before``, as it was before the step of that number."""
    return _folded(spark, _kept(spark, folder, before))


def _write(rows: DataFrame, folder: str, kind: str, number: int, micros: int) -> None:
    rows.select("ecosystem", "name", "version", "integrity", "ord", "gone").write.mode("overwrite").parquet(f"{folder}/{kind}/{number:012d}-{micros}")


def set_baseline(rows: DataFrame, folder: str, taken_at: datetime, number: int = 0) -> None:
    """Make ``rows`` (BASE columns) the whole baseline."""
    last = relational.last_wins(rows.select("ecosystem", "name", "version", "integrity", "ord"), ["ecosystem", "name"], ["ord"])
    _write(last.withColumn("gone", F.lit(False)), folder, "full", number, _micros(taken_at))


def _micros(at: datetime) -> int:
    return round((at - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def move_baseline(before: DataFrame, now: DataFrame, folder: str, number: int, micros: int) -> None:
    """Write the packages in which ``now`` differs from ``before``, the baseline so far, as step ``number``.

    After STEPS steps it also writes a full copy, and deletes what an earlier full copy had replaced already. A step that is repeated overwrites its own
    files, and what it started from is still there.
    """
    spark = now.sparkSession
    columns = ["ecosystem", "name", "version", "integrity", "ord"]
    last = relational.last_wins(now.select(*columns), ["ecosystem", "name"], ["ord"])
    old = before.select("ecosystem", "name", F.struct(*columns[2:]).alias("was"))
    both = last.select("ecosystem", "name", F.struct(*columns[2:]).alias("is")).join(old, ["ecosystem", "name"], "full_outer").filter(~F.col("is").eqNullSafe(F.col("was")))
    changed = both.select("ecosystem", "name", "is.*", F.col("is").isNull().alias("gone"))
    _write(changed, folder, "delta", number, micros)
    parts = _kept(spark, folder, number + 1)
    if len(parts) > STEPS:
        _write(_folded(spark, parts).withColumn("gone", F.lit(False)), folder, "full", number, micros)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(folder).getFileSystem(conf)
        for kind in ("full", "delta"):
            for s in fs.listStatus(path(f"{folder}/{kind}")) if fs.exists(path(f"{folder}/{kind}")) else []:
                if int(s.getPath().getName().partition("-")[0]) < parts[0][0]:
                    fs.delete(s.getPath(), True)


def watch(stream: DataFrame, baseline: str, reports: str, complete: Callable[[DataFrame], bool]):
    """A writer for ``stream`` of read_snapshots(); start() it with a checkpointLocation and a trigger, stop() what that returns.

    ``complete`` tells whether the lookup of changed packages had an answer for all. Reports are Parquet folders by batch and snapshot;
    a batch that is repeated overwrites its own. A snapshot that is older than the baseline, because it came late, is left out.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for k, mark in enumerate(batch.orderBy("taken_at", "snapshot").collect()):  # SNAPSHOTS rows at most
            at, micros = number * SNAPSHOTS + k, _micros(mark["taken_at"])
            parts = _kept(spark, baseline, at)
            if any(p[1] > micros for p in parts):
                continue
            now = spark.read.schema(BASE).parquet(mark["snapshot"])
            before = _folded(spark, parts)
            diff = relational.diff_snapshots(before, now)
            diff.filter("status != 'unchanged'").write.mode("overwrite").parquet(f"{reports}/{at}")
            if complete(relational.changed_packages(diff)):
                move_baseline(before, now, baseline, at, micros)

    return stream.writeStream.foreachBatch(step)


LISTED = "path string, length long, modificationTime timestamp"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, modificationTime`` of the dependency files below ``folder``. Spark lists them; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    named = files.withColumn("file", F.regexp_extract("path", "([^/]*)$", 1))
    return discovery.dependency_files(named).select("path", "length", "modificationTime")


def changed_files(now: DataFrame, known: DataFrame) -> DataFrame:
    """``path, change`` of files that came, went, or have another length or time than ``known`` says."""
    old = known.select("path", F.struct("length", "modificationTime").alias("was"))
    both = now.select("path", F.struct("length", "modificationTime").alias("is")).join(old, "path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select("path", change.alias("change")).filter("change is not null")


def folder_step(spark: SparkSession, folder: str, state: str, number: int, take: Callable[[DataFrame], None]) -> int:
    """List ``folder``; if a dependency file changed since the last listing below ``state``, ``take`` gets ``path, change``. How many files changed.

    The new listing counts only once ``take`` has returned, so changes that it failed on come again. A step that is repeated compares
    with the listing before its own.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(state).getFileSystem(conf)
    done = sorted(int(s.getPath().getName()) for s in fs.listStatus(path(state)) if s.getPath().getName().isdigit() and fs.exists(path(s.getPath(), "_SUCCESS"))) if fs.exists(path(state)) else []
    before = max((n for n in done if n < number), default=None)
    known = spark.read.schema(LISTED).parquet(f"{state}/{before}") if before is not None else spark.createDataFrame([], LISTED)
    pending = f"{state}/{number}"
    listed(spark, folder).write.mode("overwrite").parquet(f"{pending}.new")
    seen = spark.read.schema(LISTED).parquet(f"{pending}.new")  # what was listed, whatever happens to the files meanwhile
    changes = changed_files(seen, known)
    n = changes.count()
    if n:
        take(changes)
        seen.write.mode("overwrite").parquet(pending)
        for old in [d for d in done if before is not None and d < before]:
            fs.delete(path(f"{state}/{old}"), True)
    fs.delete(path(f"{pending}.new"), True)
    return n


def watch_folder(spark: SparkSession, folder: str, state: str, take: Callable[[DataFrame], None], seconds: int = 10):
    """A writer that looks at ``folder`` every ``seconds`` and hands changed files to ``take``; start() it, and stop() what that returns."""

    def step(_: DataFrame, number: int) -> None:
        folder_step(spark, folder, state, number, take)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).trigger(processingTime=f"{seconds} seconds")


def poll(deps: DataFrame, index: DataFrame, details: DataFrame, least: str, top: int = 10) -> DataFrame:
    """The worst findings on the baseline, for a timer: ``top`` rows and how many there are in all."""
    from palisade.functions.severity import order_of

    hits, _ = advisories.lookup(deps, index)
    rows = advisories.filter_by_severity(advisories.vulnerabilities(hits, details), least)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.coalesce(order_of(F.col("severity")), F.lit(99)).desc(), "package", "id").limit(top).crossJoin(F.broadcast(total))  # one row


def poll_timer(spark: SparkSession, baseline: str, advisory: Callable[[], tuple[DataFrame, DataFrame]], results: str, least: str, seconds: int = 3600):
    """A writer that polls the baseline every ``seconds``, LEAST_POLL_SECONDS at least; start() it, and stop() what that returns.

    ``advisory`` gives the index and the details of that moment. Each poll's findings are a Parquet folder below ``results``.
    """

    def step(_: DataFrame, number: int) -> None:
        poll(read_baseline(spark, baseline), *advisory(), least).write.mode("overwrite").parquet(f"{results}/{number}")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).trigger(processingTime=f"{max(seconds, LEAST_POLL_SECONDS)} seconds")
