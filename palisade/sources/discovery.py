"""Which files to read: fixed names per ecosystem, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.relational import prefer, present
from palisade.schema import ECOSYSTEMS


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, dir, file, content`` of the text files of a folder or a glob of folders."""
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return raw.select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.col("value").alias("content"))


def _matches(name: str) -> Column:
    return F.col("file").rlike(r"^[^/]+\.csproj$") if name == "*.csproj" else F.col("file") == name


def dependency_files(files: DataFrame) -> DataFrame:
    """Files that hold dependencies, with ``ecosystem`` and ``kind`` (lock or manifest)."""
    found = F
    for ecosystem, _, locks, manifests in ECOSYSTEMS:
        for kind, names in (("lock", locks), ("manifest", manifests)):
            for name in names:
                found = found.when(_matches(name), F.struct(F.lit(ecosystem).alias("ecosystem"), F.lit(kind).alias("kind")))
    return present(files.withColumn("found", found), "found").select(*files.columns, "found.ecosystem", "found.kind")


def preferred_files(files: DataFrame) -> DataFrame:
    """Of each folder and ecosystem the lockfiles, or its manifests if it has none; ``fallback`` marks these."""
    return prefer(dependency_files(files), ["dir", "ecosystem"], F.col("kind") == "lock")
