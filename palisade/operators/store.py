"""Lookups cached as tables: freshness, upserts, pruning.

A stored cache is laid out by a hash of its keys, a folder a bucket. Reads open the buckets of the keys that are asked for, and an upsert rewrites the
buckets of the keys that it brings; all other files stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.registry import millis_between
from palisade.schema import CACHES
from palisade.scratch import written


def empty(spark: SparkSession, kind: str) -> DataFrame:
    """A cache of ``kind`` (CACHES) that knows nothing: every lookup misses, so all goes on without one."""
    return spark.createDataFrame([], CACHES[kind][0])


def stats(**caches: DataFrame) -> DataFrame:
    """One row: the number of entries of each of the given caches."""
    out = None
    for name, cached in caches.items():
        n = cached.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)  # one row each
    return out


def partition_by_cache(wanted: DataFrame, cached: DataFrame, keys: list[str], as_of: Column, ttl_ms: int | None, at: str = "fetched_at") -> DataFrame:
    """``wanted`` with the cached columns and ``hit``. An entry exactly as old as ``ttl_ms`` still counts; None: any age."""
    joined = wanted.join(cached, keys, "left")
    fresh = F.col(at).isNotNull() if ttl_ms is None else millis_between(as_of, F.col(at)) <= ttl_ms
    return joined.withColumn("hit", F.coalesce(fresh, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of ``new``, and those of ``old`` whose keys it lacks."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def prune(cached: DataFrame, as_of: Column, most_ms: int, at: str = "fetched_at") -> DataFrame:
    return cached.filter(millis_between(as_of, F.col(at)) <= most_ms)


def parsed(cached: DataFrame, schema: str, payload: str = "payload") -> DataFrame:
    """Entries whose payload is valid, with it as ``value``; corrupt ones count as missing."""
    return cached.withColumn("value", F.from_json(payload, schema)).filter("value is not null")


def cacheable(results: DataFrame) -> DataFrame:
    """Only what a complete lookup found may be kept: checked, with a known level, with details and without warnings."""
    return results.filter("covered and coalesce(risk_level, '') != 'UNKNOWN' and not coalesce(details_missing, false) and coalesce(size(warnings), 0) = 0")


#: Buckets of a stored cache, whose numbers are all that the driver ever sees of it.
BUCKETS = 256
BUCKET = "bucket"


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _touched(rows: DataFrame) -> list[int]:
    return sorted(r[BUCKET] for r in rows.select(BUCKET).distinct().collect())  # as many as there are buckets at most


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_stored(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The cache at ``path``, or those of its buckets; empty if nothing is stored there yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, {BUCKET} int").drop(BUCKET)
    rows = spark.read.schema(f"{schema}, {BUCKET} int").parquet(path)
    return (rows if buckets is None else rows.filter(F.col(BUCKET).isin(buckets))).drop(BUCKET)


def lookup_stored(wanted: DataFrame, path: str, schema: str, keys: list[str], as_of: Column, ttl_ms: int | None, at: str = "fetched_at", buckets: int = BUCKETS) -> DataFrame:
    """As partition_by_cache(), of a stored cache; only the buckets of ``wanted`` are read."""
    asked = _touched(_bucketed(wanted, keys, buckets))
    return partition_by_cache(wanted, read_stored(wanted.sparkSession, path, schema, asked), keys, as_of, ttl_ms, at)


def _replace(rows: DataFrame, path: str) -> None:
    """Write ``rows`` over the buckets that they are in."""
    tidy = rows.repartition(BUCKET).sortWithinPartitions(BUCKET)
    tidy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upsert_stored(new: DataFrame, path: str, schema: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Put the rows of ``new`` into the cache at ``path``, in place of those with equal ``keys``. Of rows of ``new`` with equal keys any one is kept.

    What the touched buckets become is written beside the cache first, so nothing is read while it is replaced.
    """
    spark = new.sparkSession
    columns = [f.name for f in spark.createDataFrame([], schema).schema]
    fresh = written(_bucketed(new.select(*columns).dropDuplicates(keys), keys, buckets), "cache-new")
    old = read_stored(spark, path, schema, _touched(fresh))
    merged = _bucketed(upsert(old, fresh.drop(BUCKET), keys), keys, buckets)
    _replace(written(merged, "cache-merged"), path)


def prune_stored(spark: SparkSession, path: str, schema: str, keys: list[str], as_of: Column, most_ms: int, at: str = "fetched_at", buckets: int = BUCKETS) -> None:
    """Drop entries that are older than ``most_ms``; buckets without such entries stay as they are. A bucket that has nothing left keeps no rows."""
    rows = _bucketed(read_stored(spark, path, schema), keys, buckets)
    age = millis_between(as_of, F.col(at))
    aged = _touched(rows.filter(age > most_ms))
    if not aged:
        return
    left = written(rows.filter(F.col(BUCKET).isin(aged) & (age <= most_ms)), "cache-left")
    _replace(left, path)
    for bucket in sorted(set(aged) - set(_touched(left))):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={bucket}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
