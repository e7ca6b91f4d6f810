"""Helpers shared by the corpus operators: inputs, scratch tables, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of blanks (space and 09 to 0D, as the contracts of the text operators define them) that aren't one space already.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where the session names none (local tests) a folder of this machine is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


#: Has Spark remove a query's shuffle files when it ends, instead of when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a task of a narrow table writes, at the most, where the number of rows is known.
TASK_ROWS = 250_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts the lineage: a lost executor re-reads these files instead of recomputing, and values such as
    generated names can't change between two reads. The shuffle files behind ``df`` go once it is written. ``rows``, a bound on the
    number of rows of a narrow table, makes few files of few rows.
    """
    if rows is not None:
        df = df.coalesce(max(6, rows // TASK_ROWS + 1))
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Bytes of an Arrow batch that a Python worker gets at once, in the mean.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session cuts Arrow batches by BATCH_BYTES too, as rows of texts can be of any size."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) != f"{BATCH_BYTES}b":
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """The rows of ``docs`` as a struct ``row``, with ``keys`` beside it, so no name of an input column meets one of an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def squeezed(text: Column) -> Column:
    """Each run of blanks becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def held_out(doc_id: Column) -> Column:
    """Rows that learning never sees: crc32 of the id as text is divisible by 5. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
