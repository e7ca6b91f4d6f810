"""Tables that a pipeline writes on its way, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a temporary folder, but only if all of Spark runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or tempfile.mkdtemp(prefix="palisade-")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that was written once: what reads it several times doesn't compute it again, and a lost executor costs no more than a read."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows that a Python worker gets at once, in the mean.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session cuts Arrow batches by BATCH_BYTES too, as 10,000 rows of texts can be of any size."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH) != f"{BATCH_BYTES}b":
        conf.set(_BATCH, f"{BATCH_BYTES}b")
    return df
