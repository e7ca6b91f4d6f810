"""Tables of a folder, and how they stand for packages in the registered queries.

Packages are users of events or customers of orders, their versions the rows by time; severities are order priorities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The severity that an order priority stands for; the other priorities are unknown severities.
PRIORITIES = {"1-URGENT": "CRITICAL", "2-HIGH": "HIGH", "3-MEDIUM": "MODERATE", "5-LOW": "LOW"}
SEVERITY_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITIES.items()) + " ELSE 'UNKNOWN' END"
ORDER_SQL = "CASE {} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'LOW' THEN 1 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table in one task that makes a folder of files of each of them.
TASK_ROWS = 4_000


def dealt(df: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``df`` over as many tasks as its number of rows asks for, as few bytes of a table can stand for many files: one read task would make them all."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.count() // rows + 1))


def severity() -> Column:
    return F.expr(SEVERITY_SQL)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("severity", severity())


def events_with_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``as_of``, the time of the last of them, which is one row."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("as_of"))))
