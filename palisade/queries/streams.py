"""A query over a stream: snapshots of users' last events, watched until the last one has been seen."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from palisade.operators import relational, store
from palisade.queries.tables import table
from palisade.schema import DAY_MS
from palisade.scratch import root
from palisade.streaming import watch

CUTS = ["2024-01-10", "2024-01-20", "2024-02-10", "2024-02-20"]


def watch_microbatch(spark, d):
    """The baseline after four snapshots of the users' last events before a day.

    The last one brings types of events that the lookup has no answer for, so the baseline stays at the one before.
    """
    folder = f"{root(spark)}/watch-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("version"), F.col("event_id").alias("ord"), "ts")
    for cut in CUTS:
        at = F.lit(cut).cast("timestamp_ntz")
        last = relational.last_wins(events.filter(F.col("ts") < at), ["name"], ["ts", "ord"])
        version = F.col("version") if cut != CUTS[-1] else F.concat(F.col("version"), F.lit("-next"))
        rows = last.select(F.lit("npm").alias("ecosystem"), "name", version.alias("version"), F.lit(None).cast("string").alias("integrity"), "ord")
        watch.write_snapshot(rows, folder, datetime.fromisoformat(cut))
    answered = lambda changed: changed.filter("version like '%-next'").isEmpty()
    writer = watch.watch(watch.read_snapshots(spark, folder), f"{folder}/base", f"{folder}/reports", answered)
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return watch.read_baseline(spark, f"{folder}/base")


WATCH = "SELECT 'npm' AS ecosystem, user_id::VARCHAR AS name, event_type AS version, NULL::VARCHAR AS integrity, event_id AS ord FROM events WHERE ts < TIMESTAMP '2024-02-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"

CACHE = "o_custkey bigint, o_orderkey bigint, o_totalprice double, fetched_at timestamp_ntz"


def cache_stored(spark, d):
    """A stored cache of each customer's last order, after two upserts (orders before 1996, the others) and a pruning of those older than 1000 days."""
    path = f"{root(spark)}/cache-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("o_orderdate").cast("timestamp_ntz").alias("fetched_at"))
    for part in (orders.filter("fetched_at < timestamp_ntz'1996-01-01'"), orders.filter("fetched_at >= timestamp_ntz'1996-01-01'")):
        store.upsert_stored(relational.last_wins(part, ["o_custkey"], ["fetched_at", "o_orderkey"]), path, CACHE, ["o_custkey"])
    store.prune_stored(spark, path, CACHE, ["o_custkey"], F.lit("1998-08-03").cast("timestamp_ntz"), 1000 * DAY_MS)
    return store.read_stored(spark, path, CACHE)


CACHE_STORED = """
WITH l AS (SELECT o_custkey, o_orderkey, o_totalprice::DOUBLE AS o_totalprice, o_orderdate::TIMESTAMP AS fetched_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT * FROM l WHERE date_diff('millisecond', fetched_at, TIMESTAMP '1998-08-03') <= 86400000::BIGINT * 1000
"""

QUERIES = {"watch_microbatch": (watch_microbatch, WATCH), "cache_stored": (cache_stored, CACHE_STORED)}
