"""Mixing sources to target weights by Poisson replication.

Each source has a target mean number of copies a document. A document's number of copies is the inverse of that Poisson
distribution at a uniform value hashed from its id and a seed, so it is the same in every run and needs no shuffle. The
copies are then dealt out and sorted by a hashed key, which is a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import packed, table

#: Sources up to which the table of rates is broadcast (at most about 1 KB a source); beyond, it is joined.
BROADCAST_SOURCES = 10_000
#: A mean above this is a sum of several independent draws, so that no table of probabilities has over 130 entries.
MOST_MEAN = 32.0
EXPONENT = 0.5
SEED = 17


def _uniform(*parts: Column) -> Column:
    """A value in [0, 1) with 52 random bits from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _cumulative(mean: Column) -> Column:
    """Poisson probabilities of at most 0, 1, 2, ... up to where doubles can't tell them from 1."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    zero = F.exp(-mean)
    start = F.struct(zero.alias("p"), F.array(zero).alias("c"))

    def step(acc, k):
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step)["c"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, source_col: str = "source", exponent: float = EXPONENT) -> DataFrame:
    """One row per source: ``__source``, ``rate`` (mean copies a document), ``draws``, ``cdf``.

    ``weights`` gives the share of each source in the mix; a source without a weight gets none. Without ``weights`` a source of n
    documents weighs n ** exponent. ``total`` is the expected number of rows; without it, as many as ``docs`` has. The
    number of sources, not of documents, bounds the one window here.
    """
    counts = docs.groupBy(F.col(source_col).alias("__source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    else:
        share = F.lit(0.0)
        for source, weight in sorted(weights.items()):
            share = F.when(F.col("__source").eqNullSafe(F.lit(source)), F.lit(float(weight))).otherwise(share)
    counts = counts.withColumn("share", share)
    sums = counts.agg(F.sum("share").alias("all_share"), F.sum("n").cast("double").alias("all_n")).withColumn("all_share", F.nullif("all_share", F.lit(0.0)))
    rates = counts.crossJoin(F.broadcast(sums))  # one row
    want = F.lit(float(total)) if total is not None else F.col("all_n")
    rates = rates.withColumn("rate", F.coalesce(want * F.col("share") / F.col("all_share") / F.col("n"), F.lit(0.0)))
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_MEAN).cast("int")))
    return rates.select("__source", "rate", "draws", _cumulative(F.col("rate") / F.col("draws")).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", source_col: str = "source", exponent: float = EXPONENT, seed: int = SEED) -> DataFrame:
    """Copies of the rows of ``docs`` in the target mix, in random order.

    Returns the columns of ``docs`` and ``mix_rate``, ``mix_copy`` (from 1) and ``mix_key``, the place in the shuffle. An input column of
    one of these names is replaced. A null source is a source of its own, a null id draws as the text 'null', and rows that
    repeat an id get the same number of copies. Other columns can have any names. Texts are not read, so they may be null, empty or very long. An empty table
    gives no rows. All weights 0: no rows.
    """
    rest = docs.drop("mix_rate", "mix_copy", "mix_key")
    rates = source_rates(docs, weights, total, source_col, exponent)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    keyed = packed(rest, key=F.col(source_col), ident=F.col(id_col))
    joined = keyed.join(F.broadcast(rates) if few else rates, F.col("key").eqNullSafe(F.col("__source")))
    ident = F.col("ident")

    def draw(j):
        u = _uniform(F.lit(seed), ident, j)
        return F.size(F.filter("cdf", lambda c: c <= u))

    one = F.when(F.col("draws") == 1, draw(F.lit(1)))
    many = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda a, j: a + draw(j))
    counted = joined.withColumn("n", F.coalesce(one, many)).filter("n > 0")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    copies = copies.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}:place"), F.coalesce(ident.cast("string"), F.lit("null")), "mix_copy")))
    out = copies.select("row.*", F.col("rate").alias("mix_rate"), "mix_copy", "mix_key")
    return out.repartition("mix_key").sortWithinPartitions("mix_key")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM c) * pow(n, {EXPONENT}) / (SELECT sum(pow(n, {EXPONENT})) FROM c) / n AS rate FROM c),
d AS (SELECT source, rate, greatest(1, ceil(rate / {MOST_MEAN}))::INT AS draws FROM r),
p AS (
  SELECT source, k, sum(exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cum
  FROM d, range(0, 200) t(k)
),
u AS (
  SELECT doc_id, source, j, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || j), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM documents JOIN d USING (source), range(1, 1000) t(j) WHERE j <= draws
),
n AS (SELECT u.doc_id, count(p.k) AS n FROM u JOIN p ON u.source = p.source AND p.cum <= u.u GROUP BY u.doc_id)
SELECT f.*, d.rate AS mix_rate, k.c::INT AS mix_copy, md5('{SEED}:place:' || f.doc_id || ':' || k.c) AS mix_key
FROM documents f JOIN n USING (doc_id) JOIN d ON d.source IS NOT DISTINCT FROM f.source, range(1, 100000) k(c) WHERE k.c <= n.n
"""
