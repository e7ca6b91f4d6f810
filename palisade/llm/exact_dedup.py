"""Exact dedup by deterministic block naming.

Each normalised text is cut into blocks of a fixed number of bytes. Distinct blocks are sorted, and the place in that order is
a block's integer name. Then adjacent names are paired, the distinct pairs are sorted and named in turn, and so on until
each document has one name. Two documents have the same name of the same level exactly if all their blocks are
equal, so names never collide.

Only two steps move texts: the distinct blocks, and their sort. Names go back to the documents by a 128-bit fingerprint,
after a count has proved that no two distinct blocks share one; if two did, the texts themselves would be the join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import discard, materialize, packed, squeezed, table

BLOCK_BYTES = 4096


def _sorted_names(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct rows of ``keys``, each with an integer ``name`` in sort order. Materialise it before use."""
    distinct = df.select(*keys).distinct()
    return distinct.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _sorted_block_names(blocks: DataFrame) -> DataFrame:
    """As _sorted_names() for ``block``, with its fingerprint; the order is by first bytes, fingerprint, block.

    The ranges are drawn by the short parts of that key, so the samples that Spark sends to the driver hold no whole blocks.
    """
    distinct = _fingerprint(blocks.select("block").distinct(), "block").withColumn("head", F.substring("block", 1, 8))
    ranged = distinct.repartitionByRange("head", "fp_a").sortWithinPartitions("head", "fp_a", "block")
    return ranged.withColumn("name", F.monotonically_increasing_id())


def _fingerprint(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"fp_a": F.xxhash64(column), "fp_b": F.xxhash64(F.lit(7), column)})


def block_names(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per (document, block): key columns, ``n`` blocks, ``pos``, ``name``, ``m`` repeated rows."""
    text = docs.select(F.col(id_col).alias("id"), squeezed(F.col(text_col)).alias("t"))
    text = text.select("id", F.col("t").cast("binary").alias("t"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("t") / block_bytes).cast("int") - 1))
    parts = text.withColumn("parts", F.transform(starts, lambda k: F.substring("t", k * block_bytes + 1, F.lit(block_bytes))))
    # There always is a block; outer spares a filter on that, which would normalise each text once more.
    blocks = parts.select(F.explode_outer("parts").alias("block"))
    names = materialize(_sorted_block_names(blocks).select("fp_a", "fp_b", "name"), "block-names")
    seen = names.agg(F.count("*").alias("n"), F.count_distinct("fp_a", "fp_b").alias("d")).first()
    placed = parts.select("id", F.sha2("t", 256).alias("sha"), F.size("parts").alias("n"), F.posexplode_outer("parts").alias("pos", "block"))
    if seen["n"] == seen["d"]:
        named = _fingerprint(placed, "block").drop("block").join(names, ["fp_a", "fp_b"])
    else:
        discard(names)
        names = materialize(_sorted_block_names(blocks).select("block", "name"), "block-names")
        named = placed.join(names, ["block"])
    out = materialize(named.groupBy("id", "sha", "n", "pos", "name").agg(F.count("*").alias("m")), "block-places")
    discard(names)
    return out


def document_names(places: DataFrame) -> DataFrame:
    """Pair adjacent names until each document has one: key columns, ``level``, ``name``, ``m``."""
    level, done, rest = 0, [], places
    while True:
        done.append(rest.filter("n = 1").select("id", "sha", F.lit(level).alias("level"), "name", "m"))
        longer = rest.filter("n > 1")
        if longer.limit(1).count() == 0:
            break
        pairs = longer.groupBy("id", "sha", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("left"),
            F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("right"),
            F.max("m").alias("m"),
        )
        pairs = materialize(pairs, "pairs")
        names = materialize(_sorted_names(pairs, "left", "right"), "pair-names")
        rest = materialize(
            pairs.join(names, ["left", "right"]).select("id", "sha", F.expr("cast((n + 1) div 2 as int)").alias("n"), "pos", "name", "m"), "places"
        )
        discard(pairs, names)
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of documents whose texts are equal once each run of blanks is one space.

    Returns one row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. In a group the row with
    the smallest id stays. Null text counts as empty, and empty texts form a group. A null id comes after all others. Of rows
    that repeat an id and a text, one stays. An empty table gives no rows. Other columns of ``docs`` aren't read,
    whatever their names.
    """
    idents = document_names(block_names(docs, id_col, text_col, block_bytes))
    groups = idents.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.sum("m").alias("group_size"))
    rows = idents.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return rows.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. See exact_groups()."""
    groups = materialize(exact_groups(docs, id_col, text_col, block_bytes), "exact-groups")
    same_id = F.col(id_col).eqNullSafe(F.col("keep_id"))
    gone = groups.filter(~same_id).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha")).distinct()
    repeated = groups.filter(same_id & ~F.col("kept")).limit(1).count() > 0
    keyed = packed(docs, key=F.col(id_col), text=F.sha2(squeezed(F.col(text_col)), 256))
    rest = keyed.join(gone, F.col("key").eqNullSafe(F.col("__id")) & (F.col("text") == F.col("__sha")), "left_anti")
    return (rest.dropDuplicates(["key", "text"]) if repeated else rest).select("row.*")


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
