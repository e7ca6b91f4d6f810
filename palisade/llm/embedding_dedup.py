"""Near-duplicate embeddings by random-hyperplane hashing in several tables, exact cosines and connected components.

The sign bits of a vector against random hyperplanes name its bucket in each table. Vectors that share a bucket are compared in double
precision inside tasks, a block of rows against a block, so pairs are never rows: a block gives each vector's number of links
and a spanning forest of them. A pair that meets in several tables counts in the first, and a bucket that holds the same vectors
as one of an earlier table is left out. Buckets over CHUNK vectors are split into chunks, and each pair of chunks is a block of its
own. Equal vectors of a label are one node with a weight.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialize, small_batches, table
from palisade.llm.components import connected_components

THRESHOLD = 0.98
#: The chance that a pair just at the threshold shares no bucket; closer pairs are surer.
MISS = 1e-5
#: Vectors a bucket should hold in the mean, if they were spread evenly; most are alone in theirs then, and travel no further.
BUCKET = 1
CHUNK = 1024
SEED = 11


def tables_for(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Bits a table and tables for ``n`` vectors."""
    bits = min(24, max(8, math.ceil(math.log2(max(n, 1) / BUCKET)))) if n else 8
    one = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - one))


def _hashed(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Rows of ``vectors(row, vec_id, label, embedding)`` that can link, with ``dim``, ``vec`` (bytes of its components, of their own kind) and ``codes``."""
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def compute(batches):
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            rows, dims, vecs, codes = [], [], [], []
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets)
            narrow = lists.type.value_type == pa.float32()
            values = np.asarray(lists.values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False), np.float64)
            sizes = np.diff(offsets) * np.asarray(lists.is_valid())
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                x = values[offsets[at][:, None] + np.arange(dim)]
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                at, x = at[fine], x[fine]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))
                scaled = x / np.abs(x).max(axis=1, keepdims=True)
                signs = (scaled @ planes[dim] > 0).reshape(len(at), tables, bits)
                code = (signs * powers).sum(axis=2).astype(np.int32)
                rows += at.tolist()
                dims += [dim] * len(at)
                vecs += [v.tobytes() for v in (x.astype(np.float32) if narrow else x)]
                codes += [c.tobytes() for c in code]
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(codes, pa.binary())], ["row", "vec_id", "label", "dim", "vec", "codes"])

    fit = vectors.filter("label is not null and embedding is not null")
    return small_batches(fit).mapInArrow(compute, f"row long, vec_id {kinds['vec_id']}, label {kinds['label']}, dim int, vec binary, codes binary")


def _blocks(threshold: float):
    """Partitions of rows sorted by block -> per block and vector: links not counted in an earlier table, and a root to join."""

    def block(rows: pa.Table):
        number = rows["table"][0].as_py()
        own = rows["own"].to_numpy()
        ids, weights = rows["node"].to_numpy(), rows["weight"].to_numpy()
        vectors = rows["vec"].to_pylist()
        narrow = len(vectors[0]) == 4 * rows["dim"][0].as_py()
        x = np.frombuffer(b"".join(vectors), np.float32 if narrow else np.float64).reshape(len(ids), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.int32).reshape(len(ids), -1)[:, :number]
        first, second = rows["low"][0].as_py(), rows["high"][0].as_py()
        if first == second:
            a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
            a, b = np.nonzero(x[left] @ x[right].T >= threshold) if len(left) and len(right) else (left[:0], right[:0])
            a, b = left[a], right[b]
        if not len(a):
            return None
        new = np.ones(len(a), bool)
        for lo in range(0, len(a), 1 << 16):
            here = slice(lo, lo + (1 << 16))
            new[here] = ~(codes[a[here]] == codes[b[here]]).any(axis=1)
        links = np.bincount(a[new], weights[b[new]], len(ids)) + np.bincount(b[new], weights[a[new]], len(ids))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        root = np.arange(len(ids))
        pa_, pb = place[a], place[b]
        while True:
            after = root.copy()
            np.minimum.at(after, pa_, root[pb])
            np.minimum.at(after, pb, root[pa_])
            after = after[after]
            if (after == root).all():
                break
            root = after
        ranked = ids[order]
        some = np.flatnonzero((root[place] != place) | (links > 0))
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ranked[root[place[some]]])], ["node", "links", "root"])

    def compute(batches):
        keys = ["label", "dim", "table", "code", "low", "high"]
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([carried, rows]).combine_chunks() if carried is not None else rows
            change = np.zeros(len(rows) - 1, bool)
            for k in keys:
                column = rows[k].to_numpy(zero_copy_only=False)
                change |= column[1:] != column[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo > 1 and (out := block(rows.slice(lo, hi - lo))) is not None:
                    yield out
            carried = rows.slice(edges[-1])
        if carried is not None and len(carried) > 1 and (out := block(carried)) is not None:
            yield out

    return compute


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = SEED) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links``, ``component_id``, ``kept``.

    Vectors link if their labels are equal and not null, their lengths are equal, and their cosine is ``threshold`` or more. A vector
    that is null, empty or zero, or has a null or non-finite component, links with nothing and stays. ``component_id`` is the smallest
    id reachable by links; ids of null come after all others. Repeated rows are linked copies, and all rows of the smallest id
    are kept. An empty table gives no rows. Other columns aren't read, whatever their names.
    """
    chosen = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    numbered = materialize(chosen.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding"), "vectors")
    bits, tables = tables_for(numbered.count(), threshold)
    hashed = _hashed(numbered, bits, tables, seed).withColumn("same", F.sha2("vec", 256))
    hashed = materialize(hashed, "hashed")
    nodes = hashed.groupBy("label", "same").agg(F.min("row").alias("node"), F.count("*").alias("weight"), F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.first("codes").alias("codes"))
    nodes = materialize(nodes, "nodes")
    code = F.conv(F.concat(*[F.hex(F.substring("codes", F.col("table") * 4 + k, F.lit(1))) for k in (4, 3, 2, 1)]), 16, 10).cast("long")
    spread = nodes.select("node", "label", "dim", "codes").withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).select("node", "label", "dim", "table", code.alias("code"))
    members = spread.withColumns({f"h{k}": F.xxhash64("node", F.lit(k)) for k in (1, 2)})
    sizes = members.groupBy("label", "dim", "table", "code").agg(F.count("*").alias("held"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")).filter("held > 1")
    # Buckets of several tables that hold the same vectors are compared in the first of these tables.
    sizes = sizes.groupBy("label", "dim", "held", "x1", "x2").agg(F.min(F.struct("table", "code")).alias("b")).select("label", "dim", "b.table", "b.code", "held")
    met = spread.join(sizes, ["label", "dim", "table", "code"]).withColumn("chunks", F.ceil(F.col("held") / CHUNK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("label", "dim", "table", "code", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node")
    met = met.join(nodes.select("node", "weight", "vec", "codes"), "node")
    keys = ["label", "dim", "table", "code", "low", "high"]
    found = met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_blocks(threshold), "node long, links long, root long")
    found = materialize(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    judged = nodes.select("label", "same", "node", "weight").join(counts, "node", "left").join(groups, "node", "left")
    judged = judged.withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("weight") - 1, "component": F.coalesce("component", "node")})
    member = materialize(hashed.select("row", "vec_id", "label", "same").join(judged, ["label", "same"]).select("row", "vec_id", "links", "component"), "members")
    names = member.groupBy("component").agg(F.min("vec_id").alias("least"))
    linked = member.join(names, "component").select("row", "links", "least", F.lit(True).alias("fit"))
    out = numbered.select("row", "vec_id").join(linked, "row", "left")
    component = F.when(F.col("fit"), F.col("least")).otherwise(F.col("vec_id"))
    out = out.select(F.col("vec_id").alias(id_col), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
    return out


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of a label. DuckDB casts components to doubles as the query does.
OP2_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
),
ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, least(v.vec_id, coalesce(c.least, v.vec_id)) AS component_id, least(v.vec_id, coalesce(c.least, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
