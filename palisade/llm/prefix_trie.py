"""Prefix trie of conversations, from mergeable partial tries.

A node is a distinct sequence of first turns, named by a chained 128-bit hash of roles and texts. Each task reads whole conversations and keeps one
row per node that it met: how many conversations it has, the smallest of them, and which of them end there. These tables are merged by
node in rounds, each of which joins the tables of FAN neighbouring tasks, so no task ever gets more than FAN rows of a node that all
conversations share. Sums over subtrees then go upwards in steps of 1, 2, 4, ... turns, which needs no more rounds than the logarithm of
the depth. Subtrees of one conversation are chains and need none.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import discard, materialize, small_batches, table

#: Tables of so many tasks meet in one round of merging.
FAN = 256
#: Rows that a task holds before it hands on what it has: nodes, and ends of conversations.
MOST_HELD = 100_000
#: Ends of conversations in one piece of a node's list.
CHUNK = 1 << 16
#: Parts into which the children of one node are dealt, where they are joined with it.
SALTS = 64
ROOT = bytes(16)

_PARTIAL = "node binary, ups array<binary>, depth long, bytes long, conv long, n long, ends array<long>, part long"
_IDS = pa.schema([("node", pa.binary()), ("ups", pa.list_(pa.binary())), ("depth", pa.int64()), ("bytes", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()), ("ends", pa.list_(pa.int64())), ("part", pa.int64())])


class _Partial:
    """The trie of the conversations that a task has read since it last handed on."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}
        self.held = 0

    def _meet(self, node: bytes, ups: list[bytes], depth: int, size: int, conv: int) -> None:
        at = self.nodes.get(node)
        if at is None:
            self.nodes[node] = [ups, depth, size, conv, 1, []]
            self.held += 1
        else:
            at[3] = min(at[3], conv)
            at[4] += 1

    def begin(self, conv: int) -> None:
        self.conv, self.path = conv, [ROOT]
        self._meet(ROOT, [], 0, 0, conv)

    def turn(self, role: bytes, text: bytes) -> None:
        node = hashlib.sha256(b"".join((self.path[-1], len(role).to_bytes(8, "little"), role, text))).digest()[:16]
        depth = len(self.path)
        known = self.nodes.get(node)
        ups = known[0] if known else [self.path[depth - (1 << k)] for k in range(depth.bit_length())]
        self.path.append(node)
        self._meet(node, ups, depth, len(text), self.conv)

    def end(self) -> None:
        at = self.nodes.get(self.path[-1])
        if at is None:  # handed on meanwhile
            depth = len(self.path) - 1
            at = self.nodes[self.path[-1]] = [[self.path[depth - (1 << k)] for k in range(depth.bit_length())], depth, self.last, self.conv, 0, []]
        at[5].append(self.conv)
        self.held += 1

    def hand_on(self, part: int) -> pa.RecordBatch:
        rows = list(self.nodes.items())
        columns = [[k for k, _ in rows], *[[v[i] for _, v in rows] for i in range(6)], [part] * len(rows)]
        self.nodes, self.held = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _IDS, strict=True)], schema=_IDS)


def _tries(borrow: tuple[int, int] | None):
    """A function on sorted batches ``grp, conv, role, text`` that gives partial tries; ``borrow`` as in conversation_trie()."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trie = TaskContext.get().partitionId(), _Partial()
        group = base = conv = None
        lent: list[tuple[bytes, bytes]] = []
        taken = skipped = 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True)
            for g, c, role, text in rows:
                if c != conv:
                    if conv is not None:
                        trie.end()
                        if trie.held >= MOST_HELD:
                            yield trie.hand_on(part)
                    if g != group:
                        group, base, lent = g, None, []
                    if c == g:
                        base = c
                    conv, skipped, taken = c, 0, zlib.crc32(str(c).encode()) % borrow[1] if borrow and c != g else 0
                    trie.begin(c)
                    for turn in lent[:taken]:
                        trie.turn(*turn)
                        trie.last = len(turn[1])
                if borrow and c == base and len(lent) < borrow[1] - 1:
                    lent.append((role, text))
                if skipped < taken:
                    skipped += 1
                    continue
                trie.turn(role, text)
                trie.last = len(text)
                if trie.held >= MOST_HELD:
                    yield trie.hand_on(part)
        if conv is not None:
            trie.end()
            yield trie.hand_on(part)

    return read


def partial_tries(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, borrow: tuple[int, int] | None) -> DataFrame:
    """Node tables of the single tasks: ``node, ups, depth, bytes, conv, n, ends, part``. ``ups`` are the ancestors 1, 2, 4, ... turns above."""
    every = borrow[0] if borrow else 1
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("role", role_col), ("text", text_col))]
    rows = conversations.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), *texts).filter("conv is not null")
    rows = rows.withColumn("grp", F.col("conv") - F.col("conv") % every)
    dealt = rows.repartition("grp").sortWithinPartitions("grp", F.abs(F.col("conv") - F.col("grp")), "conv", F.col("turn").asc_nulls_first(), "role", "text")
    return small_batches(dealt.select("grp", "conv", "role", "text")).mapInArrow(_tries(borrow), _PARTIAL)


def merged(partial: DataFrame, fan: int = FAN) -> DataFrame:
    """One row per node: ``node, ups, depth, bytes, conv_id, n_convs``."""
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 1
    rows = partial.select("node", "ups", "depth", "bytes", "conv", "n", "part")
    while True:
        parts = -(-parts // fan)
        rows = rows.withColumn("part", F.expr(f"part div {fan}")).groupBy("node", "ups", "depth", "bytes", "part").agg(F.min("conv").alias("conv"), F.sum("n").alias("n"))
        if parts == 1:
            return rows.select("node", "ups", "depth", "bytes", F.col("conv").alias("conv_id"), F.col("n").alias("n_convs"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``node, conv`` as digests of a node's whole list, or as pieces of it where other tasks may have more of it."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("piece", pa.string()), ("sha", pa.string())])
    now, ids, in_pieces = None, [], True

    def closed(last: bool) -> tuple:
        if in_pieces or last:
            return now, ids[0], ",".join(map(str, ids)), None
        return now, None, None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)

    for batch in batches:
        out = []
        for node, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    out.append(closed(False))
                    in_pieces = False
                now, ids = node, []
            elif len(ids) == CHUNK:
                out.append((now, ids[0], ",".join(map(str, ids)), None))
                ids, in_pieces = [], True  # so is the rest of this list
            ids.append(conv)
        yield rows(out)
    if now is not None:
        yield rows([closed(True)])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node and first id, as one digest per node."""
    schema = pa.schema([("node", pa.binary()), ("sha", pa.string())])
    now, digest = None, None
    for batch in batches:
        out = []
        for node, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    out.append({"node": now, "sha": digest.hexdigest()})
                now, digest = node, hashlib.sha256(piece.encode())
            else:
                digest.update(b"," + piece.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"node": now, "sha": digest.hexdigest()}], schema)


def end_digests(partial: DataFrame) -> DataFrame:
    """``node, sha``: SHA-256 of the ascending, comma-joined ids of the conversations that end at a node.

    Ids are sorted by node and id over all tasks, and go to the last step as long pieces, so a node where very many conversations
    end is a few rows there, hashed one after the other.
    """
    ends = partial.select("node", F.explode("ends").alias("conv"))
    pieces = materialize(ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(_lists, "node binary, first long, piece string, sha string"), "end-lists")
    whole = pieces.filter("sha is null").select("node", "first", "piece").repartition("node").sortWithinPartitions("node", "first").select("node", "piece").mapInArrow(_digests, "node binary, sha string")
    return pieces.filter("sha is not null").select("node", "sha").unionByName(whole)


def rolled_up(shared: DataFrame) -> DataFrame:
    """``node, leaves, saved`` of ``shared(node, ups, depth, leaves, saved)``, each summed over the node's subtree."""
    depth = shared.agg(F.max("depth")).first()[0] or 0
    now, k = shared, 0
    while 1 << k <= depth:
        up = F.get("ups", F.lit(k))
        below = now.filter(F.size("ups") > k).groupBy(up.alias("node")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("extra"))
        sums = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "more"), ("saved", "extra"))]
        after = materialize(now.join(below, "node", "left").select("node", "ups", *sums), "subtrees")
        if k:
            discard(now)
        now, k = after, k + 1
    return now.select("node", "leaves", "saved")


def conversation_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", borrow: tuple[int, int] | None = None) -> DataFrame:
    """One row per distinct sequence of first turns: ``node``, ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` (UTF-8 bytes of last texts that members share, over the subtree), ``ends_sha256``.

    The root is the empty sequence; it has no parent. Turns go by ``turn_col``, null first, ties by role and text; repeated rows are turns of
    their own. A null role or text counts as empty. Rows without a conversation id belong to none and are left out. Texts count
    whole. An empty table has no conversation, so no root and no rows. Other columns aren't read, whatever their names.

    With ``borrow`` = (every, below), conversation c is first rebuilt: its first crc32(c) % below turns become those of conversation c - c % every (all
    if that has fewer, none if there is no such conversation).
    """
    partial = materialize(partial_tries(conversations, id_col, turn_col, role_col, text_col, borrow), "partial-tries")
    nodes = materialize(merged(partial), "nodes")
    ends = materialize(end_digests(partial), "ends")
    parent, salt = F.get("ups", F.lit(0)).alias("parent"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")
    children = nodes.filter("depth > 0").groupBy(parent, salt).agg(F.count("*").alias("n"), F.count_if(F.col("n_convs") == 1).alias("single"))
    children = materialize(children, "children")
    sums = children.groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n_children"), F.sum("single").alias("single"))
    full = nodes.join(sums, "node", "left").fillna(0, ["n_children", "single"])
    full = materialize(full, "families")
    is_shared = "n_convs > 1 or depth = 0"
    leaves = F.col("single") + (F.col("n_children") == 0).cast("long")
    totals = rolled_up(full.filter(is_shared).select("node", "ups", "depth", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")))
    above = children.select("parent", "salt").join(full.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent")
    placed = full.select("node", "conv_id", "depth", "n_convs", "n_children", parent, salt)
    out = placed.join(above, ["parent", "salt"], "left").join(totals, "node", "left").join(ends, "node", "left")
    return out.select(
        "node",
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


#: Fixed values of the query: conversation c borrows from c - c % 5, less than 9 turns.
BORROW = (5, 9)


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), borrow=BORROW).drop("node")


OP12_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
b AS (
  SELECT DISTINCT c, flatten([[ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR x IN string_split(c::VARCHAR, '')]) AS bits FROM t
),
i AS (
  SELECT c, c - c % {BORROW[0]} AS lender, xor(list_reduce(bits, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295), 4294967295) % {BORROW[1]} AS h
  FROM b
),
r AS (
  SELECT i.c, pos, role, text FROM i JOIN t ON t.c = i.lender AND pos < h
  UNION ALL
  SELECT i.c, pos, role, text FROM i JOIN t ON t.c = i.c AND pos >= h
),
p AS (
  SELECT c, row_number() OVER w AS depth, list({{'role': role, 'text': text}}) OVER w AS k, count(*) OVER (PARTITION BY c) AS size, text FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)
  UNION ALL
  SELECT i.c, 0, [], (SELECT count(*) FROM r WHERE r.c = i.c), '' FROM i
),
n AS (
  SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(strlen(text)) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = depth), '')) AS ends_sha256
  FROM p GROUP BY k, depth
),
f AS (
  SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS x WHERE x.depth = n.depth + 1 AND x.k[1:n.depth] = n.k) AS n_children
  FROM n LEFT JOIN n AS u ON u.depth = n.depth - 1 AND u.k = n.k[1:n.depth - 1]
)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.bytes)::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN f AS x ON x.depth >= f.depth AND x.k[1:f.depth] = f.k
GROUP BY f.k, f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, f.ends_sha256
"""
