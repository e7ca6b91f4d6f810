"""Removal of repeated 50-byte strings by a parse into phrases, whose dictionary is sorted into suffix arrays.

Triggers. A rolling hash of 20 bytes has a trigger in each 50-byte string: the place where that hash is least. Consecutive strings
with the same trigger form a phrase, so each 50-byte string is in one phrase of its text, and equal strings have equal triggers
wherever they are. (With triggers where a hash is 0 modulo p, some strings would hold none, and be missed.) Neighbouring phrases
overlap by 49 bytes, so no 50-byte suffix that the order is asked for runs over a phrase's end.

1. Parse: the distinct phrases of each block of texts, as (trigger, fingerprint, smallest document), meet by trigger. A phrase that also is
   in a document of a smaller id is repeated as a whole. Only where one trigger has several phrases is the dictionary needed.
2. Dictionary: of each such phrase, its first document gives the bytes. The suffixes of a range of triggers' phrases are sorted by
   their bytes to a depth of 50: the dictionary's suffix array. Where neighbours in it agree in 50 bytes, their phrases' documents,
   taken from the parse, follow each other in the corpus order, and all but the smallest lose the string.
3. Both results go back to the texts, where removed strings are joined to spans.

As phrases overlap by 49 bytes, the order of the parse never decides between two suffixes: of the parse, each phrase's smallest document is all
that the corpus order needs. Whole phrases are told by their trigger and 80 bits of fingerprint, their strings by their bytes.

Texts stay in compressed blocks; what travels by trigger is about a sixth of the texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrays import BYTE_VALUES, SLICE, give_back, mixed, released
from palisade.llm.blocks import from_planes, planes, text_blocks, texts_of
from palisade.llm.common import discard, materialize, table

LENGTH = 50
GRAM = 20
#: Bytes of text for each range of triggers.
RANGE_BYTES = 4 << 20
#: Phrases of one trigger up to which they are compared in one task; of more, each string goes by its own hash.
WIDE = 2048
#: A null id comes after all others.
LAST_ID = np.iinfo(np.int64).max

_C = np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _rolled(raw: np.ndarray) -> dict[int, np.ndarray]:
    """Linear hashes of the 2, 4, 8, 16, 32 bytes from each place."""
    out = {1: BYTE_VALUES[raw]}
    for i, n in enumerate((1, 2, 4, 8, 16)):
        h = out[n]
        out[2 * n] = h[:-n] * _C[i] + h[n:] if len(h) > n else h[:0]
    return out


def _window_hashes(h: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """Hashes of the 50 bytes from each of the places ``at``."""
    return mixed(h[32][at] * _C[5] + h[16][at + 32] * _C[6] + h[2][at + 48])


def _second_hashes(h: dict[int, np.ndarray], at: np.ndarray) -> np.ndarray:
    """As _window_hashes(), independent of those."""
    return mixed(h[32][at] * _C[10] + h[32][at + 18] * _C[11])


def _both_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the 50 bytes from each of the places ``at``, about SLICE bytes at once."""
    x, y = np.zeros((2, len(at)), np.uint64)
    order = np.argsort(at, kind="stable")
    edges = np.searchsorted(at[order], np.arange(0, len(raw) + SLICE, SLICE))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            mine = order[a:b]
            h = _rolled(raw[k * SLICE : (k + 1) * SLICE + LENGTH])
            x[mine], y[mine] = _window_hashes(h, at[mine] - k * SLICE), _second_hashes(h, at[mine] - k * SLICE)
    return x, y


def phrases(raw: np.ndarray, cuts: np.ndarray, most: int = SLICE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triggers, both phrase hashes, places and numbers of strings of all phrases. ``cuts``: where texts begin, and the end."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for lo in range(0, max(len(raw) - LENGTH + 1, 0), most):
        part = raw[lo : lo + most + LENGTH - 1]
        n = len(part) - LENGTH + 1
        if n <= 0:
            break
        h = _rolled(part)
        low = mixed(h[16][:-4] * _C[7] + h[4][16:])
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[:-15], low[15:])  # of the 31 grams in each string
        inside = np.ones(n, bool)
        for end in cuts[np.searchsorted(cuts, lo, "right") : np.searchsorted(cuts, lo + n + LENGTH, "left")].tolist():
            inside[max(end - lo - LENGTH + 1, 0) : max(end - lo, 0)] = False
        begins = inside.copy()
        begins[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
        starts = np.flatnonzero(begins)
        if not len(starts):
            continue
        stop = np.ones(n + 1, bool)
        stop[:n] = begins | ~inside
        edges = np.flatnonzero(stop)
        sizes = edges[np.searchsorted(edges, starts, "right")] - starts
        if sizes.max() > LENGTH:  # the first and the last string cover a phrase only up to here
            pieces = -(-sizes // LENGTH)
            first = np.cumsum(pieces) - pieces
            within = np.arange(pieces.sum()) - np.repeat(first, pieces)
            sizes = np.minimum(np.repeat(sizes, pieces) - within * LENGTH, LENGTH)
            starts = np.repeat(starts, pieces) + within * LENGTH
        whole = mixed(_window_hashes(h, starts) * _C[8] + _window_hashes(h, starts + sizes - 1) * _C[9] + sizes.astype(np.uint64))
        more = mixed(_second_hashes(h, starts) * _C[13] + _second_hashes(h, starts + sizes - 1) * _C[14] + sizes.astype(np.uint64))
        even = mixed(low[starts] + _C[12])  # least hashes are small; ranges of these hold about the same
        found.append((even, whole, (more >> np.uint64(32)).astype(np.uint32), starts + lo, sizes))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class _Block:
    """A block's texts again, and its phrases by part, each part's in order of their triggers."""

    def __init__(self, row: pa.Table):
        self.block, self.real_ids = row["block"][0].as_py(), row["id"][0].values
        self.ids = np.asarray(pc.fill_null(self.real_ids, LAST_ID))
        self.raw, self.cuts = texts_of(row["ends"][0].as_py(), row["data"][0].as_py())

    def parse(self, bits: int):
        """Parts as (part, first, last) of ``sent``: of phrases that are equal, only the first of the smallest id goes out."""
        triggers, whole, more, at, sizes = phrases(self.raw, self.cuts)
        owners = self.ids[np.searchsorted(self.cuts, at, "right") - 1]
        order = np.lexsort((owners, more, whole, triggers))
        self.triggers, self.whole, self.more, self.at, self.sizes, self.owners = triggers[order], whole[order], more[order], at[order], sizes[order], owners[order]
        new = np.ones(len(order), bool)
        new[1:] = (self.triggers[1:] != self.triggers[:-1]) | (self.whole[1:] != self.whole[:-1]) | (self.more[1:] != self.more[:-1])
        self.sent = np.flatnonzero(new)
        self.like = np.cumsum(new) - 1  # of each phrase, its place in ``sent``
        parts = (self.triggers[self.sent] >> np.uint64(64 - bits)).astype(np.int64)
        ends = np.searchsorted(parts, np.arange((1 << bits) + 1))
        return [(p, a, b) for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if a < b]

    def spread(self, codes: np.ndarray) -> np.ndarray:
        """The codes of all phrases from those of ``sent``."""
        first = self.owners[self.sent][self.like] if len(self.like) else self.owners
        return np.where(self.owners > first, _ALL, codes[self.like]).astype(np.uint8)


def _table(rows: list[tuple], fields: dict) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))


_SENT = {"part": pa.int32(), "block": pa.int64(), "triggers": pa.binary(), "whole": pa.binary(), "more": pa.binary(), "owners": pa.binary()}
_FOUND = {"block": pa.int64(), "part": pa.int32(), "codes": pa.binary()}
_ASKED = {"block": pa.int64(), "part": pa.int32(), "at": pa.binary(), "sizes": pa.binary(), "triggers": pa.binary(), "owners": pa.binary(), "data": pa.binary()}
_SPANS = {"block": pa.int64(), "at": pa.binary(), "masks": pa.binary()}


def _ddl(fields: dict) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{k} {names[v]}" for k, v in fields.items())


#: What is known of a phrase: nothing is repeated, all is, or its strings must be compared, by trigger or each by itself.
_NONE, _ALL, _ASK, _ASK_EACH = 0, 1, 2, 3


def _judge(rows: pa.Table) -> pa.Table:
    """Of all phrases of a part, what the phrases of other documents say."""
    give_back()
    triggers = [from_planes(b, 6) for b in rows["triggers"].to_pylist()]
    sizes = [len(t) for t in triggers]
    trigger = np.concatenate(triggers)
    whole = np.concatenate([from_planes(b, 6) for b in rows["whole"].to_pylist()])
    more = np.concatenate([from_planes(b, 4, np.uint32) for b in rows["more"].to_pylist()])
    owner = np.concatenate([from_planes(b, 8, np.int64) for b in rows["owners"].to_pylist()])
    order = np.lexsort((owner, more, whole, trigger))
    t, w, m, d = trigger[order], whole[order], more[order], owner[order]
    new_t = np.concatenate([[True], t[1:] != t[:-1]])
    new_w = new_t | np.concatenate([[True], (w[1:] != w[:-1]) | (m[1:] != m[:-1])])
    t_at, w_at = np.flatnonzero(new_t), np.flatnonzero(new_w)
    t_of, w_of = np.cumsum(new_t) - 1, np.cumsum(new_w) - 1
    several = np.minimum.reduceat(d, t_at) != np.maximum.reduceat(d, t_at)
    variants = np.add.reduceat(new_w.astype(np.int64), t_at)
    ask = np.where((variants > 1) & several, np.where(variants > WIDE, _ASK_EACH, _ASK), _NONE)
    first = d[w_at][w_of]
    code = np.where(d > first, _ALL, ask[t_of]).astype(np.uint8)
    codes = np.empty(len(code), np.uint8)
    codes[order] = code
    out, at = [], 0
    for block, part, size in zip(rows["block"].to_pylist(), rows["part"].to_pylist(), sizes, strict=True):
        if codes[at : at + size].any():
            out.append((block, part, codes[at : at + size].tobytes()))
        at += size
    return _table(out, _FOUND)


def _later(keys: tuple[np.ndarray, ...], owner: np.ndarray) -> np.ndarray:
    """Which strings, told by ``keys``, a smaller owner has too."""
    order = np.lexsort((owner, *reversed(keys)))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    least = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = np.zeros(len(owner), bool)
    gone[order] = least < owner[order]
    return gone


def _fifty(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The 50 bytes from each of the places ``at`` as seven integers, whose order is that of the bytes."""
    eight = np.lib.stride_tricks.sliding_window_view(raw, 8)
    return tuple(np.ascontiguousarray(eight[at + k]).view(">u8").ravel().astype(np.uint64) for k in (0, 8, 16, 24, 32, 40, 42))


def _repeated(raw: np.ndarray, sizes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Of phrases one after another in ``raw``, a bit for each string that a document of a smaller id has.

    The phrases' suffixes of 50 bytes or more are sorted by their first 50 bytes, and equal ones by document.
    """
    lengths = sizes + LENGTH - 1
    starts = np.cumsum(lengths) - lengths
    first = np.cumsum(sizes) - sizes
    offset = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    gone = _later(_fifty(raw, np.repeat(starts, sizes) + offset), np.repeat(owners, sizes))
    return np.bitwise_or.reduceat(np.where(gone, np.uint64(1) << offset.astype(np.uint64), np.uint64(0)), first)


def _compare(rows: pa.Table) -> pa.Table:
    """Of the phrases of a part that must be compared, the strings that a document of a smaller id has, as bits."""
    give_back()
    get = lambda name, kind: [np.frombuffer(b, kind) for b in rows[name].to_pylist()]
    sizes, triggers, owners = np.concatenate(get("sizes", np.int64)), np.concatenate(get("triggers", np.uint64)), np.concatenate(get("owners", np.int64))
    raw = np.frombuffer(b"".join(rows["data"].to_pylist()), np.uint8)
    lengths = sizes + LENGTH - 1
    starts = np.cumsum(lengths) - lengths
    masks = np.zeros(len(sizes), np.uint64)
    order = np.argsort(triggers, kind="stable")
    total = np.cumsum(lengths[order])
    ends = np.flatnonzero(np.concatenate([triggers[order][1:] != triggers[order][:-1], [True]])) + 1
    lo = 0
    while lo < len(order):  # about SLICE / 2 bytes at once, whole triggers each time
        aim = np.searchsorted(total, (total[lo - 1] if lo else 0) + SLICE // 2)
        hi = int(ends[np.searchsorted(ends, max(aim, lo + 1))]) if aim < len(order) else len(order)
        mine = order[lo:hi]
        place = np.repeat(starts[mine] - (np.cumsum(lengths[mine]) - lengths[mine]), lengths[mine]) + np.arange(lengths[mine].sum())
        masks[mine] = _repeated(raw[place], sizes[mine], owners[mine])
        lo = hi
    out, k = [], 0
    for block, places in zip(rows["block"].to_pylist(), get("at", np.int64), strict=True):
        found = masks[k : k + len(places)]
        if found.any():
            out.append((block, places[found != 0].tobytes(), found[found != 0].tobytes()))
        k += len(places)
    return _table(out, _SPANS)


def _compare_each(rows: pa.Table) -> pa.Table:
    """As _compare(), of single strings that came by their own hashes."""
    get = lambda name, kind: [np.frombuffer(b, kind) for b in rows[name].to_pylist()]
    places = get("at", np.int64)
    gone = _later((np.concatenate(get("triggers", np.uint64)), np.concatenate(get("data", np.uint64))), np.concatenate(get("owners", np.int64)))
    out, k = [], 0
    for block, at in zip(rows["block"].to_pylist(), places, strict=True):
        found = at[gone[k : k + len(at)]]
        if len(found):
            out.append((block, found.tobytes(), np.ones(len(found), np.uint64).tobytes()))
        k += len(at)
    return _table(out, _SPANS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``n_bytes``, ``spans`` (array of start and stop in UTF-8 bytes), ``kept_sha256``.

    A byte is in a span if a string of 50 bytes that covers it also starts in a document of a smaller id. Ids are integers; a null
    id comes after all others, and rows that share an id don't remove each other's bytes. Null text counts as empty. Texts
    under 50 bytes have no spans. An empty table gives no rows. Other columns aren't read, whatever their names.
    """
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1, n_bytes / RANGE_BYTES)))))
    blocks = materialize(text_blocks(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), "text-blocks")

    def send(batches):
        for batch in released(batches):
            rows = pa.Table.from_batches([batch])
            for i in range(len(rows)):
                one = _Block(rows.slice(i, 1))
                out = [(p, one.block, planes(one.triggers[k], 6), planes(one.whole[k], 6), planes(one.more[k], 4), planes(one.owners[k], 8)) for p, a, b in one.parse(bits) for k in [one.sent[a:b]]]
                yield from _table(out, _SENT).to_batches()

    found = materialize(blocks.mapInArrow(send, _ddl(_SENT)).groupBy("part").applyInArrow(_judge, _ddl(_FOUND)), "phrase-codes")
    known = blocks.unionByName(found, allowMissingColumns=True)

    def ask(rows: pa.Table) -> pa.Table:
        """Phrases that are repeated as a whole (part null, all bits set), and those to compare."""
        give_back()
        one = _Block(rows.filter(pc.is_valid(rows["data"])))
        rows = rows.filter(pc.is_null(rows["data"]))
        codes = dict(zip(rows["part"].to_pylist(), rows["codes"].to_pylist(), strict=True))
        out, block = [], one.block
        parts = one.parse(bits)
        known = np.zeros(len(one.sent), np.uint8)
        for p, a, b in parts:
            if p in codes:
                known[a:b] = np.frombuffer(codes[p], np.uint8)
        code = one.spread(known)
        full = np.flatnonzero(code == _ALL)
        if len(full):
            out.append((block, None, one.at[full].tobytes(), one.sizes[full].tobytes(), None, None, None))
        asks = np.flatnonzero(code == _ASK)
        place = one.like[asks]
        for p, a, b in parts:
            open_ = asks[np.searchsorted(place, a) : np.searchsorted(place, b)]
            if len(open_):
                data = b"".join([one.raw[s : s + n + LENGTH - 1].tobytes() for s, n in zip(one.at[open_].tolist(), one.sizes[open_].tolist(), strict=True)])
                out.append((block, p, one.at[open_].tobytes(), one.sizes[open_].tobytes(), one.triggers[open_].tobytes(), one.owners[open_].tobytes(), data))
        each = np.flatnonzero(code == _ASK_EACH)
        if len(each):
            sizes = one.sizes[each]
            at = np.repeat(one.at[each], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x, y = _both_hashes(one.raw, at)
            owners = np.repeat(one.owners[each], sizes)
            here = _later((x, y), owners)  # of a block, only the first document's strings go out
            if here.any():
                out.append((block, None, at[here].tobytes(), np.ones(here.sum(), np.int64).tobytes(), None, None, None))
            order = np.flatnonzero(~here)[np.argsort(x[~here], kind="stable")]
            parts = (x[order] >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.searchsorted(parts, np.arange((1 << bits) + 1))
            for p, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if lo < hi:
                    out.append((block, p, at[order[lo:hi]].tobytes(), None, x[order[lo:hi]].tobytes(), owners[order[lo:hi]].tobytes(), y[order[lo:hi]].tobytes()))
        return _table(out, _ASKED)

    asked = materialize(known.groupBy("block").applyInArrow(ask, _ddl(_ASKED)), "phrases")
    discard(found)
    compared = asked.filter("part is not null and sizes is not null").groupBy("part").applyInArrow(_compare, _ddl(_SPANS))
    compared_each = asked.filter("part is not null and sizes is null").groupBy("part").applyInArrow(_compare_each, _ddl(_SPANS))
    whole = asked.filter("part is null").select("block", "at", "sizes")
    everything = blocks.unionByName(whole, allowMissingColumns=True).unionByName(compared, allowMissingColumns=True).unionByName(compared_each, allowMissingColumns=True)
    kinds = {"id": pa.int64(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "kept_sha256": pa.string()}

    def remove(rows: pa.Table) -> pa.Table:
        give_back()
        one = _Block(rows.filter(pc.is_valid(rows["data"])))
        change = np.zeros(len(one.raw) + 1, np.int64)
        for at, sizes, masks in zip(rows["at"].to_pylist(), rows["sizes"].to_pylist(), rows["masks"].to_pylist(), strict=True):
            if sizes is not None:
                places, sizes = np.frombuffer(at, np.int64), np.frombuffer(sizes, np.int64)
                np.add.at(change, places, 1)
                np.add.at(change, places + sizes + LENGTH - 1, -1)
            elif masks is not None:
                places, masks = np.frombuffer(at, np.int64), np.frombuffer(masks, np.uint64)
                bits_set = (masks[:, None] >> np.arange(LENGTH, dtype=np.uint64)) & np.uint64(1)
                row, offset = np.nonzero(bits_set)
                np.add.at(change, places[row] + offset, 1)
                np.add.at(change, places[row] + offset + LENGTH, -1)
        gone = np.cumsum(change[:-1]) > 0
        out = []
        for doc, lo, hi in zip(one.real_ids.to_pylist(), one.cuts[:-1].tolist(), one.cuts[1:].tolist(), strict=True):
            mine = gone[lo:hi]
            if mine.any():
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))).reshape(-1, 2)
                spans, kept = [{"start": a, "stop": b} for a, b in edges.tolist()], one.raw[lo:hi][~mine]
            else:
                spans, kept = [], one.raw[lo:hi]
            out.append((doc, hi - lo, spans, hashlib.sha256(kept.tobytes()).hexdigest()))
        return _table(out, kinds)

    out = everything.groupBy("block").applyInArrow(remove, "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept_sha256 string")
    out = materialize(out, "spans")
    discard(blocks, asked)
    return out.withColumnRenamed("id", id_col)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


#: Bytes as pairs of hexadecimal digits; all strings of all texts.
OP9_SQL = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, length(x) // 2 AS n FROM documents),
w AS (SELECT doc_id, k, substr(x, 2 * k + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, x, unnest(range(0, greatest(n - {LENGTH - 1}, 0))) AS k FROM h)),
m AS (SELECT w.doc_id, k FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1) USING (s) WHERE least < w.doc_id),
i AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM (SELECT *, (k > coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k), -{LENGTH + 1}) + {LENGTH})::INT AS fresh FROM m)),
r AS (SELECT doc_id, min(k) AS a, max(k) + {LENGTH} AS b FROM i GROUP BY doc_id, run),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
g AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM q JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) AS kept_sha256
FROM h LEFT JOIN g USING (doc_id)
"""
