"""N-gram Jaccard self-join by token-combination prefixes, and the groups that its links form.

A document is the set of the hashes of its word shingles; documents with the same set are one class. All sets are ordered alike, by how
many documents have a token and then by its hash. Two sets of Jaccard similarity t or more share k tokens within the first
n - ceil(t * n) + k of their n tokens. So a class is indexed by the single tokens of such a prefix if they are rare, and by pairs of
tokens (k = 2) if they are frequent; what meets there is verified.

Texts lie in blocks. A block sends each of its distinct tokens once, with the number of its documents that have it, to the token's range
of hashes, where the counts are added up; so however many documents share a token, a task gets one number of it from each block.
The sums come back to the block. Tokens that one document alone has go no further, because no intersection holds them:
they only count in a prefix. A class with so many of them that no other set can be similar is dropped there. What is left is
ordinary DataFrames. A class is told by 128 bits of its set's fingerprint, and then named by the number of a row that has it.

Large groups of near copies never meet as all pairs. First each class is compared with one other per sampled token, and
components of those links are formed; from then on only classes of different components are paired.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from palisade.llm.arrays import BLANK, LOWER, give_back, mixed, paired, ranges, released, words
from palisade.llm.blocks import from_planes, planes, text_blocks, texts_of
from palisade.llm.common import discard, materialize, packed, table
from palisade.llm.components import merged_components

WORDS = 5
#: Similarity, in hundredths.
THRESHOLD = 75
#: A token is rare if at most so many classes have it in their prefixes.
RARE = 24
#: Classes of a frequent token that are compared at once.
CHUNK = 512
#: Tokens of a block of such classes that are intersected at once.
COLUMNS = 2048
#: Rounds before the exact search, in each of which a class meets two others by one of its tokens.
ROUNDS = 4
#: Bytes of text for each range of token hashes.
RANGE_BYTES = 4 << 20

_WORD = ~BLANK


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a few texts: tokens, each text's sorted and distinct; where each text's begin; two fingerprints of each set."""
    n = len(offsets) - 1
    raw = LOWER[data[offsets[0] : offsets[-1]]]
    cuts = offsets - offsets[0]
    hashes, starts, _ = words(raw, _WORD, cuts[:-1])
    owner = np.searchsorted(cuts, starts, "right") - 1
    count = np.bincount(owner, minlength=n)
    whole = np.array([0x517CC1B727220A95], np.uint64)
    rolled, tokens, owners = hashes, [], []
    first = np.cumsum(count) - count
    for k in range(1, size):
        short = np.flatnonzero(count == k)  # the whole text is one token
        tokens.append(paired(rolled[first[short]], whole + np.uint64(k)))
        owners.append(short)
        rolled = paired(rolled[:-1], hashes[k:]) if len(hashes) > k else rolled[:0]
    same = owner[size - 1 :] == owner[: max(len(owner) - size + 1, 0)]
    tokens.append(rolled[same])
    owners.append(owner[: len(same)][same])
    tokens, owners = np.concatenate(tokens), np.concatenate(owners)
    order = np.lexsort((tokens, owners))
    tokens, owners = tokens[order], owners[order]
    if len(tokens):
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
        tokens, owners = tokens[new], owners[new]
    bounds = np.searchsorted(owners, np.arange(n + 1))
    prints = []
    for key in (whole, mixed(whole)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(tokens ^ key))])
        prints.append(mixed((total[bounds[1:]] - total[bounds[:-1]]) ^ mixed(np.diff(bounds).astype(np.uint64))))
    return tokens, bounds, *prints


def _block_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets() of a block, about 1 MB of texts at once: tokens, set sizes, fingerprints."""
    parts = [(tokens, np.diff(bounds), a, b) for first, last in ranges(offsets) for tokens, bounds, a, b in [shingle_sets(data, offsets[first : last + 1], size)]]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


#: Bytes of a token that travel.
_WIDTH = 7


def _sent_tokens(size: int, bits: int):
    """Of each block, its distinct tokens by their first ``bits`` bits, and how many of its documents have them."""

    def compute(batches):
        for batch in released(batches):
            for block, ends, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens, counts = np.unique(_block_sets(*texts_of(ends, data.as_py()), size)[0], return_counts=True)
                cuts = np.searchsorted((tokens >> np.uint64(64 - bits)).astype(np.int64), np.arange((1 << bits) + 1))
                rows = [(p, block, planes(tokens[a:b], _WIDTH), planes(counts[a:b].astype(np.int32), 4)) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["part", "block", "tokens", "counts"])

    return compute


def _count_tokens(rows: pa.Table) -> pa.Table:
    """Of each block of a part, how many documents of all blocks have its tokens, in the order in which it sent them."""
    give_back()
    tokens = [from_planes(b, _WIDTH) for b in rows["tokens"].to_pylist()]
    counts = np.concatenate([from_planes(b, 4, np.int32) for b in rows["counts"].to_pylist()])
    _, inverse = np.unique(np.concatenate(tokens), return_inverse=True)
    sums = np.minimum(np.bincount(inverse, weights=counts), 2**31 - 1).astype(np.int32)[inverse]
    cuts = np.cumsum([0, *[len(t) for t in tokens]])
    found = [planes(sums[a:b], 4) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.Table.from_arrays([rows["block"].combine_chunks(), rows["part"].combine_chunks(), pa.array(found, pa.binary())], ["block", "part", "counts"])


def _shared_sets(size: int, threshold: int, keep: pa.Schema):
    """Each document of a block: what it brought, set size, fingerprints, and if other sets may be similar its shared tokens in the order of all sets.

    Of documents of the block with equal sets, one has the tokens.
    """
    kinds = pa.schema([*keep, pa.field("n", pa.int64()), pa.field("p1", pa.int64()), pa.field("p2", pa.int64()), pa.field("tokens", pa.list_(pa.int64()))])

    def compute(rows: pa.Table) -> pa.Table:
        give_back()
        own = rows.filter(pc.is_valid(rows["data"]))
        tokens, n, p1, p2 = _block_sets(*texts_of(own["ends"][0].as_py(), own["data"][0].as_py()), size)
        found = rows.filter(pc.is_null(rows["data"])).sort_by("part")
        sums = np.concatenate([np.zeros(0, np.int32), *[from_planes(b, 4, np.int32) for b in found["counts"].to_pylist()]])
        owners = np.repeat(np.arange(len(n)), n)
        _, inverse = np.unique(tokens, return_inverse=True)
        counts = sums[inverse] if len(tokens) else sums
        several = counts > 1
        shared = np.bincount(owners[several], minlength=len(n))
        fit = (100 * shared >= threshold * n) & (n > 0)
        _, once = np.unique(np.rec.fromarrays([p1, p2]), return_index=True)
        chosen = np.zeros(len(n), bool)
        chosen[once] = fit[once]
        mine = several & chosen[owners]
        tokens, owners, counts = tokens[mine], owners[mine], counts[mine]
        order = np.lexsort((tokens, counts, owners))
        ends = np.concatenate([[0], np.cumsum(np.where(chosen, shared, 0))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((tokens[order] >> np.uint64(8)).view(np.int64)), mask=pa.array(~chosen))
        brought = [own[f.name].combine_chunks().flatten().cast(f.type) for f in keep]
        return pa.Table.from_arrays([*brought, pa.array(n, pa.int64()), pa.array(p1.view(np.int64)), pa.array(p2.view(np.int64)), lists], schema=kinds)

    return compute


def document_sets(docs: DataFrame, id_col: str, text_col: str, size: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``id``, ``number``, ``t1, t2`` (of the text), ``n`` (set size), ``p1, p2`` (of the set), ``tokens``.

    ``tokens`` are the shared tokens, in order, of the sets that others may be similar to; null for other sets and repeated ones.
    """
    text = F.col(text_col)
    n_bytes = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1, n_bytes / RANGE_BYTES)))))
    chosen = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("number"), *text_digest(text), text.alias("text"))
    blocks = materialize(text_blocks(chosen), "text-blocks")
    sent = blocks.select("block", "ends", "data").mapInArrow(_sent_tokens(size, bits), "part int, block long, tokens binary, counts binary")
    counted = materialize(sent.groupBy("part").applyInArrow(_count_tokens, "block long, part int, counts binary"), "token-counts")
    kept = [f for f in chosen.schema if f.name != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", n long, p1 long, p2 long, tokens array<long>"
    both = blocks.unionByName(counted, allowMissingColumns=True)
    out = materialize(both.groupBy("block").applyInArrow(_shared_sets(size, threshold, to_arrow_schema(chosen.drop("text").schema)), schema), "document-sets")
    discard(blocks, counted)
    return out


def text_digest(text) -> list:
    """128 bits that tell texts apart, as ``t1, t2``."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``u, v`` of those ``pairs(u, v)`` whose sets are similar."""
    some = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()
    sets = sets.join(some, "class", "left_semi")
    left = sets.select(F.col("class").alias("u"), F.col("n").alias("nu"), F.col("tokens").alias("tu"))
    right = sets.select(F.col("class").alias("v"), F.col("n").alias("nv"), F.col("tokens").alias("tv"))
    both = F.size(F.array_intersect("tu", "tv")).cast("long")
    return pairs.join(left, "u").join(right, "v").withColumn("both", both).filter(100 * F.col("both") >= threshold * (F.col("nu") + F.col("nv") - F.col("both"))).select("u", "v")


def _pairs(index: DataFrame, keys: list[str], threshold: int) -> DataFrame:
    """Distinct pairs of classes of different components that meet under ``keys`` and whose sizes allow a link."""
    a = index.select(*keys, F.col("class").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu"))
    b = index.select(*keys, F.col("class").alias("v"), F.col("n").alias("nv"), F.col("component").alias("cv"))
    sizes = (100 * F.col("nu") >= threshold * F.col("nv")) & (100 * F.col("nv") >= threshold * F.col("nu"))
    return a.join(b, keys).filter((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv")) & sizes).select("u", "v").distinct()


_SKETCH = 4096


def _sketched(sets: DataFrame) -> DataFrame:
    """``class, held, sketch``: the number of shared tokens, and a bit set of their hashes."""

    def compute(batches):
        for batch in released(batches):
            offsets = np.asarray(batch.column(1).offsets)
            held = np.diff(offsets)
            tokens = np.asarray(batch.column(1).values)
            bits = np.zeros((len(held), _SKETCH), bool)
            bits[np.repeat(np.arange(len(held)), held), tokens[offsets[0] : offsets[-1]] & (_SKETCH - 1)] = True
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.astype(np.int64)), pa.array([b.tobytes() for b in packed], pa.binary())], ["class", "held", "sketch"])

    return sets.select("class", "tokens").mapInArrow(compute, "class long, held long, sketch binary")


def _meet(threshold: int):
    """Blocks of classes that have a frequent token: pairs that may be similar and have it as the first of two or more in common.

    A block is all classes of one token, or two chunks of them, and its rows come together. Of a class come all its frequent tokens,
    so the combinations of tokens are intersections of bit sets here, and a pair is made for its first combination alone.
    """

    def block(rows: pa.Table):
        token, first, second = rows["token"][0].as_py(), rows["low"][0].as_py(), rows["high"][0].as_py()
        own, ids = rows["own"].to_numpy(), rows["class"].to_numpy()
        n, held, component = rows["n"].to_numpy(), rows["held"].to_numpy(), rows["component"].to_numpy()
        lists = rows["often"].combine_chunks()
        offsets = np.asarray(lists.offsets)
        tokens = np.asarray(lists.values)[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(len(ids)), np.diff(offsets))
        left, right = (np.arange(len(ids)),) * 2 if first == second else (np.flatnonzero(own == first), np.flatnonzero(own == second))

        def common(mask):
            """How many of the tokens of ``mask`` each left and right class share, COLUMNS tokens at once."""
            names, at, held = np.unique(tokens[mask], return_inverse=True, return_counts=True)
            rows_of, out = row[mask], np.zeros((len(left), len(right)), np.float32)
            at = (np.cumsum(held > 1) - 1)[at][held[at] > 1]  # a token of one class is in no intersection
            rows_of = rows_of[held[np.searchsorted(names, tokens[mask])] > 1] if len(names) else rows_of
            order = np.argsort(at, kind="stable")
            at, rows_of = at[order], rows_of[order]
            for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
                here = slice(*np.searchsorted(at, (lo, lo + COLUMNS)).tolist())
                some = np.zeros((len(ids), COLUMNS), np.float32)
                some[rows_of[here], at[here] - lo] = 1
                out += some[left] @ some[right].T
            return out

        good = (common(tokens < token) == 0) & (common(tokens > token) > 0)
        good &= component[left][:, None] != component[right][None]
        good &= (100 * n[left][:, None] >= threshold * n[right][None]) & (100 * n[right][None] >= threshold * n[left][:, None])
        a, b = np.nonzero(good)
        a, b = left[a], right[b]
        if first == second:
            a, b = a[a < b], b[a < b]
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
        keep = []
        for lo in range(0, len(a), 1 << 14):
            x, y = a[lo : lo + (1 << 14)], b[lo : lo + (1 << 14)]
            both = np.minimum(held[x] - np.bitwise_count(sketch[x] & ~sketch[y]).sum(axis=1, dtype=np.int64), held[y] - np.bitwise_count(sketch[y] & ~sketch[x]).sum(axis=1, dtype=np.int64))
            keep.append(100 * both >= threshold * (n[x] + n[y] - both))
        keep = np.concatenate(keep) if keep else np.zeros(0, bool)
        u, v = np.minimum(ids[a[keep]], ids[b[keep]]), np.maximum(ids[a[keep]], ids[b[keep]])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) if len(u) else None

    def compute(batches):
        carried = None
        for batch in released(batches):
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([carried, rows]).combine_chunks() if carried is not None else rows
            change = np.zeros(len(rows) - 1, bool)
            for k in ("token", "low", "high"):
                column = rows[k].to_numpy()
                change |= column[1:] != column[:-1]
            edges = [0, *(np.flatnonzero(change) + 1).tolist()]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo > 1 and (out := block(rows.slice(lo, hi - lo))) is not None:
                    yield out
            carried = rows.slice(edges[-1])
        if carried is not None and len(carried) > 1 and (out := block(carried)) is not None:
            yield out

    return compute


def _combined_pairs(opened: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``u, v`` of classes that have two frequent tokens in common. ``opened(class, n, component, token)``."""
    often = opened.groupBy("class", "n", "component").agg(F.array_sort(F.collect_set("token")).alias("often"))
    often = often.join(_sketched(sets), "class")
    chunks = opened.groupBy("token").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    met = often.withColumn("token", F.explode("often")).join(chunks, "token")
    met = met.withColumn("own", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.select("token", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "class", "n", "component", "held", "often", "sketch")
    keys = ["token", "low", "high"]
    return met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_meet(threshold), "u long, v long").distinct()


def similar_classes(sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``node, component`` of each class that is linked with another: the components of all links. ``sets(class, n, tokens)``."""
    stars = materialize(sets.select("class", "n", F.array(*[_least_hashed(k) for k in range(ROUNDS)]).alias("stars")), "stars")
    groups, n_classes = None, stars.count()
    for turn in range(ROUNDS):
        known = _with_components(stars, groups).select("class", "n", "component", F.get("stars", F.lit(turn)).alias("star"))
        one, key = F.struct(F.col("class").alias("u"), F.col("n").alias("nu"), F.col("component").alias("cu")), F.xxhash64("class", F.lit(turn))
        hubs = known.groupBy("star").agg(F.array(F.min_by(one, key), F.max_by(one, key)).alias("hubs"), F.min("component").alias("low"), F.max("component").alias("high"))
        met = known.join(hubs.filter("low != high"), "star").select("class", "n", "component", F.explode("hubs").alias("hub"))
        sizes = (100 * F.col("hub.nu") >= threshold * F.col("n")) & (100 * F.col("n") >= threshold * F.col("hub.nu"))
        near = met.filter((F.col("hub.cu") != F.col("component")) & sizes).select(F.least("hub.u", "class").alias("u"), F.greatest("hub.u", "class").alias("v"))
        near = materialize(near.distinct(), "near", 2 * n_classes)
        found = materialize(_verified(near, sets, threshold), "star-links")
        discard(near)
        n_found = found.count()
        if n_found:
            groups = materialize(merged_components(groups, found), "star-components", n_classes)
        if n_found * 50 < n_classes:  # what few links are left, the exact search finds as cheaply
            break
    known = _with_components(sets, groups)
    prefix = F.floor((100 - threshold) * F.col("n") / 100).cast("int") + 2  # n - ceil(t n) + k
    alone = (F.col("n") - F.size("tokens")).cast("int")  # tokens of no other document come first
    head = F.slice("tokens", F.lit(1), F.greatest(F.lit(0), prefix - alone))
    index = materialize(known.select("class", "n", "component", F.explode(head).alias("token")), "prefix-index")
    kinds = index.groupBy("token").agg(F.count("*").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    open_tokens = materialize(kinds.filter("low != high").select("token", (F.col("held") <= RARE).alias("rare")), "open-tokens")
    opened = index.join(open_tokens, "token")
    single = _pairs(opened.filter("rare"), ["token"], threshold)
    double = _combined_pairs(opened.filter("not rare").select("class", "n", "component", "token"), sets, threshold)
    rest = materialize(single.unionByName(double).distinct(), "pairs")
    more = materialize(_verified(rest, sets, threshold), "more-links")
    discard(index, open_tokens, rest, stars)
    return merged_components(groups, more)


def _with_components(classes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``classes`` with their ``component`` so far, at first themselves."""
    if groups is None:
        return classes.withColumn("component", F.col("class"))
    return classes.join(groups.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))


def _least_hashed(seed: int):
    """The token of ``tokens`` whose hash with ``seed`` is least, told by that hash."""
    return F.aggregate("tokens", F.lit(2**63 - 1), lambda a, t: F.least(a, F.xxhash64(t, F.lit(seed))))


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: int) -> DataFrame:
    """``id``, ``t1, t2``, ``n`` of each row, and of its group (null for empty sets) the least row as ``best(none, id, t1, t2)``."""
    rows = document_sets(docs, id_col, text_col, size, threshold)
    one = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
    classes = rows.filter("n > 0").groupBy("p1", "p2").agg(F.min("number").alias("class"), F.first("n").alias("n"), F.first("tokens", ignorenulls=True).alias("tokens"), F.min(one).alias("best"))
    classes = materialize(classes, "classes")
    groups = similar_classes(classes.filter("tokens is not null").select("class", "n", "tokens"), threshold)
    groups = materialize(groups, "components").withColumnRenamed("node", "class")
    member = classes.select("p1", "p2", "class", "best").join(groups, "class", "left").withColumn("group", F.coalesce("component", "class"))
    least = member.groupBy("group").agg(F.min("best").alias("best"))
    named = member.drop("best").join(least, "group").select("p1", "p2", "best")
    return rows.select("id", "t1", "t2", "n", "p1", "p2").join(named, ["p1", "p2"], "left").select("id", "t1", "t2", "n", F.when(F.col("n") > 0, F.col("best")).alias("best"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``.

    Words are runs of other than blanks, in lower case (A-Z). A text of fewer than ``size`` words is one token; null and empty texts
    have none, link with nothing, and are components of their own. ``component_id`` is the smallest id reachable by links of
    Jaccard similarity of ``threshold`` hundredths or more. Rows with equal sets are linked; repeated rows are such. A null
    id is a row like others, but never names a component unless all its ids are null. An empty table gives no rows.
    Other columns aren't read, whatever their names.
    """
    out = _grouped(docs, id_col, text_col, size, threshold)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"))


def jaccard_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, one of each group of jaccard_groups(): one of the smallest id.

    Rows are told by id and text, so a row goes only if its own text is linked, whatever other rows have its id. Rows without words
    all stay. Other columns stay as they are, whatever their names.
    """
    rows = materialize(_grouped(docs, id_col, text_col, size, threshold).filter("best is not null"), "jaccard-groups")
    key = [F.col("id").alias("__id"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")]
    stays = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("t1") == F.col("best.t1")) & (F.col("t2") == F.col("best.t2"))
    gone = rows.filter(~stays).select(*key).distinct()
    repeated = materialize(rows.filter(stays).groupBy("id", "t1", "t2").count().filter("count > 1").select(*key), "repeated")
    keyed = packed(docs, key=F.col(id_col), d1=text_digest(F.col(text_col))[0], d2=text_digest(F.col(text_col))[1])
    same = F.col("key").eqNullSafe(F.col("__id")) & (F.col("d1") == F.col("__t1")) & (F.col("d2") == F.col("__t2"))
    rest = keyed.join(gone, same, "left_anti")
    if repeated.limit(1).count():
        rest = rest.join(repeated, same, "left_anti").unionByName(rest.join(repeated, same, "left_semi").dropDuplicates(["key", "d1", "d2"]))
    return rest.select("row.*")


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {WORDS} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {WORDS - 2}), lambda i: array_to_string(ws[i:i + {WORDS - 1}], ' ')) END) AS sh FROM w
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {THRESHOLD} * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""
