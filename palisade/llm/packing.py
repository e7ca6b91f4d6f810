"""Best-fit packing of tokenised documents, certified by dual feasible functions.

Partitions pack their pieces by best-fit decreasing and compare the number of sequences with a lower bound that dual feasible
functions give. A partition that meets its bound keeps all but its emptiest sequence; one with a gap keeps only full ones. The
pieces of the others are exchanged between fewer partitions and packed again.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrays import give_back, released
from palisade.llm.common import materialize, small_batches, table

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces a partition packs at once, in the mean.
GROUP = 2048
#: Rounds of exchange at most. Each leaves about one sequence in GROUP / 5 to the next.
ROUNDS = 8
#: Entries of each of a worker's two caches of token ids, which are emptied when full.
CACHE = 200_000


#: The steps before the model for which a text's ids are those of its chunks one after another.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    },
    "post_processor": None,
}


class _Words(dict):
    """Token ids of blank-free chunks of text, as bytes.

    With STEPS, splits never cross a blank, so a text's ids are those of its chunks one after another. A tokenizer of other steps
    encodes whole texts.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        steps = json.loads(self.tokenizer.to_str())
        self.by_chunk = all(steps[k] == v for k, v in STEPS.items()) and all(t["content"] in ("<|startoftext|>", "<|endoftext|>") for t in steps["added_tokens"])
        self.split = regex.compile(SPLIT).findall
        self.plain = regex.compile(r"[\x21-\x7EÀ-ÿ]*").fullmatch
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = iter(range(256, 512))
        self.shown = {b: chr(b if b in set(visible) else next(hidden)) for b in range(256)}
        self.parts: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            part = chunk.lower()
            ids = self.parts.get(part) or self._part(part)
        elif "<|" in chunk or not self.plain(chunk):
            ids = self._packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        else:
            ids = b"".join([self.parts.get(p) or self._part(p) for p in self.split(chunk.lower())])
        if len(chunk) <= 32:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids

    def _part(self, part: str) -> bytes:
        shown = part if part.isascii() else part.encode().decode("latin1").translate(self.shown)
        ids = self._packed([t.id for t in self.tokenize(shown)])
        if len(self.parts) >= CACHE:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not self.by_chunk or not text.isascii() and not unicodedata.is_normalized("NFC", text):
            return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        for blank in "\n\t\r":
            if blank in text:
                text = text.replace(blank, " ")
        if text.isascii():
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split(" ")))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``crc``."""

    def cut(batches):
        found = _Words(tokenizer)
        end = b"\0\0\0\0"
        for batch in released(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = found.ids(text.as_py() or "") + end
                rows += [(doc, k, at // 4, min(len(ids) - at, 4 * capacity) // 4, zlib.crc32(ids[at : at + 4 * capacity])) for k, at in enumerate(range(0, len(ids), 4 * capacity))]
            ids, *rest = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *[pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]], ["id", "piece", "start", "length", "crc"])

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return small_batches(chosen).mapInArrow(cut, f"id {chosen.schema['id'].dataType.simpleString()}, piece int, start long, length long, crc long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, each bin's fill. Sizes are integers of at most ``capacity``."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    rooms = 0  # bit r: a bin has r left
    for item in np.argsort(-sizes, kind="stable"):
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = at, fills[at]
        fills[at] += size
        left = room - size
        if left:
            free[left].append(at)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound on the number of bins that two families of dual feasible functions give.

    For each threshold e up to half the capacity, items over capacity - e count as whole bins and items under e as nothing; for
    each k, sizes are rounded to multiples of 1 / k of the capacity as such a function allows.
    """
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    for e in np.flatnonzero(count[: capacity // 2 + 1]):
        value = np.where(size > capacity - e, capacity, np.where(size < e, 0, size))
        best = max(best, -(-int((count * value).sum()) // capacity))
    for k in range(1, 33):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (with ``length`` of 1 to ``capacity`` and a unique ``row``) with ``sequence_id`` and ``offset``."""
    columns = pieces.columns
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")})
    rest, placed = pieces.filter(F.col("length") < capacity), [full]

    def packed(turn: int, last: bool):
        def one(key: tuple[pa.Scalar, ...], items: pa.Table) -> pa.Table:
            give_back()
            items = items.sort_by("row")
            sizes = items["length"].to_numpy()
            bins, offsets, fills = best_fit(sizes, capacity)
            if last:
                stay = np.ones(len(fills), bool)
            elif len(fills) == lower_bound(sizes, capacity):
                stay = np.arange(len(fills)) != np.argmin(fills)
            else:
                stay = fills == capacity
            ids = (turn << 56) + (key[0].as_py() << 24) + bins
            return items.select(columns).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets)).append_column("stay", pa.array(stay[bins]))

        return one

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, stay boolean"
    for turn in range(1, rounds + 1):
        parts = max(1, -(-rest.count() // group))
        last = parts == 1 or turn == rounds
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(parts)))
        tried = materialize(dealt.groupBy("part").applyInArrow(packed(turn, last), schema), "packed")
        placed.append(tried.filter("stay").drop("stay"))
        if last:
            break
        rest = tried.filter("not stay").select(*columns)
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack: one row per piece, ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``tokenizer`` is the path of a tokenizer file of the form of word_bpe_49k.json, at the same place on each machine. A document's
    ids are followed by id 0, so null and empty texts are one id. Documents over ``capacity`` ids are cut. Repeated rows are packed
    as often as they occur, and a null id is kept. An empty table gives no rows. Other columns of ``docs`` aren't read.
    """
    pieces = token_pieces(docs, tokenizer, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    out = pack(pieces, capacity)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
