"""Texts in compressed blocks, which the operators on shingles and strings parse more than once.

What such an operator learns of a text's parts travels by part and comes back to the block that holds the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrays import buffers, ranges, released
from palisade.llm.common import small_batches

#: Bytes of texts in a block. Of equal parts of a block one travels, so this bounds what meets of a part that all texts hold.
BLOCK = 4 << 20


def text_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of consecutive rows of ``rows(text, ...)``: ``block``, an array for each other column, ``ends`` and compressed ``data``.

    The numbers of the blocks hold only once the result is materialised.
    """
    keep = [f for f in rows.schema if f.name != "text"]

    def cut(batches):
        for batch in released(batches):
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            data, offsets = buffers(at["text"])
            for first, last in ranges(offsets, BLOCK):
                lo, hi = int(offsets[first]), int(offsets[last])
                n = last - first
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), at[f.name].slice(first, n)) for f in keep]
                ends = (offsets[first + 1 : last + 1] - lo).astype(np.int64).tobytes()
                packed = pa.compress(data[lo:hi].tobytes(), codec="zstd", asbytes=True)
                yield pa.RecordBatch.from_arrays([*lists, pa.array([ends], pa.binary()), pa.array([packed], pa.binary())], [*[f.name for f in keep], "ends", "data"])

    schema = [f"`{f.name}` array<{f.dataType.simpleString()}>" for f in keep]
    return small_batches(rows).mapInArrow(cut, ", ".join([*schema, "ends binary", "data binary"])).withColumn("block", F.monotonically_increasing_id())


def texts_of(ends: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's bytes and the offsets of its texts."""
    offsets = np.concatenate([[0], np.frombuffer(ends, np.int64)])
    size = int(offsets[-1])
    return (np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)), offsets


def planes(x: np.ndarray, width: int) -> bytes:
    """The upper ``width`` bytes of integers, bytes of equal weight together, which compresses well when ``x`` is sorted."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1)[:, -width:].T).tobytes()


def from_planes(b: bytes, width: int, dtype=np.uint64) -> np.ndarray:
    held = np.frombuffer(b, np.uint8).reshape(width, -1)
    out = np.zeros((held.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, -width:] = held.T
    return out.view(dtype).ravel()
