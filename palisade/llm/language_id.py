"""Language identification by error-correcting output codes.

Each language has a codeword of bits. A binary classifier a bit, linear in the counts of hashed byte trigrams, tells which
languages' bits a text looks like, and loss-weighted decoding takes the nearest codeword. If the second nearest is almost as near,
the prediction is flagged as ambiguous.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrays import LOWER, SLICE, buffers, ranges, released
from palisade.llm.common import discard, held_out, materialize, small_batches, table

BUCKETS = 1 << 14
#: Rows that learning reads, in the mean, drawn by a hash of the id.
TRAIN_ROWS = 20_000
#: Languages up to which the codewords are the best of several draws; of more, the first draw whose codewords differ.
CHOSEN = 256
#: Groups of buckets whose weights are learned at once.
GROUPS = 64
SMOOTHING = 0.5
#: Two codewords are about equally near if their losses differ by less.
AMBIGUOUS = 1.0


def _grams(data: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte."""
    low = LOWER[data].astype(np.uint32)
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 14)


def _slices(offsets: np.ndarray):
    """Ranges of texts and of their bytes; a text over SLICE bytes comes in several, which share two bytes."""
    for first, last in ranges(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        if last - first > 1 or hi - lo <= SLICE:
            yield first, last, lo, hi
        else:
            for at in range(lo, hi, SLICE):
                yield first, last, at, min(at + SLICE + 2, hi)


def _gram_sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The sum of ``weights`` (a row a bucket and one of zeros) over each text's trigrams."""
    out = np.zeros((len(offsets) - 1, weights.shape[1]))
    none = len(weights) - 1
    for first, last, lo, hi in _slices(offsets):
        if hi - lo < 3:
            continue
        grams = _grams(data[lo:hi])
        cuts = np.clip(offsets[first : last + 1] - lo, 0, hi - lo)
        for back in (1, 2):  # trigrams that would reach into the next text
            at = cuts[1:] - back
            grams[at[(at >= 0) & (at < len(grams))]] = none
        total = np.zeros((len(grams) + 1, weights.shape[1]))
        np.cumsum(weights[grams], axis=0, out=total[1:])
        ends = np.minimum(cuts, len(grams))
        out[first:last] += total[ends[1:]] - total[ends[:-1]]
    return out


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all texts of ``rows(text, lang)``."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in released(batches):
            data, offsets = buffers(batch.column(0))
            langs = np.array(batch.column(1).to_pylist(), object)
            for first, last, lo, hi in _slices(offsets):
                if hi - lo < 3:
                    continue
                grams = _grams(data[lo:hi]).astype(np.int64)
                cuts = np.clip(offsets[first : last + 1] - lo, 0, hi - lo)
                owner = np.repeat(np.arange(last - first), np.diff(cuts))[: len(grams)]
                inside = np.arange(len(grams)) + 2 < cuts[1:][owner] if last - first else np.zeros(0, bool)
                for lang in set(langs[first:last]):
                    mine = (langs[first:last] == lang)[owner] & inside
                    got = np.bincount(grams[mine], minlength=BUCKETS)
                    sums[lang] = sums.get(lang, 0) + got
        for lang, got in sums.items():
            some = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(got[some], pa.int64())], ["lang", "bucket", "n"])

    return small_batches(rows).select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """Codewords of -1 and 1 for ``n`` languages: all different columns if few, else random ones, about 10 * log2(n) bits long."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        columns = [[1 - 2 * (c >> i & 1) for i in range(n)] for c in range(2, 2**n, 2)]
        return np.array(columns, np.int8).T
    bits, rng, best, most = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if np.any(np.abs(code.sum(axis=0, dtype=np.int64)) == n):
            continue
        if n > CHOSEN:
            if len(np.unique(code, axis=0)) == n:
                return code
            continue
        near = np.min(((code.astype(float) @ code.T - bits) / -2)[~np.eye(n, dtype=bool)])
        if near > most:
            best, most = code, near
    return best


def bit_weights(counts: DataFrame, langs: list[str], totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Weights of each bit's classifier, a row a bucket: the log ratio of the bucket's mean share in the languages of either value.

    ``counts(lang, bucket, n)`` is worked through by groups of buckets in tasks; what comes back is a number for each bucket and bit,
    of which there are few however many languages there are.
    """
    yes = (code > 0).T.astype(np.float64)
    sides = [m / np.maximum(m.sum(axis=1, keepdims=True), 1) for m in (yes, 1 - yes)]
    whole = totals + SMOOTHING * BUCKETS
    where = {lang: i for i, lang in enumerate(langs)}

    def ratio(share: np.ndarray) -> np.ndarray:
        return (np.log(sides[0] @ share) - np.log(sides[1] @ share)).T.astype(np.float32)

    def learn(rows: pa.Table) -> pa.Table:
        buckets, at = np.unique(rows["bucket"].to_numpy(), return_inverse=True)
        seen = np.full((len(langs), len(buckets)), SMOOTHING)
        seen[[where[x] for x in rows["lang"].to_pylist()], at] += rows["n"].to_numpy()
        got = ratio(seen / whole[:, None])
        return pa.table({"bucket": pa.array(buckets, pa.int32()), "weights": pa.array([w.tobytes() for w in got], pa.binary())})

    out = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    if len(langs) < 2:
        return out
    out[:-1] = ratio((SMOOTHING / whole)[:, None])
    got = counts.groupBy(F.pmod("bucket", F.lit(GROUPS)).alias("g")).applyInArrow(learn, "bucket int, weights binary").collect()  # BUCKETS rows at most
    for row in got:
        out[row["bucket"]] = np.frombuffer(row["weights"], np.float32)
    return out


class Model:
    """Languages, codewords and the bits' weights: BUCKETS * 10 * log2(languages) numbers, a few MB."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray):
        self.langs, self.code, self.weights = langs, code.astype(np.float32), weights

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each text's margin for each bit. Sums over trigrams are divided by the root of their number, as they vary with that."""
        n = np.maximum(np.diff(offsets) - 2, 1)
        return _gram_sums(data, offsets, self.weights) / np.sqrt(n)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """The loss of each codeword, less what is the same for all.

        A bit's loss is log(1 + exp(-margin * bit)). For bits of 1 and -1 it differs by the margin, so the sum over bits is half the
        product of margins and codeword, with its sign changed, and a part that all codewords share.
        """
        return -0.5 * (margins @ self.code.T)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the languages of rows that aren't held out, however many, or None if there are none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("id").isNotNull() & ~held_out(F.col("id")) & F.col("lang").isNotNull())
    n = rows.count()
    rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1, train_rows / max(n, 1))))
    counts = materialize(gram_counts(rows), "gram-counts")
    sums = sorted((r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect())  # a row a language
    langs, totals = [s[0] for s in sums], np.array([s[1] for s in sums], float)
    code = codewords(len(langs))
    model = Model(langs, code, bit_weights(counts, langs, totals, code)) if langs else None
    discard(counts)
    return model


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score``, ``ambiguous`` of each row of ``docs``.

    A text that is null, empty or without any letter is ``und`` with score 0, as is every text without a model. ``score`` is the
    share of the nearest codeword when losses are turned into probabilities. Ties go to the first language by name, and are
    ambiguous. Repeated rows and null ids give rows as any other; other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def predict(batches):
        model = sent.value
        for batch in released(batches):
            has = np.array(batch.column(2).to_pylist(), bool)
            if model is None or not len(has):
                langs, score, unsure = ["und"] * len(has), np.zeros(len(has)), np.zeros(len(has), bool)
            else:
                data, offsets = buffers(batch.column(1))
                margins = model.margins(data, offsets)
                nearest, score, unsure = np.zeros(len(has), np.int64), np.zeros(len(has)), np.zeros(len(has), bool)
                step = max(1, (1 << 20) // len(model.langs))
                for lo in range(0, len(has), step):
                    loss = model.losses(margins[lo : lo + step])
                    rows = np.arange(len(loss))
                    nearest[lo : lo + step] = near = loss.argmin(axis=1)
                    least = loss[rows, near]
                    score[lo : lo + step] = 1 / np.exp(least[:, None] - loss).sum(axis=1)
                    loss[rows, near] = np.inf
                    unsure[lo : lo + step] = loss.min(axis=1) - least < AMBIGUOUS
                score, unsure = np.where(has, score, 0.0), unsure & has
                langs = [model.langs[k] if h else "und" for k, h in zip(nearest, has, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["id", "lang_pred", "score", "ambiguous"])

    kind = chosen.schema["id"].dataType.simpleString()
    out = small_batches(chosen).withColumn("has", letters).mapInArrow(predict, f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("id", id_col)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
