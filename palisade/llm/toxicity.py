"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned from labelled texts: words that occur in a larger share of toxic texts than of others. The features are its
density, the density of its hits near a second-person word, and the rates of capitals, punctuation and obfuscated words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrays import LOWER, buffers, ranges, released, words
from palisade.llm.common import discard, held_out, materialize, small_batches, table

#: Labelled rows that learning reads, in the mean, drawn by a hash of the id; this bounds the lexicon and the trees too.
TRAIN_ROWS = 20_000
#: Words of the lexicon at most; a word must be in so many toxic texts, and in so many times the share of other texts.
LEXICON = 400
LEAST_TEXTS = 4
LEAST_RATIO = 4.0
#: A hit within so many words of a second-person word is aimed at the reader.
NEAR = 4
#: Second-person words of the languages at hand.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "vous", "votre", "tú", "ti", "usted", "ustedes", "vosotros")
FEATURES = ("hits", "hit_rate", "weight", "weight_rate", "most", "aimed", "aimed_rate", "capitals", "shouted", "marks", "exclaims", "obfuscated", "log_words")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?.,;:*#$%&@-_")] = True
_DISGUISE = np.zeros(256, bool)
_DISGUISE[list(b"0123456789@$*!+")] = True


def word_hashes(texts: list[str]) -> np.ndarray:
    """Signed 64-bit hashes of single words, as the features see them."""
    data = LOWER[np.frombuffer("\n".join(texts).encode(), np.uint8)]
    return words(data, _LETTER, np.zeros(0, np.int64))[0].view(np.int64)


def _word_counts(rows: DataFrame) -> DataFrame:
    """``word, toxic, n``: in how many texts of ``rows(text, toxic)`` each word occurs."""

    def count(batches):
        for batch in released(batches):
            data, offsets = buffers(batch.column(0))
            toxic = np.array(batch.column(1).to_pylist(), np.int64)
            for first, last in ranges(offsets):
                low = LOWER[data[offsets[first] : offsets[last]]]
                cuts = offsets[first : last + 1] - offsets[first]
                hashes, starts, _ = words(low, _LETTER, cuts[:-1])
                owner = np.searchsorted(cuts, starts, "right") - 1
                pairs = np.unique(np.rec.fromarrays([hashes.view(np.int64), owner]))
                found, n = np.unique(np.rec.fromarrays([pairs.f0, toxic[first:last][pairs.f1]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.f0), pa.array(found.f1), pa.array(n)], ["word", "toxic", "n"])

    return small_batches(rows).select("text", "toxic").mapInArrow(count, "word long, toxic long, n long").groupBy("word", "toxic").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lexicon's words, sorted, and their log ratios. ``rows(text, toxic)``."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    both = _word_counts(rows).groupBy("word").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("bad"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("good"))
    ratio = (F.col("bad") + 0.5) / (sizes.get(1, 0) + 1) / ((F.col("good") + 0.5) / (sizes.get(0, 0) + 1))
    best = both.withColumn("ratio", ratio).filter((F.col("bad") >= LEAST_TEXTS) & (F.col("ratio") >= LEAST_RATIO))
    got = best.orderBy(F.desc("bad"), "word").limit(LEXICON).toPandas().sort_values("word")
    return got["word"].to_numpy(np.int64), np.log(got["ratio"].to_numpy(float))


def _features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, weights: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for first, last in ranges(offsets):
        raw = data[offsets[first] : offsets[last]]
        if len(raw) == 0:
            continue
        cuts = offsets[first : last + 1] - offsets[first]
        n = last - first
        hashes, starts, stops = words(LOWER[raw], _LETTER, cuts[:-1])
        owner = np.searchsorted(cuts, starts, "right") - 1

        def per_text(mask, cuts=cuts):
            total = np.concatenate([[0], np.cumsum(mask)])
            return np.diff(total[cuts]).astype(float)

        signed = hashes.view(np.int64)
        at = np.clip(np.searchsorted(lexicon, signed), 0, max(len(lexicon) - 1, 0))
        hit = lexicon[at] == signed if len(lexicon) else np.zeros(len(signed), bool)
        weight = np.where(hit, weights[at], 0.0) if len(lexicon) else np.zeros(len(signed))
        you = np.isin(signed, second)
        close = np.zeros(len(signed), bool)
        for k in range(1, NEAR + 1):
            same = owner[k:] == owner[:-k]
            close[k:] |= you[:-k] & same
            close[:-k] |= you[k:] & same
        count = lambda x: np.bincount(owner, weights=x, minlength=n)
        n_words = np.maximum(np.bincount(owner, minlength=n), 1)
        letters = np.maximum(per_text(_LETTER[raw]), 1)
        n_bytes = np.maximum(np.diff(cuts), 1)
        upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
        shouted = (stops - starts > 2) & (upper[stops] - upper[starts] == stops - starts)
        hidden = np.zeros(len(raw), bool)
        hidden[1:-1] = _DISGUISE[raw[1:-1]] & _LETTER[raw[:-2]] & _LETTER[raw[2:]]
        some = np.diff(cuts) > 0
        hidden[cuts[:-1][some]] = hidden[cuts[1:][some] - 1] = False  # the next byte belongs to another text
        most = np.zeros(n)
        np.maximum.at(most, owner, weight)
        hits, heavy, aimed = count(hit), count(weight), count(hit & close)
        out[first:last] = np.stack(
            [hits, hits / n_words, heavy, heavy / n_words, most, aimed, aimed / n_words, per_text(_UPPER[raw]) / letters, count(shouted) / n_words, per_text(_MARK[raw]) / n_bytes, per_text(raw == 33) / n_bytes, per_text(hidden) / n_words, np.log1p(n_words)],
            axis=1,
        )
        out[first:last][~some] = 0  # whatever stands beside it, an empty text has no features
    return out


def add_features(rows: DataFrame, lexicon: np.ndarray, weights: np.ndarray, inside: tuple[str, int] | None = None) -> DataFrame:
    """All columns of ``rows`` but ``text``, then FEATURES. ``rows`` has no clashing names.

    ``inside``: a struct column and the place of its field that holds the text, which then isn't sent to Python twice.
    """
    second = np.sort(word_hashes(list(SECOND_PERSON)))
    keep = [c for c in rows.columns if c != "text"]

    def compute(batches):
        for batch in released(batches):
            held = batch.column(batch.schema.get_field_index(inside[0] if inside else "text"))
            data, offsets = buffers(held.field(inside[1]) if inside else held)
            got = _features(data, offsets, lexicon, weights, second)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(np.ascontiguousarray(got[:, i])) for i in range(len(FEATURES))], [*keep, *FEATURES])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + [f"{f} double" for f in FEATURES]
    return small_batches(rows).mapInArrow(compute, ", ".join(schema))


class Model:
    """Lexicon, trees and calibration; None for the trees if there was nothing to learn from."""

    def __init__(self, lexicon, weights, trees, calibration):
        self.lexicon, self.weights, self.trees, self.calibration = lexicon, weights, trees, calibration


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labelled rows that aren't held out. A text with several labels is toxic if one says so; null labels don't count."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    marks = marks.groupBy(F.col(id_col).alias("__id")).agg((F.max(F.col(label_col)) > 0).cast("long").alias("toxic"))
    n = marks.count()
    marks = marks.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < int((1 << 30) * min(1, train_rows / max(n, 1))))
    marks = marks.limit(2 * train_rows)  # never reached; it proves the broadcast's bound
    chosen = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(chosen.join(F.broadcast(marks), "__id"), "labelled")
    fit = F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(4)) != 0  # the rest calibrates
    lexicon, weights = learn_lexicon(rows.filter(fit))
    seen = materialize(add_features(rows, lexicon, weights).withColumn("fit", fit).coalesce(8), "labelled-features")
    kinds = {(r["fit"], r["toxic"]) for r in seen.select("fit", "toxic").distinct().collect()}
    trees = calibration = None
    if {(True, 0), (True, 1)} <= kinds:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(seen).withColumn("toxic", F.col("toxic").cast("double"))
        trees = GBTClassifier(featuresCol="x", labelCol="toxic", maxIter=15, maxDepth=3, maxBins=32, stepSize=0.2, seed=3).fit(vectors.filter("fit"))
        raw = trees.transform(vectors.filter("not fit") if {(False, 0), (False, 1)} <= kinds else vectors).withColumn("p", vector_to_array("probability")[1])
        calibration = IsotonicRegression(featuresCol="p", labelCol="toxic", predictionCol="score").fit(raw.select("p", "toxic"))
    discard(rows, seen)
    return Model(lexicon, weights, trees, calibration)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5) and FEATURES of each row of ``docs``.

    Null text counts as empty; an empty text has all features 0 and gets the score of that. Without a model each score is 0. Repeated
    rows and null ids give rows as any other; other columns aren't read.
    """
    chosen = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return _scored(add_features(chosen, model.lexicon, model.weights), model).select(F.col("__id").alias(id_col), "score", "predicted", *FEATURES)


def _scored(seen: DataFrame, model: Model) -> DataFrame:
    """``seen`` with ``score`` and ``predicted`` by its FEATURES."""
    if model.trees is None:
        out = seen.withColumn("score", F.lit(0.0))
    else:
        vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(seen)
        raw = model.trees.transform(vectors).withColumn("p", vector_to_array("probability")[1])
        out = model.calibration.transform(raw)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't predict to be toxic, with their columns, whatever their names. See score_toxicity()."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    seen = add_features(whole, model.lexicon, model.weights, ("__row", docs.columns.index(text_col)))
    return _scored(seen, model).filter("predicted = 0").select("__row.*")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", *FEATURES)
