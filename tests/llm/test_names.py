"""Columns of the input that have the names which an operator uses itself."""

import numpy as np
import pytest

from palisade.llm import exact_dedup, line_dedup, ngram_join, source_mixing, toxicity

NAMES = ["__id", "__id2", "__text", "__text2", "__gone", "__key", "__source", "__t1", "__t2", "__d1", "__d2", "__sha", "__n", "rate", "cdf", "draws", "row", "key", "ident", "id", "at", "h1", "h2", "gone", "n", "d1", "d2", "best", "template", "digests", "copy", "a.b"]
BASE = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def clashing(spark):
    line = "job 7 done in the usual place today"
    rows = [(k, f"some words of text {k} here\n{line}" if k % 2 else "the same text in many rows of it", "a", *[f"{n}{k}" for n in NAMES]) for k in range(24)]
    return spark.createDataFrame(rows, ", ".join([BASE, *[f"`{n}` string" for n in NAMES]]))


@pytest.mark.parametrize("apply", [source_mixing.mix_sources, line_dedup.drop_recurring_lines, ngram_join.jaccard_dedup, exact_dedup.exact_dedup])
def test_clashing_names(clashing, apply):
    plain = apply(clashing.select("doc_id", "text", "source"))
    full = apply(clashing)
    extra = [c for c in plain.columns if c not in ("doc_id", "text", "source")]
    got = full.collect()
    assert full.columns == [*clashing.columns, *extra] and got
    assert sorted(tuple(r[c] for c in plain.columns) for r in got) == sorted(tuple(r) for r in plain.collect())
    assert all(r[n] == f"{n}{r['doc_id']}" for r in got for n in NAMES)


def test_empty_texts_have_no_features_beside_others(spark):
    rows = [(1, ""), (2, "you are a STUPID fool!"), (3, None), (4, ""), (5, "  "), (6, "")]
    lexicon = np.sort(toxicity.word_hashes(["stupid"]))
    df = spark.createDataFrame([(str(i), t or "") for i, t in rows], "id string, text string").coalesce(1)
    seen = {r["id"]: [r[f] for f in toxicity.FEATURES] for r in toxicity.add_features(df, lexicon, np.ones(1)).collect()}
    assert all(not any(seen[i]) for i in ("1", "3", "4", "6")) and any(seen["2"])
