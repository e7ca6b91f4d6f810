import hashlib
import re
from collections import defaultdict

from palisade.llm import exact_dedup as E
from tests.llm.conftest import DOCUMENTS


def brute(rows):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t, *_ in rows]
    groups = defaultdict(list)
    for (i, *_), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, *_), t in zip(rows, norm, strict=True)}


def test_groups(docs, rows):
    for size in (7, E.BLOCK_BYTES):  # small blocks need many levels
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in E.exact_groups(docs, block_bytes=size).collect()}
        assert got == brute(rows)


def test_kept_rows(docs, rows):
    want = {i for i, r in brute(rows).items() if r[2]}
    out = E.exact_dedup(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


def test_repeated_rows_null_ids_clashing_names(spark):
    data = [(1, "a b"), (1, "a b"), (2, "a  b"), (None, "a\tb"), (None, "c"), (3, None), (4, "")]
    df = spark.createDataFrame([(i, t, i, t) for i, t in data], "doc_id bigint, text string, keep_id bigint, name string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in E.exact_groups(df).collect())
    assert got == sorted([(False, 1, 1, 4, True), (False, 1, 1, 4, False), (False, 2, 1, 4, False), (True, 0, 1, 4, False), (True, 0, 0, 1, True), (False, 3, 3, 2, True), (False, 4, 3, 2, False)])
    out = E.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "c"), (1, "a b"), (3, "")]


def test_empty(none):
    assert E.exact_groups(none).count() == 0 and E.exact_dedup(none).schema == none.schema


def test_colliding_fingerprints_fall_back_to_blocks(docs, rows, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(E, "_fingerprint", lambda df, column: df.withColumns({"fp_a": F.length(column).cast("long"), "fp_b": F.lit(0).cast("long")}))
    got = {r["doc_id"]: r["keep_id"] for r in E.exact_groups(docs).collect()}
    assert got == {i: r[0] for i, r in brute(rows).items()}


def test_schema_is_that_of_documents(docs):
    assert docs.schema.simpleString() == f"struct<{','.join(c.strip().replace(' ', ':') for c in DOCUMENTS.split(','))}>"
