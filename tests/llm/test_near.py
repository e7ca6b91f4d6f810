import random

import numpy as np
import pytest

from palisade.llm import components as C
from palisade.llm import embedding_dedup as V
from palisade.llm import ngram_join as N
from palisade.llm.components import connected_components
from tests.llm.conftest import words


def shingles(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


@pytest.mark.parametrize(("rare", "rounds"), [(N.RARE, N.ROUNDS), (1, 1), (0, 0)])
def test_groups(docs, rows, rare, rounds, monkeypatch):
    monkeypatch.setattr(N, "RARE", rare)  # with 0, all goes by combinations
    monkeypatch.setattr(N, "ROUNDS", max(rounds, 1))
    monkeypatch.setattr(N, "CHUNK", 4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_groups(docs).collect()}
    assert got == brute({i: t for i, t, *_ in rows})


def test_many_edits_near_the_threshold(spark, monkeypatch):
    rng = random.Random(4)
    base, texts = words(rng, 60).split(), {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        texts[i] = " ".join(w[rng.randrange(0, 5) :])
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    monkeypatch.setattr(N, "RARE", 3)
    monkeypatch.setattr(N, "CHUNK", 16)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_groups(df).collect()} == brute(texts)


def test_dedup_keeps_one_of_each_group(docs, rows):
    want = {i for i, (_, c) in brute({i: t for i, t, *_ in rows}).items() if i == c}
    out = N.jaccard_dedup(docs)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == want


def test_repeated_rows_and_null_ids(spark, none):
    t = "a b c d e f g"
    df = spark.createDataFrame([(1, t, "x"), (1, t, "x"), (None, t, "x"), (2, "", "x"), (3, None, "x")], "doc_id bigint, text string, component string")
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in N.jaccard_groups(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 2), (3, 3)]
    assert sorted(r["doc_id"] for r in N.jaccard_dedup(df).collect()) == [1, 2, 3]
    assert N.jaccard_groups(none).count() == 0 and N.jaccard_dedup(none).count() == 0


def in_files(spark, tmp_path, files):
    """A table of one file per list of rows."""
    for rows in files:
        spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


def test_same_texts_in_another_order(spark, tmp_path):
    rng = random.Random(5)
    a, b = words(rng, 40), words(rng, 40)
    df = in_files(spark, tmp_path, [[(1, a), (2, b)], [(3, b), (4, a)]])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_groups(df).collect()} == brute({1: a, 2: b, 3: b, 4: a})
    assert sorted(r["doc_id"] for r in N.jaccard_dedup(df).collect()) == [1, 2]
    sets = {(r["p1"], r["p2"]): r for r in N.document_sets(df, "doc_id", "text").collect() if r["tokens"] is not None}
    assert [len(r["tokens"]) for r in sets.values()] == [36, 36] and len({t for r in sets.values() for t in r["tokens"]}) == 72


def test_blocks_of_one_text(spark, tmp_path):
    text = words(random.Random(6), 200)
    df = in_files(spark, tmp_path, [[(1000 * k + i, text) for i in range(1000)] for k in range(4)])
    rows = N.document_sets(df, "doc_id", "text").collect()
    held = [r for r in rows if r["tokens"] is not None]
    assert len(rows) == 4000 and len({r["number"] for r in rows}) == 4000
    assert 4 <= len(held) < 20 and {len(r["tokens"]) for r in held} == {196} and len({(r["p1"], r["p2"]) for r in rows}) == 1
    assert {(r["n_shingles"], r["component_id"]) for r in N.jaccard_groups(df).collect()} == {(196, 0)}
    assert [r["doc_id"] for r in N.jaccard_dedup(df).collect()] == [0]


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (2, " \n"), (None, "")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in N.jaccard_groups(df).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (2, 0, 2)]
    assert N.jaccard_dedup(df).count() == 4


def test_rows_that_share_an_id_are_told_by_text(spark):
    a, b, c = "a b c d e f g", "q r s t u v w x", "A b c  d e f g"
    rows = [(3, a), (5, a), (5, b), (7, c), (7, b), (None, b), (None, "only here once you see"), (8, ""), (8, ""), (9, None)]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, p1 string, best string")
    out = N.jaccard_dedup(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == sorted([(3, a), (5, b), (0, "only here once you see"), (8, ""), (8, ""), (9, "")])
    again = N.jaccard_dedup(spark.createDataFrame([(1, a), (1, a), (1, c), (2, a)], "doc_id bigint, text string"))
    assert len(again.collect()) == 1 and again.first()["doc_id"] == 1


@pytest.mark.parametrize("columns", [N.COLUMNS, 3])
def test_frequent_tokens_in_columns(spark, monkeypatch, columns):
    rng = random.Random(9)
    passage = words(rng, 40).split()
    texts = {i: " ".join([*passage[: 30 + rng.randrange(10)], *words(rng, rng.randrange(3, 14)).split()]) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    monkeypatch.setattr(N, "RARE", 0)
    monkeypatch.setattr(N, "CHUNK", 16)
    monkeypatch.setattr(N, "COLUMNS", columns)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.jaccard_groups(df).collect()} == brute(texts)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(900, 900)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    nodes = {x for e in edges for x in e}
    assert got == components(nodes, edges)


@pytest.mark.parametrize("few", [0, 100_000])
def test_merged_components_run_over_components(spark, monkeypatch, few):
    """Later links join components; the rounds see one edge for each pair of these, however many nodes they hold."""
    monkeypatch.setattr(C, "FEW_EDGES", few)
    seen, inner = [], C.connected_components
    monkeypatch.setattr(C, "connected_components", lambda edges: seen.append(edges.count()) or inner(edges))
    frame = lambda edges: spark.createDataFrame(edges, "u bigint, v bigint")
    first = [(0, k) for k in range(1, 200)] + [(300, k) for k in range(301, 500)] + [(600, 601)]
    later = [(k, 300 + k) for k in range(1, 60)] + [(700, 499), (800, 801), (801, 802)]
    groups = C.merged_components(None, frame(first))
    got = {r["node"]: r["component"] for r in C.merged_components(groups, frame(later)).collect()}
    assert got == components({x for e in first + later for x in e}, first + later)
    assert seen == [len(first), 4]


def test_few_edges_need_no_shuffle(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(900, 900)]
    table = spark.createDataFrame(edges, "u bigint, v bigint")
    few = C.connected_components(table)
    assert "Exchange" not in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(C, "FEW_EDGES", 0)
    many = C.connected_components(table)
    assert sorted(few.collect()) == sorted(many.collect())


def vectors():
    rng = np.random.default_rng(3)
    out, centers = [], rng.standard_normal((12, 16))
    for i in range(240):
        v = centers[i % 12] + rng.standard_normal(16) * (0.02 + 0.1 * (i % 5))
        out.append((i, [float(np.float32(x)) for x in v], None if i % 40 == 7 else i % 2))
    out += [(240, out[0][1], 0), (241, out[0][1], 0), (242, None, 0), (243, [0.0] * 16, 0), (244, [float("nan")] + [1.0] * 15, 0), (245, [None] + [1.0] * 15, 0), (246, [], 0), (247, [1.0, 2.0], 0), (248, [2.0, 4.0], 0), (249, [float("inf")] * 16, 0)]
    return out


def brute_vectors(rows):
    unit = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[i] = (np.array(v) / np.linalg.norm(v), label)
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.98]
    comp = components([i for i, *_ in rows], links)
    return {i: (sum(i in e for e in links), comp[i], comp[i] == i) for i, *_ in rows}


@pytest.mark.parametrize("chunk", [V.CHUNK, 3])
def test_vectors(spark, chunk, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", chunk)
    df = spark.createDataFrame([(i, v, label, 1) for i, v, label in vectors()], "vec_id bigint, embedding array<float>, label int, node int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.near_duplicates(df).collect()}
    assert got == brute_vectors(vectors())
    assert V.near_duplicates(df.limit(0)).count() == 0


def test_repeated_vectors_null_ids_and_clashing_names(spark):
    rows = [(1, [1.0, 0.0], 0, 9, "a"), (1, [1.0, 0.0], 0, 9, "a"), (None, [1.0, 0.0], 0, 9, "b"), (None, [0.0, 1.0], 0, 9, "b"), (2, [0.0, 1.0], None, 9, "c"), (3, [1.0, 1e-9], 1, 9, "c")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, node int, component string")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in V.near_duplicates(df).collect()))
    assert got == [(0, 0, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_recall_on_a_table(spark):
    """All links of the test table and of copies of its vectors with noise, close to the threshold on either side, found by all products."""
    import os

    from tests.compare import DATA

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in table.collect()]
    rng = np.random.default_rng(12)
    for k, (_, v, label) in enumerate(rows[:300]):
        x = np.array(v)
        noise = rng.standard_normal(len(x))
        rows.append((10**6 + k, [float(np.float32(y)) for y in x + noise * np.linalg.norm(x) / np.linalg.norm(noise) * (0.1 + 0.15 * k / 300)], label))
    want = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in V.near_duplicates(df).collect()}
    assert got == want and sum(n for n, *_ in want.values()) > 200


def test_tables_reach_the_recall():
    for n in (0, 10, 10**5, 10**9):
        bits, tables = V.tables_for(n)
        assert (1 - (1 - np.arccos(0.98) / np.pi) ** bits) ** tables <= V.MISS
