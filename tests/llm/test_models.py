import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import language_id as G
from palisade.llm import packing as P
from palisade.llm import source_mixing as M
from palisade.llm import toxicity as T

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path(P.TOKENIZER)


def pieces(texts):
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(TOKENIZER), []
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        out += [(i, k, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    return sorted(out)


def check_packed(rows, capacity=2048):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values(), default=0) <= capacity
    return len(at)


HARD = ["<|endoftext|> x<|startoftext|>", "don't WE'LL 12 3.5", "é é İIΣΣ σς", "a b c​d\x85e\x1cf", "ªº×÷ß\x00\x07", "...). \"q\"!?--", "日本語 テキスト 👍🏽", "퟿￿", "a\r\nb\tc\x0bd\x0ce"]


def test_tokens(spark, docs, rows):
    texts = [(i, t) for i, t, *_ in rows] + [(1000 + k, t) for k, t in enumerate(HARD)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    out = P.pack_documents(df, TOKENIZER).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces(texts)
    n = check_packed(out)
    assert P.lower_bound(np.array([r["length"] for r in out]), 2048) <= n <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_small_caches(monkeypatch, rows):
    from tokenizers import Tokenizer

    monkeypatch.setattr(P, "CACHE", 3)
    found, tok = P._Words(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _, t, *_ in rows[:30]:
        assert found.ids(t or "") == np.array(tok.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_other_tokenizers_encode_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    other = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    assert P._Words(TOKENIZER).by_chunk
    other["normalizer"] = None
    path = tmp_path / "other.json"
    path.write_text(json.dumps(other))
    found, tok = P._Words(str(path)), Tokenizer.from_file(str(path))
    assert not found.by_chunk
    for t in HARD:
        assert found.ids(t) == np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_of_nulls_and_clashing_names(spark):
    rows = [(None, "a b", 7, "x"), (None, None, 8, "y"), (1, "word " * 5000, 9, None), (1, "word " * 5000, 9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, row bigint, part string").repartition(2)
    out = P.pack_documents(df, TOKENIZER).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == [(i or 0, *rest) for i, *rest in sorted(pieces([(i or 0, t) for i, t, *_ in rows]))]
    check_packed(out)


def test_mixing_of_null_texts_and_repeats(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", None), (None, "x", "a")], "doc_id bigint, text string, source string")
    out = M.mix_sources(df, total=400.0).collect()
    assert {r["text"] for r in out} == {None, "", "x"} and len([r for r in out if r["doc_id"] == 1]) % 2 == 0


def test_pack_exchanges(spark, none):
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1500, 3000)
    df = spark.createDataFrame([(int(i), int(s)) for i, s in enumerate(sizes)], "row bigint, length bigint")
    out = P.pack(df, group=200).collect()
    assert len(out) == 3000
    n = check_packed(out)
    assert n <= P.lower_bound(sizes, 2048) * 1.01 + 1
    assert P.pack_documents(none, TOKENIZER).count() == 0


def test_bounds():
    assert P.lower_bound(np.array([1100] * 7), 2048) == 7  # more than the 4 that their sum needs
    assert P.lower_bound(np.array([700] * 6), 2048) == 3
    bins, offsets, fills = P.best_fit(np.array([1000, 1048, 2000, 48]), 2048)
    assert len(fills) == 2 and sorted(fills.tolist()) == [2048, 2048] and offsets[3] == 2000


def test_mixing(spark, none):
    rows = [(i, f"t{i}", "en", "big" if i % 5 else None, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, mix_copy bigint")
    out = M.mix_sources(df, total=8000.0)
    again = M.mix_sources(df.repartition(7), total=8000.0)
    got = out.groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    want = {s: 8000 * np.sqrt(c) / (np.sqrt(3200) + np.sqrt(800)) for s, c in (("big", 3200), (None, 800))}
    assert all(abs(n[s] - w) < 5 * np.sqrt(w) for s, w in want.items())
    key = lambda d: sorted((r["doc_id"], r["mix_copy"]) for r in d.select("doc_id", "mix_copy").collect())
    assert key(out) == key(again)
    order = [r["doc_id"] for r in out.select("doc_id").limit(500).collect()]
    assert order != sorted(order)
    assert M.mix_sources(df, {"big": 1.0}).filter("source is null").count() == 0
    assert M.mix_sources(df, {}).count() == 0 and M.mix_sources(none).count() == 0


def test_large_means(spark):
    df = spark.createDataFrame([(i, "s") for i in range(50)], "doc_id bigint, source string")
    n = M.mix_sources(df, total=50 * 500.0).count()
    assert abs(n - 25000) < 5 * np.sqrt(25000)


def test_bounded_broadcast_has_another_way(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 7}") for i in range(200)], "doc_id bigint, source string")
    few = M.mix_sources(df).count()
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 3)
    assert M.mix_sources(df).count() == few


def labelled(spark, n=900):
    rng = np.random.default_rng(5)
    plain, bad = [f"w{k}" for k in range(300)], ["vile", "scumbag", "moron"]
    plain = ["".join(chr(97 + int(c)) for c in str(k * 7919)) for k in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = list(rng.choice(plain, 40))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.integers(40)] = str(rng.choice(bad))
        docs.append((i, " ".join(w), int(toxic), i))
        labels.append((i, int(toxic)))
    docs += [(n, None, 0, 0), (n + 1, "", 0, 0), (None, "you moron vile scumbag", 1, 0), (0, docs[0][1], 1, 0)]
    labels += [(0, 1), (None, 1), (5, None), (n + 5, 1)]
    return spark.createDataFrame(docs, "doc_id bigint, text string, score int, hits bigint"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = T.train(docs, labels)
    out = T.score_toxicity(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    right = [r["predicted"] == (r["doc_id"] % 6 == 0) for r in held]
    assert len(held) > 100 and np.mean(right) > 0.97
    kept = T.keep_clean(docs, model)
    assert kept.schema == docs.schema and kept.count() == sum(1 - r["predicted"] for r in out)
    assert {r["predicted"] for r in out if r["doc_id"] in (900, 901)} == {0}


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 30)
    model = T.train(docs, labels.limit(0))
    assert {r["score"] for r in T.score_toxicity(docs, model).collect()} == {0.0}
    assert T.score_toxicity(docs.limit(0), model).count() == 0


def test_features():
    text = ["You are a Moron! idi0t SHOUT", "", "plain words here"]
    data = np.frombuffer("".join(text).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in text]])
    lexicon = np.sort(T.word_hashes(["moron"]))
    got = dict(zip(T.FEATURES, T._features(data, offsets, lexicon, np.array([2.0]), np.sort(T.word_hashes(["you"]))).T, strict=True))
    assert got["hits"].tolist() == [1, 0, 0] and got["aimed"].tolist() == [1, 0, 0] and got["most"].tolist() == [2, 0, 0]
    assert got["shouted"][0] > 0 and got["exclaims"][0] > 0 and got["obfuscated"][0] > 0 and got["capitals"][2] == 0


def naive_features(text, lexicon, second):
    """FEATURES by plain loops; ``lexicon`` maps words to weights."""
    raw = text.encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    words, k = [], 0
    while k < len(low):
        if letter(low[k]):
            end = k
            while end < len(low) and letter(low[end]):
                end += 1
            words.append((low[k:end].decode(errors="replace"), raw[k:end]))
            k = end
        else:
            k += 1
    weight = [lexicon.get(w, 0.0) for w, _ in words]
    hit = [w in lexicon for w, _ in words]
    close = [any(words[j][0] in second for j in range(max(0, i - T.NEAR), min(len(words), i + T.NEAR + 1)) if j != i) for i in range(len(words))]
    n = max(len(words), 1)
    aimed = sum(h and c for h, c in zip(hit, close, strict=True))
    letters, size = max(sum(map(letter, raw)), 1), max(len(raw), 1)
    hidden = sum(raw[k] in b"0123456789@$*!+" and letter(raw[k - 1]) and letter(raw[k + 1]) for k in range(1, len(raw) - 1))
    shouted = sum(len(r) > 2 and all(65 <= c <= 90 for c in r) for _, r in words)
    caps, marks = sum(65 <= c <= 90 for c in raw), sum(c in b"!?.,;:*#$%&@-_" for c in raw)
    return [sum(hit), sum(hit) / n, sum(weight), sum(weight) / n, max([0.0, *weight]), aimed, aimed / n, caps / letters, shouted / n, marks / size, raw.count(b"!") / size, hidden / n, np.log1p(n)]


def test_features_against_brute_force():
    rng = np.random.default_rng(6)
    vocabulary = ["you", "Moron", "idi0t", "SHOUT", "été", "vile!", "plain", "du", "a", "?", "x@y", "\n", "NO"]
    texts = ["", " ", "é"] + [" ".join(rng.choice(vocabulary, rng.integers(1, 40))) for _ in range(60)]
    lexicon = {"moron": 2.0, "vile": 1.5, "été": 0.5}
    second = {"you", "du"}
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    hashes = T.word_hashes(list(lexicon))
    order = np.argsort(hashes)
    got = T._features(data, offsets, hashes[order], np.array(list(lexicon.values()))[order], np.sort(T.word_hashes(list(second))))
    want = np.array([naive_features(t, lexicon, second) for t in texts])
    assert np.allclose(got, want), [(T.FEATURES[j], texts[i]) for i, j in np.argwhere(~np.isclose(got, want))][:5]


def test_scores_against_the_trees_one_by_one(spark):
    from pyspark.ml.linalg import Vectors

    docs, labels = labelled(spark)
    model = T.train(docs, labels)
    bounds, values = model.calibration.boundaries.toArray(), model.calibration.predictions.toArray()
    rows = T.score_toxicity(docs, model).collect()
    for r in rows[:: max(1, len(rows) // 60)]:
        x = Vectors.dense([r[f] for f in T.FEATURES])
        margin = sum(w * tree.predict(x) for w, tree in zip(model.trees.treeWeights, model.trees.trees, strict=True))
        p = 1 / (1 + np.exp(-2 * margin))
        assert abs(r["score"] - np.interp(p, bounds, values)) < 1e-9 and r["predicted"] == (r["score"] >= 0.5)


def languages(n=400):
    rng = np.random.default_rng(8)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst", "ee": "abfgk", "ff": "uvwxy", "gg": "éèàçù"}
    return [(i, " ".join("".join(rng.choice(list(letters[lang]), 6)) for _ in range(20)), lang) for i in range(n) for lang in [sorted(letters)[i % 7]]]


@pytest.mark.parametrize("kept", [7, 3, 1])
def test_languages(spark, kept):
    rows = [(i, t, lang, "x") for i, t, lang in languages() if sorted({r[2] for r in languages(7)}).index(lang) < kept]
    odd = [(10_000, None, None, "x"), (10_001, "", None, "x"), (10_002, "12 !?", "aa", "x"), (None, rows[0][1], None, "x")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, lang_pred string")
    out = {r["doc_id"]: r for r in G.identify(df, G.train(df)).collect()}
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (10_000, 10_001, 10_002))
    held = [(i, lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[None]["lang_pred"] == rows[0][2]


def test_many_languages(spark):
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows, n = [], 300
    for lang in range(n):
        own = ["".join(rng.choice(letters, 5)) for _ in range(12)]
        rows += [(lang + n * k, " ".join(rng.choice(own, 40)), f"l{lang:03d}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = G.train(df)
    assert len(model.langs) == n > G.CHOSEN
    out = {r["doc_id"]: r["lang_pred"] for r in G.identify(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i] == lang for i, lang in held]) > 0.95


def test_languages_against_brute_force(spark):
    """Counts, weights, margins and decoding with plain loops."""
    rows = [(i, t, lang) for i, t, lang in languages(120)] + [(900, "abcde " * 3 + "é", "aa"), (901, "zz", "bb"), (902, "x", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = G.train(df)

    def buckets(text):
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        return [((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 18 for k in range(len(b) - 2)]

    langs = sorted({lang for i, _, lang in rows if lang and zlib.crc32(str(i).encode()) % 5})
    counts = np.zeros((len(langs), G.BUCKETS))
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            np.add.at(counts[langs.index(lang)], buckets(text), 1)
    share = (counts + G.SMOOTHING) / (counts + G.SMOOTHING).sum(axis=1, keepdims=True)
    code = G.codewords(len(langs))
    want = {}
    for i, text, _ in rows:
        found = buckets(text)
        margins = [sum(np.log(share[code[:, k] > 0, g].mean()) - np.log(share[code[:, k] < 0, g].mean()) for g in found) / max(1, len(found)) ** 0.5 for k in range(code.shape[1])]
        losses = [sum(np.log1p(np.exp(-m * c)) for m, c in zip(margins, word, strict=True)) for word in code]
        order = np.argsort(losses)
        want[i] = (langs[order[0]], 1 / sum(np.exp(losses[order[0]] - x) for x in losses), losses[order[1]] - losses[order[0]] < G.AMBIGUOUS)
    for r in G.identify(df, model).collect():
        lang, score, unsure = want[r["doc_id"]]
        assert abs(r["score"] - score) < 1e-4
        if not unsure:
            assert (r["lang_pred"], r["ambiguous"]) == (lang, False)


def test_languages_without_rows(spark, none, docs):
    assert G.train(none) is None
    assert {r["lang_pred"] for r in G.identify(docs, None).collect()} == {"und"} and G.identify(none, None).count() == 0


def test_long_text_in_slices(monkeypatch):
    data = np.frombuffer(b"abcdefghijkl" * 500, np.uint8)
    offsets = np.array([0, 4000, 4001, 6000])
    weights = np.random.default_rng(1).random((G.BUCKETS + 1, 2))
    weights[-1] = 0
    whole = G._gram_sums(data, offsets, weights)
    monkeypatch.setattr(G, "SLICE", 100)
    monkeypatch.setattr("palisade.llm.language_id.ranges", lambda o: [(k, k + 1) for k in range(len(o) - 1)])
    assert np.allclose(G._gram_sums(data, offsets, weights), whole)
    assert np.allclose(whole[0], weights[G._grams(data[:4000])].sum(axis=0))


def test_codewords():
    for n in (2, 4, 7, 40):
        code = G.codewords(n)
        assert len({tuple(r) for r in code}) == n and F is not None
