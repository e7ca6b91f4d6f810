import hashlib
import re

import pytest

from palisade.llm import fill_middle as M
from tests.compare import DATA, same

TOKENS = {"letters": r"[A-Za-z]+|[^A-Za-z]", "words": r"\S+|\s+", "lines": r"[^\n]*\n|[^\n]+", "characters": r"[\s\S]"}


def brute(doc_id, text, grammar="letters", rate=90, spm=20):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    u = re.findall(TOKENS[grammar], text)
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, None, text
    lo, hi = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(u), form, p, m, s, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "ab", " ", "\n", "\n\n a\tb\r\n", "don't stop", "𝒜b𝒞 \U0001f600\U0001f600x", "é", "a<P>b", "<S", "x <M> y", "<<P", "P>a<S>", "word " * 3000, "<P", "a\x00b"]


@pytest.mark.parametrize("grammar", sorted(TOKENS))
def test_against_loop(spark, grammar):
    rows = [(k, TEXTS[k % len(TEXTS)], "extra") for k in range(200)] + [(None, "no id here", "e"), (5, "a", "e"), (5, "a", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, u string").repartition(3)
    got = sorted(((r["row"]["doc_id"], r["row"]["text"], r["n"], r["form"], r["prefix"], r["middle"], r["suffix"], r["output"]) for r in M.fill_in_middle(df, grammar=grammar).collect()), key=str)
    assert got == sorted(((i, t, *brute(i, t, grammar)) for i, t, _ in rows), key=str)


def test_round_trip_and_rates(spark):
    df = spark.createDataFrame([(k, f"some words {k} and more of them, to be cut") for k in range(2000)], "doc_id bigint, text string")
    made = M.fill_in_middle(df)
    assert made.filter(M.restored(made["output"], made["form"]) != made["row.text"]).isEmpty()
    n = {r["form"]: r["count"] for r in made.groupBy("form").count().collect()}
    assert 140 < n["plain"] < 260 and 280 < n["spm"] < 440
    assert {r["form"] for r in M.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r["form"] for r in M.fill_in_middle(df, rate=100, spm=100).collect()} == {"spm"}


def test_boundaries_of_units(spark):
    cases = [("letters", "ab1c", ["ab", "1", "c"]), ("words", " ab  c", [" ", "ab", "  ", "c"]), ("lines", "a\n\nb", ["a\n", "\n", "b"]), ("lines", "a\n", ["a\n"]), ("characters", "é\U0001f600", ["é", "\U0001f600"])]
    df = spark.createDataFrame([(c[1],) for c in cases], "t string")
    for grammar, text, want in cases:
        assert df.filter(df["t"] == text).select(M.units(df["t"], M.GRAMMARS[grammar]).alias("u")).first()["u"] == want


def test_clashing_names_and_empty_table(spark, none):
    names = ["row", "t", "h", "u", "n", "form", "lo", "hi", "prefix", "middle", "suffix", "output", "a.b"]
    df = spark.createDataFrame([(1, "some text here", *map(str, range(len(names))))], ", ".join(["doc_id bigint", "text string", *[f"`{c}` string" for c in names]]))
    row = M.fill_in_middle(df).first()
    assert row["row"]["output"] == "11" and row["output"] == brute(1, "some text here")[-1]
    assert M.fill_in_middle(none).count() == 0


def test_query_and_sql(spark):
    assert same(M.op11_fill_middle(spark, DATA), M.OP11_SQL, DATA) > 0
