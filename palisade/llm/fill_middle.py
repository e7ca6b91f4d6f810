"""Fill-in-the-middle transformation of texts, cut at the boundaries of a unit grammar.

A grammar says which neighbouring characters belong to one unit, as pairs of character classes. It is translated to one regular expression of
lookarounds that matches the empty string at each boundary, so Spark's split() gives the units and loses no character. Text
without characters has no boundary and no unit, which split() can't express, so it is handled on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import table

#: Grammars of units: pairs of character classes (what regular expressions write in brackets) whose neighbours stay together.
GRAMMARS = {
    "letters": [("A-Za-z", "A-Za-z")],
    "words": [(r"\S", r"\S"), (r"\s", r"\s")],
    "lines": [(r"^\n", r"\s\S")],
    "characters": [],
}
#: Markers of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts, how many aren't left plain; of 100 of these, how many have their suffix first.
RATE, SPM = 90, 20
#: Goes into the hash that draws cuts and forms.
SEED = "1"


def boundary(grammar: list[tuple[str, str]]) -> str:
    """A zero-width regular expression for the places between two units; it never matches at the ends of a text."""
    together = "".join(rf"(?!(?<=[{left}])[{right}])" for left, right in grammar)
    return rf"(?<=[\s\S])(?=[\s\S]){together}"


def units(text: Column, grammar: list[tuple[str, str]]) -> Column:
    """The units of ``text``, in order; an empty array for empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def _draw(digest: Column, k: int) -> Column:
    """The k-th group (from 0) of eight hexadecimal digits, as an integer."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of fill_in_middle() was made of."""
    parts = F.split(output, "|".join(MARKERS), -1)
    piece = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(piece(1), piece(3), piece(2))).otherwise(F.concat(piece(2), piece(3), piece(1)))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: str = "letters", seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per row of ``docs``: ``row`` (its columns, as a struct), ``n`` units, ``form``, ``prefix``, ``middle``, ``suffix``, ``output``.

    A hash of ``seed`` and the id draws two cuts between units, whether the text is left as it is (form plain, as are empty texts and those that
    hold a marker), and whether its suffix comes first (spm) or its prefix (psm). Parts of plain texts are null. Null text counts as empty;
    a null id draws as an empty one. Repeated rows give the same results. A text is cut whole, whatever its length. An
    empty table gives no rows. Columns of ``docs`` can have any names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), digest.alias("h"))
    cut = rows.select("row", "t", "h", units(F.col("t"), GRAMMARS[grammar]).alias("u"))
    n = F.size("u").cast("long")
    plain = (F.col("t") == "") | F.col("t").rlike("|".join(MARKERS)) | (_draw(F.col("h"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(_draw(F.col("h"), 3) % 100 < spm, "spm").otherwise("psm")
    ends = [_draw(F.col("h"), k) % (n + 1) for k in (0, 1)]
    drawn = cut.select("row", "t", "u", n.alias("n"), form.alias("form"), F.least(*ends).cast("int").alias("lo"), F.greatest(*ends).cast("int").alias("hi"))

    def joined(start: Column, stop: Column) -> Column:
        return F.when(F.col("form") != "plain", F.array_join(F.slice("u", start + 1, stop - start), ""))

    zero, size = F.lit(0), F.col("n").cast("int")
    parts = drawn.select("row", "t", "n", "form", joined(zero, F.col("lo")).alias("prefix"), joined(F.col("lo"), F.col("hi")).alias("middle"), joined(F.col("hi"), size).alias("suffix"))
    p, s, m = (F.concat(F.lit(mark), F.col(c)) for mark, c in zip(MARKERS, ("prefix", "suffix", "middle"), strict=True))
    output = F.when(F.col("form") == "psm", F.concat(p, s, m)).when(F.col("form") == "spm", F.concat(s, p, m)).otherwise(F.col("t"))
    return parts.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sizes = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return made.select("row.doc_id", "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
),
n AS (
  SELECT doc_id, t, u, len(u)::BIGINT AS n, [('0x' || h[8 * k + 1:8 * k + 8])::BIGINT FOR k IN [0, 1, 2, 3]] AS r FROM d
),
c AS (
  SELECT doc_id, t, u, n, least(r[1] % (n + 1), r[2] % (n + 1)) AS lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS hi,
         CASE WHEN t = '' OR regexp_matches(t, '{"|".join(MARKERS)}') OR r[3] % 100 >= {RATE} THEN 'plain' WHEN r[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM n
),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM p
"""
