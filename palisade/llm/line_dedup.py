"""Line dedup by a fixed-depth template tree.

The tree's first level is a line's number of tokens, the next ones are its leading tokens, where tokens with digits are already
variable. In a leaf, a token is fixed if enough documents have it at that place, and else a variable field. If enough of a line's
tokens are fixed, its template is that generalisation, otherwise the line itself. Templates that recur across documents are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import discard, materialize, packed, table

DEPTH = 3
LEAST_DOCS = 10
#: The share of a line's tokens that must be fixed for it to be generalised.
FIXED_SHARE = 0.7
FIELD = "<*>"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _masked(line: Column) -> Column:
    """Tokens, one space between them, with those that hold a digit masked; blanks at either end go."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", FIELD)).otherwise(line)
    return F.trim(F.regexp_replace(masked, r"[\x20\x09-\x0D]+", " "))


def _digest(value: Column) -> list[Column]:
    return [F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(3), F.concat(value, F.lit("."))).alias("h2")]


def line_digests(docs: DataFrame, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """One row per line: its row's ``number``, ``__id`` and ``__text`` that tell the row's content, ``at``, the masked line's digest ``h1, h2``.

    The numbers hold only in what this returns, which is materialised.
    """
    ident = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("number"), ident.alias("__id"), F.xxhash64(F.col(text_col)).alias("__text"), F.col(text_col).alias("t"))
    lines = rows.select("number", "__id", "__text", F.posexplode(_lines(F.col("t"))).alias("at", "line"))
    return materialize(lines.select("number", "__id", "__text", "at", *_digest(_masked(F.col("line")))), "line-digests")


def recurring_lines(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, least_docs: int = LEAST_DOCS, fixed_share: float = FIXED_SHARE, digests: DataFrame | None = None) -> DataFrame:
    """``h1, h2, template, docs`` of each masked line whose template ``least_docs`` documents or more have.

    ``h1, h2`` is the masked line's 128-bit digest; ``docs`` counts different documents, however many lines of the template one has.
    Sums over lines only rule out what can't recur; what is left is counted by the documents that own its lines. ``digests`` are
    those of line_digests(), if there already.
    """
    digests = line_digests(docs, text_col) if digests is None else digests
    masked = F.array_distinct(F.transform(_lines(F.col(text_col)), _masked))
    lines = docs.select(F.explode(F.filter(masked, lambda x: x != "")).alias("line")).groupBy("line").agg(F.count("*").alias("docs"))
    tokens = F.split("line", " ")
    leaf = F.xxhash64(F.size(tokens), F.array_join(F.slice(tokens, 1, depth), " "))
    lines = materialize(lines.withColumn("leaf", leaf), "lines")
    leaves = lines.groupBy("leaf").agg(F.sum("docs").alias("in_leaf")).filter(F.col("in_leaf") >= least_docs)
    some = materialize(lines.join(leaves, "leaf").select("leaf", "line", "docs", *_digest(F.col("line"))), "leaf-lines")
    owned = materialize(digests.select("number", "h1", "h2").join(some.select("h1", "h2"), ["h1", "h2"]), "line-owners")
    placed = some.select("leaf", "h1", "h2", "docs", F.posexplode(F.split("line", " ")).alias("at", "token"))
    sums = placed.groupBy("leaf", "at", "token").agg(F.sum("docs").alias("held"), F.max("docs").alias("most")).filter(F.col("held") >= least_docs)
    sums = materialize(sums.select("leaf", "at", "token", (F.col("most") >= least_docs).alias("fixed")), "tokens")
    unsure = placed.join(sums.filter("not fixed").drop("fixed"), ["leaf", "at", "token"]).join(owned, ["h1", "h2"]).select("leaf", "at", "token", "number").distinct()
    counted = unsure.groupBy("leaf", "at", "token").count().filter(F.col("count") >= least_docs).select("leaf", "at", "token", F.lit(True).alias("fixed"))
    held = sums.filter("fixed").unionByName(counted)
    marked = placed.join(held, ["leaf", "at", "token"], "left").withColumn("fixed", F.coalesce("fixed", F.lit(False)))
    field = F.when(F.col("fixed"), F.col("token")).otherwise(FIELD)
    general = marked.groupBy("h1", "h2").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("at", field.alias("t"))))["t"], " ").alias("general"), F.avg(F.col("fixed").cast("double")).alias("share")
    )
    template = F.when(F.col("share") >= fixed_share, F.col("general")).otherwise(F.col("line"))
    named = materialize(some.join(general, ["h1", "h2"]).select("h1", "h2", "docs", template.alias("template")), "templates")
    likely = named.groupBy("template").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("template")
    owners = named.join(likely, "template").select("h1", "h2", "template").join(owned, ["h1", "h2"]).select("template", "number").distinct()
    often = owners.groupBy("template").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_docs)
    out = materialize(named.select("h1", "h2", "template").join(often, "template").select("h1", "h2", "template", "docs"), "recurring")
    discard(lines, some, owned, sums, named)
    return out


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_docs: int = LEAST_DOCS, fixed_share: float = FIXED_SHARE) -> DataFrame:
    """One row per input row: the columns of ``docs`` with ``text_col`` rid of recurring lines, ``n_lines`` and ``n_dropped``.

    Lines end at newlines. Blank lines stay and count for no template. A null text stays null and has no lines; an empty one has one
    blank line. A template recurs if lines of it are in ``least_docs`` different documents. Rows
    that repeat count as documents of their own and are treated alike. An input column named ``n_lines`` or ``n_dropped`` is
    replaced; others can have any names. An empty table gives no rows.
    """
    rest = docs.drop("n_lines", "n_dropped")
    digests = line_digests(docs, text_col, id_col)
    recurring = recurring_lines(docs, text_col, depth, least_docs, fixed_share, digests).select("h1", "h2", F.lit(True).alias("gone"))
    found = digests.select("__id", "__text", "at", "h1", "h2").join(recurring, ["h1", "h2"], "left")
    flags = found.groupBy("__id", "__text").agg(F.array_sort(F.collect_set(F.struct("at", F.col("gone").isNotNull().alias("gone"))))["gone"].alias("gone"))
    some = flags.filter(F.exists("gone", lambda g: g))
    keyed = packed(rest, id=F.col(id_col).cast("string"), text=F.xxhash64(F.col(text_col)))
    both = keyed.join(some, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text") == F.col("__text")), "left")
    whole = F.col("row").getField(text_col)
    split = _lines(whole)
    kept = F.filter(F.arrays_zip(split.alias("line"), F.col("gone").alias("gone")), lambda x: ~x["gone"])
    text = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(kept["line"], "\n"))
    columns = [(text if c == text_col else F.col("row").getField(c)).alias(c) for c in rest.columns]
    n_lines = F.when(whole.isNull(), F.lit(0)).otherwise(F.size(split))
    return both.select(*columns, n_lines.alias("n_lines"), F.coalesce(F.size(F.filter("gone", lambda g: g)), F.lit(0)).alias("n_dropped"))


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


OP1_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL
),
m AS (
  SELECT doc_id, pos, raw, regexp_replace(regexp_replace(regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '{FIELD}', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS line
  FROM l
),
d AS (SELECT DISTINCT doc_id, line FROM m WHERE line <> ''),
u AS (SELECT line, string_split(line, ' ') AS toks FROM (SELECT DISTINCT line FROM d)),
t AS (SELECT line, len(toks) AS n, array_to_string(toks[1:{DEPTH}], ' ') AS lead, unnest(toks) AS tok, generate_subscripts(toks, 1) AS k FROM u),
x AS (SELECT n, lead, k, tok, true AS fixed FROM t JOIN d USING (line) GROUP BY ALL HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
g AS (
  SELECT line, CASE WHEN avg(coalesce(fixed, false)::INT) >= {FIXED_SHARE} THEN string_agg(CASE WHEN fixed THEN tok ELSE '{FIELD}' END, ' ' ORDER BY k) ELSE line END AS template
  FROM t LEFT JOIN x USING (n, lead, k, tok) GROUP BY line
),
r AS (SELECT line FROM g WHERE template IN (SELECT template FROM g JOIN d USING (line) GROUP BY template HAVING count(DISTINCT doc_id) >= {LEAST_DOCS})),
o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line IN (SELECT line FROM r)) AS n_dropped,
         coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (line NOT IN (SELECT line FROM r)), '') AS kept
  FROM m GROUP BY doc_id
)
SELECT documents.* REPLACE (CASE WHEN text IS NULL THEN NULL ELSE kept END AS text), coalesce(o.n_lines, 0) AS n_lines, coalesce(o.n_dropped, 0) AS n_dropped
FROM documents LEFT JOIN o USING (doc_id)
"""
