"""Secret scan with ownership frequency over the whole corpus.

Candidates are found by patterns in every whole text. Then each candidate's hash is counted over distinct repositories and
owners: a value that many owners or very many repositories have is an example that was copied; one that a single owner has in
few repositories is live if it also looks like a credential: it isn't a placeholder, and its characters are many and mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialize, table

#: Kind, pattern, the group that holds the value, its least length. The first three are the base kinds.
KINDS = [
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # runs are maximal, so this is [0-9a-f]+ of 24 characters or more
    ("forge", r"gh[opsu]_[A-Za-z0-9]{30,}", 0, 34),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
]
BASE = 3
#: A value of so many owners, or of so many repositories of any owners, was copied from an example.
COPIED_OWNERS = 3
COPIED_REPOS = 50
#: What marks a value as a placeholder.
PLACEHOLDER = r"(?i)example|placeholder|change_?me|dummy|sample|redacted|your[_.-]|x{4}|\*{4}|1234|qwerty|foobar|password|passwd|secret"
#: Different characters that a live value has at least, if it mixes letters and digits; half as many more if it doesn't.
LIVE_CHARACTERS = 6
#: The kind whose matches are headings and hold no value.
HEADING = "pem"


def _looks_live(value: Column) -> Column:
    characters = F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0))))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return ~value.rlike(PLACEHOLDER) & (characters >= F.when(mixed, LIVE_CHARACTERS).otherwise(LIVE_CHARACTERS * 3 // 2))


def _matches(text: Column, order: int) -> Column:
    """Matches of one kind, leftmost and non-overlapping, each with the lengths of the gap before it and of itself, in code points.

    Running sums of these lengths give the places, in time linear in the matches.
    """
    kind, pattern, group, _ = KINDS[order]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.slice(F.arrays_zip(whole.alias("m"), value.alias("v"), F.split(text, pattern, -1).alias("gap")), F.lit(1), F.size(whole))

    def one(x, at):
        known = F.lit(None).cast("string") if kind == HEADING else F.sha2(x["v"], 256)
        return F.struct(F.lit(order).alias("ord"), at.alias("at"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["v"]).alias("held"), known.alias("value"), _looks_live(x["v"]).alias("looks_live"))

    kinds = "array<struct<ord:int,at:int,gap:int,size:int,held:int,value:string,looks_live:boolean>>"
    return F.when(text.rlike(pattern), F.transform(parts, one).cast(kinds)).otherwise(F.array().cast(kinds))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per input row: ``id_col``, ``found`` (spans by start, then kind), ``live`` and ``copied`` (how many spans are either).

    A span is copied if ``copied_owners`` or more distinct owners, or ``copied_repos`` or more distinct repositories, have its value. It is
    live if it isn't copied, one owner has its value, and the value looks live: no placeholder, and enough different characters.
    Others, and headings of keys, are neither. Null text counts as empty, and has no spans. A null repository or owner counts as
    one of its own. Repeated rows give repeated rows, and count as one repository. An empty table gives no rows. Other columns of
    ``docs`` aren't read, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    hits = F.concat(*[_matches(F.col("t"), i) for i in range(len(KINDS))])
    rows = materialize(base.select("id", "repo", "owner", hits.alias("hits"), F.monotonically_increasing_id().alias("row")), "secret-matches")
    each = rows.filter(F.size("hits") > 0).select("row", "repo", "owner", F.inline("hits"))
    before = Window.partitionBy("row", "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    least = F.get(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("ord"))
    spans = each.withColumn("stop", F.sum(F.col("gap").cast("long") + F.col("size")).over(before)).filter(F.col("held") >= least)
    spans = spans.select("row", "repo", "owner", (F.col("stop") - F.col("size")).alias("start"), "ord", "stop", "value", "looks_live")
    spans = materialize(spans, "secret-spans")
    owned = spans.filter("value is not null").groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = owned.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    by_value = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    copied = (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos)
    by_value = by_value.select("value", copied.alias("copied"), (~copied & (F.col("owners") == 1)).alias("single"))
    kind = F.get(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("ord"))
    span = F.struct("start", "ord", "stop", kind.alias("kind"), "value")
    judged = spans.join(by_value, "value", "left").groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("found"), F.count_if(F.col("single") & F.col("looks_live")).alias("live"), F.count_if("copied").alias("copied"))
    out = rows.select("id", "row").join(judged, "row", "left")
    zero, none = F.lit(0).cast("long"), F.array().cast(judged.schema["found"].dataType)
    return out.select(F.col("id").alias(id_col), F.coalesce("found", none).alias("found"), F.coalesce("live", zero).alias("live"), F.coalesce("copied", zero).alias("copied"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def count(order: int) -> Column:
        return F.size(F.filter("found", lambda s: s["ord"] == order)).cast("long")

    counts = {f"n_{kind}": count(i) for i, (kind, *_) in enumerate(KINDS[:BASE])}
    base = _listed(F.filter("found", lambda s: s["ord"] < BASE))
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(base, 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), F.col("live").alias("n_live"), F.col("copied").alias("n_copied"))


def _kind_sql(order: int) -> str:
    kind, pattern, group, least = KINDS[order]
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, source, {order} AS o, '{kind}' AS kind, stop - length(m) AS start, stop, v FROM (
    SELECT doc_id, source, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, source, unnest(ms) AS m, unnest(vs) AS v, unnest(gaps[:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i
      FROM (SELECT doc_id, source, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs, string_split_regex(t, '{quoted}') AS gaps FROM n)
    )
  ) WHERE length(v) >= {least}"""


OP5_SQL = (
    "WITH n AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),\ns AS ("
    + "\n  UNION ALL".join(_kind_sql(i) for i in range(len(KINDS)))
    + f"""
),
c AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT doc_id) AS repos FROM s WHERE kind <> '{HEADING}' GROUP BY v),
w AS (
  SELECT v, owners >= {COPIED_OWNERS} OR repos >= {COPIED_REPOS} AS copied,
         owners = 1 AND repos < {COPIED_REPOS} AND NOT regexp_matches(v, '{PLACEHOLDER}')
         AND len(list_distinct(regexp_extract_all(v, '.'))) >= CASE WHEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') THEN {LIVE_CHARACTERS} ELSE {LIVE_CHARACTERS * 3 // 2} END AS live
  FROM c
),
g AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) FILTER (o < {BASE}) AS base,
         string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, o) AS spans,
         count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied
  FROM s LEFT JOIN w ON s.v = w.v AND s.kind <> '{HEADING}' GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM n LEFT JOIN g USING (doc_id)
"""
)
