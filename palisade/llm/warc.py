"""WARC archives: written by Spark's text writer, read back in splits, with record boundaries proved by their chain.

An archive is read as a text file whose separator is the line that opens each record, so splits can be of any size and a task never
holds more than a piece between two such lines. A piece may be a record, or a part of a payload that happens to hold that line.
Each task says of each candidate where its successor must begin, by the length in its header, and follows that chain to the end of its
split. Where the splits' chains begin is then found from the start of the file by pointer jumping, over one row for each place where a chain
enters a split. Only records on the chain from the start count; all else is payload, whatever it looks like.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import discard, materialize, scratch_root, small_batches, table

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How a page's id and its payload's digest make a record's id.
RECORD_ID = "<urn:page:{}:{}>"
#: Parts into which the pages of one payload are dealt, where they are joined with the one that holds it.
SALTS = 64

#: Rows of shared payloads up to which they are broadcast, about 150 bytes each; beyond it pages are joined with them by payload and salt.
BROADCAST_ROWS = 200_000

# ---- writing


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four digits of base 32."""
    digest = F.sha1(data)
    return F.concat(*[F.translate(F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0"), *BASE32) for k in range(8)])


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages(id, url, payload)`` with ``digest``, ``sha`` and ``refers``: of equal payloads of at least ``least`` bytes the largest id is null there and the
    others have that id. Of repeated rows of the largest id, one is null.

    Payloads are equal if their SHA-256 are. What travels of a hot payload is a row per salt, and its pages are dealt by salt.
    """
    salted = lambda rows: rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    keyed = salted(pages.withColumn("sha", F.sha2(F.col("payload").cast("binary"), 256)))
    each = keyed.filter(F.octet_length("payload") >= least).groupBy("sha", "salt", "id").agg(F.count("*").alias("n"))
    each = materialize(each, "payload-ids")
    best = F.max(F.struct(F.col("id").isNotNull().alias("has"), "id", "n")).alias("best")
    whole = each.groupBy("sha").agg(best, F.sum("n").alias("n")).filter("n > 1").select("sha", F.col("best.id").alias("best"), F.col("best.n").alias("times"))
    one = F.lit(None).cast("long")
    if whole.filter("times > 1").isEmpty():
        keyed = keyed.withColumn("uid", one)
        whole = whole.withColumn("first", one)
    else:  # rows that repeat a payload's largest id are told apart by numbers
        keyed = materialize(keyed.withColumn("uid", F.monotonically_increasing_id()), "payload-rows")
        repeated = keyed.select("sha", "id", "uid").join(whole.filter("times > 1"), "sha").filter(F.col("id").eqNullSafe(F.col("best")))
        whole = whole.join(repeated.groupBy("sha").agg(F.min("uid").alias("first")), "sha", "left")
    chosen = each.select("sha", "salt").distinct().join(whole, "sha").select("sha", "salt", "best", "first", F.lit(True).alias("shared"))
    chosen = materialize(chosen, "shared-payloads")
    few = chosen.count() <= BROADCAST_ROWS  # then no payload travels
    out = keyed.join(F.broadcast(chosen) if few else chosen, ["sha", "salt"], "left")
    kept = F.col("id").eqNullSafe(F.col("best")) & (F.col("first").isNull() | (F.col("uid") == F.col("first")))
    refers = F.when(F.col("shared") & (F.octet_length("payload") >= least) & ~kept, F.struct(F.col("best").alias("id")))
    return out.select("id", "url", "payload", "sha", sha1_base32(F.col("payload").cast("binary")).alias("digest"), refers.alias("refers"))


def record(page: Column, url: Column, payload: Column, digest: Column, refers: Column) -> Column:
    """The text of a record, but for the line that opens the next one; ``refers`` is null for a response, else a struct of an id."""
    name = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("")), F.lit(":"), digest, F.lit(">"))
    is_revisit = refers.isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    block = F.concat(http, F.when(is_revisit, "").otherwise(payload))
    plain = F.nullif(F.regexp_replace(url, r"[\x00-\x20\x7f]+", "%20"), F.lit(""))
    head = F.concat(
        F.lit(MAGIC),
        _field("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", name(page)),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", plain),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        _field("WARC-Profile", F.when(is_revisit, PROFILE)),
        _field("WARC-Refers-To", F.when(is_revisit, name(refers["id"]))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit("\r\n"), block)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> None:
    """Archives of ``pages`` in a new ``folder``, one file a task, a record a row.

    Of equal payloads of at least ``least`` bytes, that of the largest id is a response, the others are revisits that refer to it; all
    other records are responses. A null payload counts as empty, a null id as the smallest, and a null or empty url is left out. Of
    repeated rows one is a response. Other columns aren't read, whatever their names. An empty table gives a folder without records.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    text = revisits(rows, least).select(record(F.col("id"), F.col("url"), F.col("payload"), F.col("digest"), F.col("refers")).alias("value"))
    text.write.option("lineSep", END).text(folder)


# ---- reading

_PIECE = pa.schema(
    [
        ("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("stop", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()),
        ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("sha1", pa.string()), ("payload", pa.binary()),
    ]
)
PIECE = "path string, block long, seq long, at long, stop long, next long, exit long, fields map<string,string>, payload_bytes long, sha1 string, payload binary"
_SIZE = re.compile(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n|$)")


def _header(piece: bytes) -> tuple[int, int] | None:
    """Of a piece after MAGIC: the length of its header with the empty line, and of the block that the header announces."""
    stop = piece.find(b"\r\n\r\n")
    found = _SIZE.search(b"\r\n" + piece[:stop]) if stop >= 0 else None
    return (stop + 4, int(found[1])) if found else None


def parsed(piece: bytes, keep: bool) -> tuple[dict, int, str, bytes | None]:
    """Fields, payload size, its digest and, if ``keep``, the payload of a whole record after MAGIC. A revisit has no payload here."""
    head, size = _header(piece)
    fields = {}
    for line in piece[: head - 4].decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    block = memoryview(piece)[head : head + size]
    begin = 0
    if fields.get("content-type", "").startswith("application/http"):
        stop = piece.find(b"\r\n\r\n", head, head + size)
        begin = stop + 4 - head if stop >= 0 else size
        announced = _SIZE.search(b"\r\n" + piece[head : head + begin - 4]) if stop >= 0 else None
        if announced:
            fields["http-content-length"] = announced[1].decode()
    payload = block[begin:]
    return fields, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), bytes(payload) if keep else None


def _scan(keep: bool):
    """A function on ``path, block, value`` that gives the pieces of each split; places are relative to the split."""

    def finish(rows: list[dict], stop: int) -> pa.RecordBatch:
        index = {r["at"]: k for k, r in enumerate(rows)}
        for r in reversed(rows):
            if r["next"] is not None:
                r["exit"] = r["next"] if r["next"] >= stop else rows[index[r["next"]]]["exit"] if r["next"] in index else None
        return pa.RecordBatch.from_pylist(rows, _PIECE)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, at = None, [], 0
        for batch in batches:
            for path, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (path, block) != key:
                    if rows:
                        yield finish(rows, at)
                    key, rows, at = (path, block), [], 0
                piece = value.as_py()
                opened = block > 0 or bool(rows)  # what comes before the first such line of a file is no candidate
                start, at = at, at + len(piece) + (len(MAGIC) if opened else 0)
                row = {"path": path, "block": block, "seq": len(rows), "at": start, "stop": at, "next": None, "exit": None}
                header = _header(piece) if opened else None
                if header:
                    row["next"] = start + len(MAGIC) + sum(header) + len(END)
                    if row["next"] == at:
                        row |= dict(zip(("fields", "payload_bytes", "sha1", "payload"), parsed(piece, keep), strict=True))
                rows.append(row)
        if rows:
            yield finish(rows, at)

    return read


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(folder)
    return small_batches(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")))


def _entries(nodes: DataFrame) -> DataFrame:
    """``path, at`` of the candidates of ``nodes(path, at, next, first)`` on the chain from a file's start, by pointer jumping.

    A round doubles the steps that the pointers take, and adds what they reach from all that was reached before.
    """
    reached = materialize(nodes.filter("first").select("path", "at"), "reached")
    jump = materialize(nodes.filter("next is not null").select("path", "at", "next"), "jumps")
    n = reached.count()
    while True:
        more = materialize(reached.unionByName(reached.join(jump, ["path", "at"]).select("path", F.col("next").alias("at"))).distinct(), "reached")
        now = more.count()
        discard(reached)
        reached = more
        if now == n:
            discard(jump)
            return reached
        target = jump.select("path", F.col("at").alias("next"), F.col("next").alias("after"))
        longer = materialize(jump.join(target, ["path", "next"]).select("path", "at", F.col("after").alias("next")), "jumps")
        discard(jump)
        n, jump = now, longer


def _walk(keys, split):
    """Of one split, the pieces ``seq`` on the chain that begins where ``entry`` says."""
    rows = split.select(["seq", "at", "next", "entry"]).to_pylist()
    index, now, out = {r["at"]: r for r in rows}, next((r["at"] for r in rows if r["entry"]), None), []
    while now in index:
        out.append(index[now]["seq"])
        now = index[now]["next"]
    n = len(out)
    return pa.table({"path": pa.array([keys[0].as_py()] * n, pa.string()), "block": pa.array([keys[1].as_py()] * n, pa.int64()), "seq": pa.array(out, pa.int64())})


def chained(pieces: DataFrame) -> DataFrame:
    """``path, block, seq, at, stop, next`` (places in the file) of ``pieces``, with ``is_record``: on the chain from the file's start."""
    splits = pieces.groupBy("path", "block").agg(F.max("stop").alias("size"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select("path", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    narrow = pieces.select("path", "block", "seq", "at", "stop", "next", "exit").join(bases, ["path", "block"])
    placed = narrow.select("path", "block", "seq", *[(F.col(c) + F.col("base")).alias(c) for c in ("at", "stop", "next", "exit")])
    placed = materialize(placed, "placed")
    opening = placed.filter("next is not null and at = 0").select("path", "at", F.col("exit").alias("next"), F.lit(True).alias("first"))
    exits = placed.filter("exit is not null and at > 0").select("path", "at", "exit")
    targets = placed.filter("exit is not null").select("path", F.col("exit").alias("at")).distinct()
    inner = targets.join(exits, ["path", "at"]).select("path", "at", F.col("exit").alias("next"), F.lit(False).alias("first"))
    entries = materialize(_entries(materialize(opening.unionByName(inner), "crossings")), "entries")
    marked = placed.join(entries.withColumn("entry", F.lit(True)), ["path", "at"], "left").select("path", "block", "seq", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    walked = marked.groupBy("path", "block").applyInArrow(_walk, "path string, block long, seq long")
    return placed.drop("exit").join(walked.withColumn("is_record", F.lit(True)), ["path", "block", "seq"], "left").withColumn("is_record", F.coalesce("is_record", F.lit(False)))


def _assembled(keep: bool):
    """A function that joins the pieces ``owner, at, next, value`` of a record whose payload holds MAGIC."""

    def join(keys, rows):
        parts = rows.sort_by("at").to_pylist()
        whole = MAGIC.encode().join(p["value"] for p in parts)
        fields, size, sha1, payload = parsed(whole, keep)
        one = {"path": keys[0].as_py(), "at": keys[1].as_py(), "fields": list(fields.items()), "payload_bytes": size, "sha1": sha1, "payload": payload}
        return pa.Table.from_pylist([one], pa.schema([("path", pa.string()), ("at", pa.int64()), *[_PIECE.field(c) for c in ("fields", "payload_bytes", "sha1", "payload")]]))

    return join


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, n = None, 0
    for batch in batches:
        numbers = []
        for now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, key = (n + 1, key) if now == key else (0, now)
            numbers.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], ["path", "block", "value", "seq"])


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records of the uncompressed archives in ``folder``, and problems.

    Records: ``path``, ``at`` (offset), ``fields`` (names in lower case), ``payload_bytes``, ``sha1`` (of the payload that is there, in base32), ``payload``
    (null unless ``payloads``). A record counts if the next one on the chain, or the file's end, is where its length says. Problems: ``path, at`` of
    the first that isn't so, which ends its file's records; ``at`` is 0 if a file doesn't begin with one. Files without bytes have neither.
    """
    pieces = materialize(_pieces(spark, folder).mapInArrow(_scan(payloads), PIECE), "warc-pieces")
    chain = materialize(chained(pieces), "warc-chain")
    ends = chain.groupBy("path").agg(F.max("stop").alias("size"), F.max_by(F.struct("at", "next"), F.when(F.col("is_record"), F.col("at"))).alias("last"))
    problems = ends.filter("size > 0 and (last is null or last.next != size)").select("path", F.coalesce("last.at", F.lit(0).cast("long")).alias("at"))
    problems = materialize(problems, "warc-problems")
    if not problems.isEmpty():
        chain = chain.join(problems.withColumn("astray", F.lit(True)), ["path", "at"], "left").withColumn("is_record", F.col("is_record") & F.col("astray").isNull()).drop("astray")
    own = chain.filter("is_record and next = stop").select("path", "block", "seq", F.col("at").alias("offset"))
    records = pieces.join(own, ["path", "block", "seq"]).select("path", F.col("offset").alias("at"), "fields", "payload_bytes", "sha1", "payload")
    if not chain.filter("is_record and next > stop").isEmpty():
        records = records.unionByName(_spanning(spark, folder, chain, payloads))
    return records, problems


def _spanning(spark: SparkSession, folder: str, chain: DataFrame, payloads: bool) -> DataFrame:
    """The records that consist of several pieces. Only these pieces are read again."""
    here = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.struct("at", "next")
    within = chain.withColumn("mine", F.last(F.when(F.col("is_record"), last), ignorenulls=True).over(here))
    per_split = chain.groupBy("path", "block").agg(F.max_by(last, F.when(F.col("is_record"), F.col("at"))).alias("latest"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_split.select("path", "block", F.last("latest", ignorenulls=True).over(earlier).alias("carried"))
    owned = within.join(carried, ["path", "block"]).withColumn("owner", F.coalesce("mine", "carried"))
    parts = owned.filter("owner is not null and at < owner.next").withColumn("whole", (F.col("owner.at") == F.col("at")) & (F.col("next") == F.col("stop")))
    parts = parts.filter("not whole").select("path", "block", "seq", F.col("owner.at").alias("owner"), F.col("owner.next").alias("end"), F.col("at").alias("place"), "stop")
    values = _pieces(spark, folder).mapInArrow(_numbered, "path string, block long, value binary, seq long")
    texts = values.join(parts, ["path", "block", "seq"]).select("path", "owner", F.col("place").alias("at"), F.col("end").alias("next"), "value")
    return texts.groupBy("path", "owner").applyInArrow(_assembled(payloads), "path string, at long, fields map<string,string>, payload_bytes long, sha1 string, payload binary")


def pages_of(records: DataFrame) -> DataFrame:
    """What write_warc() put into ``records``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, intact``.

    Size and digest are those of the full payload, for revisits as their headers tell them. ``intact``: a response's payload has its header's digest.
    """
    field = lambda name: F.col("fields")[name]
    page = lambda name: F.regexp_extract(field(name), r"^<urn:page:(-?\d*):", 1).try_cast("long")
    digest = F.regexp_replace(field("warc-payload-digest"), "^sha1:", "")
    revisit = field("warc-type") == "revisit"
    size = F.when(revisit, field("http-content-length").cast("long")).otherwise(F.col("payload_bytes"))
    return records.select(
        page("warc-record-id").alias("page_id"),
        size.alias("payload_bytes"),
        F.when(revisit, digest).otherwise(F.col("sha1")).alias("payload_digest"),
        field("warc-type").alias("record_type"),
        F.when(revisit, page("warc-refers-to")).alias("refers_to"),
        (revisit | (digest == F.col("sha1"))).alias("intact"),
    )


def op13_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), folder)
    records, _ = read_warc(spark, folder, payloads=False)
    return pages_of(records)


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS top FROM p),
x AS (SELECT page_id, strlen(h) AS payload_bytes, top, [('0x' || s[5 * k + 1:5 * k + 5])::BIGINT FOR k IN range(8)] AS v FROM (SELECT *, sha1(h) AS s FROM g))
SELECT page_id, payload_bytes,
       array_to_string([array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((n >> b) & 31) + 1] FOR b IN [15, 10, 5, 0]], '') FOR n IN v], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, true AS intact
FROM x
"""
