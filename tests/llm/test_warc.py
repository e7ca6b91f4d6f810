import base64
import glob
import hashlib
import os
import random
from collections import defaultdict

import pytest

from palisade.llm import warc as W
from tests.compare import DATA, same

PAGES = "page_id bigint, url string, html string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666:X>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
HTMLS = [
    "<p>plain</p>", "", None, "\r\n\r\n", "\r\n\r\n\r\n\r\n\r\nWARC/1.1\r\n", FAKE, f"x{FAKE}{FAKE}y", FAKE + "WARC/1.1\r\n", "WARC/1.1\r\n" * 40, "WARC/1.", "é\U0001f600\x00\n", "\r\n", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\n",
    "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3, "long " * 400, "<p>plain</p>", "copy", "copy", "copy",
]


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages(n=60):
    return [(k, None if k % 5 == 0 else f"http://a.b/{k}\r\nX: 1" if k % 5 == 1 else f"http://a.b/{k}", HTMLS[k % len(HTMLS)] if k % 3 else f"page {k} " + (HTMLS[k % len(HTMLS)] or "")) for k in range(n)]


def brute(rows, least=0):
    top = defaultdict(lambda: -1)
    for i, _, h in rows:
        top[h or ""] = max(top[h or ""], -1 if i is None else i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= least and top[h or ""] != i
        out.append((i, len(data), digest(data), "revisit" if again else "response", top[h or ""] if again else None, True))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["intact"]) for r in df.collect()), key=str)


def sequential(folder):
    """The payloads of all records, by walking each file from its start."""
    out = []
    for name in glob.glob(f"{folder}/*.txt"):
        data, at = open(name, "rb").read(), 0
        while at < len(data):
            assert data.startswith(b"WARC/1.1\r\n", at)
            stop = data.index(b"\r\n\r\n", at)
            head = dict(line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:])
            size = int(head["Content-Length"])
            out.append((os.path.basename(name), at, head["WARC-Type"], data[stop + 4 : stop + 4 + size].split(b"\r\n\r\n", 1)[1]))
            at = stop + 4 + size + 4
        assert at == len(data)
    return sorted(out)


@pytest.fixture()
def split(spark):
    """Sets how many bytes a split has."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", n), spark.conf.set("spark.sql.files.openCostInBytes", 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("size", [2500, 1 << 20])
def test_round_trip_in_splits_of_any_size(spark, tmp_path, split, size):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).coalesce(2)
    W.write_warc(df, f"file://{tmp_path}/w")
    walked = sequential(f"{tmp_path}/w")
    assert len(walked) == len(rows)
    split(size)
    records, problems = W.read_warc(spark, f"file://{tmp_path}/w")
    assert problems.count() == 0
    got = sorted((os.path.basename(r["path"]), r["at"], r["fields"]["warc-type"], bytes(r["payload"])) for r in records.collect())
    assert got == walked
    assert found(W.pages_of(records)) == brute(rows)
    assert found(W.pages_of(W.read_warc(spark, f"file://{tmp_path}/w", payloads=False)[0])) == brute(rows)


def test_random_archives(spark, tmp_path, split):
    rng = random.Random(7)
    parts = ["WARC/1.1\r\n", "\r\n\r\n", "\r\n", "WARC/", "Content-Length: 12", "Content-Length: 0", "abc", "\n", "W"]
    rows = [(k, "u", "".join(rng.choice(parts) for _ in range(rng.randrange(0, 30)))) for k in range(60)]
    W.write_warc(spark.createDataFrame(rows, PAGES).coalesce(1), f"file://{tmp_path}/w")
    split(600)
    assert found(W.pages_of(W.read_warc(spark, f"file://{tmp_path}/w")[0])) == brute(rows)


def test_least_bytes_repeated_rows_and_null_ids(spark, tmp_path):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, None, "abc"), (4, None, "abc"), (None, "u", "abc"), (None, "u", "only"), (5, "u", "")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], f"{PAGES}, sha string, salt string, uid string").repartition(3)
    W.write_warc(df, f"file://{tmp_path}/w", least=3)
    got = [(r[0], r[3], r[4]) for r in found(W.pages_of(W.read_warc(spark, f"file://{tmp_path}/w")[0]))]
    assert sorted(got, key=str) == sorted([(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (4, "revisit", 4), (None, "revisit", 4), (None, "response", None), (5, "response", None)], key=str)


def test_many_shared_payloads_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BROADCAST_ROWS", 1)
    rows = [(k, "u", f"page {k % 7}") for k in range(80)]
    W.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}/w")
    assert found(W.pages_of(W.read_warc(spark, f"file://{tmp_path}/w")[0])) == brute(rows)


def test_broken_archives(spark, tmp_path):
    W.write_warc(spark.createDataFrame([(k, "u", f"page {k}") for k in range(9)], PAGES).coalesce(1), f"file://{tmp_path}/w")
    data = open(glob.glob(f"{tmp_path}/w/*.txt")[0], "rb").read()
    os.mkdir(f"{tmp_path}/b")
    third = data.index(b"WARC/1.1", data.index(b"WARC/1.1", 5) + 5)
    inside = data.index(b"\r\n\r\npage", third) + 5  # of its payload
    for name, x in (("cut", data[:-3]), ("junk", b"?" + data), ("wrong", data[:inside] + b"?" + data[inside:]), ("none", b""), ("good", data)):
        open(f"{tmp_path}/b/{name}.warc", "wb").write(x)
    records, problems = W.read_warc(spark, f"file://{tmp_path}/b")
    name = lambda r: os.path.basename(r["path"])
    n = defaultdict(int)
    for r in records.collect():
        n[name(r)] += 1
    assert n == {"cut.warc": 8, "wrong.warc": 2, "good.warc": 9}
    assert {name(r): r["at"] for r in problems.collect()} == {"cut.warc": data.rindex(b"WARC/1.1"), "junk.warc": 0, "wrong.warc": third}


def test_base32_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([("",), ("a",), ("é" * 99,)], "t string")
    assert all(r["d"] == digest(r["t"].encode()) for r in df.select("t", W.sha1_base32(df["t"].cast("binary")).alias("d")).collect())
    W.write_warc(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w")
    records, problems = W.read_warc(spark, f"file://{tmp_path}/w")
    assert records.count() == 0 and problems.count() == 0


def test_query_and_sql(spark):
    assert same(W.op13_warc(spark, DATA), W.OP13_SQL, DATA) > 0
