import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from palisade.llm import prefix_trie as P
from tests.compare import DATA, same

ROWS = "conv_id bigint, turn bigint, role string, text string"


def brute(rows, borrow=None):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    built = turns
    if borrow:
        mod = lambda c: c % borrow[0] if c >= 0 else -(-c % borrow[0])
        built = {}
        for c, x in turns.items():
            h = zlib.crc32(str(c).encode()) % borrow[1]
            built[c] = turns.get(c - mod(c), [])[:h] + x[h:]
    members = defaultdict(list)
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    done = {}
    for k in sorted(members, key=len, reverse=True):
        below = [done[x] for x in children[k]]
        done[k] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[k]) - 1) * len(k[-1][1].encode() if k else b""))
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *done[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def conversations(seed=3, n=150):
    rng = random.Random(seed)
    out = []
    for c in range(-12, n):
        if rng.random() < 0.15:
            continue
        for turn in range(rng.randrange(1, 14)):
            out.append((c, None if turn == 0 and c % 7 == 0 else turn, rng.choice(["user", "assistant", None]), rng.choice(["hi", "ho", "é\U0001f600", None, "", f"w{rng.randrange(9)}"])))
    for c in range(n, n + 40):  # copies of one conversation, and of its first turn
        out += [(c, t, "user", f"same {t}") for t in range(20 if c % 2 else 1)]
    return out + [(3, 2, "user", "tie"), (3, 2, "user", "tie"), (None, 0, "user", "of nobody")]


@pytest.mark.parametrize("borrow", [None, (5, 9), (3, 20), (1, 4)])
def test_against_loop(spark, borrow):
    rows = conversations()
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    assert found(P.conversation_trie(df, borrow=borrow)) == brute(rows, borrow)


def test_small_tables_pieces_and_rounds(spark, monkeypatch):
    rows = conversations(5, 80)
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    for name, value in (("MOST_HELD", 5), ("CHUNK", 3), ("SALTS", 2)):
        monkeypatch.setattr(P, name, value)
    before = P.merged
    monkeypatch.setattr(P, "merged", lambda partial: before(partial.withColumn("part", P.F.col("part") * 37 % 50), 2))
    assert found(P.conversation_trie(df, borrow=(5, 9))) == brute(rows, (5, 9))


def test_turnless_conversations(spark):
    rows = [(c, 0, "user", "only") for c in (11, 12, 13, 14)]  # all of them borrow from 10, which isn't there
    got = found(P.conversation_trie(spark.createDataFrame(rows, ROWS), borrow=(5, 9)))
    assert got == brute(rows, (5, 9)) and got[0][1] == 0


def test_long_conversations(spark):
    rows = [(c, t, "user", f"{t}") for c in range(3) for t in range(700)] + [(9, t, "user", f"{t}") for t in range(350)]
    df = spark.createDataFrame(rows, ROWS)
    assert found(P.conversation_trie(df)) == brute(rows)


def test_clashing_names_and_empty_table(spark):
    names = ["node", "ups", "depth", "bytes", "conv", "n", "ends", "part", "grp", "salt", "parent"]
    df = spark.createDataFrame([(1, 0, "user", "a", *names), (2, 0, "user", "b", *names)], ", ".join([ROWS, *[f"{c} string" for c in names]]))
    assert found(P.conversation_trie(df)) == brute([(1, 0, "user", "a"), (2, 0, "user", "b")])
    assert P.conversation_trie(spark.createDataFrame([], ROWS), borrow=(5, 9)).count() == 0


def test_query_and_sql(spark):
    assert same(P.op12_prefix_trie(spark, DATA), P.OP12_SQL, DATA) > 0
