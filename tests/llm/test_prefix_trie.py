import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T
from torquil.llm import prefix_trie as P

FIELDS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()), T.StructField("i", T.StringType()), T.StructField("h", T.StringType())])


def by_hand(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [(x[2], x[3]) for x in sorted(ts)] for c, ts in turns.items()}
    made = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = original.get(c - c % 100, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(p))))
        kids = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids, len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", None, "y") for r in rows], FIELDS)


def some_rows():
    rows = [(c, t, "user" if t % 2 else None, f"say {t % 3} {c % 2 if t > 2 else ''}" if t else None) for c in (*range(0, 9), 100, 103, 104, 205, 206, 309, 310) for t in range(c % 12)]
    rows += [(400 + c, t, "u", "same text") for c in range(1, 30) for t in range(8)]  # no host, copies
    rows += [(500, None, None, None), (500, None, "a", "x" * 20000), (500, 1, "a", ""), (500, 1, "a", ""), (501, 0, "é", "😀"), (None, 1, "u", "lost"), (7, 1, "u", "again")]
    rows += [(600, t, "u", f"{t}") for t in range(90)] + [(601, t, "u", f"{t}") for t in range(95)]  # many bands
    return rows


@pytest.mark.parametrize("height", [1 + 1, 4])
def test_against_every_prefix(spark, height):
    rows = some_rows()
    got = sorted(map(tuple, P.prefix_trie(table(spark, rows), height).collect()), key=str)
    assert got == by_hand(rows)


def test_a_conversation_that_spans_all_ranges(spark):
    rows = [(0, t, "u", f"{t % 5}") for t in range(400)] + [(3, 0, "u", "0")]
    assert sorted(map(tuple, P.prefix_trie(table(spark, rows)).collect()), key=str) == by_hand(rows)


def test_turnless_conversations_and_no_rows(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    got = P.prefix_trie(table(spark, [(c, 0, "u", "gone")])).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert P.prefix_trie(table(spark, [])).count() == 0


def test_pieces_of_a_chain(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 10)
    ends = spark.range(1000).selectExpr("CASE WHEN id % 50 = 0 THEN X'02' ELSE X'01' END AS node", "id AS conv_id")
    got = {bytes(r.node): r.ends_sha256 for r in P.ends_digests(ends).collect()}
    for k, ids in ((b"\1", [i for i in range(1000) if i % 50]), (b"\2", range(0, 1000, 50))):
        assert got[k] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = db.execute(P.SQL)
    names = [x[0] for x in want.description]
    got = P.op11_prefix_trie(spark, d)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
