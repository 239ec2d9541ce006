import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from torquil.llm import suffix_dedup as S

FIELDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kind", T.StringType())])


def brute(rows, length):
    seen = Counter(t[i : i + length] for _, x in rows if (t := (x or "").encode()) for i in range(len(t) - length + 1))
    out = []
    for i, x in rows:
        t = (x or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for j in range(len(t) - length + 1):
            if seen[t[j : j + length]] > 1:
                gone[j : j + length] = True
        left = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest(), None if x is None else left.decode("utf-8", "ignore")))
    return sorted(out, key=str)


def corpus():
    g = np.random.default_rng(3)
    word = lambda: "".join(g.choice(list("abcdeé"), 5))
    common = " ".join(word() for _ in range(30))
    rows = []
    for i in range(60):
        t = " ".join(word() for _ in range(int(g.integers(1, 60))))
        if i % 3 == 0:
            cut = int(g.integers(len(t)))
            t = t[:cut] + common[int(g.integers(20)) : len(common) - int(g.integers(20))] + t[cut:]
        rows.append((i, t))
    rows += [(100, rows[0][1]), (101, rows[0][1]), (101, rows[0][1]), (102, None), (103, ""), (None, rows[3][1]), (0, "other text of an id that is there"), (None, None)]
    return rows + [(104, "ab" * 3000), (105, "x" * 5000), (106, rows[4][1] + "é" * 300)]


def check(spark, rows, length, monkeypatch=None):
    docs = spark.createDataFrame([(*r, "kept") for r in rows], FIELDS)
    also = length // 2
    got = sorted(map(tuple, S.removed_bytes(docs, length, also).collect()), key=str)
    want, more = brute(rows, length), brute(rows, also)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert sorted((str(g[0]), g[1], g[5]) for g in got) == sorted((str(w[0]), w[1], w[2]) for w in more)


def test_against_all_substrings(spark):
    check(spark, corpus(), 64)


def test_hot_anchors_are_merged_across_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_SEGMENTS", 3)
    monkeypatch.setattr(S, "RANGE_SEGMENTS", 2)
    monkeypatch.setattr(S, "SHARD_BYTES", 300)
    check(spark, corpus(), 64)


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 500)
    check(spark, corpus(), 64)


def test_texts_and_other_columns(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("row", S.F.lit("mine"))
    got = sorted([(r.doc_id, r.text, r.row) for r in S.suffix_dedup(docs, 64).collect()], key=str)
    assert got == sorted([(w[0], w[5], "mine") for w in brute(corpus(), 64)], key=str)
    assert S.suffix_dedup(docs.limit(0), 64).count() == 0


def test_suffix_array_and_common_prefixes():
    g = np.random.default_rng(5)
    for _ in range(20):
        texts = [bytes(g.integers(97, 99, int(g.integers(1, 200))).astype(np.uint8)) for _ in range(5)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        order = S.suffix_array(data)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:].tobytes())
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        owner = np.repeat(ends, ends - begins)
        got = S.kasai(data, order, begins, ends)
        for r in range(1, len(order)):
            a, b = (data[i : owner[i]].tobytes() for i in order[r - 1 : r + 1])
            assert got[r] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        flags = S.repeats(texts, [len(t) for t in texts], (8,))[0]
        seen = Counter(t[i : i + 8] for t in texts for i in range(len(t) - 7))
        assert [f.tolist() for f in flags] == [[seen[t[i : i + 8]] > 1 for i in range(len(t) - 7)] for t in texts]
