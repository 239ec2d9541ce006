from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from torquil.llm import ngram_join as J


def brute(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            shared = len(a & b)
            if i is not None and j is not None and shared and 100 * shared >= percent * (len(a) + len(b) - shared):
                r, s = sorted((root(i), root(j)))
                up[s] = r
    return sorted(((i, len(s), root(i)) for i, s in sets), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())]))


@pytest.mark.parametrize(("k", "percent", "block", "keys"), [(3, 90, 256, 1 << 20), (5, 80, 2, 500), (3, 60, 1, 50)])
def test_against_all_pairs(spark, k, percent, block, keys, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "KEYS", keys)
    g = np.random.default_rng(k * percent)
    rows, n = [], 0
    for base in range(12):
        words = [f"w{x}" for x in g.integers(0, 3000, int(g.integers(3, 160)))]
        for _ in range(int(g.integers(1, 9))):
            w = list(words)
            for _ in range(int(g.integers(0, 1 + len(w) // 15))):
                w[int(g.integers(len(w)))] = f"v{g.integers(9999)}"
            rows.append((n * 7 % 1009, " ".join(w[: len(w) - int(g.integers(0, 3))])))
            n += 1
    rows += [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "A b"), (5004, "a  B"), (5005, "a"), (5006, "a b"), (None, "a b"), (5007, "É b"), (5008, "é b")]
    rows += [(6000, "x " * 50000), (6001, "X " * 40000), (6002, rows[0][1]), (6002, rows[0][1])]
    got = J.ngram_join(frame(spark, rows), k, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, k, percent)


def test_empty_table(spark):
    assert J.ngram_join(frame(spark, [])).count() == 0


def test_rows_of_one_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = {(r.doc_id, r.component_id) for r in J.ngram_join(frame(spark, [(3, a), (3, b), (1, a), (2, b), (9, "z")])).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (9, 9)}


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize(("left", "right"), [([1, 6], [3, 7]), ([3, 7], [1, 6]), ([1, 6], [1, 6])])
def test_a_tile_holds_each_pair_whichever_block_has_the_smaller_row(left, right, every):
    bits = J.bitmap(np.arange(1, 9, dtype=np.uint64))
    found = []
    J._tile([(0, side, d, d, 8, bits) for side, docs in enumerate((left, right)) for d in docs], 80, every, found)
    assert sorted(f[:2] for f in found) == sorted({(min(a, b), max(a, b)) for a in left for b in right if a != b})


def test_components_go_on_from_known_ones(spark):
    links = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = J.C.components(links([(5, 4), (4, 9), (2, 3), (20, 21)]))
    got = J.C.components(links([(9, 3), (30, 31), (1, 20), (4, 5), (7, 7)]), known)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 2), (9, 2), (20, 1), (21, 1), (30, 30), (31, 30)]
    assert sorted(map(tuple, J.C.components(links([]), known).collect())) == sorted(map(tuple, known.collect()))


def test_bits_never_bound_too_low():
    g = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(g.integers(0, 300, int(g.integers(1, 200))).astype(np.uint64) * J.C.M1) for _ in "ab")
        assert J.overlap_bound(len(a), J.bitmap(a), len(b), J.bitmap(b)) >= len(np.intersect1d(a, b))


def test_linked_sets_share_a_key_and_no_key_is_of_nothing():
    g = np.random.default_rng(2)
    for percent in (60, 80, 90):
        seen = Counter()
        for n in [*range(1, 40), 100, 300, 700]:
            a = np.unique(g.integers(0, 1 << 63, n).astype(np.uint64))
            b = a.copy()
            differ = n * (100 - percent) // (100 + percent)  # as many as can be new in b
            b[g.choice(n, differ, replace=False)] = g.integers(0, 1 << 63, differ).astype(np.uint64)
            b = np.unique(b)
            assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
            x, y = J.segment_keys(a, percent), J.segment_keys(b, percent)
            assert len(np.intersect1d(x, y))
            seen.update(x.tolist())
        assert max(seen.values()) == 1
