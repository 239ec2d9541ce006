from collections import Counter

import numpy as np

from conftest import ODD
from torquil.llm import sample_pieces as P


def test_round_trip_and_repeatability(documents):
    rows = [(1, "The quick  brown fox.\n  jumps\tover"), (2, "Être ou ne pas être <s> <0x41> <unk>"), *ODD]
    docs = documents(rows)
    got = P.encode(docs)
    back = sorted(map(tuple, P.decode(got).collect()), key=str)
    assert back == sorted([(i, t or "") for i, t in rows], key=str)
    again = {(r.doc_id, tuple(r.ids)) for r in P.encode(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, tuple(r.ids)) for r in got.collect()}
    assert all(r.lossless for r in P.encode(docs, digest=True).collect())
    assert P.encode(documents([])).count() == 0


def test_many_rows_of_one_batch(documents):
    rows = [(i, f"text number {i} " * 3) for i in range(700)]
    got = {r.doc_id: tuple(r.ids) for r in P.encode(documents(rows).coalesce(1)).collect()}
    alone = {r.doc_id: tuple(r.ids) for r in P.encode(documents(rows[::100])).collect()}
    assert len(got) == 700 and all(got[i] == ids for i, ids in alone.items())


def test_draws_follow_the_weights():
    s = P.sampler(P.MODEL, 0.5)
    keys = list(range(4000))
    drawn = Counter(tuple(i.tolist()) for i in s(keys, ["thing"] * len(keys)))
    weight = {k: float(w) for keys_, codes, weights, _ in s.tables for k, w in zip(codes.tolist(), weights) if k >= 0}
    names = {k: s.bytes_of[k].decode() for k in weight}
    of = {v: k for k, v in names.items()}
    word, ways = " thing", {}

    def walk(at, ids, w):
        if at == len(word):
            ways[tuple(ids)] = np.exp(w)
        for e in range(at + 1, len(word) + 1):
            k = of.get(word[at:e])
            if k is not None:
                walk(e, [*ids, k], w + weight[k])

    walk(0, [], 0.0)
    total = sum(ways.values())
    assert set(drawn) <= set(ways)
    for ids, w in ways.items():
        p = w / total
        assert abs(drawn[ids] / len(keys) - p) < 5 * (p * (1 - p) / len(keys)) ** 0.5 + 1e-3
