import numpy as np

from torquil.llm import near_vectors as N

SCHEMA = "vec_id long, embedding array<float>, label int, cls string"


def brute(rows):
    good = {k: np.array(v, np.float32).astype(float) for k, (i, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)}
    near = {k: [j for j in good if j != k and len(good[j]) == len(x) and x @ good[j] / np.linalg.norm(x) / np.linalg.norm(good[j]) >= 0.9] for k, x in good.items()}
    comp = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0)):
        todo, seen = [k], {k}
        while todo:
            a = todo.pop()
            for b in [*near.get(a, []), *[j for j in range(len(rows)) if rows[a][0] is not None and rows[j][0] == rows[a][0]]]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        comp[k] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None) if rows[k][0] is not None else None
    return sorted([(i, len(near.get(k, [])), comp[k]) for k, (i, _) in enumerate(rows)], key=str)


def test_against_all_pairs(spark, monkeypatch):
    g = np.random.default_rng(2)
    rows = []
    for c in range(12):
        x = g.standard_normal(32)
        for _ in range(int(g.integers(1, 14))):
            rows.append((len(rows) * 37 % 1009, (x + 0.35 * g.standard_normal(32) * g.random()).tolist()))
    rows += [(2000, rows[0][1]), (2001, rows[0][1]), (2002, [2 * v for v in rows[3][1]]), (2003, None), (2004, [0.0] * 32), (2005, [float("nan")] * 32), (2006, [None] * 32), (2007, []), (2008, [1.0, 0.0]), (2009, [1.0, 0.1]), (2010, [float("inf")] + [1.0] * 31), (rows[5][0], rows[40][1])]
    monkeypatch.setattr(N, "SHARED", 12)
    monkeypatch.setattr(N, "BLOCK", 8)
    df = spark.createDataFrame([(i, v, None, "c") for i, v in rows], SCHEMA)
    got = N.near_vectors(df).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=str) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert N.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    g = np.random.default_rng(0)
    x = g.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = g.standard_normal((300, 64))
    r -= (r * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * r / np.linalg.norm(r, axis=1, keepdims=True)
    for n in (10_000, 1_000_000):
        z, words = N.design(n, 0.9)
        hit = np.zeros(300, bool)
        for seed in range(N.CODES):
            hit |= [len(np.intersect1d(a, b)) > 0 for a, b in zip(N.decode(x, z, words, seed), N.decode(y, z, words, seed))]
        assert hit.mean() >= 0.93


def test_list_decoding_is_complete():
    g = np.random.default_rng(4)
    x = g.standard_normal((20, 18))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn, a, b = N.code(18, 15, 1)
    y = x @ turn
    for row, got in zip(y, N.decode(x, 1.2, 15, 1)):
        s = (a @ row[:9])[:, None] + (b @ row[9:])[None]
        assert got.tolist() == np.flatnonzero(s.ravel() >= 1.2 * np.sqrt(2 / 18)).tolist()
