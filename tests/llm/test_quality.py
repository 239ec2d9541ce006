import re

import numpy as np

from conftest import ODD
from torquil.llm import quality as Q


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_counts_and_outliers(documents):
    g = np.random.default_rng(0)
    text = lambda n: "\n".join(" ".join("".join(g.choice(list("abcdeé"), int(g.integers(2, 9)))) for _ in range(10)) for _ in range(n))
    rows = [(i, text(int(g.integers(3, 30)))) for i in range(150)]
    rows += [(200, rows[0][1] + "\n" + rows[0][1]), (201, "a b\n\n \na b\na b "), (202, "x y z " * 40), (203, rows[1][1])]
    junk = [(300 + i, " ".join("&#$%*" * 6 for _ in range(60 + i))) for i in range(4)]
    got = {}
    for r in Q.quality(documents(rows + junk + ODD)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows + junk + ODD:
        if i is not None:
            assert tuple(got[i][0][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute(t), i
    assert len(got[903]) == 2 and len(got[None]) == 2 and got[1][0].row == "r"
    assert all(got[i][0].kept for i in range(150)) and not any(got[i][0].kept for i, _ in junk)
    kept = {(r.doc_id, r.text) for r in Q.kept_documents(documents(rows + junk + ODD)).collect()}
    assert kept == {(i, t) for i, t in rows + junk + ODD if i is not None and got[i][0].kept}


def test_small_and_empty_tables(documents):
    assert Q.quality(documents([])).count() == 0
    assert [r.kept for r in Q.quality(documents([(1, "w%d " * 30)], None, None)).collect()] == [False]
    assert [r.kept for r in Q.quality(documents([(1, " ".join(map(str, range(30))))], None, None)).collect()] == [True]


def test_steps_find_the_clean_center():
    g = np.random.default_rng(1)
    import pandas as pd

    x = np.concatenate((g.standard_normal((800, Q.P)), 30 + g.standard_normal((200, Q.P))))
    center, inverse = np.median(x, 0), np.eye(Q.P)
    for _ in range(Q.STEPS):
        y = x - center
        bins = np.floor(np.log2(np.einsum("ni,ij,nj->n", y, inverse.reshape(Q.P, Q.P), y) + 1e-3) * 8).astype(int)
        rows = pd.DataFrame([("g", b, (bins == b).sum(), x[bins == b].sum(0), (x[bins == b].T @ x[bins == b]).ravel()) for b in set(bins.tolist())], columns=["grp", "bin", "n", "s", "ss"])
        out = Q._step(("g",), rows).iloc[0]
        center, inverse = out.center, out.inverse
    assert np.abs(center).max() < 0.2 and 0.5 < np.diag(inverse.reshape(Q.P, Q.P)).mean() < 3


def test_cutoff_rejects_junk_and_keeps_clean_texts(spark):
    x = Q.QUANTILE / 2
    assert abs(np.exp(-x) * (1 + x + x * x / 2) - 0.001) < 1e-5  # chi-square of six features
    assert len(Q.FEATURES) == 6 and Q.CUTOFF == Q.MARGIN * Q.QUANTILE and Q.MARGIN <= 1.25
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    rows = Q.op6_quality(spark, d).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    junk, clean = ([r.kept for r in rows if r.quality == q] for q in (0, 1))
    assert len(junk) > 250 and sum(junk) <= 0.1 * len(junk)
    assert len(clean) > 3000 and len(clean) - sum(clean) <= 0.0025 * len(clean)


def test_columns_with_names_that_operators_use_stay(spark):
    rows = spark.sql("SELECT id AS doc_id, concat_ws(' ', transform(sequence(1, 60), i -> concat('word', i * (id + 3)))) AS text, 'en' AS lang, 's' AS source, 'mine' AS __row, named_struct('x y', id) AS `a.b` FROM range(40)")
    got = Q.kept_documents(rows)
    assert got.columns == rows.columns and {r["__row"] for r in got.collect()} <= {"mine"}
    whole = Q.quality(rows).collect()
    assert len(whole) == 40 and {r["a.b"]["x y"] for r in whole} == set(range(40))
