import math
from collections import Counter

import numpy as np

from conftest import ODD
from torquil.llm import class_lm as M


def test_base_scores_and_perplexity(documents, monkeypatch):
    monkeypatch.setattr(M, "HEAD", 30)
    monkeypatch.setattr(M, "CLUSTERED", 20)
    monkeypatch.setattr(M, "CLASSES", 4)
    g = np.random.default_rng(0)
    sets = [[f"{c}{i}" for i in range(8)] for c in "nvad"]
    rows = [(i, " ".join(sets[k % 4][int(g.integers(8))] for k in range(int(g.integers(5, 60)))) + f" Rare{i % 40}") for i in range(200)]
    rows += [(i, t) for i, t in ODD if t is None or len(t) < 100]
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in M.class_scores(documents(rows)).collect()], key=lambda r: (str(r[:4]), r[5]))
    counts = Counter(w for i, t in rows if not M.held_out(i) for w in [*(t or "").encode().lower().split(), b"\n"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        ws = [*(t or "").encode().lower().split(), b"\n"]
        want.append((i, M.held_out(i), len(ws), sum(w in counts for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    want.sort(key=lambda r: (str(r[:4]), r[5]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-12)
    held = [r for r in got if r[1]]
    assert sum(r[6] for r in held) > 0.85 * sum(r[5] for r in held)  # scores are negative: a better model


def test_probabilities_sum_to_one(documents, spark, monkeypatch):
    monkeypatch.setattr(M, "HEAD", 3)
    monkeypatch.setattr(M, "CLUSTERED", 2)
    monkeypatch.setattr(M, "CLASSES", 2)
    rows = [(i, "a b c d e a b a") for i in range(1, 40) if not M.held_out(i)]
    vocabulary = ["a", "b", "c", "d", "e", "never"]
    held = [i for i in range(1000, 2000) if M.held_out(i)][:7]
    got = M.class_scores(documents(rows + list(zip(held, [*vocabulary, ""])))).where("doc_id >= 1000").collect()
    assert sorted(r.doc_id for r in got if r.held_out and r.n_known == r.n_tokens) == held[:5] + held[6:]
    # P(w, end) summed over w is the chance of a text of one word; with longer texts and the empty one all sums to 1 or less
    assert 0 < sum(10**r.score for r in got) <= 1


def test_every_training_word_has_a_class(documents, monkeypatch):
    monkeypatch.setattr(M, "HEAD", 16)
    monkeypatch.setattr(M, "CLUSTERED", 16)
    monkeypatch.setattr(M, "CLASSES", 2)
    g = np.random.default_rng(0)
    # n and v alternate; rare words, far beyond HEAD, stand in the place of a v or of an n
    rows = []
    for i in [i for i in range(1, 400) if not M.held_out(i)][:300]:
        ws = [f"{'nv'[k % 2]}{g.integers(8)}" for k in range(20)]
        ws[9 if i % 2 else 8] = f"{'x' if i % 2 else 'y'}{i % 60}"
        rows.append((i, " ".join(ws)))
    held = [i for i in range(1000, 2000) if M.held_out(i)][:4]
    probe = list(zip(held, ["n1 x7 n2", "n1 y8 n2", "n1 never n2", ""]))
    score = {r.doc_id: (r.score, r.n_known) for r in M.class_scores(documents(rows + probe)).where("doc_id >= 1000").collect()}
    assert score[held[0]][0] > score[held[1]][0] + 1  # x7 is of the words that stand between n and n
    assert [score[i][1] for i in held] == [4, 4, 3, 1]


def test_model_sums_to_one():
    g = np.random.default_rng(0)
    both = g.integers(0, 50, (5, 5))
    both[:, 2] = 0  # a class without words
    both[2] = 0
    log, unseen = M._model(both, np.array([3.0, 0.0, 0.0, 7.0, 0.0]))
    p = 10**log
    # words of a class share what it doesn't leave to unseen words; the last column is all unseen words' together
    assert np.allclose(p[:, :5] @ (1 - unseen) + p[:, 5], 1) and unseen[2] == 1 and unseen[4] == 0


def test_nothing_to_learn_from(documents):
    assert M.class_scores(documents([])).count() == 0
    got = M.class_scores(documents([(None, "a b")])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(True, 3, 0, 0, 0.0)] and got[0].score <= 0


def test_exchange_finds_the_classes():
    g = np.random.default_rng(0)
    # words 1..8 alternate with words 9..16
    text = np.array([[1 + g.integers(8), 9 + g.integers(8)] for _ in range(4000)]).ravel()
    classes = np.full(1 << 16, 3, np.int64)
    classes[0] = 2
    classes[1:17] = np.arange(16) % 2
    for _ in range(4):
        c = classes[text]
        both = np.zeros((5, 5), np.int64)
        np.add.at(both, (c[:-1], c[1:]), 1)
        words = {}
        for w in range(1, 17):
            at = np.flatnonzero(text[1:-1] == w) + 1
            words[w] = np.concatenate((np.bincount(c[at - 1], minlength=5), np.bincount(c[at + 1], minlength=5)))
        M.exchange(both, words, classes, 2)
    assert len(set(classes[1:9])) == 1 and len(set(classes[9:17])) == 1 and classes[1] != classes[9]
