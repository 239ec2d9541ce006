import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ODD
from torquil.llm import spelling_trie as S


def by_hand(rows):
    n = Counter()
    for doc_id, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: set() for w in words}
    cut = {}
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in words:
                near[w].add(less)
                near[less].add(w)
            cut.setdefault((i, less), []).append(w)
    for group in cut.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * c:
            form[w] = best
    out = []
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, c, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out, key=str)


def corpus(seed=1, size=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("aeiostrnléßxÉ", k=rng.randint(4, 9))) for _ in range(size)]
    rows = []
    for i in range(400):
        ws = []
        for _ in range(40):
            w = rng.choice(stems[: 1 + int(size * rng.random() ** 2)])
            at = rng.randrange(len(w))
            ws.append(rng.choice([w, w, w[:at] + w[at + 1 :], w[:at] + rng.choice("aeé") + w[at:], w[:at] + rng.choice("rß") + w[at + 1 :], w.capitalize()]))
        rows.append((i, rng.choice([" ", ", ", "1"]).join(ws)))
    return rows


@pytest.mark.parametrize("shard", [7, 4000])
def test_against_deletions(spark, documents, shard):
    rows = corpus() + [(5, "×÷×÷× ×÷×÷× ×÷×÷× naïve日naïve naïve"), (6, "z" * 70 + " "), *[(7 + i, f"{'z' * 70} {'z' * 69}y {'zy' * 50} {'zy' * 49}zz {'zy' * 49}z") for i in range(4)], *ODD]
    got = S.spelling_variants(documents(rows), shard)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)
    assert S.spelling_variants(documents([])).count() == 0


def test_very_many_words_of_the_same_letters(spark, documents):
    rng = random.Random(4)
    made = {"".join(rng.sample("abcdéfgê", 8)) for _ in range(300)}
    made |= {w.replace("é", "e") for w in made} | {w.replace("ê", "") for w in made}
    rows = [(i, " ".join(sorted(made))) for i in range(6)]
    words = S.vocabulary(documents(rows))
    assert max(S.top_of_trie(words, 20)[1]) > 1  # leaves in blocks
    assert sorted(map(tuple, S.spelling_variants(documents(rows), 20).collect()), key=str) == by_hand(rows)


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")], "word string, form string")
    assert {tuple(r) for r in S.roots(forms).collect()} == {(f"w{i}", "w37") for i in range(37)} | {("x", "w37")}


def test_search_finds_each_pair_once():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abcde", k=rng.randint(5, 7))) for _ in range(900)})
    raw = [w.encode() for w in words]
    got = [(int(i), int(j)) for a, b in S.found(raw, raw) for i, j in zip(a, b)]
    want = {(i, j) for i, a in enumerate(raw) for j, b in enumerate(raw) if S.differ_by_one(a, b) and (len(a) < len(b) or a < b)}
    assert len(got) == len(set(got)) and set(got) == want
    assert np.all(S.vectors([b"\xe9e\xc9x\xdf"])[0][[0, 1, 1 + S.LEVELS.index("x"), S.N - 1]] == [5, 3, 1, 1])


def test_real_texts(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.op13_spelling_trie(spark, d).collect()), key=str) == by_hand(rows)
