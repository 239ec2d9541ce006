import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import ODD
from pyspark.sql import functions as F
from torquil.llm import language_filters as L


def grams_by_hand(text):
    padded = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in f" {text} ")
    return Counter(padded[i : i + n] for n in L.ORDERS for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1])


@pytest.mark.parametrize("piece", [7, 1 << 18])
def test_grams_of_pieces(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    texts = ["Ein Wort, zwei Wörter; x yz", "", None, "日本語テキスト İstanbul a", "a" * 50, "12 - ?", "a" * 50]
    seen = [Counter() for _ in texts]
    for codes, at, rows, _ in L.pieces(texts):
        for h, i in zip(*(x.tolist() for x in L.grams(codes, at, rows))):
            seen[i][h] += 1
    for text, got in zip(texts, seen):
        assert sorted(got.values()) == sorted(grams_by_hand(text or "").values())
    assert seen[4] == seen[6]


def test_filter_has_every_n_gram_and_counts_are_corrected(spark, documents):
    rng = random.Random(1)
    say = lambda letters: " ".join("".join(rng.choices(letters, k=6)) for _ in range(3000))
    texts = {0: say("abcdef"), 1: say("uvwxyz")}
    training = spark.createDataFrame(list(texts.items()), "language int, text string")
    owned = L.belonging(training)
    assert owned.count() == sum(len(grams_by_hand(t)) for t in texts.values())
    (masks, chance), = L.filters(owned, 2)
    assert masks.dtype == np.uint8 and len(masks) == L.BITS
    found, total, lettered = L.bit_counts([texts[0], texts[1], "12"], masks, 2)
    assert total.tolist() == [sum(grams_by_hand(texts[0]).values()), sum(grams_by_hand(texts[1]).values()), 0] and lettered.tolist() == [True, True, False]
    assert found[0, 0] == total[0] and found[1, 1] == total[1]
    assert abs(found[0, 1] - total[0] * chance[1]) <= 5 * np.sqrt(total[0] * chance[1] + 1)


def test_share_keeps_other_languages_passages_out(spark):
    rows = [(0, "wort " * 1000 + "mot "), (1, "mot " * 1000)]
    owned = L.belonging(spark.createDataFrame(rows, "language int, text string")).groupBy("gram").count()
    assert owned.where("count > 1").count() == 0


def test_odd_rows_and_no_training(documents):
    docs = documents([(1, "the cat"), (2, "1234 !"), *ODD])
    train = documents([(7, "the cat sat on the mat"), (8, None)], lang="en").union(documents([(9, "le chat est la")], lang="fr")).union(documents([(10, "das")], lang=None))
    got = sorted(map(tuple, L.languages(docs, train).collect()), key=str)
    assert len(got) == 2 + len(ODD)
    by = {g[0]: g for g in got if g[0] is not None}
    # of its eight n-grams one, "at ", is French as well
    assert by[1][1] == "en" and by[1][2] == pytest.approx(8 / 9, abs=0.01)
    assert all(by[i][1:3] == ("und", 0.0) for i in (2, 900, 901, 902))
    assert by[905][1:3] == ("en", 0.0) and [g[1] for g in got if g[0] is None] == ["en", "und"]
    assert {tuple(r)[1:3] for r in L.languages(docs, train.where("false")).collect()} == {("und", 0.0)}
    assert L.languages(documents([]), train).count() == 0


def test_more_languages_than_a_mask_holds(spark, documents):
    rng = random.Random(3)
    words = {i: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(30)] for i in range(70)}
    train = spark.createDataFrame([(f"l{i:02}", " ".join(ws)) for i, ws in words.items()], "lang string, text string")
    docs = documents([(i, " ".join(ws[:9])) for i, ws in words.items()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.languages(docs, train).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: f"l{i:02}" for i in words} and all(s > 0.8 for _, s in got.values())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = L.op12_language_filters(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out) and len(out) == 1000
    unseen = [r for r in out if r.held_out]
    assert sum(r.lang == r.lang_pred for r in unseen) >= 0.98 * len(unseen)


def test_labels_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = docs.where(~L.held_out())
    same = L.languages(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), train)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, L.languages(docs, train).collect()))
