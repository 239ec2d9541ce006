"""Totals of term weights, held against the weights themselves."""

import pytest
from pyspark.sql import functions as F

from torquil import queries as Q
from torquil.operators import search as R

Q.load()

#: Words that repeat, of other scripts, of one letter; no text; rows that share an id; a row without one.
TEXTS = [(1, "the pump the pump the motor"), (2, "The motor, the fan"), (3, None), (4, ""), (5, "a b c"), (6, "Ängström überlast ängström x2_y"), (7, "the fan the"), (7, "fan motor the"), (None, "the pump"), (8, "the " * 40), (9, "of them 東京 東京 water"), (10, "valve"), (11, "valve of them")]


@pytest.mark.parametrize("share, words", [(2_500_000, 1 << 19), (7, 3)])
def test_totals_are_those_of_the_weights(spark, monkeypatch, share, words):
    monkeypatch.setattr(R, "SHARE", share)  # many pieces, and texts longer than a share
    monkeypatch.setattr(R, "WORDS", words)
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string").repartition(3)
    want = R.tfidf(docs, "doc_id", "text", 0.5).groupBy("doc_id").agg(F.count("*").alias("terms"), F.max("weight").alias("heaviest"), F.sum("weight").alias("total")).where("doc_id is not null")
    out = R.term_totals(docs, "doc_id", "text", 0.5)
    assert dict(out.dtypes) == dict(want.dtypes)
    got, want = ({r.doc_id: (r.terms, r.heaviest, r.total) for r in x.collect()} for x in (out, want))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)


def test_no_texts(spark):
    assert R.term_totals(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    assert R.term_totals(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_terms_are_no_rows_of_their_own(spark):
    plan = Q.QUERIES["term_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
