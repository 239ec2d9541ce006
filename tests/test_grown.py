"""Forests grown by task: splits against brute force, blocks of rows against one, edges, and the jobs of a validation."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from torquil.operators import grown as G, model as M

COLUMNS = ("a", "b", "c")


@pytest.fixture(scope="module")
def samples(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(240, 3)).round(2)
    y = np.where(x[:, 0] > 0.3, "p", np.where(x[:, 1] > 0, "q", "r"))
    rows = [(i, str(y[i]), i % 3, *map(float, x[i])) for i in range(240)] + [(240, None, 0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, family string, fold int, a double, b double, c double").repartition(3).cache()


def scored(samples, trees=6, depth=5, fits=(0, 1, 2)):
    out = G.probabilities(samples, "fold", ("id",), COLUMNS, "family", trees, depth, 0, list(fits))
    return {(r.id, r["class"]): r.p for r in out.collect()}


def test_a_node_takes_the_split_of_least_impurity():
    r = np.random.default_rng(2)
    x, y = r.integers(0, 4, (2, 60)).astype(np.uint8), r.integers(0, 2, 60).astype(np.int32)
    plan = G.Plan(("a", "b"), ["p", "q"], 1, 1, 0, {0: [np.arange(3.0)] * 2})
    w = plan.drawn(0, 0, 0, 60)
    gini = lambda m: (n := w[m].sum()) - sum(w[m & (y == c)].sum() ** 2 for c in (0, 1)) / n if w[m].sum() else np.inf
    best = min((gini(x[j] <= b) + gini(x[j] > b), j, b) for j in (0, 1) for b in range(3))
    tree = plan.grown(0, 0, x, y)
    left = x[tree.feature[0]] <= tree.cut[0]
    assert abs(gini(left) + gini(~left) - best[0]) < 1e-9 and len(tree.feature) == 3
    assert tree.counts[1].tolist() == [w[left & (y == c)].sum() for c in (0, 1)] and (tree.reached(x) == np.where(left, 1, 2)).all()


def test_edges_lie_between_values():
    assert G._edges(np.array([3.0, 1.0, np.nan, 1.0])).tolist() == [2.0] and not len(G._edges(np.array([5.0, 5.0]))) and not len(G._edges(np.array([])))
    many = G._edges(np.arange(6400.0))
    assert len(many) == G.BINS - 1 and set(np.bincount(np.searchsorted(many, np.arange(6400.0)))) == {200}


def test_every_sample_is_scored_by_the_others(samples):
    got = scored(samples)
    assert {i for i, _ in got} == set(range(241)) and {c for _, c in got} == {"p", "q", "r"}  # rows without a label too
    assert all(abs(sum(got[i, c] for c in "pqr") - 1) < 1e-9 for i in range(241))
    true = {r.id: r.family for r in samples.where("id < 240").collect()}
    assert sum(max("pqr", key=lambda c: got[i, c]) == true[i] for i in true) > 210
    assert scored(samples.repartition(5)) == got
    # a row's own label cannot change its score, only those of other folds
    lied = scored(samples.withColumn("family", F.when(F.col("id") == 6, "p").otherwise(F.col("family"))))
    assert all(lied[i, c] == got[i, c] for i in range(0, 241, 3) for c in "pqr") and lied != got


def test_folds_without_others_have_no_scores(samples):
    assert scored(samples.where("fold = 1")) == {} and scored(samples.where("id < 0")) == {}
    # a class of one fold alone is not known to that fold's forest
    assert {c for i, c in scored(samples.where("family <> 'r' or fold = 2")) if i % 3 == 2} == {"p", "q"}


def test_level_by_level_is_the_same_as_at_once(spark, samples, monkeypatch):
    monkeypatch.setattr(G, "TREES", 2)
    at_once, by_level = scored(samples), []
    one = G._by_level
    monkeypatch.setattr(G, "_at_once", lambda packed, plan, chunks: by_level.append(1) or one(spark, packed, plan, chunks))
    assert scored(samples) == at_once and by_level
    monkeypatch.setattr(G, "HELD", 60)
    many = scored(samples)
    assert set(many) == set(at_once) and np.mean([abs(many[k] - at_once[k]) for k in many]) < 0.1


def test_a_validation_takes_a_few_jobs_whatever_trees_depth_and_folds(spark, samples):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "fits")
    try:
        M.Forest(COLUMNS, "family", trees=60, depth=8).cross_validated(samples, ("id",), 3).collect()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 25


def jobs_of(spark, run) -> int:
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "fits")
    try:
        run()
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_left_out_events_take_a_few_jobs_whatever_the_groups(spark, samples):
    forest = M.Forest(COLUMNS, "family", trees=60, depth=8)
    rows = samples.where("family is not null").withColumn("event", F.col("id") % 24)
    assert jobs_of(spark, lambda: forest.left_out(rows, "event", 10).collect()) < 35


@pytest.mark.parametrize("sizes, regime, most", [((10,), (False, True), 120), ((5, 10, 20), (False,), 180)])
def test_an_experiment_takes_a_few_jobs_for_each_cell(spark, sizes, regime, most):
    rows = spark.range(360).select("id", (F.col("id") / 30).cast("int").alias("event"), F.timestamp_seconds("id").alias("t"), F.col("id").cast("double").alias("r"))
    rows = rows.withColumns({"family": F.concat(F.lit("c"), F.col("event") % 3), "x": (F.col("event") % 3) * 10 + F.col("id") % 7})
    got = []
    n = jobs_of(spark, lambda: got.extend(M.experiment(rows, M.Forest((), "family", trees=60, depth=8), sizes, ("x",), ("r",), regime, "event", ("t", "id"), folds=3).collect()))
    assert n < most and len(got) == len(sizes) * len(regime) and all(r.by_event > 0.9 for r in got)
