"""Forests on small tables: no leak, grids, and fits side by side."""

import pytest
from pyspark.sql import functions as F

from torquil.operators import model as M
from torquil.operators.features import STATISTICS

NAMES = tuple(f"x__{s}" for s in STATISTICS)


@pytest.fixture(scope="module")
def samples(spark):
    """Twelve events of three classes with six windows each; the class shows in the median, each event has an offset."""
    rows = []
    for event in range(12):
        for k in range(6):
            x = (event % 3) * 10 + event * 0.1 + k * 0.01
            rows.append((f"c{event % 3}", event, k, x, 1.0 + k % 2, 0.0, float(event), 2.0))
    return spark.createDataFrame(rows, "family string, event int, k int, " + ", ".join(f"{n} double" for n in NAMES)).cache()


def forest(**more):
    return M.Forest(NAMES, "family", trees=8, depth=4, **more)


@pytest.mark.parametrize("groups", [None, 4])
def test_an_events_own_rows_cannot_change_its_ranking(spark, samples, groups):
    before = {(r.event, r["class"]): (r.p, r["rank"], r.family) for r in forest().left_out(samples, "event", groups).collect()}
    assert {e for e, _ in before} == set(range(12)) and {f for _, _, f in before.values()} == {"c0", "c1", "c2"}
    assert sum(f == c for (e, c), (_, rank, f) in before.items() if rank == 1) >= 9
    # one event gets another class: its own ranking stays as it was, to the last digit
    lied = samples.withColumn("family", F.when(F.col("event") == 5, "c0").otherwise(F.col("family")))
    after = {(r.event, r["class"]): (r.p, r["rank"]) for r in forest().left_out(lied, "event", groups).collect()}
    assert {k: v for k, v in after.items() if k[0] == 5} == {k: v[:2] for k, v in before.items() if k[0] == 5}
    assert after != {k: v[:2] for k, v in before.items()}


def test_one_event_and_all_events_agree(samples):
    one = {r["class"]: r.p for r in forest().held_out(samples, "event", 4).collect()}
    every = {r["class"]: r.p for r in forest().left_out(samples, "event").where("event = 4").collect()}
    assert set(one) == set(every) and max(one, key=one.get) == max(every, key=every.get)


def test_validation(samples):
    got = {r.strategy: r for r in forest().validated(samples, "event", ("event", "k"), 3).collect()}
    # a guess is right in a third of all cases, and samples of events that were learned are recognised
    assert got["by event"].leaked == 0 and got["random"].leaked > 0 and 0.5 < got["by event"].accuracy <= got["random"].accuracy


def test_grid(spark):
    rows = spark.range(1200).select("id", (F.col("id") / 100).cast("int").alias("event"), F.timestamp_seconds("id").alias("t"), F.col("id").cast("double").alias("r"))
    rows = rows.withColumns({"family": F.concat(F.lit("c"), F.col("event") % 3), "x": (F.col("event") % 3) * 10 + F.rand(1)}).where("event < 11 or id % 100 < 20")
    f = M.Forest((), "family", trees=4, depth=3)
    got = {(r["size"], r.regime): r for r in M.experiment(rows, f, (10, 50, 500), ("x",), ("r",), (False, True), "event", ("t", "id"), folds=3).collect()}
    assert set(got) == {(s, on) for s in (10, 50, 500) for on in (False, True)}
    small, none = got[10, False], got[500, True]
    assert small.events == 12 and small.lost_pct == 0 and small.classes == 3 and small.by_event > 0.9 and abs(small.inflation - (small.random - small.by_event)) < 1e-12
    assert got[50, False].events == 11 and abs(got[50, False].lost_pct - 100 / 12) < 1e-9
    assert none.samples == 0 and none.lost_pct == 100 and none.by_event is None
    # the regime tells events apart, not classes: samples of known events do better than whole new ones by more
    assert got[10, True].inflation > got[10, False].inflation


def test_a_failing_fit_fails_the_job(spark):
    def fails():
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        M.side_by_side([lambda: spark.range(1), fails], 2)
    assert M.side_by_side([], 2) is None and M.side_by_side([lambda: None], 2) is None


def test_a_forest_is_the_same_whatever_the_shuffle_partitions(spark):
    rows = [("abc"[i * 7 % 3], float(i * 37 % 101), float(i * i % 89)) for i in range(300)]
    samples = spark.createDataFrame(rows, "family string, x double, y double")
    forest, found = M.Forest(("x", "y"), trees=5, depth=4), []
    try:
        for n in (4, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            found.append(forest.fit(samples).stages[2].toDebugString.split("\n", 1)[1])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]
