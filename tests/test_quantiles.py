"""Exact quantiles by refined bins, and orders whose rows crowd in one place."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from torquil.operators import quantiles as Q, segment as S
from torquil.operators.timeline import Timeline

OF = {"a": 0.5, "b": 0.05, "c": 0.998, "d": 1.0, "e": 0.0}


def rows():
    rng = random.Random(1)
    out = [("near", 1.0 + rng.random() * 1e-12) for _ in range(700)] + [("near", 1e300), ("near", -1e300)]
    out += [("wide", rng.lognormvariate(0, 9)) for _ in range(900)] + [("same", 7.5)] * 400 + [("few", float(i)) for i in range(3)]
    out += [(None, rng.gauss(0, 1)) for _ in range(301)] + [("few", None), ("none", None)]
    return out + [("inf", x) for x in (float("inf"), float("-inf"), 1.0, 2.0, 3.0, float("inf"), float("inf"))]


@pytest.mark.parametrize("gathered", [1, 100_000])
def test_quantiles_of_numpy(spark, monkeypatch, gathered):
    monkeypatch.setattr(Q, "GATHERED", gathered)
    monkeypatch.setattr(Q, "BINS", 16)
    df = spark.createDataFrame(rows(), "key string, value double")
    got = {r.key: r for r in Q.quantiles(df, ("key",), {"a": 0.5, "b": 0.05, "d": 1.0, "e": 0.0}).collect()}
    assert set(got) == {"near", "wide", "same", "few", None, "inf"}
    for k, r in got.items():
        v = np.array([x for key, x in rows() if key == k and x is not None])
        want = np.quantile(v, [0.5, 0.05, 1, 0]) if k != "inf" else [3.0, float("-inf"), float("inf"), float("-inf")]
        assert np.allclose([r.a, r.b, r.d, r.e], want, rtol=1e-14, atol=0), k


def test_counts_stand_for_rows(spark):
    df = spark.createDataFrame(rows(), "key string, value double").where("key <> 'inf'")
    whole = Q.quantiles(df, (), OF).first()
    counted = Q.quantiles(df.groupBy("value").count(), (), OF, "value", "count").first()
    v = np.array([x for k, x in rows() if k not in ("inf", None) and x is not None])
    assert np.allclose(list(whole), np.quantile(v, list(OF.values())), rtol=1e-12) and list(whole) == list(counted)


def test_nan_and_no_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("nan"),)], "value double")
    assert np.isnan(Q.quantiles(df, (), {"m": 0.5}).first().m) and Q.quantiles(df, (), {"m": 0.0}).first().m == 1.0
    none = df.where("false")
    assert Q.quantiles(none, (), {"m": 0.5}).count() == 0 and Q.quantiles(none, (), {"m": 0.5}, whole=True).first().m is None


def crowded(spark):
    """Nine tenths of the rows on one day, and of one machine; a third at one time."""
    at = F.when(F.col("id") % 10 == 0, F.col("id") * 86400).when(F.col("id") % 3 == 0, F.lit(5000)).otherwise(F.col("id") % 4001)
    machine = F.when(F.col("id") % 10 < 9, F.lit("m0")).when(F.col("id") % 20 == 9, F.concat(F.lit("m"), F.col("id") % 7))
    return spark.range(20_000).select("id", F.timestamp_seconds(at).alias("t"), machine.alias("m"), (F.hash("id") % 3).alias("x"))


def test_one_day_spreads_over_all_buckets(spark):
    line = Timeline(("t", "id"), (), 16).over(crowded(spark))
    sizes = [r["count"] for r in line._bucketed(crowded(spark)).groupBy("__bucket").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * 20_000 / 16


@pytest.mark.parametrize("entity", [(), ("m",), ("m", "x")])
def test_buckets_equal_one_window(spark, entity):
    df = crowded(spark)
    line = Timeline(("t", "id"), entity, 13)
    w = Window.partitionBy(*(entity or [F.lit(1)])).orderBy("t", "id")
    want = df.select("id", F.lag("x").over(w).alias("p"), F.sum(F.col("x").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.row_number().over(w).alias("n"))
    got = line.row_number(line.running_sum(line.previous(df, p="x"), F.col("x"), "s"), "n")
    assert got.where((F.col("n") == 1) != F.col("__first")).count() == 0
    assert sorted(map(tuple, got.select("id", "p", "s", "n").collect())) == sorted(map(tuple, want.collect()))


def test_split_first_numbers_follow_the_combinations(spark):
    df = crowded(spark).withColumn("created_at", F.col("t"))
    got = S.events_split_first(df, ("m", "x"), "created_at", "id", 4000.0).groupBy("m", "x").agg(F.min("event").alias("a"), F.max("event").alias("b")).collect()
    got.sort(key=lambda r: (r.m is None, r.m or "", r.x))
    assert got[0].a == 1 and all(r.b + 1 == s.a for r, s in zip(got, got[1:])) and got[-1].m is None


def test_no_rows(spark):
    df = crowded(spark).where("false")
    line = Timeline.within(("m",), "t", "id")
    assert line.row_number(line.previous(df, p="x"), "n").count() == 0
