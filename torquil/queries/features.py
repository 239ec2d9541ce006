"""Samples, folds, splits, metrics and forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from torquil.operators import features as M, segment as S
from torquil.operators.model import Forest, experiment
from torquil.queries import query, readings
from torquil.queries.monitoring import EVENTS, R6
from torquil.sources import shared as T

SIZE, STEP = 20, 10
COLUMNS = ("m1", "m2")
NAMES = tuple(f"{c}__{s}" for c in COLUMNS for s in M.STATISTICS)

_STATS = ", ".join(
    f"""round(coalesce(quantile_cont({c}, 0.5), 0), 6) AS {c}__median, round(coalesce(stddev_pop({c}), 0), 6) AS {c}__std,
round(coalesce((sum((i - (n-1)/2) * {c}) - quantile_cont({c}, 0.5) * sum(CASE WHEN {c} IS NOT NULL THEN i - (n-1)/2 END)) / nullif(any_value(n*(n*n-1)/12), 0), 0), 6) AS {c}__slope,
round(coalesce(max({c}) - min({c}), 0), 6) AS {c}__range, round(coalesce(quantile_cont({c}, 0.9) - quantile_cont({c}, 0.1), 0), 6) AS {c}__spread"""
    for c in COLUMNS
)
WINDOWS = """p AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY created_at, id) - 1 AS j, count(*) OVER (PARTITION BY event) AS m FROM e1),
x AS (SELECT *, unnest(generate_series(greatest(0, ceil((j - 19)/10.0))::BIGINT, j // 10)) AS k FROM p), w AS (SELECT *, j - k*10 AS i, 20.0 AS n FROM x WHERE k*10 + 20 <= m)"""
SAMPLES = "WITH {r}, " + EVENTS + ", " + WINDOWS + ", s AS (SELECT fault, event, k, min(id) AS id FROM w GROUP BY ALL)"
FOLDS = SAMPLES + """, ef AS (SELECT fault, event, (row_number() OVER (PARTITION BY fault ORDER BY md5(concat('0:', event))) - 1) % 5 AS fold FROM (SELECT DISTINCT fault, event FROM s)),
rf AS (SELECT *, (row_number() OVER (PARTITION BY fault ORDER BY md5(concat('0:', event, ':', k))) - 1) % 5 AS fold FROM s)"""


def _events(spark, d):
    return S.events(readings(spark, d))


def _windows(spark, d):
    return M.windowed(_events(spark, d), "event", ("created_at", "id"), SIZE, STEP)


def _samples(spark, d):
    return M.summarised(_windows(spark, d), ("fault", "event"), COLUMNS)


@query("WITH {r}, " + EVENTS + ", " + WINDOWS + f" SELECT fault, event, k, count(*) AS n, {_STATS} FROM w GROUP BY fault, event, k")
def window_features(spark, d):
    """M-02, M-03, M-05: five statistics of each column and sliding window."""
    return _samples(spark, d).select("fault", "event", "k", "n", *R6(*NAMES))


@query("WITH {r}, " + EVENTS + ", w AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY created_at, id) - 1 AS i, count(*) OVER (PARTITION BY event) * 1.0 AS n FROM e1)" + f" SELECT event, {_STATS} FROM w GROUP BY event")
def event_features(spark, d):
    """M-03: the whole event as one window."""
    return M.summarised(M.whole(_events(spark, d), "event", ("created_at", "id")), ("event",), COLUMNS).select("event", *R6(*NAMES))


@query("WITH {r}, " + EVENTS + ", w AS (SELECT *, 0 AS k, row_number() OVER (PARTITION BY fault ORDER BY created_at, id) - 1 AS i, count(*) OVER (PARTITION BY fault) * 1.0 AS n FROM e1)" + f", f AS (SELECT fault, {_STATS} FROM w GROUP BY fault) SELECT fault, 'm1' AS \"column\", m1__median AS median, m1__std AS std, m1__spread AS spread FROM f UNION ALL SELECT fault, 'm2', m2__median, m2__std, m2__spread FROM f")
def statistics_table(spark, d):
    """M-04: a row for each column, a column for each statistic."""
    wide = M.summarised(M.whole(readings(spark, d), "fault", ("created_at", "id")), ("fault",), COLUMNS)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.round(f"{c}__{s}", 6).alias(s) for s in ("median", "std", "spread")]) for c in COLUMNS]))
    return wide.select("fault", rows.alias("x")).select("fault", "x.*")


@query("WITH {r}, " + EVENTS + " SELECT fault, count(*) AS events, count(*) FILTER (n >= 20) AS used, round(100*count(*) FILTER (n < 20)/count(*), 6) AS lost_pct, quantile_cont(n, 0.5) AS median_n FROM ev GROUP BY fault")
def event_coverage(spark, d):
    """G-A21."""
    return M.event_coverage(_events(spark, d).groupBy("fault", "event").agg(F.count("*").alias("n")), SIZE, "fault").select("fault", "events", "used", *R6("lost_pct"), "median_n")


@query("WITH {r}, " + EVENTS + " SELECT event, fault, n FROM ev WHERE n >= 20")
def usable_events(spark, d):
    """G-A22."""
    return _events(spark, d).groupBy("event", "fault").agg(F.count("*").alias("n")).where(F.col("n") >= SIZE)


@query(FOLDS + " SELECT fault, event, fold FROM ef")
def event_folds(spark, d):
    """M-11, M-18: events dealt whole."""
    return M.event_folds(_samples(spark, d).select("fault", "event"), "fault", "event", 5).distinct().select("fault", "event", "fold")


@query(FOLDS + ", a AS (SELECT DISTINCT event, fold FROM rf), b AS (SELECT event FROM a GROUP BY event HAVING count(*) > 1) SELECT fold, count(b.event) AS leaked FROM a LEFT JOIN b USING (event) GROUP BY fold")
def random_fold_leaks(spark, d):
    """M-11: how many events samples dealt singly tear apart."""
    return M.leaks(M.random_folds(_samples(spark, d), "fault", ("event", "k"), 5), "event")


@query(FOLDS + " SELECT fold, 0 AS leaked FROM ef GROUP BY fold")
def event_fold_leaks(spark, d):
    """M-11: events dealt whole tear none."""
    return M.leaks(M.event_folds(_samples(spark, d), "fault", "event", 5), "event")


@query(SAMPLES + " SELECT fault, count(DISTINCT event) AS events FROM s GROUP BY fault HAVING count(DISTINCT event) < 50")
def small_classes(spark, d):
    """M-10."""
    return M.small_classes(_samples(spark, d), "fault", "event", 50)


SPLIT = SAMPLES + """, o AS (SELECT fault, event, row_number() OVER (PARTITION BY fault ORDER BY md5(concat('0:', event))) AS i, count(*) OVER (PARTITION BY fault) AS n FROM (SELECT DISTINCT fault, event FROM s)),
t AS (SELECT fault, event, CASE WHEN i <= CASE WHEN n >= 2 THEN greatest(1, floor(n*0.2)) ELSE 0 END THEN 'test' ELSE 'train' END AS side FROM o)"""


@query(SPLIT + " SELECT fault, side, count(DISTINCT event) AS events, count(*) AS samples FROM s JOIN t USING (fault, event) GROUP BY ALL")
def train_test_split(spark, d):
    """M-12."""
    return M.split(_samples(spark, d), "fault", "event", 0.2).groupBy("fault", "side").agg(F.count_distinct("event").alias("events"), F.count("*").alias("samples"))


@query(SPLIT + " SELECT fault, 'train' AS side FROM (SELECT fault FROM t WHERE side='train' EXCEPT SELECT fault FROM t WHERE side='test') UNION ALL SELECT fault, 'test' FROM (SELECT fault FROM t WHERE side='test' EXCEPT SELECT fault FROM t WHERE side='train')")
def one_sided_classes(spark, d):
    """U-02."""
    return M.one_sided(M.split(_samples(spark, d), "fault", "event", 0.2), "fault")


@query(FOLDS + " SELECT event FROM rf WHERE fold < 2 INTERSECT SELECT event FROM rf WHERE fold >= 2")
def leaked_events(spark, d):
    """U-03: events on both sides of a split of single samples."""
    folded = M.random_folds(_samples(spark, d), "fault", ("event", "k"), 5).withColumn("side", F.when(F.col("fold") < 2, "test").otherwise("train"))
    return M.leaked_events(folded, "event")


@query("WITH {r}, c AS (SELECT count(*) AS n FROM r GROUP BY fault) SELECT count(*) AS classes, round(max(n)/sum(n), 6) AS majority, round(1/count(*), 6) AS random FROM c")
def baselines(spark, d):
    """G-A24."""
    return M.baselines(readings(spark, d), "fault").select("classes", *R6("majority", "random"))


PREDICTED = "WITH {r}, p AS (SELECT fault, CASE WHEN id%3=0 THEN 'L1' WHEN id%7=0 THEN 'L2' ELSE fault END AS said FROM r)"


def _predicted(spark, d):
    return readings(spark, d).withColumn("said", F.when(F.col("id") % 3 == 0, "L1").when(F.col("id") % 7 == 0, "L2").otherwise(F.col("fault")))


@query(PREDICTED + " SELECT fault, said, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY fault), 6) AS share FROM p GROUP BY fault, said")
def confusion(spark, d):
    """M-13."""
    return M.confusion(_predicted(spark, d), "fault", "said").select("fault", "said", "n", *R6("share"))


@query(PREDICTED + ", w AS (SELECT fault, said, count(*) AS k, row_number() OVER (PARTITION BY fault ORDER BY count(*) DESC, said) AS i FROM p WHERE fault <> said GROUP BY fault, said), a AS (SELECT fault, count(*) AS n, round(count(*) FILTER (fault = said)/count(*), 6) AS accuracy FROM p GROUP BY fault) SELECT a.fault, n, accuracy, said AS confused_with, coalesce(k, 0) AS confused FROM a LEFT JOIN w ON a.fault = w.fault AND i = 1")
def accuracy_per_class(spark, d):
    """M-14, J-08."""
    return M.per_class(_predicted(spark, d), "fault", "said").select("fault", "n", *R6("accuracy"), "confused_with", "confused")


@query(PREDICTED + ", c AS (SELECT fault AS c FROM p UNION SELECT said FROM p), f AS (SELECT c, 2*count(*) FILTER (fault = c AND said = c)/(count(*) FILTER (fault = c) + count(*) FILTER (said = c)) AS f1 FROM c, p GROUP BY c) SELECT round((SELECT count(*) FILTER (fault = said)/count(*) FROM p), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f")
def accuracy_and_f1(spark, d):
    """M-11: metrics."""
    return M.scores(_predicted(spark, d), "fault", "said").select(*R6("accuracy", "macro_f1"))


SIZES = (20, 50, 60, 90, 180)


def _forest():
    return Forest(NAMES, "fault")


@query()
def forest_blocks(spark, d):
    """M-06..M-08: families of events by a forest of 400 trees, with confidence and divergence."""
    samples, forest = T.written(_samples(spark, d), "samples"), _forest()
    operator = _events(spark, d).groupBy("event").agg(F.count("*").alias("readings"), F.first("fault").alias("operator_family"))
    return forest.classified(forest.fit(samples), samples, "event", operator)


@query()
def forest_importances(spark, d):
    """T-06."""
    forest = _forest()
    ranked = forest.importances(forest.fit(T.written(_samples(spark, d), "samples")), spark)
    return ranked.unionByName(ranked.groupBy("column").agg(F.sum("importance").alias("importance")).withColumn("feature", F.lit("all")))


@query()
def forest_validation(spark, d):
    """M-11: accuracy with samples dealt singly and events whole, in five folds."""
    return _forest().validated(_samples(spark, d), "event", ("event", "k"))


@query()
def left_out_events(spark, d):
    """M-09: every event's ranking by forests that never saw it, in ten groups of events."""
    return _forest().left_out(_samples(spark, d), "event", 10)


@query()
def window_experiment(spark, d):
    """M-15: accuracy by window size, events whole and samples dealt singly."""
    return experiment(_events(spark, d), _forest(), SIZES, COLUMNS, ("rpm",), (False,), "event", ("created_at", "id"))


@query()
def regime_experiment(spark, d):
    """M-16: accuracy with and without the rotation as a feature."""
    return experiment(_events(spark, d), _forest(), (SIZE,), COLUMNS, ("rpm",), (False, True), "event", ("created_at", "id"))
