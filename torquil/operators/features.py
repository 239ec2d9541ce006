"""Samples from events: sliding windows, five statistics a column, folds that keep events whole, and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from torquil.operators.quantiles import with_quantiles
from torquil.operators.timeline import Timeline

STATISTICS = ("median", "std", "slope", "range", "spread")


def windowed(df: DataFrame, group: str, order: tuple[str, ...], size: int, step: int | None = None) -> DataFrame:
    """df once for each full window its row is in: k, and i, the place in it. Shorter groups have none."""
    step = max(1, size // 2) if step is None else step
    w = Window.partitionBy(group)
    out = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    ks = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("__i") - size + 1) / step)).cast("int"), F.floor(F.col("__i") / step).cast("int"))
    out = out.withColumn("k", F.explode(ks)).where(F.col("k") * step + size <= F.col("__n"))
    return out.withColumn("i", F.col("__i") - F.col("k") * step).drop("__i", "__n")


def whole(df: DataFrame, group: str, order: tuple[str, ...]) -> DataFrame:
    """Each group as one window."""
    return df.withColumn("k", F.lit(0)).withColumn("i", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def summarised(windows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """<column>__<statistic> of each window. In the slope a null counts as the median; statistics of nulls alone are 0."""
    parts: list[Column] = [F.count("*").alias("n")]
    for c in columns:
        x = F.col(c).cast("double")
        t = F.when(x.isNotNull(), F.col("i"))
        parts += [
            F.percentile(x, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias(f"__p_{c}"),
            F.stddev_pop(x).alias(f"__s_{c}"),
            (F.max(x) - F.min(x)).alias(f"__r_{c}"),
            F.sum(t * x).alias(f"__tx_{c}"),
            F.sum(x).alias(f"__x_{c}"),
            F.sum(t).alias(f"__t_{c}"),
            F.count(x).alias(f"__n_{c}"),
        ]
    out = windows.groupBy(*keys, "k").agg(*parts)
    middle, squares = (F.col("n") - 1) / 2, F.col("n") * (F.col("n") * F.col("n") - 1) / 12
    features = []
    for c in columns:
        p, m = F.col(f"__p_{c}"), F.col(f"__p_{c}")[0]
        top = F.col(f"__tx_{c}") - middle * F.col(f"__x_{c}") - m * (F.col(f"__t_{c}") - middle * F.col(f"__n_{c}"))
        for name, e in zip(STATISTICS, (m, F.col(f"__s_{c}"), F.try_divide(top, squares), F.col(f"__r_{c}"), p[2] - p[1])):
            features.append(F.coalesce(e, F.lit(0.0)).alias(f"{c}__{name}"))
    return out.select(*keys, "k", "n", *features)


def event_coverage(sizes: DataFrame, size: int, family: str = "family") -> DataFrame:
    """sizes (family, event, n): events of each family, those a window fits in, the share lost, and the median size."""
    out = sizes.groupBy(family).agg(F.count("*").alias("events"), F.count_if(F.col("n") >= size).alias("used"), (100 * F.count_if(F.col("n") < size) / F.count("*")).alias("lost_pct"))
    return with_quantiles(out, sizes, (family,), {"median_n": 0.5}, "n")


def _hashed(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def event_folds(samples: DataFrame, label: str, event: str, folds: int, seed: int = 0) -> DataFrame:
    """samples with fold: events are dealt whole, in turn by hash within their class."""
    events = samples.select(label, event).distinct()
    w = Window.partitionBy(label).orderBy(_hashed(seed, event))
    return samples.join(events.withColumn("fold", (F.row_number().over(w) - 1) % folds), [label, event])


def random_folds(samples: DataFrame, label: str, keys: tuple[str, ...], folds: int, seed: int = 0) -> DataFrame:
    """samples with fold: single samples are dealt in turn by hash within their class."""
    dealt = Timeline.within((label,), "__hash").row_number(samples.withColumn("__hash", _hashed(seed, *keys)), "__at")
    return dealt.withColumn("fold", ((F.col("__at") - 1) % folds).cast("int")).drop("__hash", "__at")


def leaks(samples: DataFrame, event: str) -> DataFrame:
    """(fold, leaked): events of the fold that other folds have too."""
    per = samples.select(event, "fold").distinct()
    several = per.groupBy(event).agg(F.count("*").alias("n")).where("n > 1")
    return per.join(several, event, "left").groupBy("fold").agg(F.count("n").alias("leaked"))


def small_classes(samples: DataFrame, label: str, event: str, least: int) -> DataFrame:
    """Classes with fewer than `least` events."""
    return samples.groupBy(label).agg(F.count_distinct(event).alias("events")).where(F.col("events") < least)


def split(samples: DataFrame, label: str, event: str, test_share: float, seed: int = 0) -> DataFrame:
    """samples with side: test events are the first by hash of each class, one at least if it has two."""
    events = samples.select(label, event).distinct()
    w = Window.partitionBy(label)
    n = F.count("*").over(w)
    test = F.row_number().over(w.orderBy(_hashed(seed, event))) <= F.when(n >= 2, F.greatest(F.lit(1), F.floor(n * test_share))).otherwise(0)
    return samples.join(events.withColumn("side", F.when(test, "test").otherwise("train")), [label, event])


def one_sided(samples: DataFrame, label: str) -> DataFrame:
    """(label, side): classes that only one side of the split has."""
    a, b = (samples.where(F.col("side") == s).select(label) for s in ("train", "test"))
    return a.subtract(b).withColumn("side", F.lit("train")).union(b.subtract(a).withColumn("side", F.lit("test")))


def leaked_events(samples: DataFrame, event: str) -> DataFrame:
    a, b = (samples.where(F.col("side") == s).select(event) for s in ("train", "test"))
    return a.intersect(b)


def confusion(predictions: DataFrame, true: str, predicted: str) -> DataFrame:
    """(true, predicted, n, share): the share is of the true class."""
    return predictions.groupBy(true, predicted).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(true)))


def per_class(predictions: DataFrame, true: str, predicted: str) -> DataFrame:
    """(true, n, accuracy, confused_with, confused): the most frequent wrong class, by name among equals."""
    wrong = predictions.where(F.col(true) != F.col(predicted)).groupBy(true, predicted).agg(F.count("*").alias("confused"))
    first = wrong.withColumn("__r", F.row_number().over(Window.partitionBy(true).orderBy(F.desc("confused"), predicted))).where("__r = 1").select(true, F.col(predicted).alias("confused_with"), "confused")
    return predictions.groupBy(true).agg(F.count("*").alias("n"), (F.count_if(F.col(true) == F.col(predicted)) / F.count("*")).alias("accuracy")).join(first, true, "left").withColumn("confused", F.coalesce("confused", F.lit(0)))


def scores(predictions: DataFrame, true: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, accuracy, macro_f1)."""
    p = predictions.select(*by, F.col(true).alias("__t"), F.col(predicted).alias("__p"))
    sides = p.select(*by, F.col("__t").alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("__t") == F.col("__p")).cast("int").alias("h")).union(p.select(*by, F.col("__p"), F.lit(0), F.lit(1), F.lit(0)))
    f = sides.groupBy(*by, "c").agg(F.sum("t").alias("t"), F.sum("p").alias("p"), F.sum("h").alias("h"))
    return f.groupBy(*by).agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"))


def baselines(samples: DataFrame, label: str) -> DataFrame:
    """(classes, majority, random): accuracy of always the largest class, and of guessing."""
    return samples.groupBy(label).agg(F.count("*").alias("n")).agg(F.count("*").alias("classes"), (F.max("n") / F.sum("n")).alias("majority"), (1 / F.count("*")).alias("random"))
