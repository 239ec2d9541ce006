"""Forest classification of families on Spark ML, validated with whole events held out."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from torquil.config import DEFAULTS
from torquil.operators import features as M
from torquil.operators.grown import probabilities
from torquil.sources import shared as T

#: Parts of a fit's samples at least, and at most while they have fewer than the second number of rows; rows that ask for one more of the former, and of the latter.
PARTS, ROWS = (4, 12), (7_500, 300_000)
#: Fits of a validation that share a job.
FITS = 10


@dataclass(frozen=True)
class Forest:
    columns: tuple[str, ...]
    label: str = "family"
    trees: int = DEFAULTS.trees
    depth: int = 10
    seed: int = DEFAULTS.seed
    pool: int = 4

    def fit(self, samples: DataFrame) -> PipelineModel:
        """A forest that depends on the samples' values and the seed alone: rows are dealt and ordered by their values, as each part draws its own rows.

        Each part sends the counts of all nodes of a level, so there are as few parts as keep the cores busy, whatever
        the shuffle partitions: these sums, not the rows, are most of the work.
        """
        samples = samples.select(self.label, *self.columns)
        n = samples.count()
        parts = max(PARTS[0], min(PARTS[1], n // ROWS[0]), n // ROWS[1])
        samples = samples.repartition(parts, self.label, *self.columns).sortWithinPartitions(self.label, *self.columns).persist()
        forest = RandomForestClassifier(labelCol="__label", featuresCol="__x", numTrees=self.trees, maxDepth=self.depth, featureSubsetStrategy="sqrt", seed=self.seed)
        try:
            return Pipeline(stages=[StringIndexer(inputCol=self.label, outputCol="__label", handleInvalid="skip", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=list(self.columns), outputCol="__x"), forest]).fit(samples)
        finally:
            samples.unpersist()

    def probabilities(self, model: PipelineModel, samples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
        """(keys, class, p): a row for each sample and class."""
        names = F.array(*[F.lit(x) for x in model.stages[0].labels])
        scored = model.stages[2].transform(model.stages[1].transform(samples))
        return scored.select(*keys, F.posexplode(vector_to_array("probability"))).select(*keys, names[F.col("pos")].alias("class"), F.col("col").alias("p"))

    def blocks(self, model: PipelineModel, samples: DataFrame, block: str) -> DataFrame:
        """(block, class, p, rank): mean over the block's windows, ranked; ties by name."""
        return ranked(self.probabilities(model, samples, (block,)), block)

    def classified(self, model: PipelineModel, samples: DataFrame, block: str, operator: DataFrame, least: int = DEFAULTS.least_readings) -> DataFrame:
        """Each block's family, confidence, windows, whether it is short of data, and whether operator (block, readings, operator_family) says another family."""
        top = top_family(self.blocks(model, samples, block), block)
        n = samples.groupBy(block).agg(F.count("*").alias("windows"))
        out = top.join(n, block).join(operator, block, "left")
        return out.withColumn("short", F.col("readings") < least).withColumn("diverges", F.coalesce(F.col("operator_family") != F.col("family"), F.lit(False)))

    def held_out(self, samples: DataFrame, event: str, one) -> DataFrame:
        """The ranking of one event by a forest that never saw it."""
        dealt = samples.withColumn("__one", F.when(F.col(event) == one, 1).otherwise(0))
        return ranked(self._scored(dealt, "__one", (event,), [1]), event)

    def left_out(self, samples: DataFrame, event: str, groups: int | None = None) -> DataFrame:
        """(event, label, class, p, rank) of every event, by forests that never saw it: one for each event, or one for each group of events, all of which it leaves out.

        The samples are stored once, and a fit only leaves rows out. An event has no ranking if no other samples are left.
        """
        stored = T.written(samples.select(event, self.label, *self.columns), "samples")
        events = stored.select(event).distinct()
        if groups:
            dealt = events.withColumn("__group", (F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col(event).cast("string"))))) - 1) % groups)  # a row for each event
        else:
            dealt = events.withColumn("__group", F.row_number().over(Window.orderBy(event)))
        dealt = T.written(dealt, "groups")
        grouped = T.written(stored.join(dealt, event), "grouped")
        out = ranked(self._scored(grouped, "__group", (event,)), event)
        return out.join(stored.groupBy(event).agg(F.first(self.label).alias(self.label)), event).select(event, self.label, "class", "p", "rank")

    def _scored(self, folded: DataFrame, fold: str, keys: tuple[str, ...], fits: list[int] | None = None) -> DataFrame:
        """(keys, class, p): a row for each sample and class, by the forest of the samples of other folds; some fits at a time."""
        fits = [r[0] for r in folded.select(fold).distinct().orderBy(fold).collect()] if fits is None else fits
        one = lambda ks: probabilities(folded, fold, keys, self.columns, self.label, self.trees, self.depth, self.seed, ks)
        some = [fits[i : i + FITS] for i in range(0, len(fits), FITS)]
        return one(fits) if len(some) < 2 else side_by_side([lambda ks=ks: one(ks) for ks in some], self.pool, folded.sparkSession)

    def cross_validated(self, folded: DataFrame, keys: tuple[str, ...], folds: int) -> DataFrame:
        """(keys, label, fold, predicted): each fold by a forest grown on the others."""
        p = self._scored(folded, "fold", (*keys, self.label, "fold"), list(range(folds)))
        return p.groupBy(*keys, self.label, "fold").agg(F.max_by("class", F.struct("p", "class")).alias("predicted"))

    def _folded(self, samples: DataFrame, event: str, keys: tuple[str, ...], folds: int) -> dict[str, DataFrame]:
        dealt = {"random": M.random_folds(samples, self.label, keys, folds, self.seed), "by event": M.event_folds(samples, self.label, event, folds, self.seed)}
        return {name: T.written(df, "folds") for name, df in dealt.items()}  # each fit reads it again

    def validated(self, samples: DataFrame, event: str, keys: tuple[str, ...], folds: int = DEFAULTS.folds) -> DataFrame:
        """(strategy, accuracy, macro_f1, leaked) with samples dealt singly and with events whole."""
        out = None
        for strategy, folded in self._folded(samples, event, keys, folds).items():
            leaked = M.leaks(folded, event).agg(F.sum("leaked").alias("leaked"))
            row = M.scores(self.cross_validated(folded, keys, folds), self.label, "predicted").crossJoin(leaked).withColumn("strategy", F.lit(strategy))
            out = row if out is None else out.unionByName(row)
        return out

    def importances(self, model: PipelineModel, spark) -> DataFrame:
        """(feature, column, importance): as many rows as features."""
        rows = [(c, c.split("__")[0], float(v)) for c, v in zip(self.columns, model.stages[2].featureImportances.toArray())]
        return spark.createDataFrame(rows, "feature string, column string, importance double")


def ranked(probabilities: DataFrame, block: str) -> DataFrame:
    """(block, class, p, rank) of probabilities (block, class, p), a row for each window: their mean, ranked; ties by name."""
    mean = probabilities.groupBy(block, "class").agg(F.avg("p").alias("p"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy(block).orderBy(F.desc("p"), "class")))


def top_family(ranking: DataFrame, block: str) -> DataFrame:
    return ranking.where("rank = 1").select(block, F.col("class").alias("family"), F.col("p").alias("confidence"))


def side_by_side(jobs: list[Callable[[], DataFrame | None]], pool: int, session: SparkSession | None = None) -> DataFrame | None:
    """The union of what the jobs give, `pool` of them at a time, each written as it comes: Spark deals their tasks to the same executors."""
    if not jobs:
        return None
    session = session or T.active()
    run = inheritable_thread_target(session)(lambda job: (lambda df: None if df is None else T.written(df, "fit"))(job()))
    with ThreadPoolExecutor(pool) as threads:
        parts = [df for df in threads.map(run, jobs) if df is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def experiment(events: DataFrame, forest: Forest, sizes: tuple[int, ...], columns: tuple[str, ...], regime: tuple[str, ...], with_regime: tuple[bool, ...], event: str, order: tuple[str, ...], folds: int = DEFAULTS.folds) -> DataFrame:
    """(size, regime, samples, events, lost_pct, classes, by_event, random, inflation): accuracy by window size, with and without the regime's columns as features.

    Windows of all sizes are summarised once, into one table. Classes with fewer events than folds are left out; a size
    that leaves fewer than two classes has no accuracy. All fits of the grid share one pool.
    """
    spark, label = events.sparkSession, forest.label
    parts = [M.summarised(M.windowed(events, event, order, size), (label, event), (*columns, *regime)).withColumn("size", F.lit(size)) for size in sizes]
    windows = T.written(reduce(DataFrame.unionByName, parts), "windows")
    per_class = windows.groupBy("size", label).agg(F.count_distinct(event).alias("__events")).where(F.col("__events") >= folds).drop("__events")
    kept = T.written(windows.join(per_class, ["size", label]), "windows")
    counts = {r["size"]: r for r in kept.groupBy("size").agg(F.count("*").alias("samples"), F.count_distinct(event).alias("events"), F.count_distinct(label).alias("classes")).collect()}  # a row for each size
    total = events.select(event).distinct().count()
    jobs = []
    for size in sizes:
        if size not in counts or counts[size].classes < 2:
            continue
        for strategy, folded in forest._folded(kept.where(F.col("size") == size), event, (event, "k"), folds).items():
            for on in with_regime:
                names = tuple(f"{c}__{s}" for c in (*columns, *(regime if on else ())) for s in M.STATISTICS)
                tag = lambda df, size=size, on=on, strategy=strategy: df.withColumns({"size": F.lit(size), "regime": F.lit(on), "strategy": F.lit(strategy)})
                jobs.append(lambda f=replace(forest, columns=names), folded=folded, tag=tag: tag(f.cross_validated(folded, (event, "k"), folds)))
    said = side_by_side(jobs, forest.pool)
    cells = spark.createDataFrame([(size, on, *((counts[size].samples, counts[size].events, counts[size].classes) if size in counts else (0, 0, 0))) for size in sizes for on in with_regime], "size int, regime boolean, samples long, events long, classes long")
    cells = cells.withColumn("lost_pct", 100 * (1 - F.try_divide(F.col("events"), F.lit(total))))
    if said is None:
        return cells.withColumns({c: F.lit(None).cast("double") for c in ("by_event", "random", "inflation")})
    right = F.avg((F.col(label) == F.col("predicted")).cast("double"))
    wide = said.groupBy("size", "regime", "strategy").agg(right.alias("a")).groupBy("size", "regime").agg(*[F.max(F.when(F.col("strategy") == s, F.col("a"))).alias(n) for s, n in (("by event", "by_event"), ("random", "random"))])
    return cells.join(wide, ["size", "regime"], "left").withColumn("inflation", F.col("random") - F.col("by_event"))
