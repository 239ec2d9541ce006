"""Profiles and quality of a readings table, label signatures and downsampled series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from torquil import functions as X
from torquil.config import DEFAULTS
from torquil.operators.quantiles import quantiles, with_quantiles
from torquil.operators.timeline import Timeline
from torquil.sources import shared as T


def long(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, column, value): numeric columns one below the other."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "column", "value")


def table_summary(df: DataFrame, label: str = DEFAULTS.label) -> DataFrame:
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"), F.count_distinct(label).alias("labels"), nulls.alias("null_cells"))


def nulls_by_column(df: DataFrame) -> DataFrame:
    """(column, nulls, null_pct, filled, distinct_values, type) of every column."""
    types = dict(df.dtypes)
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in df.columns])
    distinct = df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], list(df.columns), "column", "v").where("v is not null").groupBy("column", "v").agg(F.count("*").alias("k")).groupBy("column").agg(F.count("*").alias("distinct_values"))
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.round(100 * F.try_divide(F.col(f"n_{c}"), F.col("n")), 6).alias("null_pct"), (F.col("n") - F.col(f"n_{c}")).alias("filled"), F.lit(types[c]).alias("type")) for c in df.columns])).alias("x")).select("x.*")
    return rows.join(distinct, "column", "left").withColumn("distinct_values", F.coalesce("distinct_values", F.lit(0)))


def is_state(label: Column, stems: tuple[str, ...]) -> Column:
    """Whether the label holds a stem of a state that is no problem."""
    return F.coalesce(F.lower(label).rlike("|".join(stems)), F.lit(False))


def label_profile(df: DataFrame, label: str = DEFAULTS.label, time: str = DEFAULTS.time, states: tuple[str, ...] = ("l0",)) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    out = df.groupBy(label).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).crossJoin(F.broadcast(total))
    return out.select(label, "n", "first", "last", (X.seconds("first", "last") / 3600).alias("span_h"), (100 * F.col("n") / F.col("total")).alias("pct"), (~is_state(F.col(label), states)).alias("is_problem"))


def time_span(df: DataFrame, position: str, time: str = DEFAULTS.time) -> DataFrame:
    """Start, end, days, whether the file never steps back, distinct times and rows that repeat one."""
    out = Timeline.by_position(position).previous(df.select(position, time), __pt=time)
    return out.agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count_distinct(time).alias("times"), F.count("*").alias("n"), F.count_if(F.col(time) < F.col("__pt")).alias("b")).select("start", "end", (X.seconds("start", "end") / 86400).alias("days"), (F.col("b") == 0).alias("monotonic"), "times", (F.col("n") - F.col("times")).alias("repeated"))


def sampling_rate(df: DataFrame, time: str = DEFAULTS.time, tie: str = DEFAULTS.tie, cadence_s: float = DEFAULTS.cadence_s, slack_s: float = DEFAULTS.cadence_slack_s, cut_s: float = DEFAULTS.session_gap_s) -> DataFrame:
    """Median, 5th and 95th percentile gap, share on the cadence, cuts, sessions and the largest gap, in time order."""
    gaps = Timeline.by_time(time, tie).previous(df.select(time, tie), __pt=time).select(X.seconds("__pt", time).alias("g"))
    gaps = T.written(gaps.where("g is not null").groupBy("g").agg(F.count("*").alias("k")), "gaps")
    count = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("k"))), F.lit(0))
    out = gaps.agg(F.sum("k").alias("n"), count(F.abs(F.col("g") - cadence_s) <= slack_s).alias("on"), count(F.col("g") > cut_s).alias("cuts"), F.max("g").alias("largest_s"))
    out = out.crossJoin(quantiles(gaps, (), {"median_s": 0.5, "p05_s": 0.05, "p95_s": 0.95}, "g", "k", whole=True))
    return out.select("median_s", "p05_s", "p95_s", (100 * F.try_divide("on", "n")).alias("on_cadence_pct"), "cuts", (F.col("cuts") + 1).alias("sessions"), "largest_s")



def file_jumps(df: DataFrame, position: str, time: str = DEFAULTS.time) -> DataFrame:
    """Steps back in file order: count, share, worst, and the median step forward. Rows of one position go by time."""
    steps = Timeline((position, time)).previous(df.select(position, time), __pt=time).select(X.seconds("__pt", time).alias("d"))
    steps = T.written(steps.where("d is not null").groupBy("d").agg(F.count("*").alias("k")), "steps")
    back = F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("k"))), F.lit(0))
    out = steps.agg(back.alias("backward"), (100 * F.try_divide(back, F.sum("k"))).alias("backward_pct"), F.min(F.when(F.col("d") < 0, F.col("d"))).alias("worst_s"))
    return out.crossJoin(quantiles(steps.where("d >= 0"), (), {"median_forward_s": 0.5}, "d", "k", whole=True))


def dominant_values(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column, distinct_values, mode, mode_pct, constant) of numeric columns: ties go to the least value; the share is of all rows."""
    counts = long(df, columns).groupBy("column", "value").agg(F.count("*").alias("k"))
    top = counts.groupBy("column").agg(F.count("value").alias("distinct_values"), F.max_by(F.struct("value", "k"), F.struct(F.col("value").isNotNull(), "k", -F.col("value"))).alias("m"), F.sum("k").alias("n"))
    return top.select("column", "distinct_values", F.col("m.value").alias("mode"), (100 * F.col("m.k") / F.col("n")).alias("mode_pct"), (F.col("distinct_values") <= 1).alias("constant"))


def unit_redundancy(df: DataFrame, pairs: list[tuple[str, str, float, float]], tolerance: float = DEFAULTS.unit_tolerance) -> DataFrame:
    """(source, target, max_error, mean_error, redundant) for target = source * factor + offset."""
    error = [F.abs(F.col(b) - (F.col(a) * f + o)) for a, b, f, o in pairs]
    row = df.agg(*[x for i, e in enumerate(error) for x in (F.max(e).alias(f"x{i}"), F.avg(e).alias(f"a{i}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), F.col(f"x{i}").alias("max_error"), F.col(f"a{i}").alias("mean_error"), F.coalesce(F.col(f"x{i}") <= tolerance, F.lit(False)).alias("redundant")) for i, (a, b, _, _) in enumerate(pairs)])).alias("x")).select("x.*")


def consecutive_duplicates(df: DataFrame, position: str, label: str, measures: tuple[str, ...]) -> DataFrame:
    """(label, n, duplicates): rows equal to the one before in file order. A null measure equals nothing; a null label is passed over. Rows of one position go by label and measures, nulls first."""
    out = Timeline((position, label, *measures)).previous(df, __pl=label, **{f"__p{i}": c for i, c in enumerate(measures)})
    same = X.all_of([F.coalesce(F.col(c) == F.col(f"__p{i}"), F.lit(False)) for i, c in enumerate(measures)]) & F.coalesce(F.col(label) == F.col("__pl"), F.lit(True)) & ~F.col("__first")
    return out.groupBy(label).agg(F.count("*").alias("n"), F.count_if(same).alias("duplicates"))


def repeated_times(df: DataFrame, time: str, label: str, id: str, measures: tuple[str, ...]) -> DataFrame:
    """Instants with several rows: rows, labels, ids, whether all measures agree (nulls apart), repeated rows, and whether ids are consecutive."""
    kinds = F.greatest(*[F.count_distinct(m) for m in measures], F.lit(0))
    out = df.groupBy(time).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("labels"), F.min(id).alias("first_id"), F.max(id).alias("last_id"), (kinds == 1).alias("identical"), (F.count("*") - F.count_distinct(F.struct(*measures))).alias("repeated"), (F.max(id) - F.min(id) + 1 == F.count("*")).alias("contiguous"))
    return out.where("n > 1")


def tukey_outliers(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = (), mild: float = DEFAULTS.tukey, extreme: float = DEFAULTS.tukey_extreme) -> DataFrame:
    """(keys, column, n, low, high, moderate, extreme): values beyond the fences of their column, in all or in each key. Value counts come first, so quartiles take no row twice."""
    counts = T.written(long(df, columns, keys).where("value is not null").groupBy(*keys, "column", "value").agg(F.count("*").alias("k")), "value-counts")
    by = [*keys, "column"]
    q = quantiles(counts, tuple(by), {"q1": 0.25, "q3": 0.75}, "value", "k").withColumn("i", F.col("q3") - F.col("q1"))
    out = counts.join(T.if_small(q), by)
    far = lambda f: (F.col("value") < F.col("q1") - f * F.col("i")) | (F.col("value") > F.col("q3") + f * F.col("i"))
    return out.groupBy(*by).agg(F.sum("k").alias("n"), F.first(F.col("q1") - mild * F.col("i")).alias("low"), F.first(F.col("q3") + mild * F.col("i")).alias("high"), F.sum(F.when(far(mild), F.col("k")).otherwise(0)).alias("moderate"), F.sum(F.when(far(extreme), F.col("k")).otherwise(0)).alias("extreme"))


def droppable(df: DataFrame, columns: tuple[str, ...], pairs: list[tuple[str, str, float, float, str]], leaks: tuple[str, ...]) -> DataFrame:
    """(column, reason): a unit copy, then a leak, then a constant; the first reason counts. pairs: those of unit_redundancy, each with the one of its two columns to drop."""
    drop = df.sparkSession.createDataFrame([(a, b, c) for a, b, _, _, c in pairs], "source string, target string, drop string")
    copies = unit_redundancy(df, [p[:4] for p in pairs]).where("redundant").join(F.broadcast(drop), ["source", "target"]).select(F.col("drop").alias("column"), F.lit("unit copy").alias("reason"), F.lit(1).alias("p"))
    leak = df.sparkSession.createDataFrame([(c, "leak", 2) for c in leaks], "column string, reason string, p int")
    flat = dominant_values(df, columns).where("constant").select("column", F.lit("constant").alias("reason"), F.lit(3).alias("p"))
    return copies.union(leak).union(flat).groupBy("column").agg(F.min_by("reason", "p").alias("reason"))


def signatures(df: DataFrame, columns: tuple[str, ...], label: str = DEFAULTS.label, least: int = 1) -> DataFrame:
    """Medians of each label with `least` rows or more."""
    enough = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    medians = quantiles(long(df, columns, (label,)), (label, "column"), {"median": 0.5})
    wide = medians.groupBy(label).agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in columns])
    return X.joined_on(enough, wide, (label,), "left").select(label, "n", *columns)


def described(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, column, n, median, q1, q3, mean, std, cv, min, max); std is of a sample."""
    values = long(df, columns, keys)
    out = values.groupBy(*keys, "column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    out = with_quantiles(out, values, (*keys, "column"), {"median": 0.5, "q1": 0.25, "q3": 0.75})
    return out.select(*keys, "column", "n", "median", "q1", "q3", "mean", "std", F.try_divide("std", F.abs("mean")).alias("cv"), "min", "max")


def against_global(df: DataFrame, columns: tuple[str, ...], label: str = DEFAULTS.label) -> DataFrame:
    """(label, column, median, global_median, deviation_pct)."""
    own = with_quantiles(long(df, columns, (label,)).select(label, "column").distinct(), long(df, columns, (label,)), (label, "column"), {"median": 0.5})
    whole = quantiles(long(df, columns), ("column",), {"global_median": 0.5}).select("column", "global_median")
    return own.join(F.broadcast(whole), "column", "left").select(label, "column", "median", "global_median", (100 * F.try_divide(F.col("median") - F.col("global_median"), F.abs("global_median"))).alias("deviation_pct"))  # a row for each column


def downsampled(df: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...], time: str, tie: str, factor: int) -> DataFrame:
    """(keys, block, column, time, median, low, high): runs of `factor` rows of each key, long."""
    placed = Timeline.within(keys, time, tie).row_number(df, "__at").withColumn("block", F.floor((F.col("__at") - 1) / factor))
    cut = placed.select(*keys, "block", F.col(time).alias("time"), *[F.col(c).cast("double").alias(c) for c in columns])
    return cut.unpivot([*keys, "block", "time"], list(columns), "column", "value").groupBy(*keys, "block", "column").agg(F.min("time").alias("time"), F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


def with_ratio(df: DataFrame, over: str, under: str, name: str = "axis_ratio") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(over), F.col(under)))


def standardised(df: DataFrame, columns: tuple[str, ...], zero_as_one: bool = True) -> DataFrame:
    """df with z_<column> by the whole table's mean and sample deviation; a deviation of 0 counts as 1, or gives 0."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_samp(c).alias(f"__s_{c}"))])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        s, y = F.col(f"__s_{c}"), F.col(c) - F.col(f"__m_{c}")
        out = out.withColumn(f"z_{c}", y / F.when(s == 0, 1.0).otherwise(s) if zero_as_one else F.when(s > 0, y / s).otherwise(0.0))
    return out.drop(*stats.columns)


def event_profiles(df: DataFrame, columns: tuple[str, ...], group: str, time: str, tie: str, factor: int) -> DataFrame:
    """(group, block, column, minutes, z): standardised blocks of each group, aligned at its start."""
    z = standardised(df, columns)
    start = z.groupBy(group).agg(F.min(time).alias("__start"))
    out = downsampled(z, tuple(f"z_{c}" for c in columns), (group,), time, tie, factor).join(start, group)
    return out.select(group, "block", F.substring("column", 3, 200).alias("column"), (X.seconds("__start", "time") / 60).alias("minutes"), F.col("median").alias("z"))


def file_blocks(df: DataFrame, position: str, label: str = DEFAULTS.label) -> DataFrame:
    """(block, label, first, last, n, next_first, centre): runs in file order, cut where the label changes or the position jumps. Rows of one position go by label."""
    opens = lambda rows: rows.withColumn("__opens", F.col("__first") | X.changed(F.col(label), F.col("__pl")) | (F.col(position) - F.col("__pp") > 1))
    out = Timeline((position, label)).scan(df.select(position, label), {"__pl": label, "__pp": position}, opens, "__opens", "block")
    bands = out.groupBy("block").agg(F.first(label).alias(label), F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n"))
    follow = Timeline.by_position("__neg").previous(bands.withColumn("__neg", -F.col("block")), next_first="first")
    return follow.select("block", label, "first", "last", "n", "next_first", ((F.col("first") + F.col("last")) / 2).alias("centre"))
