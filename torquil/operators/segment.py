"""Events, sessions and gaps of labelled readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from torquil import functions as X
from torquil.config import DEFAULTS
from torquil.operators.quantiles import quantiles, with_quantiles
from torquil.operators.timeline import Timeline
from torquil.sources import shared as T


def numbered(df: DataFrame, line: Timeline, breaks: tuple[str, ...], time: str, gap_s: float | None = None, name: str = "event", start: int = 1) -> DataFrame:
    """df with the number of its group: a group opens where a break column changes (null always does) or after a gap beyond gap_s. Also gap_s: seconds since the row before, null in the first row."""
    def cut(rows: DataFrame) -> DataFrame:
        opens = F.col("__first")
        for i, c in enumerate(breaks):
            opens = opens | X.changed(F.col(c), F.col(f"__p{i}"))
        rows = rows.withColumn("gap_s", X.seconds("__pt", time))
        return rows.withColumn("opens", opens | X.exceeded(F.col("gap_s"), gap_s))

    out = line.scan(df, {f"__p{i}": c for i, c in enumerate(breaks)} | {"__pt": time}, cut, "opens", name)
    return out.withColumn(name, F.col(name) + F.lit(start - 1)).drop("__pt", "__first", *[f"__p{i}" for i in range(len(breaks))])


def events(df: DataFrame, breaks: tuple[str, ...] = DEFAULTS.breaks, time: str = DEFAULTS.time, tie: str = DEFAULTS.tie, gap_s: float | None = None) -> DataFrame:
    """Order first: rows in time order, cut where a break column changes."""
    return numbered(df, Timeline.by_time(time, tie), breaks, time, gap_s)


def events_split_first(df: DataFrame, breaks: tuple[str, ...] = DEFAULTS.breaks, time: str = DEFAULTS.time, tie: str = DEFAULTS.tie, gap_s: float | None = None) -> DataFrame:
    """Split first: rows of each combination of break columns in time order, cut at gaps only. Numbers follow the combinations' order; a row with a null break is an event of its own kind like any other."""
    kinds = tuple(x for b in breaks for x in (f"`{b}` IS NULL", f"`{b}`"))  # null combinations come last

    def cut(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("gap_s", X.seconds("__pt", time))
        return rows.withColumn("opens", F.col("__first") | X.exceeded(F.col("gap_s"), gap_s))

    return Timeline.within(kinds, time, tie).scan(df, {"__pt": time}, cut, "opens", "event", whole=True).drop("__pt", "__first")


def summary(df: DataFrame, group: str = "event", time: str = DEFAULTS.time, tie: str = DEFAULTS.tie, firsts: tuple[str, ...] = DEFAULTS.breaks) -> DataFrame:
    """A row for each group: rows, start, end, duration, largest gap inside (0 for one row), and the first row's values."""
    order = F.struct(time, tie)
    out = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.min(time).alias("start"),
        F.max(time).alias("end"),
        F.coalesce(F.max(F.when(~F.col("opens"), F.col("gap_s"))), F.lit(0.0)).alias("largest_gap_s"),
        F.min_by(F.struct(*firsts), order).alias("__f"),
    )
    return out.select(group, "n", "start", "end", X.seconds("start", "end").alias("duration_s"), (X.seconds("start", "end") / 60).alias("duration_min"), "largest_gap_s", *[F.col(f"__f.{c}").alias(c) for c in firsts])


def sessions(df: DataFrame, label: str = DEFAULTS.label, time: str = DEFAULTS.time, tie: str = DEFAULTS.tie, gap_s: float = DEFAULTS.session_gap_s) -> DataFrame:
    """Sessions of each label, numbered from 0, and the gap inside a session (null where one opens)."""
    out = numbered(df, Timeline.within((label,), time, tie), (), time, gap_s, "session", 0)
    return out.withColumn("delta_s", F.when(~F.col("opens"), F.col("gap_s")))


def same_label_gaps(df: DataFrame, label: str = DEFAULTS.label, time: str = DEFAULTS.time, tie: str = DEFAULTS.tie) -> DataFrame:
    """df with gap_s and same: whether the row before has the same label (null never is)."""
    out = Timeline.by_time(time, tie).previous(df, __pl=label, __pt=time)
    return out.select(*df.columns, X.seconds("__pt", time).alias("gap_s"), F.coalesce(F.col(label) == F.col("__pl"), F.lit(False)).alias("same"), F.col("__first").alias("first"))


def gap_stats(gaps: DataFrame, pause_s: float, gap: str = "gap_s") -> DataFrame:
    """(gaps, median_s, largest_s, mean_s, paused_s): paused_s sums the gaps beyond pause_s."""
    out = gaps.agg(F.count("*").alias("gaps"), F.max(gap).alias("largest_s"), F.avg(gap).alias("mean_s"), F.sum(F.when(F.col(gap) > pause_s, F.col(gap))).alias("paused_s"))
    return out.crossJoin(quantiles(gaps, (), {"median_s": 0.5}, gap, whole=True))


def episode_counts(gaps: DataFrame, cuts: list[float]) -> DataFrame:
    """(cut_s, episodes) for every cut at once: a group opens at another label or beyond the cut."""
    counts = gaps.agg(*[F.count_if(~F.col("same") | X.exceeded(F.col("gap_s"), c)).alias(f"c{i}") for i, c in enumerate(cuts)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(c)).alias("cut_s"), F.col(f"c{i}").alias("episodes")) for i, c in enumerate(cuts)])).alias("x")).select("x.*")


def gap_bands(gaps: DataFrame, bounds: list[float]) -> DataFrame:
    """(low_s, high_s, gaps, empty) of same-label gaps; a gap on a bound is in the band that ends there."""
    edges = [0.0, *bounds, float("inf")]
    inside = [F.count_if(F.col("same") & (F.col("gap_s") > lo) & (F.col("gap_s") <= hi)) for lo, hi in zip(edges, edges[1:])]
    row = gaps.agg(*[c.alias(f"c{i}") for i, c in enumerate(inside)])
    parts = [F.struct(F.lit(lo).alias("low_s"), F.lit(None if hi == float("inf") else hi).cast("double").alias("high_s"), F.col(f"c{i}").alias("gaps"), (F.col(f"c{i}") == 0).alias("empty")) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def cut_effects(inside: DataFrame, cuts: list[float], group: str = "event") -> DataFrame:
    """For existing groups, what cutting at each gap beyond the cut would do: groups split, cuts made, groups afterwards. inside: rows with gap_s and opens."""
    gap = F.when(~F.col("opens"), F.col("gap_s"))
    row = inside.agg(F.count_if("opens").alias("groups"), *[x for i, c in enumerate(cuts) for x in (F.count_if(gap > c).alias(f"n{i}"), F.count_distinct(F.when(gap > c, F.col(group))).alias(f"g{i}"))])
    parts = [F.struct(F.lit(float(c)).alias("cut_s"), F.col(f"g{i}").alias("split"), F.col(f"n{i}").alias("cuts"), (F.col("groups") + F.col(f"n{i}")).alias("groups")) for i, c in enumerate(cuts)]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def automatic_cuts(gaps: DataFrame, gap: str = "gap_s") -> DataFrame:
    """(rule, cut_s): Tukey's fences, median and scaled deviation, the 99.8th percentile, and the largest relative jump. The gaps are stored once, as values with counts."""
    g = T.written(gaps.where(F.col(gap) > 0).groupBy(F.col(gap).alias("g")).agg(F.count("*").alias("k")), "gaps")
    q = quantiles(g, (), {"q1": 0.25, "q3": 0.75, "m": 0.5, "p": 0.998}, "g", "k")
    away = g.crossJoin(F.broadcast(q.select("m"))).select(F.abs(F.col("g") - F.col("m")).alias("d"), "k")  # one row
    one = q.crossJoin(quantiles(away, (), {"mad": 0.5}, "d", "k").select("mad"))
    rules = [("tukey", "q3 + 1.5D * (q3 - q1)"), ("tukey_extreme", "q3 + 3D * (q3 - q1)"), ("deviation", "m + 10D * mad / 0.6745D"), ("percentile", "p")]
    out = one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(e).cast("double").alias("cut_s")) for r, e in rules])).alias("x")).select("x.*")
    return out.unionByName(largest_jumps(g, "g", 1).select(F.lit("jump").alias("rule"), F.col("low_s").alias("cut_s")))


def largest_jumps(gaps: DataFrame, gap: str, k: int = 5) -> DataFrame:
    """(low_s, high_s, ratio) of the k largest ratios between neighbours among the distinct positive gaps."""
    distinct = gaps.where(F.col(gap) > 0).select(F.col(gap).alias("low_s")).distinct()
    line = Timeline(("__neg",))
    pairs = line.previous(distinct.withColumn("__neg", -F.col("low_s")), high_s="low_s").where("high_s is not null")
    return pairs.select("low_s", "high_s", (F.col("high_s") / F.col("low_s")).alias("ratio")).orderBy(F.desc("ratio"), "low_s").limit(k)


def cohesion(df: DataFrame, columns: tuple[str, ...], group: str = "event") -> DataFrame:
    """(group, dispersion): mean distance of a group's rows to its centre, with columns scaled by the whole table's population deviation (0 counts as 1) and null at the mean."""
    stats = df.agg(*[x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"__m{i}"), F.stddev_pop(c).alias(f"__s{i}"))])
    z = [F.coalesce((F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") == 0, 1.0).otherwise(F.col(f"__s{i}")), F.lit(0.0)) for i, c in enumerate(columns)]
    scaled = df.crossJoin(F.broadcast(stats)).select(group, *[x.alias(f"z{i}") for i, x in enumerate(z)])  # one row of statistics
    centres = scaled.groupBy(group).agg(*[F.avg(f"z{i}").alias(f"c{i}") for i in range(len(columns))])
    distance = F.sqrt(sum(((F.col(f"z{i}") - F.col(f"c{i}")) ** 2 for i in range(len(columns))), F.lit(0.0)))
    return scaled.join(centres, group).groupBy(group).agg(F.avg(distance).alias("dispersion"))


def same_partition(a: DataFrame, left: str, right: str) -> DataFrame:
    """(same): whether two numberings of the rows cut them alike."""
    return a.agg(F.count_distinct(left).alias("a"), F.count_distinct(right).alias("b"), F.count_distinct(left, right).alias("both")).select("a", "b", "both", ((F.col("a") == F.col("b")) & (F.col("a") == F.col("both"))).alias("same"))


def invariants(df: DataFrame, group: str = "event", label: str = DEFAULTS.label, breaks: tuple[str, ...] = DEFAULTS.breaks, total: DataFrame | None = None) -> DataFrame:
    """(check, passed): one label and one value of each break a group, every row in a group, consecutive numbers from 1, and no row lost against total."""
    kinds = df.groupBy(group).agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"k{i}") for i, c in enumerate(dict.fromkeys((label, *breaks)))])
    one = kinds.agg(*[(F.max(f"k{i}") <= 1).alias(f"one_{c}") for i, c in enumerate(dict.fromkeys((label, *breaks)))])
    rows = df.agg(F.count("*").alias("n"), (F.count_if(F.col(group).isNull()) == 0).alias("assigned"), ((F.max(group) == F.count_distinct(group)) & (F.min(group) == 1)).alias("consecutive"))
    both = one.crossJoin(rows)
    both = both.withColumn("complete", F.lit(True)) if total is None else both.crossJoin(total.agg(F.count("*").alias("t"))).withColumn("complete", F.col("n") == F.col("t"))
    names = [*one.columns, "assigned", "consecutive", "complete"]
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("passed")) for c in names])).alias("x")).select("x.*")


def disorder(df: DataFrame, position: str, time: str = DEFAULTS.time, tie: str = DEFAULTS.tie) -> DataFrame:
    """(rows, backward, worst_s, misplaced): how far the file order is from the time order. Rows of one position go by time and tie; equal rows share the first of their places in both orders."""
    step = lambda rows: rows.withColumns({"delta": X.seconds("__pt", time), "__one": F.lit(1)})
    rows = Timeline((position, time, tie)).scan(df.select(position, time, tie), {"__pt": time}, step, "__one", "__at")
    placed = Timeline.by_time(time, tie, position).row_number(rows, "__rank")
    alike = placed.groupBy(position, time, tie).agg(F.count("*").alias("n"), F.count_if(F.col("delta") < 0).alias("b"), F.min("delta").alias("w"), (F.min("__at") != F.min("__rank")).alias("away"))
    none = F.lit(0).cast("long")
    return alike.agg(F.coalesce(F.sum("n"), none).alias("rows"), F.coalesce(F.sum("b"), none).alias("backward"), F.least(F.min("w"), F.lit(0.0)).alias("worst_s"), F.coalesce(F.sum(F.when(F.col("away"), F.col("n"))), none).alias("misplaced"))


def worst_backward(df: DataFrame, position: str, time: str = DEFAULTS.time, k: int = 1) -> DataFrame:
    """The k rows that step back furthest, with the row before. Rows of one position go by time."""
    out = Timeline((position, time)).previous(df, previous_position=position, previous_time=time)
    return out.withColumn("delta_s", X.seconds("previous_time", time)).where("delta_s < 0").select("previous_position", position, "previous_time", F.col(time).alias("time"), "delta_s").orderBy("delta_s", position, "previous_position", "time").limit(k)


def per_label(event_table: DataFrame, label: str = DEFAULTS.label) -> DataFrame:
    """Events and readings of each label, with median minutes, total hours, first start, last end and readings an event."""
    out = event_table.groupBy(label).agg(F.count("*").alias("events"), F.sum("n").alias("readings"), (F.sum("duration_s") / 3600).alias("hours"), F.min("start").alias("first"), F.max("end").alias("last"), (F.sum("n") / F.count("*")).alias("readings_per_event"))
    return with_quantiles(out, event_table, (label,), {"median_min": 0.5}, "duration_min")
