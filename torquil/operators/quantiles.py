"""Exact quantiles of many keys at once, with no task that holds a key's values.

The rank that a quantile needs is looked for in a span of values: the span is cut into BINS of equal width, rows are
counted in each bin, with its least and largest value, and the bin that holds the rank is the next span. A bin of one value
is the answer; once the spans left hold GATHERED rows or fewer in all, those rows are sorted, which a table of no more rows
is at once. So a task gets counts, and rows of a few narrow bins, whatever the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from torquil import functions as X
from torquil.sources import shared as T

BINS = 1024
GATHERED = 500_000


def _bin(v: Column, low: Column, high: Column) -> Column:
    """Never decreasing in v; what isn't finite has bins of its own."""
    width = (high - low) / BINS
    at = F.floor(F.when(width > 0, (v - low) / width).otherwise(0.0)).cast("int")
    return F.when(F.isnan(v), BINS + 2).when(v == float("inf"), BINS + 1).when(v == float("-inf"), -1).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(BINS)))


def quantiles(values: DataFrame, keys: tuple[str, ...], of: dict[str, float], value: str = "value", count: str | None = None, whole: bool = False) -> DataFrame:
    """(keys, a column for each quantile by name) of values (keys, value), linear between neighbours; rows count once, or `count` times.

    Nulls don't count; NaN is beyond all numbers. Keys whose values are all null are left out; without keys, `whole`
    gives one row of nulls for a table without values.
    """
    own = [f"k{i}" for i in range(len(keys))]
    plain = values.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own)], F.col(f"`{value}`").cast("double").alias("v"), (F.col(f"`{count}`").cast("long") if count else F.lit(1).cast("long")).alias("w")).where("v is not null")
    if plain.limit(GATHERED + 1).count() <= GATHERED:
        each = plain.groupBy(*own).agg(*[F.percentile("v", F.lit(p), F.col("w")).alias(name) for name, p in of.items()], F.sum("w").alias("n")).where("n > 0")
        each = each.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], *of)
        return each.agg(*[F.max(name).alias(name) for name in of]) if whole and not keys else each
    finite = F.when(~F.isnan("v") & (F.abs("v") != float("inf")), F.col("v"))
    start = plain.groupBy(*own).agg(F.sum("w").alias("n"), F.count("*").alias("rows"), F.min(finite).alias("low"), F.max(finite).alias("high"), F.min("v").alias("least"), F.max("v").alias("most")).where("n > 0")
    sizes = T.written(start, "sizes")
    rank = lambda p, up: (F.ceil if up else F.floor)(F.lit(p) * (F.col("n") - 1)).cast("long")
    wanted = F.array(*[F.struct(F.lit(f"{name}{up:d}").alias("q"), rank(p, up).alias("rank")) for name, p in of.items() for up in (False, True)])
    spans = sizes.select(*own, "low", "high", F.col("rows").alias("held"), (F.col("least") == F.col("most")).alias("one"), F.col("least").alias("at"), F.explode(wanted).alias("t"))
    spans = T.written(spans.select(*own, F.lit(None).cast("double").alias("from"), F.lit(None).cast("double").alias("to"), "low", "high", "held", "one", "at", "t.q", "t.rank"), "spans")
    done = spans.where("one")
    tables = [sizes, spans]
    while left := spans.where("not one").select(*own, "from", "to", "held").distinct().agg(F.sum("held")).first()[0]:
        cuts = spans.where("not one").select(*own, "from", "to", "low", "high").distinct()
        inside = (F.col("from").isNull() | (F.col("v") >= F.col("from"))) & (F.col("to").isNull() | (F.col("v") <= F.col("to")))
        rows = X.joined_on(plain, F.broadcast(cuts) if own == [] else T.if_small(cuts), tuple(own)).where(inside)
        span = [*own, "from", "to"]
        if left <= GATHERED:
            each = rows.groupBy(*span, "v").agg(F.sum("w").alias("c"), F.count("*").alias("r")).withColumn("most", F.col("v"))
            order = "v"
        else:
            each = rows.groupBy(*span, "low", "high", _bin(F.col("v"), F.col("low"), F.col("high")).alias("b")).agg(F.sum("w").alias("c"), F.count("*").alias("r"), F.min("v").alias("v"), F.max("v").alias("most"))
            order = "b"
        w = Window.partitionBy(*span).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # BINS rows, or GATHERED in all
        each = each.select(*span, F.coalesce(F.sum("c").over(w), F.lit(0)).alias("before"), "c", "r", "v", "most")
        found = X.joined_on(spans.where("not one").select(*span, "q", "rank"), each, tuple(span)).where("rank >= before and rank < before + c")
        finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
        spans = T.written(found.select(*own, F.col("v").alias("from"), F.col("most").alias("to"), finite("v").alias("low"), finite("most").alias("high"), F.col("r").alias("held"), (F.col("v") == F.col("most")).alias("one"), F.col("v").alias("at"), "q", (F.col("rank") - F.col("before")).alias("rank")), "spans")
        tables.append(spans)
        done = done.unionByName(spans.where("one"))
    at = done.groupBy(*own).agg(*[F.max(F.when(F.col("q") == f"{name}{up:d}", F.col("at"))).alias(f"{name}{up:d}") for name in of for up in (False, True)])
    out = X.joined_on(sizes.select(*own, "n"), at, tuple(own))
    between = []
    for name, p in of.items():
        place = F.lit(p) * (F.col("n") - 1)
        low, high = F.col(f"{name}0"), F.col(f"{name}1")
        between.append(F.when(F.ceil(place) == F.floor(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    out = T.written(out.select(*[F.col(o).alias(k) for o, k in zip(own, keys)], *between), "quantiles")
    T.dropped(*tables)
    if whole and not keys:
        return out.agg(*[F.max(name).alias(name) for name in of])
    return out


def with_quantiles(df: DataFrame, values: DataFrame, keys: tuple[str, ...], of: dict[str, float], value: str = "value") -> DataFrame:
    """df (keys, ...) with the quantiles of values of the same keys, null keys among them."""
    return X.joined_on(df, quantiles(values, keys, of, value), keys, "left")
