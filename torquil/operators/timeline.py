"""Ordered scans: the row before, running sums and row numbers along one order, without one task seeing all rows.

Rows are dealt into buckets of the order, as many as there are shuffle partitions (MOST at most), between splitters
taken from a sample, so a bucket has about the same number of rows wherever they crowd: one day, one entity or one time
may hold nearly all of them. Windows run inside buckets, and a table with one row for each bucket carries the last row and the
sum of an entity that goes on across buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from torquil.sources import shared as T

#: Buckets at most, which bounds the splitters and the carried rows, and sampled rows for each.
MOST, SAMPLED = 4096, 40


@dataclass(frozen=True)
class Timeline:
    """Order of rows, in all or of each entity; ties must be broken by the last columns. Order and entity are columns or SQL expressions; nulls come first."""

    order: tuple[str, ...]
    entity: tuple[str, ...] = ()
    buckets: int | None = None
    splitters: tuple[tuple, ...] | None = None

    @classmethod
    def by_time(cls, time: str, *ties: str) -> Timeline:
        return cls((time, *ties))

    @classmethod
    def by_position(cls, position: str, buckets: int | None = None) -> Timeline:
        return cls((position,), (), buckets)

    @classmethod
    def within(cls, entity: tuple[str, ...], *order: str) -> Timeline:
        return cls(order, entity)

    def _key(self) -> Column:
        return F.struct(*[F.expr(c).alias(f"k{i}") for i, c in enumerate((*self.entity, *self.order))])

    def over(self, df: DataFrame) -> Timeline:
        """This order with splitters for the rows of df: equal shares of a sample of SAMPLED rows a bucket."""
        if self.splitters is not None:
            return self
        n = min(MOST, self.buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        sample = df.select(self._key().alias("k")).orderBy(F.rand(0)).limit(n * SAMPLED).collect() if n > 1 else []
        # as Spark orders them: null, numbers, NaN
        keys = sorted((tuple(r.k) for r in sample), key=lambda k: [(x is not None, x != x, 0 if x is None or x != x else x) for x in k])
        return replace(self, splitters=tuple(dict.fromkeys(keys[len(keys) * i // n] for i in range(1, n) if keys)))

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """df with __bucket, the number of splitters not beyond the row: a binary search in a fixed array."""
        if not self.splitters:
            return df.withColumn("__bucket", F.lit(0))
        kinds = df.select(self._key().alias("k")).schema["k"].dataType
        typed = F.array(*[F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(s, kinds.fields)]) for s in self.splitters])
        steps = [1 << i for i in reversed(range(len(self.splitters).bit_length()))]
        n = len(self.splitters)
        at = lambda low, step: F.when((low + step <= n) & (F.get("__splitters", low + step - 1) <= F.col("__key")), low + step).otherwise(low)
        found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), at)
        return df.withColumns({"__key": self._key(), "__splitters": typed}).withColumn("__bucket", found).drop("__key", "__splitters")

    def _window(self) -> WindowSpec:
        return Window.partitionBy("__bucket").orderBy(*[F.expr(c) for c in (*self.entity, *self.order)])

    def _owner(self) -> Column:
        """The row's entity; of one type whether there is any or not."""
        return F.struct(F.lit(0).alias("e"), *[F.expr(c).alias(f"e{i}") for i, c in enumerate(self.entity)])

    def previous(self, df: DataFrame, **columns: str) -> DataFrame:
        """df with new columns: name=column gives the value in the row before of the same entity; __first says that there is none."""
        line = self.over(df)
        df = line._bucketed(df)
        whole = line._whole(columns)
        last = df.groupBy("__bucket").agg(F.max_by(whole, line._key()).alias("__last"))
        df = df.withColumn("__before", F.lag(whole).over(line._window())).join(F.broadcast(_lagged(last)), "__bucket", "left")
        return line._told(df.withColumn("__before", F.coalesce("__before", "__carried")), columns).drop("__before", "__carried", "__bucket")

    def _whole(self, columns: dict[str, str]) -> Column:
        return F.struct(*[F.col(c).alias(n) for n, c in columns.items()], self._owner().alias("__owner"))

    def _told(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """df with the columns of previous() from __before, a row of any entity or null."""
        same = F.coalesce(F.col("__before.__owner").eqNullSafe(self._owner()), F.lit(False))
        return df.withColumn("__first", ~same).withColumns({n: F.when(~F.col("__first"), F.col(f"__before.{n}")) for n in columns})

    def scan(self, df: DataFrame, columns: dict[str, str], more: Callable[[DataFrame], DataFrame], value: str, name: str, whole: bool = False) -> DataFrame:
        """previous(), then more(df), which may use it, then the running sum of a column `value` that more() gives, for each entity or for the whole order.

        Rows are shuffled and sorted once, into a table with sums inside buckets; the first and the last row of each bucket
        then tell what to add. more() looks at a row alone.
        """
        line = self.over(df)
        wide = line._bucketed(df).withColumns({"__before": F.lag(line._whole(columns)).over(line._window()), "__tail": F.lead(F.lit(1)).over(line._window()).isNull()})
        wide = wide.withColumn("__head", F.col("__before").isNull())
        first = more(line._told(wide, columns))
        cut = [*([] if whole else [F.expr(c) for c in line.entity])]
        inside = Window.partitionBy("__bucket", *cut).orderBy(*[F.expr(c) for c in (*(line.entity if whole else ()), *line.order)]).rowsBetween(Window.unboundedPreceding, 0)
        # a bucket's first row counts once it is known what comes before it
        table = T.written(first.withColumn("__run", F.sum(F.when(F.col("__head"), 0).otherwise(F.col(value).cast("long"))).over(inside)), "scan")
        owner = F.struct(F.lit(0).alias("e")) if whole else line._owner()
        tails = table.where("__tail").select("__bucket", line._whole(columns).alias("__last"), owner.alias("__of"), F.col("__run").alias("t"))
        heads = table.where("__head").select(*df.columns, "__bucket").join(F.broadcast(_lagged(tails)), "__bucket", "left").withColumn("__before", F.col("__carried"))
        heads = more(line._told(heads, columns)).select("__bucket", "__carried", owner.alias("__of"), F.col(value).cast("long").alias("__v"))
        # of an entity that reaches over a bucket's end: what its last row has, and the first one's value if it began there too
        ends = tails.join(F.broadcast(heads.select("__bucket", F.col("__of").alias("__o"), "__v")), "__bucket").select("__bucket", "__of", (F.col("t") + F.when(F.col("__o") == F.col("__of"), F.col("__v")).otherwise(0)).alias("t"), F.lit(None).cast("long").alias("__v"))
        asked = heads.select("__bucket", "__of", F.lit(0).cast("long").alias("t"), "__v")
        before = Window.partitionBy("__of").orderBy("__bucket").rangeBetween(Window.unboundedPreceding, -1)  # two rows a bucket
        sums = ends.unionByName(asked).withColumn("__o", F.coalesce(F.sum("t").over(before), F.lit(0))).where("__v is not null").select("__bucket", F.col("__of").alias("__mine"), (F.col("__o") + F.col("__v")).alias("__o"))
        carried = heads.select("__bucket", "__carried").join(F.broadcast(sums), "__bucket")
        out = table.drop(*columns, "__first").join(F.broadcast(T.written(carried, "carried")), "__bucket", "left").withColumn("__before", F.coalesce("__before", "__carried"))
        out = more(line._told(out, columns)).withColumn(name, F.col("__run") + F.when(owner == F.col("__mine"), F.col("__o")).otherwise(0))
        return out.drop("__bucket", "__before", "__tail", "__head", "__run", "__carried", "__mine", "__o")

    def running_sum(self, df: DataFrame, value: Column, name: str) -> DataFrame:
        """df with the sum of value over the entity's rows up to this one."""
        line = self.over(df)
        df = line._bucketed(df).withColumns({"__v": value.cast("long"), "__owner": line._owner()})
        sums = df.groupBy("__bucket", "__owner").agg(F.sum("__v").alias("t"))
        # only a bucket's first and last entity can reach over its ends
        ends = sums.groupBy("__bucket").agg(F.array_distinct(F.array(F.min_by(F.struct("__owner", "t"), "__owner"), F.max_by(F.struct("__owner", "t"), "__owner"))).alias("e"), F.min("__owner").alias("first"))
        ends = ends.select("__bucket", "first", F.explode("e").alias("e")).select("__bucket", "first", "e.*")
        before = Window.partitionBy("__owner").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # two rows a bucket at most
        carried = ends.withColumn("__o", F.sum("t").over(before)).where(F.col("__owner") == F.col("first")).select("__bucket", F.col("first").alias("__head"), "__o")
        inside = Window.partitionBy("__bucket", "__owner").orderBy(*[F.expr(c) for c in line.order]).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(name, F.sum("__v").over(inside)).join(F.broadcast(carried), "__bucket", "left")
        on = F.when(F.col("__owner") == F.col("__head"), F.coalesce("__o", F.lit(0))).otherwise(0)
        return df.withColumn(name, F.col(name) + on).drop("__v", "__owner", "__head", "__o", "__bucket")

    def row_number(self, df: DataFrame, name: str) -> DataFrame:
        """Numbers from 1 along the order, in all or in each entity."""
        return self.running_sum(df, F.lit(1), name)


def _lagged(last: DataFrame) -> DataFrame:
    """(__bucket, __carried): the bucket before's last row, of (__bucket, __last), MOST rows at most."""
    return last.select("__bucket", F.lag("__last").over(Window.orderBy("__bucket")).alias("__carried"))
