"""What the corpus operators share: shared tables, size-checked joins, tokens, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Rows of (id, short payload) that may be broadcast: tens of MB at most. Larger sides are shuffled.
BROADCAST_ROWS = 400_000
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, as texts and shingle sets may be long: bounded by rows and, where Spark can, by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "250")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only a session in one process may leave it unset and has a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="torquil-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path, None
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """df with its columns named c0, c1, ... and numbered rows, as a table bucketed by `row`: whatever is joined to it by row is shuffled, never the table.

    Row numbers are distinct, so null ids, repeated ids and copies spread evenly. There are as many buckets as shuffle partitions.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).withColumn("row", F.monotonically_increasing_id())
    plain.repartition(buckets, "row").write.bucketBy(buckets, "row").option("path", path).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    out.kept_at = path, table
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written and stored tables that no later step reads."""
    for df in tables:
        path, table = df.kept_at
        spark = df.sparkSession
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few rows, else as it is, for a shuffled join. Pass a written table: it is counted."""
    return F.broadcast(df) if df.count() <= rows else df


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def with_text(docs: DataFrame, *more: str) -> DataFrame:
    """The given columns and text only, whatever else docs holds."""
    return docs.select(*[F.col(f"`{c}`") for c in more], F.col("text").cast("string").alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full, so its memory is bounded."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One for each Python worker, which outlives the operators that use it.
WORDS = WordHashes()


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k items; of the whole sequence as one if it is shorter (none if it is empty)."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        k = n
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * M1 + hashes[i : n - k + 1 + i]
        out ^= out >> np.uint64(29)
    return mix(out)


def mapped(df: DataFrame, function, schema: str | StructType, **settings) -> DataFrame:
    """mapInArrow with a function(batch, **settings) -> iterable of RecordBatch, or a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from function(batch, **settings)

    return df.mapInArrow(run, schema)


#: Links for each task, and tasks at least, when few links are left.
EDGES, TASKS = 20_000, 8


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component_id): every id of the links (a, b: long) with the smallest id it reaches. known: such a table of earlier links, whose links count, too.

    Contracts edges round by round: each node goes to the neighbour (or itself) of the least seeded hash, which
    shrinks any graph by a constant factor expected, so the rounds are logarithmic in the longest path and no
    node's neighbours meet in one task: minima are combined before the shuffle. What a round leaves is written by
    as many tasks as its size asks for, since the last rounds have little to do. With known, only its components are nodes.
    """
    if known is not None:
        to = lambda c: known.toDF(c, f"c{c}")
        ends = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = components(ends)
        grown = known.join(joined.toDF("component_id", "to"), "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id"))
        return written(grown.union(joined.join(known.select("id"), "id", "left_anti")), "components")
    most = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    edges, steps, turn, size = links, [], 0, links.count()
    tasks = asked = max(TASKS, size // EDGES)
    few = lambda df: df.coalesce(tasks) if tasks < most else df
    while size:
        edges = few(edges)
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: E731  a bijection, so there are no ties
        up = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("m"), F.min(rank("b")).alias("h")).select(F.col("a").alias("node"), F.when(F.col("h") < rank("a"), F.col("m")).otherwise(F.col("a")).alias("up"))
        up = written(few(up), "parents")
        left = edges.join(up.toDF("a", "ua"), "a").join(up.toDF("b", "ub"), "b").where("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        edges = written(few(left), "edges")
        if turn:
            drop(kept)
        kept, size = edges, edges.count()
        tasks = max(TASKS, size // EDGES)
        steps.append(up)
        turn += 1
    tasks = asked
    roots = nodes.withColumn("root", F.col("id"))
    for up in steps:
        roots = roots.join(up.toDF("root", "up"), "root", "left").select("id", F.coalesce("up", "root").alias("root"))
    roots = written(few(roots), "roots")
    # both sides are plain tables, so that a giant component's rows can be split
    least = written(few(roots.groupBy("root").agg(F.min("id").alias("component_id"))), "least")
    out = written(few(roots.join(least, "root").select("id", "component_id")), "components")
    drop(*([kept] if turn else []), *steps, roots, least, links)
    return out
