"""Near-duplicate embeddings by spherical-cap filters from structured random product codes.

Some independent codes are used. A code's words are pairs of words of two smaller random codes on the halves of the rotated space. Each vector is
list-decoded to all code words it exceeds a threshold with, found by sorting the halves' products, not by trying
all pairs. Vectors that share a filter are compared in double precision. The threshold follows from the number of
vectors (so many a filter), and the number of code words from the threshold (so many shared filters are expected
of a pair at the least cosine), so work a vector and recall stay alike at every size.

Copies of a vector are one class. A filter's members are dealt by hash into blocks, and pairs of blocks into tiles;
a tile sends counts and a spanning set of links, never its pairs. A pair is counted in its first shared filter.

Results for odd input: null, zero and non-finite vectors and those with null components link with nothing; vectors
of another length than the most frequent are compared among their own length; rows that share an id count as
vectors of their own and are one node; a null id has no component and is kept; other columns are left alone.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from torquil.llm import common as C

#: Vectors a filter has, codes, filters of each that a pair at the least cosine is expected to share, and vectors of a block.
MEMBERS, CODES, SHARED, BLOCK = 100, 6, 3, 512
FEW = 16


def _tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def design(n: int, cosine: float) -> tuple[float, int]:
    """(threshold in standard deviations, words of each half code) for n vectors."""
    z = 2.0
    while n * _tail(z) > MEMBERS and z < 6:
        z += 0.05
    x = np.linspace(z, z + 8, 4001)
    inner = np.array([_tail((z - cosine * v) / math.sqrt(1 - cosine * cosine)) for v in x])
    both = float((np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * inner).sum() * (x[1] - x[0]))
    return z, max(8, math.ceil(math.sqrt(SHARED / both)))


@functools.cache
def code(dims: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A rotation and the two halves' words."""
    g = np.random.default_rng([seed, dims, words])
    turn = np.linalg.qr(g.standard_normal((dims, dims)))[0]
    halves = [g.standard_normal((words, d)) for d in (dims - dims // 2, dims // 2)]
    return turn, *(h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-300) for h in halves)


def decode(x: np.ndarray, z: float, words: int, seed: int) -> list[np.ndarray]:
    """For each unit vector the sorted numbers of all code words it exceeds the threshold with."""
    turn, left, right = code(x.shape[1], words, seed)
    y = x @ turn
    a, b = y[:, : left.shape[1]] @ left.T, y[:, left.shape[1] :] @ right.T
    # the design is for products that are nearly normal; in few dimensions caps must be wide to be met at all
    least = math.sqrt(2) * (z / math.sqrt(x.shape[1]) if x.shape[1] >= FEW else min(0.35, z / math.sqrt(x.shape[1])))
    out = []
    for p, q in zip(a, b):
        i, j = np.argsort(-p), np.argsort(-q)
        n = np.searchsorted(-q[j], p[i] - least, "right")  # how many words of the right half go with each of the left
        n = n[: int(np.argmin(n > 0)) if not n.all() else len(n)]
        out.append(np.sort(np.repeat(i[: len(n)], n) * words + np.concatenate([j[:k] for k in n] or [np.zeros(0, np.int64)])))
    return out


def _clean(batch: pa.RecordBatch, kind: str):
    """Vectors as bytes; null where they can't link."""
    out = []
    for v in batch.column("v").to_pylist():
        x = None if not v or None in v else np.array(v, kind)
        with np.errstate(over="ignore"):
            ok = x is not None and np.isfinite(x).all() and 0 < np.linalg.norm(x.astype(float)) < np.inf
        out.append((x + 0).tobytes() if ok else None)
    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "v"])


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _filters(batch: pa.RecordBatch, kind: str, z: float, words: int):
    vectors = batch.column("v").to_pylist()
    lists: list = [None] * len(vectors)
    for size in {len(v) for v in vectors}:
        at = [i for i, v in enumerate(vectors) if len(v) == size]
        x = _units([vectors[i] for i in at], kind)
        for i, *f in zip(at, *(decode(x, z, words, seed) for seed in range(CODES))):
            # filters of other codes, and of vectors of other lengths, have other numbers
            lists[i] = np.concatenate([g + k * words * words for k, g in enumerate(f)]) + (size << 40)
    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], [*batch.schema.names, "filters"])


def _tiles(batches, kind: str, cosine: float):
    """Of each tile (rows are sorted by tile): links of each class, weighted by copies, and links that connect it."""

    def one(rows: list[dict]):
        f = rows[0]["filter"]
        x = _units([r["v"] for r in rows], kind)
        i, j = (np.array([k for k, r in enumerate(rows) if r["side"] in (s, 2)]) for s in (0, 1))
        if not len(i) or not len(j):
            return
        near = x[i] @ x[j].T >= cosine
        if rows[0]["same"]:
            near &= i[:, None] < j[None]
        if not near.any():
            return
        earlier = [[g for g in r["filters"] if g < f] for r in rows]
        numbers = {g: k for k, g in enumerate(sorted({g for e in earlier for g in e}))}
        has = np.zeros((len(rows), max(1, len(numbers))), np.float32)
        for k, e in enumerate(earlier):
            has[k, [numbers[g] for g in e]] = 1
        counted = near & (has[i] @ has[j].T == 0)
        n, total = np.array([r["n"] for r in rows]), np.zeros(len(rows), np.int64)
        np.add.at(total, i, counted @ n[j])
        np.add.at(total, j, counted.T @ n[i])
        link = np.arange(len(rows))
        while True:  # least number reached
            new = link.copy()
            np.minimum.at(new, i, np.where(near, link[j][None], len(rows)).min(1))
            np.minimum.at(new, j, np.where(near, link[i][:, None], len(rows)).min(0))
            if (new == link).all():
                break
            link = new
        for k, r in enumerate(rows):
            if total[k] or link[k] != k:
                yield r["cls"], int(total[k]), rows[link[k]]["cls"]

    def sent(rows):
        found = list(one(rows))
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["cls", "links", "to"])

    rest: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if rest and r["tile"] != rest[0]["tile"]:
                yield sent(rest)
                rest = []
            rest.append(r)
    if rest:
        yield sent(rest)


def near_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of each row of vectors."""
    spark = vectors.sparkSession
    C.tune(spark)
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    plain = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    clean = C.written(C.mapped(plain, _clean, "id long, v binary", kind=kind).withColumn("cls", F.xxhash64("v")), "vectors")
    good = clean.where("v is not null")
    classes = C.written(good.groupBy("cls").agg(F.first("v").alias("v"), F.count("*").alias("n")), "classes")
    z, words = design(max(1, classes.count()), cosine)
    decoded = C.written(C.mapped(classes, _filters, "cls long, v binary, n long, filters array<long>", kind=kind, z=z, words=words), "decoded")
    members = decoded.select("cls", F.explode("filters").alias("filter"))
    sizes = C.written(members.groupBy("filter").agg(F.count("*").alias("size")).where("size > 1"), "filters")
    dealt = members.join(C.if_small(sizes), "filter").withColumn("blocks", F.ceil(F.col("size") / BLOCK)).withColumn("b", F.pmod(F.xxhash64("cls", F.lit(3)), "blocks"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1)
    dealt = dealt.select("cls", "filter", F.xxhash64("filter", F.least("b", "o"), F.greatest("b", "o")).alias("tile"), side.alias("side"), (F.col("b") == F.col("o")).alias("same"))
    rows = dealt.join(decoded, "cls").repartition("tile").sortWithinPartitions("tile")
    found = C.written(rows.mapInArrow(lambda it: _tiles(it, kind, cosine), "cls long, links long, to long"), "links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    # nodes are ids: a class is its least id, and ids of several rows join their classes
    named = good.where("id is not null").select("id", "cls").distinct()
    least = C.written(named.groupBy("cls").agg(F.min("id").alias("rep")), "reps")
    pairs = C.written(found.where("cls <> `to`").select(F.col("cls").alias("a"), F.col("to").alias("b")).union(named.join(named.groupBy("id").agg(F.min("cls").alias("a")), "id").where("a <> cls").select("a", F.col("cls").alias("b"))), "pairs")
    groups = C.components(pairs)
    of_class = C.written(classes.select("cls").join(groups.toDF("cls", "grp"), "cls", "left").select("cls", F.coalesce("grp", "cls").alias("grp")), "groups")
    ids = of_class.join(least, "cls").groupBy("grp").agg(F.min("rep").alias("component_id"))
    out = clean.join(classes.select("cls", "n").join(counts, "cls", "left").join(of_class.join(ids, "grp", "left"), "cls").select("cls", "n", "links", "component_id").withColumn("ok", F.lit(True)), "cls", "left")
    ok = F.col("ok") & F.col("v").isNotNull()
    component = F.when(F.col("id").isNotNull(), F.when(ok, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id), F.when(ok, F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(0).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op9_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
