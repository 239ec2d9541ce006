"""Random forests of a validation: every sample is scored by the forest of the samples outside its fold.

As in Spark ML's forests, trees learn from rows drawn with replacement (a Poisson number each), a node looks at a random
subset of the columns, splits lie between at most BINS bins of a column, by Gini, and a row's probabilities are the mean
of its leaves' shares. Spark ML sums up the counts of all nodes of a level over all rows, fit after fit; here tasks are
dealt by fit and trees, and a task grows its trees from the bins of the rows, a byte a value, and scores the rows left
out. A task holds HELD rows at most: more are dealt in blocks, whose counts are summed up level by level.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from torquil.sources import shared as T

#: Bins of a column; trees of a task; rows of a task at most.
BINS, TREES, HELD = 32, 50, 1 << 22
#: Rows that the bins' edges are taken from, about: all, if there are no more (Spark ML takes 10,000). All rows are learned from.
EDGES = 1 << 16
#: Shares of leaves are whole multiples of this, so that their sums are the same in any order.
UNIT = 2.0**-40

_STATE = "fit int, chunk int, tree int, feature array<int>, cut array<int>, left array<int>, counts array<double>, start int"


@dataclass
class Tree:
    """Nodes in the order of their making, level by level; those from start on are not tried yet."""

    feature: np.ndarray  # -1: a leaf, so far
    cut: np.ndarray  # bins up to it go left
    left: np.ndarray  # the right child comes next
    counts: np.ndarray  # of classes, a row for each node
    start: int = 0

    @classmethod
    def root(cls, classes: int) -> Tree:
        return cls(np.array([-1]), np.array([0]), np.array([0]), np.zeros((1, classes)))

    @classmethod
    def of(cls, r, classes: int) -> Tree:
        return cls(*[np.array(x, dtype=int) for x in (r.feature, r.cut, r.left)], np.array(r.counts, dtype=float).reshape(-1, classes), int(r.start))

    def row(self) -> list:
        return [self.feature, self.cut, self.left, self.counts.ravel(), self.start]

    @property
    def open(self) -> int:
        return len(self.feature) - self.start

    def split(self, sums: np.ndarray, subset: np.ndarray) -> None:
        """Gives each open node its best split, if any lessens the impurity, by sums (column of subset, node, bin, class)."""
        upto = sums.cumsum(2)
        total, a = upto[0, :, -1], upto[:, :, :-1]
        b = total[None, :, None] - a
        na, nb, n = a.sum(-1), b.sum(-1), total.sum(-1)
        if not self.start:
            self.counts[0] = total[0]
        score = (a * a).sum(-1) / np.maximum(na, 1) + (b * b).sum(-1) / np.maximum(nb, 1)
        score[(na < 1) | (nb < 1)] = -np.inf
        flat = score.transpose(1, 0, 2).reshape(len(n), -1)
        best = flat.argmax(1)
        real = np.flatnonzero(flat[np.arange(len(n)), best] > (total * total).sum(-1) / np.maximum(n, 1) + 1e-9)
        j, at = best[real] // a.shape[2], best[real] % a.shape[2]
        first = len(self.feature)
        self.feature[self.start + real], self.cut[self.start + real] = subset[real, j], at
        self.left[self.start + real] = first + 2 * np.arange(len(real))
        made = np.stack([a[j, real, at], b[j, real, at]], axis=1).reshape(-1, total.shape[1])
        more = np.zeros(len(made), dtype=int)
        self.feature, self.cut, self.left = np.append(self.feature, more - 1), np.append(self.cut, more), np.append(self.left, more)
        self.counts, self.start = np.concatenate([self.counts, made]), first

    def step(self, x: np.ndarray, rows: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The child of each row's node; leaves stay."""
        f = self.feature[node]
        right = x.ravel().take(np.maximum(f, 0) * x.shape[1] + rows) > self.cut[node]
        return np.where(f >= 0, self.left[node] + right, node)

    def reached(self, x: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        rows = np.arange(x.shape[1]) if rows is None else rows
        node = np.zeros(len(rows), dtype=int)
        while (self.feature[node] >= 0).any():
            node = self.step(x, rows, node)
        return node

    def shares(self) -> np.ndarray:
        return np.round(self.counts / np.maximum(self.counts.sum(1, keepdims=True), 1) / UNIT) * UNIT


@dataclass(frozen=True)
class Plan:
    """What all tasks of some fits know."""

    columns: tuple[str, ...]
    classes: list
    trees: int
    depth: int
    seed: int
    edges: dict[int, list[np.ndarray]] = field(default_factory=dict)
    each: int = TREES

    def subset(self, fit: int, tree: int, level: int, nodes: int) -> np.ndarray:
        """The columns that each node of a level looks at: as many as the root of their number, without those of one value."""
        real = np.array([j for j, e in enumerate(self.edges[fit]) if len(e)] or [0])
        drawn = np.random.default_rng([self.seed % (1 << 64), fit, 1, tree, level]).random((nodes, len(real))).argsort(1)
        return real[drawn[:, : int(np.ceil(np.sqrt(len(self.columns))))]]

    def drawn(self, fit: int, tree: int, block: int, rows: int) -> np.ndarray:
        """How often a tree takes each row of a block."""
        return np.random.default_rng([self.seed % (1 << 64), fit, 2, tree, block]).poisson(1.0, rows)

    def sums(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, weights: np.ndarray, at: np.ndarray, subset: np.ndarray) -> np.ndarray:
        """Weights by column of subset, node, bin and class; at is the place of each row's node in its level."""
        flat, size, k = x.ravel(), x.shape[1], len(self.classes)
        base, shape = at * (BINS * k) + y[rows], (len(subset), BINS, k)
        return np.stack([np.bincount(base + flat.take(subset[at, j] * size + rows) * np.int64(k), weights, int(np.prod(shape))).reshape(shape) for j in range(subset.shape[1])])

    def grown(self, fit: int, tree: int, x: np.ndarray, y: np.ndarray) -> Tree:
        """A tree of all rows, if they are one block."""
        out = Tree.root(len(self.classes))
        w = self.drawn(fit, tree, 0, len(y))
        rows = np.flatnonzero(w)
        w, node = w[rows].astype(float), np.zeros(len(rows), dtype=int)
        for level in range(self.depth):
            if not out.open or not len(rows):
                break
            subset, start = self.subset(fit, tree, level, out.open), out.start
            out.split(self.sums(x, y, rows, w, node - start, subset), subset)
            on = out.feature[node] >= 0
            rows, w, node = rows[on], w[on], node[on]
            node = out.step(x, rows, node)
        return out

    def chunk(self, c: int) -> range:
        return range(c * self.each, min(self.trees, (c + 1) * self.each))


def _edges(x: np.ndarray) -> np.ndarray:
    """Between all values, if they are few, or else between values with about as many rows in each bin."""
    v, n = np.unique(x[~np.isnan(x)], return_counts=True)
    at = np.arange(len(v) - 1)
    if len(v) > BINS:
        upto, wanted = n.cumsum(), n.sum() / BINS * np.arange(1, BINS)
        at = np.searchsorted(upto, wanted)
        at = np.unique(np.clip(at - (wanted - upto[np.maximum(at, 1) - 1] < upto[at] - wanted), 0, len(v) - 2))  # the nearest
    between = v[at] / 2 + v[at + 1] / 2 if len(at) else np.zeros(0)
    return np.where(np.isfinite(between), between, v[at]) if len(at) else between


def _fit_edges(train: DataFrame, n: int, fits: list[int], columns: tuple[str, ...]) -> dict[int, list[np.ndarray]]:
    """Edges of each fit's columns by its own rows alone."""
    some = train if n <= EDGES else train.where(F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) < int((1 << 30) * EDGES / n))
    each = some.select("__fold", *columns, F.explode(F.array(*[F.lit(k) for k in fits])).alias("fit")).where(F.col("__fold") != F.col("fit"))

    def run(key, rows):
        return pd.DataFrame({"fit": [key[0]], "edges": [[_edges(rows[c].to_numpy(dtype=float)) for c in columns]]})

    found = each.groupBy("fit").applyInPandas(lambda key, rows: run(key, rows), "fit int, edges array<array<double>>").collect()  # BINS numbers a fit and column
    return {r.fit: [np.array(e, dtype=float) for e in r.edges] for r in found}


def _packed(rows: DataFrame, plan: Plan, blocks: int) -> DataFrame:
    """(fit, test, block, x, y, ids): bins, classes and row numbers in bytes, of the rows that a fit learns from and of those it scores."""
    columns, names = plan.columns, pd.Index(plan.classes)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = b.to_pandas()
            values, fold, ids, block = t[list(columns)].to_numpy(dtype=float), t["__fold"].to_numpy(), t["__row"].to_numpy(np.int64), t["__block"].to_numpy()
            y = names.get_indexer(t["__label"]).astype(np.int32)
            y[t["__label"].isna()] = -1
            out = []
            for fit, edges in plan.edges.items():
                x = np.stack([np.searchsorted(e, values[:, j]).astype(np.uint8) for j, e in enumerate(edges)])
                for test in (False, True):
                    mine = (fold == fit) if test else (fold != fit) & (y >= 0)
                    for k in np.unique(block[mine]):
                        at = np.flatnonzero(mine & (block == k))
                        out.append((fit, test, int(k), x[:, at].T.tobytes(), y[at].tobytes(), ids[at].tobytes() if test else b""))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["fit", "test", "block", "x", "y", "ids"]).astype({"fit": "int32", "block": "int32"}), schema=kinds, preserve_index=False)

    kinds = pa.schema([("fit", pa.int32()), ("test", pa.bool_()), ("block", pa.int32()), ("x", pa.binary()), ("y", pa.binary()), ("ids", pa.binary())])
    place = F.pmod(F.xxhash64("__label", *columns), F.lit(blocks)).cast("int")
    return rows.select("__row", "__fold", "__label", *columns, place.alias("__block")).mapInArrow(run, "fit int, test boolean, block int, x binary, y binary, ids binary")


def _opened(t: pd.DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (column, row), classes and row numbers of packed rows."""
    x = np.frombuffer(b"".join(t["x"]), np.uint8).reshape(-1, columns)
    return np.ascontiguousarray(x.T), np.frombuffer(b"".join(t["y"]), np.int32), np.frombuffer(b"".join(t["ids"]), np.int64)


def _in_order(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by their bins and class, since a tree draws them by place."""
    order = np.lexsort((*x[::-1], y))
    return np.ascontiguousarray(x[:, order]), y[order]


def _sum_of_shares(trees: list[Tree], x: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    p = sum(t.shares()[t.reached(x)] for t in trees)
    return pd.DataFrame({"row": ids, "p": list(p)})


_SCORES = "row long, p array<double>"


def _at_once(packed: DataFrame, plan: Plan, chunks: int) -> DataFrame:
    """(row, p): sums of shares by the trees of a task, each task with all rows of its fit."""

    def run(key, t):
        x, y = _in_order(*_opened(t[~t["test"]], len(plan.columns))[:2])
        seen, _, ids = _opened(t[t["test"]], len(plan.columns))
        if not len(y) or not len(ids):
            return pd.DataFrame(columns=["row", "p"], dtype=object)
        return _sum_of_shares([plan.grown(key[0], i, x, y) for i in plan.chunk(key[1])], seen, ids)

    tasks = packed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).repartition(chunks * len(plan.edges), "fit", "chunk")
    return tasks.groupBy("fit", "chunk").applyInPandas(lambda key, t: run(key, t), _SCORES)


def _by_level(spark, packed: DataFrame, plan: Plan, chunks: int) -> DataFrame:
    """The same from rows in blocks: each task sums up one block for some trees, level by level."""
    k, m = len(plan.classes), len(plan.columns)
    packed = T.written(packed, "packed")
    places = T.written(packed.select("fit", "test", "block").distinct(), "places")
    parts = max(spark.sparkContext.defaultParallelism, chunks * len(plan.edges))

    def counted(key, t, state):
        out, (x, y) = [], _in_order(*_opened(t, m)[:2])
        for r in state.itertuples():
            tree = Tree.of(r, k)
            if not tree.open:
                continue
            w = plan.drawn(r.fit, r.tree, key[2], len(y))
            rows = np.flatnonzero(w)
            node = tree.reached(x, rows)
            here = node >= tree.start
            rows, node = rows[here], node[here] - tree.start
            subset = plan.subset(r.fit, r.tree, int(r.level), tree.open)
            out.append((r.fit, r.chunk, r.tree, plan.sums(x, y, rows, w[rows].astype(float), node, subset).tobytes()))
        return pd.DataFrame(out, columns=["fit", "chunk", "tree", "sums"])

    def split(key, sums, state):
        out = []
        for r in state.itertuples():
            tree = Tree.of(r, k)
            if tree.open and len(sums):
                subset = plan.subset(r.fit, r.tree, int(r.level), tree.open)
                tree.split(sum(np.frombuffer(s) for s in sums["sums"]).reshape(subset.shape[1], len(subset), BINS, k), subset)
            out.append([r.fit, r.chunk, r.tree, *tree.row()])
        return pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])

    def scored(key, t, state):
        seen, _, ids = _opened(t, m)
        return _sum_of_shares([Tree.of(r, k) for r in state.itertuples()], seen, ids) if len(ids) and len(state) else pd.DataFrame(columns=["row", "p"], dtype=object)

    def each_block(test: bool, state: DataFrame):
        """Blocks with the trees of a task."""
        here = packed.where(F.col("test") == F.lit(test)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        trees = state.join(F.broadcast(places.where(F.col("test") == F.lit(test)).drop("test")), "fit")
        by = ("fit", "chunk", "block")
        return here.repartition(parts, *by).groupBy(*by).cogroup(trees.repartition(parts, *by).groupBy(*by))

    first = [(fit, i // plan.each, i, [-1], [0], [0], [0.0] * k, 0) for fit in plan.edges for i in range(plan.trees)]
    state = T.written(spark.createDataFrame(first, _STATE), "trees")
    for level in range(plan.depth):
        before, now = state, state.withColumn("level", F.lit(level))
        sums = each_block(False, now).applyInPandas(lambda key, t, s: counted(key, t, s), "fit int, chunk int, tree int, sums binary")
        by = ("fit", "tree")
        state = T.written(sums.groupBy(*by).cogroup(now.toDF(*now.columns).groupBy(*by)).applyInPandas(lambda key, t, s: split(key, t, s), _STATE), "trees")
        T.dropped(before)
    out = T.written(each_block(True, state).applyInPandas(lambda key, t, s: scored(key, t, s), _SCORES), "shares")
    T.dropped(state, packed, places)
    return out


def probabilities(samples: DataFrame, fold: str, keys: tuple[str, ...], columns: tuple[str, ...], label: str, trees: int, depth: int, seed: int, fits: list[int]) -> DataFrame:
    """(keys, class, p): a row for each sample of the folds in fits and each class that the other folds have. A fold without others has none.

    The forests depend on the values and the seed alone, not on how rows are dealt. Rows without a label are scored but
    not learned from; values that are null or not a number share the last bin. The result is written.
    """
    spark = samples.sparkSession
    rows = T.written(samples.select(*keys, F.col(label).alias("__label"), F.col(fold).cast("int").alias("__fold"), *[F.col(c).cast("double").alias(c) for c in columns]).withColumn("__row", F.monotonically_increasing_id()), "rows")
    train = rows.where(F.col("__label").isNotNull())
    found = train.groupBy("__label", "__fold").count().collect()  # a row for each class and fold
    n, classes = sum(r["count"] for r in found), sorted({r["__label"] for r in found})
    known = [(fit, c) for fit in fits for c in classes if any(r["__label"] == c and r["__fold"] != fit for r in found)]
    kinds = {**dict(samples.dtypes), "class": dict(samples.dtypes)[label]}
    if not known:
        T.dropped(rows)
        return spark.createDataFrame([], ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], f"class {kinds['class']}", "p double"]))
    plan = Plan(columns, classes, trees, depth, seed, _fit_edges(train, n, fits, columns), TREES)
    blocks, chunks = -(-max(1, rows.count()) // HELD), -(-trees // TREES)
    packed = _packed(rows, plan, blocks)
    shares = _at_once(packed, plan, chunks) if blocks == 1 else _by_level(spark, packed, plan, chunks)
    total = shares.groupBy(F.col("row").alias("__row")).agg(F.array(*[F.sum(F.col("p")[i]) / trees for i in range(len(classes))]).alias("__p"))
    some = F.broadcast(spark.createDataFrame([(f, classes.index(c), c) for f, c in known], f"__fold int, __i int, class {kinds['class']}"))
    out = T.written(rows.select("__row", "__fold", *keys).join(total, "__row").join(some, "__fold").select(*keys, "class", F.col("__p")[F.col("__i")].alias("p")), "probabilities")
    T.dropped(rows)
    return out
