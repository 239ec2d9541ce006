"""Quality rules: fixed ones, and robust multivariate outliers within each language and source.

Each text's transformed statistics are held against the minimum covariance determinant estimate of its group: from
medians and median deviations, concentration steps go on with the mean and covariance of the nearest SHARE of the
group. Every step is one pass: tasks sum counts, values and products by group and bin of distance, so a group of
any size comes to the next step as a bounded number of rows. Texts beyond CUTOFF are rejected.

Every group is judged by its own estimate, drawn towards its language's as if PRIOR rows of the language were in it
too: a source of a few rows is judged nearly as its language, one of thousands by itself, with no switch between.
Cutoffs are wider the fewer rows an estimate stands on.

Results for odd input: null or empty texts have no words and fail; a null language or source is a group like any
other; rows that share an id are judged apart; an empty table gives no rows; other columns are left alone, and where
one has the name of a column made here, the made one is in the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from torquil.llm import common as C

#: Transformed statistics, with the least standard deviation that counts as a spread.
FEATURES = {"log_words": 0.3, "word_length": 0.3, "log_line_words": 0.3, "symbols": 0.1, "repeated": 0.1, "capitals": 0.05}
SHARE, STEPS, PRIOR = 0.75, 4, 50
P = len(FEATURES)
#: Squared distances, scaled to a median as of normal data: the chi-square quantile 0.999 of P features, and a margin of a tenth, as clean texts are not quite normal.
QUANTILE, MARGIN = 22.458, 1.1
CUTOFF = MARGIN * QUANTILE
#: An estimate on n rows has its cutoff times 1 + WIDER / n.
WIDER = (P + 1) ** 2
_SYMBOLS, _SPACE, _CAPITALS = b"#*$%&|<>", b" \t\n\v\f\r", bytes(range(65, 91))
_MORE = bytes(range(128, 192))


def counts(text: bytes) -> tuple[int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word, capital letters."""
    words = text.split()
    n = len(words)
    seen, lines, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeated = 0
    if n > 8:
        h = C.rolling(C.WORDS.of(words), 8)
        _, at, times = np.unique(h, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(times[at] > 1)
        if len(hit):
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + 8, -1)
            repeated = int((np.cumsum(mark[:n]) > 0).sum())
    chars = len(text.translate(None, _SPACE + _MORE))
    return n, chars, len(text) - len(text.translate(None, _SYMBOLS)), dup, repeated, lines, len(text) - len(text.translate(None, _CAPITALS))


def _stats(batch: pa.RecordBatch):
    rows = np.array([counts(t) for t in C.texts_of(batch)], np.int64)
    n, chars, symbols, dup, repeated, lines, capitals = rows.T
    words = np.maximum(n, 1)
    x = np.stack([np.log1p(n), chars / words, np.log1p(n / np.maximum(lines, 1)), np.minimum(symbols / words, 1), np.maximum(repeated / words, dup / np.maximum(lines, 1)), np.minimum(capitals / np.maximum(chars, 1), 1)], 1)
    failed = (n < 20) | (100 * repeated > 30 * n)
    names = [c for c in batch.schema.names if c != "text"]
    arrays = [*(batch.column(c) for c in names), *(pa.array(c) for c in (n, chars, symbols, dup, repeated, failed)), pa.array(list(x), pa.list_(pa.float64()))]
    yield pa.RecordBatch.from_arrays(arrays, [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "x"])


def _distance(rows: pd.DataFrame) -> np.ndarray:
    y = np.stack(rows.x) - np.stack(rows.center)
    inverse = np.stack(rows.inverse).reshape(-1, P, P)
    return np.einsum("ni,nij,nj->n", y, inverse, y)


_SUMS = "grp string, bin int, n long, s array<double>, ss array<double>"
_PARAMS = "grp string, n long, center array<double>, inverse array<double>, scale double"


def _histograms(batches):
    """Counts of each group, feature and fixed bin."""
    for b in batches:
        rows = b.to_pandas()
        for i, width in enumerate(FEATURES.values()):
            g = rows.groupby([rows.grp, np.floor(np.stack(rows.x)[:, i] * 20 / width).astype(int)]).size()
            yield pa.RecordBatch.from_arrays([pa.array(g.index.get_level_values(0)), pa.array([i] * len(g), pa.int32()), pa.array(g.index.get_level_values(1), pa.int64()), pa.array(g.to_numpy(), pa.int64())], ["grp", "feature", "bin", "n"])


def _start(key, rows: pd.DataFrame) -> pd.DataFrame:
    """Medians, and a diagonal from the median deviations."""
    center, spread, n = np.zeros(P), np.zeros(P), 0
    for i, width in enumerate(FEATURES.values()):
        f = rows[rows.feature == i].sort_values("bin")
        at, n = (f.bin.to_numpy() + 0.5) * width / 20, int(f.n.sum())
        center[i] = at[np.searchsorted(f.n.cumsum(), n / 2)]
        off = np.abs(at - center[i])
        by = np.argsort(off, kind="stable")
        spread[i] = max(width, 1.4826 * off[by][np.searchsorted(f.n.to_numpy()[by].cumsum(), n / 2)])
    return pd.DataFrame({"grp": [key[0]], "n": [n], "center": [center], "inverse": [np.diag(spread**-2.0).ravel()], "scale": [1.0]})


class _Sums(dict):
    """Count, values and products of each (group, bin)."""

    def add(self, key: tuple[str, int], n: int, s: np.ndarray, ss: np.ndarray) -> None:
        old = self.get(key)
        self[key] = (n, s, ss) if old is None else (old[0] + n, old[1] + s, old[2] + ss)

    def sent(self) -> pa.RecordBatch:
        rows = [(g, k, *v) for (g, k), v in self.items()]
        self.clear()
        types = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["grp", "bin", "n", "s", "ss"])


def _bins(batches):
    """Sums of each group and bin of distance over the rows of a task; sent early where there are many groups."""
    sums = _Sums()
    for b in batches:
        rows = b.to_pandas()
        x = np.stack(rows.x)
        bins = np.floor(np.log2(_distance(rows) + 1e-3) * 8).astype(int)
        for (g, k), i in rows.groupby([rows.grp, bins]).indices.items():
            sums.add((g, int(k)), len(i), x[i].sum(0), (x[i].T @ x[i]).ravel())
        if len(sums) > 20_000:
            yield sums.sent()
    yield sums.sent()


def _combined(batches):
    """One row for each group and bin, all of whose rows are in this task."""
    sums = _Sums()
    for b in batches:
        for r in b.to_pylist():
            sums.add((r["grp"], r["bin"]), r["n"], np.array(r["s"]), np.array(r["ss"]))
    yield sums.sent()


def _step(key, rows: pd.DataFrame) -> pd.DataFrame:
    """The estimate from the bins that hold the nearest SHARE of the group, and the median distance by the last one."""
    by = rows.groupby("bin").agg({"n": "sum", "s": lambda v: np.sum(np.stack(v), 0), "ss": lambda v: np.sum(np.stack(v), 0)}).sort_index()
    total = int(by.n.sum())
    last = int(np.searchsorted(by.n.cumsum(), SHARE * total))
    n = by.n.iloc[: last + 1].sum()
    center = by.s.iloc[: last + 1].sum() / n
    cov = (by.ss.iloc[: last + 1].sum() / n).reshape(P, P) - np.outer(center, center)
    cov = (cov + cov.T) / 2 + np.diag(np.square(list(FEATURES.values())))
    middle = by.index[int(np.searchsorted(by.n.cumsum(), total / 2))]
    scale = 2 ** ((middle + 0.5) / 8) / (P * (1 - 2 / (9 * P)) ** 3)
    return pd.DataFrame({"grp": [key[0]], "n": [total], "center": [center], "inverse": [np.linalg.inv(cov).ravel()], "scale": [max(scale, 1.0)]})


def _blended(batches):
    """Each group's estimate, drawn towards its language's, and the factor of its distances."""
    for rows in batches:
        if not len(rows):
            continue
        n, many = rows.n.to_numpy(float), rows.lang_n.to_numpy(float)
        own = (n / (n + PRIOR))[:, None]
        cov = [np.linalg.inv(np.stack(rows[c]).reshape(-1, P, P)) for c in ("inverse", "lang_inverse")]
        center = own * np.stack(rows.center) + (1 - own) * np.stack(rows.lang_center)
        inverse = np.linalg.inv(own[:, :, None] * cov[0] + (1 - own[:, :, None]) * cov[1])
        stands_on = own[:, 0] * n + (1 - own[:, 0]) * many
        scale = (own[:, 0] * rows["scale"] + (1 - own[:, 0]) * rows["lang_scale"]) * (1 + WIDER / stands_on)
        yield pd.DataFrame({"grp": rows.grp, "center": list(center), "inverse": list(inverse.reshape(-1, P * P)), "scale": scale})


def _verdicts(batches):
    for b in batches:
        rows = b.to_pandas()
        far = _distance(rows) / rows["scale"].to_numpy() if len(rows) else np.zeros(0)
        names = [c for c in b.schema.names if c not in ("grp", "x", "center", "inverse", "scale")]
        kept = ~np.asarray(b.column("base_failed").to_pylist(), bool) & (far <= CUTOFF)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept), pa.array(far)], [*names, "kept", "distance"])


def quality(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source, ... but the text) with the counts, base_failed, kept and the distance in its group."""
    C.tune(docs.sparkSession)
    rest = [f for f in docs.schema if f.name != "text"]
    own = [f"c{i}" for i in range(len(rest))]  # names that can't clash
    named = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    plain = docs.select(*[F.col(f"`{f.name}`").alias(c) for f, c in zip(rest, own)], F.col("text").cast("string"), named("lang", "source").alias("grp"), named("lang").alias("lang_"))

    def schema(*more: str) -> StructType:
        out = StructType()
        for f, c in zip(rest, own):
            out.add(c, f.dataType)
        return StructType(out.fields + StructType.fromDDL(", ".join(more)).fields)

    figures = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    stats = C.written(C.mapped(plain, _stats, schema("grp string, lang_ string", figures, "x array<double>")), "stats")
    x = stats.select(F.explode(F.array("grp", "lang_")).alias("grp"), "x")  # estimates of groups and of languages side by side
    params = x.mapInArrow(_histograms, "grp string, feature int, bin long, n long").groupBy("grp", "feature", "bin").agg(F.sum("n").alias("n")).groupBy("grp").applyInPandas(_start, _PARAMS)
    for _ in range(STEPS):
        params = C.written(params, "params")
        sums = x.join(C.if_small(params, 20_000), "grp").select("grp", "x", "center", "inverse").mapInArrow(_bins, _SUMS)
        params = sums.repartition("grp", "bin").mapInArrow(_combined, _SUMS).groupBy("grp").applyInPandas(_step, _PARAMS)
    params = C.written(params, "params")
    languages = params.select(F.col("grp").alias("lang_"), *[F.col(c).alias(f"lang_{c}") for c in ("n", "center", "inverse", "scale")])
    both = stats.select("grp", "lang_").distinct().join(params, "grp").join(languages, "lang_")
    blended = C.written(both.mapInPandas(_blended, "grp string, center array<double>, inverse array<double>, scale double"), "blended")
    out = stats.drop("lang_").join(C.if_small(blended, 20_000), "grp").mapInArrow(_verdicts, schema(figures, "kept boolean, distance double"))
    more = [c for c in out.columns if c not in own]
    return out.select(*[F.col(c).alias(f.name) for f, c in zip(rest, own) if f.name not in more], *more)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns. The text is read again instead of carried through every step."""
    name = "__row"
    while name in map(str.lower, docs.columns):
        name += "_"
    row = F.xxhash64(*[F.col(f"`{c}`") for c in ("doc_id", "text", "lang", "source")]).alias(name)
    verdicts = quality(docs.select("doc_id", "text", "lang", "source", row)).where("not kept").select("doc_id", name).distinct()
    bad = C.written(verdicts, "rejected")
    named = docs.withColumn(name, row)
    match = named["doc_id"].eqNullSafe(bad["doc_id"]) & (named[name] == bad[name])
    return named.join(C.if_small(bad), match, "left_anti").drop(name)
