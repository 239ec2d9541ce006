"""Languages of texts by bit-sliced Bloom filters of letter n-grams.

An n-gram belongs to a language if at least one in RARE of the language's n-grams in the training texts is it, and its
share there is at least one in TIMES of its share in the language where it is most frequent. So a language has RARE
n-grams at most, whatever the corpus, and the filters have a fixed size. They are bit-sliced: one table of BITS
places, each place a bit mask of languages, so the masks at an n-gram's places, joined by AND, are the languages that
contain it. Counts of bits for each language over a text, less those that the filter's fill makes by chance, decide.

Training texts are counted in tasks before the shuffle, and the filters are packed by ranges of places in tasks; what
reaches the driver and the workers is a table of BITS masks of up to eight bytes. More than 64 languages take a filter
for each 64, with whole texts read once for each and the best kept. Texts are read whole, in pieces of bounded size.

A text's words are runs of letters and marks, in lower case; n-grams of ORDERS lie within a word with one character
before and after it.

Results for odd input: `und` with score 0 for texts that are null or have no letter, and for all if no row has a text
and a language; a text none of whose n-grams is known gets the language with most n-grams of its own, with score 0; a null
doc_id counts as an empty one and stays null; repeated rows count and are judged each; an empty language is one like
others; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from torquil.llm import common as C

ORDERS = (3, 5)
RARE, TIMES = 1 << 18, 16
#: Places of a filter (a power of two), places of an n-gram, languages of a filter, places of a packed block.
BITS, HASHES, SLICE, BLOCK = 1 << 21, 3, 64, 1 << 14
#: Code points of a text that are looked at together, and n-grams that are counted together.
PIECE, BUFFER = 1 << 18, 1 << 21


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case if it is a letter or mark, else 0; whether it is a letter."""
    lower, letter = np.zeros(0x110000, np.uint32), np.zeros(0x110000, bool)
    for i in range(0x110000):
        kind = unicodedata.category(c := chr(i))[0]
        if kind in "LM":
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
            letter[i] = kind == "L"
    return lower, letter


def pieces(texts: list[str | None]):
    """(codes, counted, row of each counted code, whether it is a letter): codes of one or more texts with 0 where there is no letter; the first `counted` of each start n-grams."""
    lower, letter = _letters()
    more = max(ORDERS) - 1
    held: list[tuple[int, str, int]] = []

    def flush():
        codes = np.frombuffer("".join(s for _, s, _ in held).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(s) for _, s, _ in held])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        counted = np.array([n for _, _, n in held])
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(counted)[:-1]]), counted) + np.arange(counted.sum())
        return lower[codes], at, np.repeat(np.array([i for i, _, _ in held]), counted), letter[codes[at]]

    size = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        padded = f" {text}"
        for a in range(0, len(padded), PIECE):
            part = padded[a : a + PIECE + more]
            n = min(PIECE, len(padded) - a)
            held.append((i, part + " " * (n + more - len(part)), n))
            size += n
            if size >= PIECE:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def grams(codes: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that start at the places, and their rows."""
    found, of = [], []
    wide = codes.astype(np.uint64)
    inside = codes != 0
    for n in ORDERS:
        ok = inside[at + 1]
        for j in range(2, n - 1):
            ok = ok & inside[at + j]
        start = at[ok]
        h = np.full(len(start), np.uint64(n))
        for j in range(n):
            h = h * C.M1 + wide[start + j]
            h ^= h >> np.uint64(29)
        found.append(C.mix(h))
        of.append(rows[ok])
    return np.concatenate(found), np.concatenate(of)


def places(hashes: np.ndarray) -> list[np.ndarray]:
    step = C.mix(hashes + C.M2) | np.uint64(1)
    return [((hashes + np.uint64(i) * step) & np.uint64(BITS - 1)).astype(np.int64) for i in range(HASHES)]


def _counted(batches):
    """(language, gram, n) of a task's texts, summed up whenever BUFFER n-grams are there."""
    held, langs, size = [], [], 0

    def flush():
        g, at = np.concatenate(held), np.concatenate(langs)
        order = np.lexsort((g, at))
        g, at = g[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (at[1:] != at[:-1])]))
        n = np.diff(np.append(first, len(g)))
        return pa.RecordBatch.from_arrays([pa.array(at[first].astype(np.int32)), pa.array(g[first].view(np.int64)), pa.array(n.astype(np.int64))], ["language", "gram", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lang = np.array(batch.column("language").to_pylist())
        for codes, at, rows, _ in pieces(batch.column("text").to_pylist()):
            g, of = grams(codes, at, rows)
            held.append(g)
            langs.append(lang[of])
            size += len(g)
            if size >= BUFFER:
                yield flush()
                held, langs, size = [], [], 0
    if size:
        yield flush()


def _marked(batches):
    """(place, mask) of each n-gram of a language."""
    for batch in batches:
        g = batch.column("gram").to_numpy().view(np.uint64)
        mask = np.uint64(1) << batch.column("bit").to_numpy().astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places(g))), pa.array(np.tile(mask, HASHES).view(np.int64))], ["place", "mask"])


def _block(key, rows: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(BLOCK, np.uint64)
    out[rows.place.to_numpy() % BLOCK] = rows["mask"].to_numpy().view(np.uint64)
    return pd.DataFrame({"block": [key[0]], "masks": [out.tobytes()]})


def belonging(training: DataFrame) -> DataFrame:
    """(language, gram), written: the n-grams of each language of training (language int, text)."""
    counts = C.written(training.mapInArrow(_counted, "language int, gram long, n long").repartition("gram").groupBy("gram", "language").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))
    shares = counts.join(C.if_small(C.written(totals, "totals")), "language").withColumn("share", F.col("n") / F.col("total"))
    most = F.max("share").over(Window.partitionBy("gram"))  # a row for each language at most
    out = C.written(shares.withColumn("most", most).where((F.col("n") * RARE >= F.col("total")) & (F.col("share") * TIMES >= F.col("most"))).select("language", "gram"), "belonging")
    C.drop(counts)
    return out


def filters(owned: DataFrame, languages: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each SLICE languages: masks of BITS places in the fewest bytes that hold them, and each language's rate of false positives."""
    out = []
    for a in range(0, languages, SLICE):
        size = min(SLICE, languages - a)
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.dtype(t).itemsize * 8 >= size)
        marks = owned.where((F.col("language") >= a) & (F.col("language") < a + size)).select((F.col("language") - a).alias("bit"), "gram").mapInArrow(_marked, "place long, mask long")
        blocks = marks.groupBy("place").agg(F.bit_or("mask").alias("mask")).groupBy(F.floor(F.col("place") / BLOCK).cast("long").alias("block")).applyInPandas(_block, "block long, masks binary")
        masks = np.zeros(BITS, kind)
        for r in blocks.toLocalIterator():
            masks[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.masks, np.uint64)
        fill = np.array([np.count_nonzero(masks & kind(1 << b)) for b in range(size)]) / BITS
        out.append((masks, fill**HASHES))
    return out


def bit_counts(texts: list[str | None], masks: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: n-grams that each language may contain, n-grams, whether it has a letter."""
    n = len(texts)
    planes = masks.dtype.itemsize
    seen = np.zeros((planes, n, 256), np.int64)
    total, lettered = np.zeros(n, np.int64), np.zeros(n, bool)
    for codes, at, rows, letter in pieces(texts):
        lettered[rows[letter]] = True
        g, of = grams(codes, at, rows)
        found = reduce(np.bitwise_and, (masks[p] for p in places(g)))
        total += np.bincount(of, minlength=n)
        low, high = (int(of.min()), int(of.max()) + 1) if len(of) else (0, 0)
        for k, plane in enumerate(found.view(np.uint8).reshape(-1, planes).T):
            seen[k, low:high] += np.bincount((of - low) * 256 + plane, minlength=(high - low) * 256).reshape(-1, 256)
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    return np.concatenate(list(seen @ bits), axis=1)[:, :size], total, lettered


def _judged(batches, filter, names: list[str], prior: np.ndarray):
    masks, chance = filter.value if filter else (np.zeros(BITS, np.uint8), np.zeros(0))
    for batch in batches:
        if not batch.num_rows:
            continue
        found, total, lettered = bit_counts(batch.column("text").to_pylist(), masks, len(names))
        n = len(total)
        if names:
            real = np.maximum(0, (found - total[:, None] * chance) / (1 - chance))
            best = np.lexsort((np.broadcast_to(prior, real.shape), real), axis=1)[:, -1]
            top = real[np.arange(n), best]
            rest = real.copy()
            rest[np.arange(n), best] = -1
            second = np.maximum(rest.max(axis=1), 0)
        else:
            best, top, second = np.zeros(n, int), np.zeros(n), np.zeros(n)
        pred = [names[b] if ok and names else None for b, ok in zip(best, lettered)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(top), pa.array(second), pa.array(prior[best] if names else np.zeros(n), pa.float64()), pa.array(total)], ["row", "doc_id", "lang_pred", "top", "second", "prior", "n_grams"])


def held_out() -> Column:
    """Whether a document is not learned from: crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def languages(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, n_grams) of each row of docs (doc_id, text), learned from training (text, lang)."""
    spark = docs.sparkSession
    C.tune(spark)
    known = training.where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    names = sorted(r.lang for r in known.select("lang").distinct().toLocalIterator())
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "lang string, language int")
    owned = belonging(known.join(C.if_small(index), "lang").select("language", "text"))
    sizes = {r.language: r.n for r in owned.groupBy("language").agg(F.count("*").alias("n")).toLocalIterator()}
    made = filters(owned, len(names)) or [None]
    C.drop(owned)
    rows = C.with_text(docs, "doc_id").withColumn("row", F.monotonically_increasing_id())
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, top double, second double, prior double, n_grams long"
    parts = []
    for k, one in enumerate(made):
        own = names[k * SLICE : (k + 1) * SLICE]
        prior = np.array([float(sizes.get(k * SLICE + i, 0)) for i in range(len(own))])
        shared = spark.sparkContext.broadcast(one) if one else None
        parts.append(rows.mapInArrow(lambda b, f=shared, o=own, p=prior: _judged(b, f, o, p), schema))
    out = parts[0]
    if len(parts) > 1:
        best = F.max(F.struct("top", "prior", "lang_pred", "second", "n_grams", "doc_id"))
        both = reduce(DataFrame.union, parts).groupBy("row").agg(best.alias("b"), F.sort_array(F.flatten(F.collect_list(F.array("top", "second"))), asc=False).alias("all"))
        out = both.select("row", "b.doc_id", "b.lang_pred", "b.top", F.col("all")[1].alias("second"), "b.n_grams")
    score = F.coalesce(F.try_divide("top", F.col("top") + F.col("second")), F.lit(0.0))
    return out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.when(F.col("lang_pred").isNull(), 0.0).otherwise(score).alias("score"), "n_grams")


def op12_language_filters(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = languages(docs, docs.where(~held_out()))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "n_grams")
