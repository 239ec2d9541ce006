"""Exact Jaccard self-join of word-shingle sets, by size-banded tiles and hashed bitmap signatures.

Sizes are cut into bands. A pair meets in the tile (band) of its smaller set: there both sets are cut by hash
range into more segments than a linked pair can have differing shingles, so a linked pair has an equal segment.
A set with too few segments that hold shingles is also cut into twice as many, until it has more of them than a
linked pair can differ in; only these are keys. Pairs that share a segment go on; bitmaps of hashed shingles bound
their overlap from above by bit counts; what is left is decided on the sorted arrays of 64-bit shingle hashes.

Keys travel sorted and packed, a row for each range of keys and some thousand sets, after a task has joined its own
sets that share a key: so a key that many sets hold comes as few entries. Copies of one set are one class from the
start. In each segment every class is compared with the smallest one in it, never all with all; only segments that
still hold several components after that are compared block by block, the likeliest pair of each two components first.

Texts are stored once, bucketed by row number, and are never shuffled again.

Results for odd input: null, empty or blank texts have no shingles and link with nothing; fewer than k words are
one shingle; rows of one id are one node; a null id links with nothing and gets no component; other columns are
left alone.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from torquil.llm import common as C

#: Members of a block when segments with several components are compared.
BLOCK = 256


def shingles(text: bytes, k: int) -> np.ndarray:
    """The text's set as sorted hashes: A-Z lower-cased, words between ASCII white space, k words each."""
    return np.unique(C.rolling(C.WORDS.of(text.lower().split()), k))


@functools.cache
def bands(percent: int) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, shingles that a linked pair can differ in, segments) of each band."""
    out, low = [], 1
    while low < 1 << 40:
        high = max(low, math.ceil(low * (100 / percent) ** 2) - 1)
        most = (high + 100 * high // percent) * (100 - percent) // (100 + percent)
        empty = (most + 1) * math.exp(-low / (most + 1))
        spare = math.ceil(empty + 2 * math.sqrt(empty)) if most else 0
        out.append((low, high, most, most + 1 + spare))
        low = high + 1
    return out


@functools.cache
def _starts(percent: int) -> np.ndarray:
    return np.array([b[0] for b in bands(percent)])


def segment_keys(items: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the sorted set's segments in each tile where it may meet a linked set.

    Two linked sets differ in at most `most` shingles, so at least one of more than `most` segments of either that
    hold shingles is the same in both. A set is cut finer until it has so many: two sets share every cut up to the
    first one that is fine enough for either of them.
    """
    n, out = len(items), []
    if not n:
        return items
    sums = np.concatenate(([np.uint64(0)], np.cumsum(C.mix(items ^ C.M2))))
    own = b = int(np.searchsorted(_starts(percent), n, "right")) - 1
    while b >= 0 and (b == own or percent * n <= 100 * bands(percent)[b][1]):
        most, k = bands(percent)[b][2:]
        while True:
            of = (items >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)
            at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            value = sums[np.append(at[1:], n)] - sums[at]
            out.append(C.mix(value * C.M1 + C.mix((of[at] << np.uint64(32)) + np.uint64(k)) + np.uint64(b)))
            if len(at) > most or k >= 1 << 31:
                break
            k *= 2
        b -= 1
    return np.concatenate(out)


def bitmap(items: np.ndarray) -> bytes:
    """A bit for each item by its hash; as many bits as a power of two from 64 that is twice the items or more, to 4096."""
    bits = min(4096, max(64, 1 << (2 * len(items) - 1).bit_length()))
    out = np.zeros(bits, bool)
    out[(items & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def fold(bits: bytes, size: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits. Bit i of the small one stands for all i + j * size bits."""
    return np.bitwise_or.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def overlap_bound(na: int, a: bytes, nb: int, b: bytes) -> int:
    """At most so many items are in both: each bit set in one bitmap alone is an item of that set alone."""
    size = min(len(a), len(b))
    x, y = fold(a, size), fold(b, size)
    return min(na - int(np.bitwise_count(x & ~y).sum()), nb - int(np.bitwise_count(y & ~x).sum()))


def _linked(shared: int, na: int, nb: int, percent: int) -> bool:
    return shared > 0 and 100 * shared >= percent * (na + nb - shared)


def _sizes(batch: pa.RecordBatch, k: int):
    """n and a hash of the whole set for each row."""
    sets = [shingles(t, k) for t in C.texts_of(batch)]
    sums = [C.mix(s).sum(keepdims=True, dtype=np.uint64)[0] if len(s) else np.uint64(0) for s in sets]
    yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(sums, np.uint64).view(np.int64))], ["row", "doc_id", "n", "set"])


def _bits(batch: pa.RecordBatch, k: int):
    sets = [shingles(t, k) for t in C.texts_of(batch)]
    yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())], ["row", "n", "bits"])


def _items(batch: pa.RecordBatch, k: int):
    """The sorted set of each row with whatever else the row has."""
    names = [c for c in batch.schema.names if c != "text"]
    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([shingles(t, k).tobytes() for t in C.texts_of(batch)], pa.binary())], [*names, "items"])


#: Keys a task sorts and joins before it sends them.
KEYS = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)
_PACKED = "range int, key long, a long, b long, keys binary, rows binary"
_PACKED_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_PACKED_NAMES = ["range", "key", "a", "b", "keys", "rows"]


def _joined(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The distinct keys in order, the least row of each, and (key, least row, other row) of those that share one."""
    by = np.lexsort((rows, keys))
    keys, rows = keys[by], rows[by]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, bool)
    least = rows[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(keys) else rows
    more = ~first & (rows != least)
    return keys[first], rows[first], (keys[more], least[more], rows[more])


def _keys(batches, k: int, percent: int, ranges: int):
    """Packed keys by range, and pairs of rows that share one here already (in any range)."""
    held: list[np.ndarray] = []
    rows: list[tuple[int, int]] = []

    def sent():
        keys = np.concatenate(held)
        # the upper half of a key gives its range, within which the lower half tells keys apart
        keys = ((keys >> np.uint64(32)) * np.uint64(ranges) & ~_LOW) | (keys & _LOW)
        keys, least, pairs = _joined(keys, np.repeat([r for r, _ in rows], [n for _, n in rows]))
        for at in range(0, len(pairs[0]), 50_000):
            part = [pa.array(x[at : at + 50_000].view(np.int64)) for x in pairs]
            n = len(part[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n) % ranges, pa.int32()), *part, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], _PACKED_NAMES)
        at = np.searchsorted(keys >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64)).tolist()
        out = [(r, None, None, None, (keys[x:y] & _LOW).astype("<u4").tobytes(), least[x:y].tobytes()) for r, (x, y) in enumerate(zip(at, at[1:])) if x < y]
        for x in range(0, len(out), 200):
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out[x : x + 200]], t) for i, t in enumerate(_PACKED_TYPES)], _PACKED_NAMES)

    size = 0
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), C.texts_of(batch)):
            keys = segment_keys(shingles(text, k), percent)
            held.append(keys)
            rows.append((row, len(keys)))
            size += len(keys)
            if size >= KEYS:
                yield from sent()
                held, rows, size = [], [], 0
    if size:
        yield from sent()


def _stars(batches):
    """(key, a, b, here): rows that share a key in one task, each with the least of these (here), and those with the least of all."""
    runs: list[tuple[bytes, bytes]] = []
    last = None

    def batch_of(columns, here: bool):
        columns = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64)) for c in columns]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), here))], ["key", "a", "b", "here"])

    def merged():
        keys, rows = (np.concatenate([np.frombuffer(r[i], t) for r in runs]) for i, t in enumerate(("<u4", np.int64)))
        return batch_of(_joined(keys + (np.uint64(last) << np.uint64(32)), rows)[2], False)

    for batch in batches:
        packed = batch.column("keys").is_valid()
        yield batch_of(batch.filter(pc.invert(packed)).columns[1:4], True)
        rows = batch.filter(packed)
        for of, keys, ids in zip(*(rows.column(c).to_pylist() for c in ("range", "keys", "rows"))):
            if of != last and runs:
                yield merged()
                runs = []
            last = of
            runs.append((keys, ids))
    if runs:
        yield merged()


def _by_bits(batch: pa.RecordBatch, percent: int):
    """All pairs with bitmaps of the same two widths at once."""
    na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
    a, b = (batch.column(c).to_pylist() for c in ("abits", "bbits"))
    widths = np.array([(len(x), len(y)) for x, y in zip(a, b)])
    bound = np.zeros(len(a), np.int64)
    for u, v in set(map(tuple, widths.tolist())):
        at = np.flatnonzero((widths == (u, v)).all(1))
        size = min(u, v)
        x, y = (np.bitwise_or.reduce(np.frombuffer(b"".join([s[i] for i in at]), np.uint8).reshape(len(at), -1, size), axis=1) for s in (a, b))
        only = [np.bitwise_count(z).sum(1, dtype=np.int64) for z in (x & ~y, y & ~x)]
        bound[at] = np.minimum(na[at] - only[0], nb[at] - only[1])
    keep = (bound > 0) & (100 * bound >= percent * (na + nb - bound))
    yield batch.select(["a", "b"]).filter(pa.array(keep))


def _exact(batch: pa.RecordBatch, percent: int):
    """Sorted-array intersection, by one merge of the two arrays."""
    keep = []
    for a, b in zip(batch.column("aitems").to_pylist(), batch.column("bitems").to_pylist()):
        both = np.sort(np.concatenate((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))), kind="stable")
        keep.append(_linked(int((both[1:] == both[:-1]).sum()), len(a) // 8, len(b) // 8, percent))
    yield batch.select(["a", "b"]).filter(pa.array(keep))


def _tile(rows: list[tuple], percent: int, every: bool, found: list[tuple]) -> None:
    """Adds (a, b, one, other, score) of pairs of different components, one of the tile's first block and one of its second, that bitmaps leave: every one, or the best of each two components. The two blocks are the same one or have no row in common."""
    left, right = ([r for r in rows if r[1] == side] for side in (0, 1))
    if not left or not right or len({r[3] for r in rows}) == 1:
        return
    size = min(len(r[5]) for r in rows)
    y = np.stack([fold(r[5], size) for r in right])
    docs, comps, ny = (np.array([r[k] for r in right], np.int64) for k in (2, 3, 4))
    across = left[0][2] not in docs  # in one block alone both sides hold each pair
    best: dict[tuple[int, int], tuple] = {}
    for _, _, doc, comp, nx, bits in left:
        at = np.flatnonzero(((docs > doc) | across) & (comps != comp))
        if not len(at):
            continue
        x, z = fold(bits, size), y[at]
        bound = np.minimum(nx - np.bitwise_count(x & ~z).sum(1, dtype=np.int64), ny[at] - np.bitwise_count(z & ~x).sum(1, dtype=np.int64))
        keep = (bound > 0) & (100 * bound >= percent * (nx + ny[at] - bound))
        at, score = at[keep], bound[keep] / (nx + ny[at[keep]] - bound[keep])
        for j, p in zip(at.tolist(), score.tolist()):
            pair, c = tuple(sorted((doc, int(docs[j])))), int(comps[j])
            if every:
                found.append((*pair, *pair, p))
            else:
                key = (min(comp, c), max(comp, c))
                if key not in best or best[key][4] < p:
                    best[key] = (*pair, *key, p)
    found += best.values()


def _blocks(batches, percent: int, every: bool):
    """The pairs that are left of each tile; rows come sorted by tile."""
    rest: list[tuple] = []
    found: list[tuple] = []

    def sent():
        types = [pa.int64()] * 4 + [pa.float64()]
        out = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], ["a", "b", "one", "other", "score"])
        found.clear()
        return out

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "doc", "comp", "n", "bits"))):
            if rest and row[0] != rest[0][0]:
                _tile(rest, percent, every, found)
                rest = []
            rest.append(row)
        yield sent()
    if rest:
        _tile(rest, percent, every, found)
    yield sent()


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int, single: bool = False) -> DataFrame:
    """The linked ones of the pairs (a, b), as a table: b's sets go to a's. single: no b is in two pairs."""

    def items(rows: DataFrame, schema: str) -> DataFrame:
        return C.mapped(texts.join(rows.hint("shuffle_hash"), "row").select("row", *rows.drop("row").columns, "text"), _items, schema, k=k)

    if single:
        b = items(pairs.select(F.col("b").alias("row"), "a"), "row long, a long, items binary").toDF("b", "a", "bitems")
    else:
        b = pairs.join(items(pairs.select(F.col("b").alias("row")).distinct(), "row long, items binary").toDF("b", "bitems"), "b")
    a = items(pairs.select(F.col("a").alias("row")).distinct(), "row long, items binary").toDF("a", "aitems")
    return C.written(C.mapped(b.join(a, "a").select("a", "b", "aitems", "bitems"), _exact, "a long, b long", percent=percent), "verified")


def _with_components(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """pairs with ca, cb: the components so far (a row in no link is its own)."""
    out = pairs
    for c in ("a", "b"):
        out = out.join(comps.toDF(c, f"c{c}"), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    return out


def row_components(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(row, doc_id, n_shingles, component_id) of each row of texts (row, doc_id, text; stored by row), as a table."""
    ranges = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = C.written(C.mapped(texts, _sizes, "row long, doc_id long, n long, set long", k=k), "sets")
    # copies of one set: the class goes on as its smallest row
    some = sized.where("n > 0 and doc_id is not null")
    classes = C.written(some.groupBy("set", "n").agg(F.min("row").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("set", "n", "rep"), "classes")
    member = C.written(some.join(classes, ["set", "n"], "left").select("row", "doc_id", F.coalesce("rep", "row").alias("rep")), "members")
    others = sized.where("n = 0 or doc_id is null").select("row").union(member.where("row <> rep").select("row"))
    reps = texts.join(others.hint("shuffle_hash"), "row", "left_anti").select("row", "text")
    packed = reps.mapInArrow(lambda it: _keys(it, k, percent, ranges), _PACKED)
    found = C.written(packed.repartition("range").sortWithinPartitions("range").mapInArrow(_stars, "key long, a long, b long, here boolean"), "shared")
    # a task's least rows stand for what they stand for, so that each row is held against the least of all that have the key
    tops = found.where("not here").select("key", F.col("b").alias("a"), F.col("a").alias("top"))
    stars = found.where("here").join(tops, ["key", "a"], "left").select("key", F.coalesce("top", "a").alias("a"), "b")
    stars = C.written(stars.union(found.where("not here").select("key", "a", "b")), "stars")
    C.drop(found)
    # hashed bitmaps rule out most pairs
    pairs = C.written(stars.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    signed = C.written(C.mapped(texts.join(ids.hint("shuffle_hash"), "row").select("row", "text"), _bits, "row long, n long, bits binary", k=k), "bits")
    rows = pairs.join(signed.toDF("b", "nb", "bbits"), "b").join(signed.toDF("a", "na", "abits"), "a").select("a", "b", "na", "abits", "nb", "bbits")
    possible = C.written(C.mapped(rows, _by_bits, "a long, b long", percent=percent), "possible")
    # first one pair of each set, then what doesn't follow from these
    first = C.written(possible.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    # sets of rows that share an id
    shared = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z")
    same = member.join(C.written(shared.select("doc_id", "a"), "shared"), "doc_id").where("a < rep").select("a", F.col("rep").alias("b"))
    verified = _verified(first, texts, k, percent, single=True)
    links = C.written(verified.union(same), "linked")
    comps = C.components(links)
    more = C.written(_with_components(possible.join(first, ["a", "b"], "left_anti"), comps).where("ca <> cb").select("a", "b"), "more")
    if more.take(1):
        comps = C.components(_verified(more, texts, k, percent), comps)
    # segments that still hold several components: block by block, first a pair of each two components, then all that are
    # left of different components
    for every in (False, True):
        split = _with_components(stars, comps)
        open_keys = C.written(split.groupBy("key").agg(F.max(F.col("ca") != F.col("cb")).alias("open"), F.count("*").alias("n")).where("open and n > 1").select("key", "n"), "open")
        more_open = open_keys.take(1)
        if more_open:
            comps = C.components(_verified(_open_pairs(stars, open_keys, signed, comps, first, percent, every), texts, k, percent), comps)
        C.drop(open_keys)
        if not more_open:
            break
    # back to all copies
    named = C.written(member.join(comps.toDF("rep", "grp"), "rep", "left").select("row", "doc_id", F.coalesce("grp", "rep").alias("grp")), "named")
    least = C.written(named.groupBy("grp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").select("grp", "component_id"), "least")
    named = named.join(least, "grp", "left").select("row", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = C.written(sized.join(named, "row", "left").select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    C.drop(sized, classes, member, stars, pairs, signed, possible, first, verified, links, comps, more)
    return out


def _open_pairs(stars: DataFrame, open_keys: DataFrame, signed: DataFrame, comps: DataFrame, first: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of rows of different components that share an open key and that bitmaps leave, as a table: every one, or the likeliest of each two components.

    A key's rows are dealt by hash into blocks of about BLOCK, and pairs of blocks into tiles.
    """
    left = stars.join(open_keys, "key")
    rows = C.written(left.select("key", "n", F.col("a").alias("doc")).union(left.select("key", "n", F.col("b").alias("doc"))).distinct(), "open-rows")
    # of keys that the same rows hold, one is enough: rows that share a passage share many segments
    held = rows.groupBy("key").agg(*[F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"h{i}") for i in (0, 1)], F.count("*").alias("rows"))
    left = rows.join(held.groupBy("h0", "h1", "rows").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    left = left.join(comps.toDF("doc", "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    left = left.join(signed.toDF("doc", "size", "bits"), "doc").withColumn("last", F.floor(F.col("n") / BLOCK))
    left = left.withColumn("i", F.pmod(F.xxhash64("doc"), F.col("last") + 1))
    tiles = left.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    tiles = tiles.where("(side = 0 and i <= j) or (side = 1 and j <= i)").select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("tile"), "side", "doc", "comp", F.col("size").alias("n"), "bits")
    found = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(functools.partial(_blocks, percent=percent, every=every), "a long, b long, one long, other long, score double")
    found = found.groupBy("one", "other").agg(F.max_by(F.struct("a", "b"), F.struct("score", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    out = C.written(found.join(first, ["a", "b"], "left_anti"), "found")
    C.drop(rows)
    return out


def ngram_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): components of the links of Jaccard similarity percent/100 or more."""
    C.tune(docs.sparkSession)
    rows = C.stored(C.with_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")), "documents")
    out = row_components(rows.toDF("doc_id", "text", "row"), k, percent)
    C.drop(rows)
    return out.drop("row")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs (all columns) without near copies: of each component, and of rows that share an id, one stays. Rows without an id or words stay."""
    C.tune(docs.sparkSession)
    rows = C.stored(docs, "documents")
    at = {c: f"c{docs.columns.index(c)}" for c in ("doc_id", "text")}
    found = row_components(rows.select(F.col("row"), F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["text"]).cast("string").alias("text")), k, percent)
    gone = found.where("doc_id <> component_id").select("row")
    # rows that share an id are one group too
    twice = C.written(found.where("doc_id is not null").groupBy("doc_id").agg(F.min("row").alias("one"), F.count("*").alias("n")).where("n > 1").select("doc_id", "one"), "twice")
    gone = gone.union(found.join(twice, "doc_id").where("row <> one").select("row"))
    return rows.join(gone.hint("shuffle_hash"), "row", "left_anti").drop("row").toDF(*docs.columns)


def op2_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)
