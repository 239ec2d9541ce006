"""Exact removal of long byte strings that occur more than once, by sharded suffix arrays.

A string of `length` bytes belongs to its anchor: the place of the least hash of `GRAM` bytes in it. Equal strings
have equal anchors, so only places whose anchor's hash occurs more than once can repeat; all others drop out after
one count of hashes. All starts of one anchor's strings are a segment of text. Equal segments of an anchor are
counted by hash; of the anchors that still have several, one text a segment goes to the shards.
A shard sorts its suffixes by Larsson-Sadakane refinement (prefix doubling of the groups not yet sorted) in numpy,
and Kasai's scan gives common prefixes: `length` shared bytes mark both starts.
An anchor with very many different segments is dealt over many shards. Each sorts its distinct strings' digests,
cuts them at fixed splitters by binary search and sends each run as one row; runs of one range meet and are merged
by binary search.

Texts are stored once, bucketed by row number, so segments are cut and places removed where the texts lie; only
hashes, segments of anchors in doubt, and places are shuffled.

Several lengths can be looked for at once: anchors are those of the least, and segments are as long as the greatest
needs.

Results for odd input: null and short texts lose nothing; every row is its own, so equal rows count as two
occurrences and null or repeated ids are kept apart; other columns are left alone; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from torquil.llm import common as C

GRAM = 32
#: Different segments of one anchor that go to one shard, and that one range of the merge may come from.
SHARD_SEGMENTS, RANGE_SEGMENTS = 512, 2048
#: Bytes of text of which one suffix array is made.
SHARD_BYTES = 1 << 19
#: Bytes hashed at once.
PIECE = 1 << 18


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place."""
    h = data.astype(np.uint64) + np.uint64(1)
    size, by = 1, np.array([0x9E3779B97F4A7C15], np.uint64)
    while size < GRAM:
        h = h[:-size] * by + h[size:]
        by = by * by
        size *= 2
    return C.mix(h)


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each anchor, its text's number, and the first and last start of its strings. Every start has one anchor, fixed by its string alone."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    hashes = _gram_hashes(data)
    low = np.uint64(0xFFFFFF)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while size * 2 <= width:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    at = (np.minimum(keys[:n], keys[width - size : width - size + n]) & low).astype(np.int64)
    inside = (np.repeat(ends, sizes)[:n] - np.arange(n)) >= length  # strings that would run into the next text don't count
    new = np.concatenate(([True], (at[1:] != at[:-1]) | ~inside[:-1])) & inside
    end = np.concatenate((new[1:] | ~inside[1:], [True])) & inside
    first, last = np.flatnonzero(new), np.flatnonzero(end)
    text = np.searchsorted(ends, first, "right")
    begin = (ends - sizes)[text]
    return hashes[at[first]], text, first - begin, last - begin


def _pieces(size: int, length: int):
    """Ranges of long texts, so that every start lies in one of them."""
    start = 0
    while start == 0 or start + length - 1 < size:
        yield start, min(size, start + PIECE)
        start += PIECE - length + 1


def _anchor_rows(batch: pa.RecordBatch, lengths: tuple[int, ...]):
    """The segments of each text. `starts` counts those of the least length; `size` is the segment's length in bytes, enough for the greatest."""
    least, most = min(lengths), max(lengths)
    names, types = ["anchor", "segment", "row", "start", "starts", "size"], [pa.int64()] * 4 + [pa.int32()] * 2
    parts: list[tuple[int, int, bytes]] = []

    def sent():
        h, text, first, last = anchors([t for _, _, t in parts], least)
        rows, offsets = (np.array([p[i] for p in parts], np.int64)[text] for i in (0, 1))
        first, last = first + offsets, last + offsets
        whole = [texts[k] for k in rows]
        stop = np.minimum(last + most, np.array([len(t) for t in whole], np.int64))
        segments = np.fromiter((xxhash.xxh3_64_intdigest(t[i:j]) for t, i, j in zip(whole, first.tolist(), stop.tolist())), np.uint64, len(first))
        columns = h.view(np.int64), segments.view(np.int64), ids[rows], first, last - first + 1, stop - first
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, types)], names)

    ids, texts, size = np.asarray(batch.column("row")), C.texts_of(batch), 0
    for k, text in enumerate(texts):
        if len(text) < least:
            continue
        for a, b in _pieces(len(text), least):
            parts.append((k, a, text[a:b]))
            size += b - a
            if size >= PIECE:
                yield sent()
                parts, size = [], 0
    if parts:
        yield sent()


def _cut(batch: pa.RecordBatch):
    """The segments' text, of all that are to be cut from each text."""
    names, types = ["anchor", "segment", "n", "starts", "text"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    out, size = [], 0
    for text, cuts in zip(C.texts_of(batch), batch.column("cuts").to_pylist()):
        out += [(c["anchor"], c["segment"], c["n"], c["starts"], text[c["start"] : c["start"] + c["size"]]) for c in cuts]
        size += sum(c["size"] for c in cuts)
        if size > 1 << 22:
            yield _batch(out, names, types)
            out, size = [], 0
    if out:
        yield _batch(out, names, types)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes in order, which Kasai's scan needs in full."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    bits = int(len(used)).bit_length()
    wide = 64 // bits  # as many bytes as fit into one key
    number = np.zeros(256, np.uint64)
    number[used] = np.arange(1, len(used) + 1)
    padded = np.concatenate((number[data], np.zeros(wide, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(wide):
        key = (key << np.uint64(bits)) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    # a group's rank is the place of its first suffix, so the ranks of other groups stay as one group is split
    rank = np.zeros(n + 1, np.uint64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    done = wide
    open_at = np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))
    while len(open_at):
        suffixes = order[open_at]
        key = (rank[suffixes] << np.uint64(32)) | rank[np.minimum(suffixes + done, n)]
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[open_at] = suffixes
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[suffixes] = np.maximum.accumulate(np.where(new, open_at, 0)) + 1
        open_at = open_at[~(new & np.concatenate((new[1:], [True])))]
        done *= 2
    return order


def kasai(data: np.ndarray, order: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, within its text [begins, ends).

    Kasai's observation: the suffix after one that shares h bytes with its neighbour shares h - 1 with that
    neighbour's next, and exactly so if that is its own neighbour. Only the other places are compared, all at once.
    """
    n = len(order)
    if n == 0:
        return np.zeros(0, np.int64)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order[np.maximum(place - 1, 0)]
    room = np.repeat(ends, ends - begins) - np.arange(n)
    room = np.minimum(room, room[before])
    room[order[0]] = 0
    starts = np.zeros(n + 1, bool)
    starts[begins] = starts[order[0]] = starts[order[0] + 1] = True
    fresh = np.concatenate(([True], (before[1:] != before[:-1] + 1) | (data[:-1] != data[before[:-1]]))) | starts[:n] | starts[before]
    wide = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= wide[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    i = np.flatnonzero(fresh)
    j, limit, have = before[i], room[i], np.zeros(len(i), np.int64)
    going = np.flatnonzero(limit > 0)
    while len(going):
        x = words[i[going] + have[going]] ^ words[j[going] + have[going]]
        lowest = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.bitwise_count(lowest - np.uint64(1)) // 8).astype(np.int64))
        have[going] += same
        going = going[(same == 8) & (have[going] < limit[going])]
    have = np.minimum(have, limit)
    nearest = np.cumsum(fresh) - 1
    out = np.empty(n, np.int64)
    out[place] = np.maximum(have[nearest] - (np.arange(n) - i[nearest]), 0)
    return out


def repeats(texts: list[bytes], starts: list[int], lengths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each length and text whether the string from each of its first starts occurs from another such start in these texts. UTF-8 has no byte 255, which ends each text."""
    texts = [t + b"\xff" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    order = suffix_array(data)
    common = kasai(data, order, ends - sizes, ends)
    out = []
    for length in lengths:
        stops = ends - sizes + np.maximum(0, np.minimum(starts, sizes - length))
        counts = np.repeat(stops, sizes) > np.arange(len(data))  # what starts later is in the text as the end of an earlier string only
        group = np.cumsum(common < length)
        of = np.empty(len(data), np.int64)
        of[order] = group
        twice = counts & (np.bincount(group, counts[order])[of] > 1)
        out.append([twice[e - s : stop] for s, e, stop in zip(sizes.tolist(), ends.tolist(), stops.tolist())])
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """[begin, end) of each run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


_PART = "anchor long, segment long, kind int, begin int, end int, range int, digests binary, places binary"
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
_NAMES = ["anchor", "segment", "kind", "begin", "end", "range", "digests", "places"]
#: A distinct string of a shard: its digest, its segment and its start there.
_STRING = np.dtype([("segment", "<i8"), ("start", "<i4")])


def _sent(strings: list[tuple[bytes, int, int]], anchor: int, kind: int, ranges: int):
    """A shard's strings of one anchor as sorted runs, cut at the ranges' splitters by binary search."""
    strings.sort()
    digests = np.array([s[0] for s in strings], "S16")
    places = np.array([s[1:] for s in strings], _STRING)
    splitters = np.array([((k << 128) // ranges).to_bytes(16, "big") for k in range(1, ranges)], "S16")
    at = [0, *np.searchsorted(digests, splitters, "left").tolist(), len(strings)]
    for k, (a, b) in enumerate(zip(at, at[1:])):
        if a < b:
            yield anchor, None, kind, None, None, k, digests[a:b].tobytes(), places[a:b].tobytes()


def _shard(batches, lengths: tuple[int, ...]):
    """Sorts shards; all rows of an anchor's shard come together. Shards of hot anchors also send what the merge must compare."""
    rows: list[tuple] = []
    size, last = 0, None

    def finish():
        out = []
        for kind, (length, flags) in enumerate(zip(lengths, repeats([r[3] for r in rows], [r[5] for r in rows], lengths))):
            hot: dict[tuple[int, int], dict[bytes, tuple[int, int]]] = {}
            ranges = {}
            for (anchor, segment, shard, text, n, _), twice in zip(rows, flags):
                out += [(anchor, segment, kind, a, b, None, None, None) for a, b in _runs(twice)]
                if shard >= 0:
                    found = hot.setdefault((anchor, shard), {})
                    ranges[anchor] = -(-n // RANGE_SEGMENTS)
                    for a in range(len(twice)):
                        found.setdefault(xxhash.xxh3_128_digest(text[a : a + length]), (segment, a))
            for (anchor, _), found in hot.items():
                out += _sent([(d, *p) for d, p in found.items()], anchor, kind, ranges[anchor])
        return _batch(out, _NAMES, _TYPES)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "segment", "shard", "text", "n", "starts"))):
            if row[0:3:2] != last and size >= SHARD_BYTES:
                yield finish()
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
            last = row[0:3:2]
    if rows:
        yield finish()


def _merge(batches):
    """Of the strings that shards sent, those that another shard sent too; the runs of one range come together."""
    runs: list[tuple[bytes, bytes]] = []
    last = None

    def merged():
        digests = [np.frombuffer(d, "S16") for d, _ in runs]
        all_ = np.sort(np.concatenate(digests))
        out = []
        for d, (_, places) in zip(digests, runs):
            again = np.searchsorted(all_, d, "right") - np.searchsorted(all_, d, "left") > 1
            found = np.sort(np.frombuffer(places, _STRING)[again])
            new = np.flatnonzero(np.concatenate(([True], (found["segment"][1:] != found["segment"][:-1]) | (found["start"][1:] != found["start"][:-1] + 1)))) if len(found) else np.zeros(0, np.int64)
            for a, b in zip(new, [*new[1:], len(found)]):
                out.append((last[0], int(found["segment"][a]), last[1], int(found["start"][a]), int(found["start"][b - 1]) + 1))
        return _batch(out, _NAMES[:5], _TYPES[:5])

    for batch in batches:
        for *key, digests, places in zip(*(batch.column(c).to_pylist() for c in ("anchor", "kind", "range", "digests", "places"))):
            if key != last and runs:
                yield merged()
                runs = []
            last = key
            runs.append((digests, places))
    if runs:
        yield merged()


def repeated_places(texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(row, places: array<struct<kind, begin, end>>): where in texts (row, text; stored by row) strings of lengths[kind] start that also start elsewhere."""
    lengths = tuple(lengths)
    least = min(lengths)
    found = C.written(C.mapped(texts, _anchor_rows, "anchor long, segment long, row long, start long, starts int, size int", lengths=lengths), "anchors")
    again = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    again = C.written(again, "again")  # a plain table, so that a hot anchor's rows can be split
    candidates = C.written(found.join(again, "anchor", "left_semi"), "candidates")
    # how often each segment and how many different segments of each anchor there are; any place of a segment will do to cut it
    counted = C.written(candidates.groupBy("anchor", "segment").agg(F.count("*").alias("times"), F.min("row").alias("row"), F.min_by("start", "row").alias("start"), F.min("starts").alias("starts"), F.min("size").alias("size")), "segments")
    C.drop(found, again)
    several = C.written(counted.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "several")
    cuts = counted.join(several, "anchor").groupBy("row").agg(F.collect_list(F.struct("anchor", "segment", "n", "start", "starts", "size")).alias("cuts"))
    cut = C.mapped(texts.join(cuts.hint("shuffle_hash"), "row"), _cut, "anchor long, segment long, n long, starts int, text binary")
    salt = F.when(F.col("n") > SHARD_SEGMENTS, F.pmod("segment", F.ceil(F.col("n") / SHARD_SEGMENTS))).otherwise(-1)
    shards = cut.withColumn("shard", salt).repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "segment")
    parts = C.written(shards.mapInArrow(lambda it: _shard(it, lengths), _PART), "parts")
    runs = parts.where("digests is not null").select("anchor", "kind", "range", "digests", "places").repartition("anchor", "kind", "range").sortWithinPartitions("anchor", "kind", "range")
    merged = runs.mapInArrow(_merge, "anchor long, segment long, kind int, begin int, end int")
    whole = counted.where("times > 1").select("anchor", "segment", F.posexplode(F.array(*[F.least(F.col("starts"), F.col("size") - n + 1) for n in lengths])).alias("kind", "end"))
    whole = whole.where("`end` > 0").select("anchor", "segment", "kind", F.lit(0).alias("begin"), "end")
    ranges = C.written(whole.union(parts.where("digests is null").select(*_NAMES[:5])).union(merged), "ranges")
    C.drop(several, counted, parts)
    place = F.struct("kind", (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("end")).alias("end"))
    out = C.written(candidates.join(ranges, ["anchor", "segment"]).groupBy("row").agg(F.sort_array(F.collect_list(place)).alias("places")), "places")
    C.drop(candidates, ranges)
    return out


def covered(batch: pa.RecordBatch, lengths: tuple[int, ...]) -> list[list[list[tuple[int, int]]]]:
    """For each row and length the maximal runs of bytes under repeated strings; places come sorted by kind and begin."""
    lists = batch.column("places")
    flat = lists.flatten()
    kind, begin, end = (np.asarray(flat.field(k)).astype(np.int64) for k in ("kind", "begin", "end"))
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    group = np.repeat(np.arange(batch.num_rows), sizes) * len(lengths) + kind
    end = end + np.array(lengths, np.int64)[kind] - 1
    apart = int(end.max(initial=0)) + 2  # so that no run goes on in the next group
    reach = np.maximum.accumulate(end + group * apart) if len(end) else end
    first = np.flatnonzero(np.concatenate(([True], (begin + group * apart)[1:] > reach[:-1]))) if len(end) else np.zeros(0, np.int64)
    stop = reach[np.concatenate((first[1:], [len(end)])) - 1] if len(end) else end
    out: list[list[list[tuple[int, int]]]] = [[[] for _ in lengths] for _ in range(batch.num_rows)]
    for g, a, b in zip(group[first].tolist(), begin[first].tolist(), (stop - group[first] * apart).tolist()):
        out[g // len(lengths)][g % len(lengths)].append((a, b))
    return out


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    at = [0, *[x for r in runs for x in r], len(text)]
    return b"".join(text[a:b] for a, b in zip(at[::2], at[1::2]))


def _texts_left(batch: pa.RecordBatch, text: str, length: int):
    """The rows with what is left of their texts; bytes of characters that were cut go too, and null stays null."""
    left = [kept(t, runs).decode("utf-8", "ignore") if ok else None for t, (runs,), ok in zip(C.texts_of(batch, text), covered(batch, (length,)), batch.column(text).is_valid().to_pylist())]
    names = [c for c in batch.schema.names if c not in ("row", "places")]
    yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if c == text else batch.column(c) for c in names], names)


def _figures(batch: pa.RecordBatch, lengths: tuple[int, ...]):
    """What is removed of each row, and the bytes under repeated strings of the second length."""
    out = []
    for doc_id, text, (runs, *others) in zip(batch.column("doc_id").to_pylist(), C.texts_of(batch), covered(batch, lengths)):
        more = [sum(b - a for a, b in other) for other in others]
        out.append((doc_id, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept(text, runs)).hexdigest(), *more))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *[f"n_repeated_{n}" for n in lengths[1:]]]
    yield _batch(out, names, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * (len(lengths) - 1)])


def suffix_dedup(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs (all columns) with each byte removed from text that a string of `length` bytes covers which also starts elsewhere."""
    C.tune(docs.sparkSession)
    rows = C.stored(docs, "documents")
    text = f"c{docs.columns.index('text')}"
    places = repeated_places(rows.select("row", F.col(text).cast("string").alias("text")), (length,))
    schema = StructType([f for f in rows.schema if f.name != "row"])
    return C.mapped(rows.join(places.hint("shuffle_hash"), "row", "left"), _texts_left, schema, text=text, length=length).toDF(*docs.columns)


def removed_bytes(docs: DataFrame, length: int = 400, also: int = 256) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_<also>) of each row of docs (doc_id, text): what suffix_dedup removes, and the bytes under repeated strings of `also` bytes (50 short words and spaces), which stay."""
    C.tune(docs.sparkSession)
    rows = C.stored(C.with_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")), "documents").toDF("doc_id", "text", "row")
    lengths = (length, also) if also else (length,)
    places = repeated_places(rows.select("row", "text"), lengths)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", n_repeated_{n} long" for n in lengths[1:])
    return C.mapped(rows.join(places.hint("shuffle_hash"), "row", "left"), _figures, schema, lengths=lengths)


def op4_suffix_dedup(spark, sf_dir: str, length: int = 400) -> DataFrame:
    return removed_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), length)
