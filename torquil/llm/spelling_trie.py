"""Spelling variants by a trie of letter-group counts.

A word's vector counts its letters by group (a letter with its accented forms; all else together). The words stand in a
trie by successive counts. From each word a depth-first search walks the trie with a budget of one letter more and one
letter less than its own counts, since two words that differ by one letter differ in their counts by no more; the words
at the leaves it reaches are verified letter by letter. A pair is searched from its shorter word, or from the smaller
of two equally long ones, so the trie's first level is the count of all letters: as many, or one more, which leaves no
letter less.

The trie is spread over tasks: its top, down to nodes of SHARD words, is counted level by level in Spark and walked first;
each word is sent to the subtrees it may reach, and the search goes on in there. A leaf with more words than SHARD
(very many words with the same letters) is dealt into blocks of words and of searching words, each pair of blocks a
task. Occurrences are counted in tasks before the shuffle, and roots are found by pointer jumping: counts at least double
along a chain of forms, so there are few rounds.

Results for odd input: null and empty texts have no words; a null doc_id counts as an empty one; rows that share an id
count each; words of any length count; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from torquil.llm import common as C

#: Fewest code points and occurrences of a word; occurrences that one in DAMAGED makes are spelled with a letter less.
SHORTEST, FEWEST, DAMAGED = 5, 3, 97
#: A form has at least so many times its variant's occurrences.
FACTOR = 2
#: Words of a subtree that a task searches, and words that a task counts or walks with at once.
SHARD, HELD = 4000, 100_000
#: Code points of a text after which a task gives its counts away.
LONG = 1 << 22
#: Nodes with no more words than this aren't divided further: their words are compared with the vector itself.
FEW = 16
#: Words up to this length are verified many at a time.
WIDE = 64

#: Letters in the order of the trie's levels, frequent ones first; all others are the last level.
LEVELS = "etaoinsrhldcumfpgwybvkxjqz"
#: Of all letters, which is the trie's first level, and of each group.
N = len(LEVELS) + 2
_GROUP = np.array([i + 1 if (i := LEVELS.find(unicodedata.normalize("NFKD", chr(b))[0].lower())) >= 0 else N - 1 for b in range(256)])
#: A-Z in lower case, the other letters as they are, all else as white space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def vectors(words: list[bytes]) -> np.ndarray:
    """Counts of all letters and by group of words in Latin-1."""
    sizes = np.array([len(w) for w in words], np.int64)
    letters = _GROUP[np.frombuffer(b"".join(words), np.uint8)]
    out = np.bincount(np.repeat(np.arange(len(words)), sizes) * N + letters, minlength=len(words) * N).reshape(-1, N).astype(np.int32)
    out[:, 0] = sizes
    return out


def occurrences(doc_id, text: str | None, out: dict[bytes, int]) -> None:
    """Adds the counts of a text's words in Latin-1, damaged ones as they are spelled then."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # what Latin-1 lacks becomes a question mark, which is no letter
    for run, n in Counter((text or "").encode("latin-1", "replace").translate(_LETTERS).split()).items():
        if len(run) >= SHORTEST:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % DAMAGED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < SHORTEST:
                    continue
            out[run] = out.get(run, 0) + n


def _counted(batches):
    held: dict[bytes, int] = {}

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            occurrences(doc_id, text, held)
            if len(held) >= HELD or text and len(text) >= LONG:
                yield flush()
                held = {}
    if held:
        yield flush()


def _with_vectors(batches):
    for batch in batches:
        if batch.num_rows:
            v = vectors([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), N).cast(pa.list_(pa.int32()))], [*batch.schema.names, "counts"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n, counts), written: the words of docs (doc_id, text) that occur FEWEST times or more."""
    counts = C.with_text(docs, "doc_id").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)
    return C.written(counts.mapInArrow(_with_vectors, "word string, n long, counts array<int>"), "words")


def top_of_trie(words: DataFrame, shard: int) -> tuple[list, list[int]]:
    """The top of the trie as nested lists of (least count, largest count, child), a child being a node or a subtree's number, and of each subtree the number of its blocks.

    A node of more than `shard` words is divided by its next level; of its children, neighbours are put together while
    they have no more words than that. What comes to the driver is a row for each child of a divided node.
    """
    spark = words.sparkSession
    total = words.count()
    blocks: list[int] = []

    def subtree(n: int) -> int:
        blocks.append(-(-n // shard))
        return len(blocks) - 1

    root: list = []
    open_nodes = {"": root} if total > shard else {}
    if not open_nodes:
        root.append((0, 1 << 31, subtree(max(total, 1))))
    for level in range(N):
        if not open_nodes:
            break
        path = lambda k: F.array_join(F.slice("counts", 1, k), ",") if k else F.lit("")
        listed = spark.createDataFrame([(p,) for p in open_nodes], "path string")
        at = words.select(path(level).alias("path"), F.col("counts")[level].alias("count")).join(C.if_small(listed), "path").groupBy("path", "count").agg(F.count("*").alias("n"))
        deeper: dict[str, list] = {}
        group: list = []
        for r in [*at.orderBy("path", "count").toLocalIterator(), None]:
            large = r is not None and r.n > shard
            if group and (r is None or large or r.path != group[0] or group[3] + r.n > shard):
                open_nodes[group[0]].append((group[1], group[2], subtree(group[3])))
                group = []
            if large and level + 1 < N:
                child: list = []
                open_nodes[r.path].append((r["count"], r["count"], child))
                deeper[f"{r.path},{r['count']}" if level else str(r["count"])] = child
            elif large:
                open_nodes[r.path].append((r["count"], r["count"], subtree(r.n)))
            elif r is not None:
                group = [r.path, group[1] if group else r["count"], r["count"], r.n + (group[3] if group else 0)]
        open_nodes = deeper
    return root, blocks


def reached(top: list, counts: np.ndarray):
    """(subtree, words that may reach it, whether it is their own) for every subtree that some of the words reach."""

    def walk(node, level, at, more, less, own):
        for low, high, child in node:
            have = counts[at, level]
            gain, loss = low > have, high < have
            inside = own & ~gain & ~loss
            if level == 0:  # of all letters: as many or, which leaves none less, one more
                ok, gain, loss = ~((low > have + 1) | loss), loss, gain
            else:
                ok = ~((low > have + 1) | (high < have - 1) | (gain & more) | (loss & less))
            if not ok.any():
                continue
            inside = inside[ok]
            if isinstance(child, list):
                yield from walk(child, level + 1, at[ok], (more | gain)[ok], (less | loss)[ok], inside)
            else:
                yield child, at[ok], inside

    every = np.arange(len(counts))
    none = np.zeros(len(counts), bool)
    yield from walk(top, 0, every, none, none, ~none)


def _sent(batches, top: list, blocks: list[int]):
    """(subtree, block, part, searching, word, n): words to the block they stand in, for each part of searching words, and searching words to all blocks, in their part."""
    held: list = []

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        counts = table.column("counts").combine_chunks().flatten().to_numpy().reshape(-1, N)
        plain = table.select(["word", "n"])
        hashes = np.array([zlib.crc32(w.encode()) for w in table.column("word").to_pylist()], np.int64) if max(blocks) > 1 else np.zeros(table.num_rows, np.int64)
        for subtree, at, own in reached(top, counts):
            b = blocks[subtree]
            for searching, rows in ((False, at[own]), (True, at)):
                one, all_ = np.repeat(hashes[rows] % b, b), np.tile(np.arange(b), len(rows))
                rows = np.repeat(rows, b)
                if len(rows):
                    block, part = (all_, one) if searching else (one, all_)
                    out = plain.take(pa.array(rows)).combine_chunks()
                    columns = [pa.array(np.full(len(rows), subtree, np.int32)), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array(np.full(len(rows), searching)), *(c.combine_chunks() for c in out.columns)]
                    yield pa.RecordBatch.from_arrays(columns, ["subtree", "block", "part", "searching", "word", "n"])

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def differ_by_one(a: bytes, b: bytes) -> bool:
    """Whether b is a with one letter put in or replaced."""
    if len(b) - len(a) not in (0, 1) or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _padded(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w[:width].ljust(width + 1, b"\0") for w in words), np.uint8).reshape(-1, width + 1)


def _verified(a: list[bytes], b: list[bytes], wide_a: np.ndarray, wide_b: np.ndarray, i: np.ndarray, j: np.ndarray, gap: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Which pairs (i of a, j of b, which has `gap` letters more, 0 or 1) differ by one letter."""
    x, y = wide_a[i], wide_b[j]
    same = x == y
    ok = np.count_nonzero(same, axis=1) == same.shape[1] - 1
    more = np.flatnonzero(gap)
    first = np.argmin(same[more], axis=1)
    ok[more] = ((x[more, :-1] == y[more, 1:]) | (np.arange(x.shape[1] - 1) < first[:, None])).all(1)
    for k in np.flatnonzero(long):
        ok[k] = differ_by_one(a[i[k]], b[j[k]])
    return ok


def _spent(d: np.ndarray, level: int, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which of the searches go on at a node with d letters more, and which have spent the letter more and the letter less."""
    if level == 0:  # of all letters: as many or, which leaves none less, one more
        return (d == 0) | (d == 1), more, less | (d == 1)
    return (d == 0) | (d == 1) & ~more | (d == -1) & ~less, more | (d == 1), less | (d == -1)


def found(searching: list[bytes], words: list[bytes]):
    """(i, j) arrays of the searching words' places and those of the words that differ by one letter, each pair from its shorter or smaller word."""
    counts, own = vectors(words), vectors(searching)
    order = np.lexsort(counts.T[::-1])
    words = [words[x] for x in order]
    counts = counts[order]
    size_s, size_w = own[:, 0], counts[:, 0]
    width = int(min(WIDE, size_w.max()))
    wide_s, wide_w = _padded(searching, width), _padded(words, width)
    kind = f"S{width + 1}"
    rank = np.unique(np.concatenate([wide_s.view(kind).ravel(), wide_w.view(kind).ravel()]), return_inverse=True)[1]
    rank_s, rank_w = rank[: len(searching)], rank[len(searching) :]
    if max(own.max(), counts.max()) < 100:
        counts, own = counts.astype(np.int8), own.astype(np.int8)

    def leaf(level, low, high, at, more, less):
        step = max(1, (1 << 18) // (high - low))
        for a in range(0, len(at), step):
            some = at[a : a + step]
            # of two equally long words the smaller one searches; cut ones are told apart when verified
            ok = (size_w[low:high] > size_s[some, None]) | (rank_w[low:high] >= rank_s[some, None])
            for k in range(level, N, 9):  # most differ in the next groups already
                i, j = np.nonzero(ok)
                ok[i, j] = np.count_nonzero(counts[j + low, k : k + 9] != own[some[i], k : k + 9], axis=1) <= 2
            i, j = np.nonzero(ok)
            if level < N:
                d = counts[j + low, level:] - own[some[i], level:]
                fits = (np.maximum(d, 0).sum(1) + more[a + i] <= 1) & (np.maximum(-d, 0).sum(1) + less[a + i] <= 1)
                i, j = i[fits], j[fits]
            i, j = some[i], j + low
            gap = size_w[j] - size_s[i]
            for c in range(0, len(i), 1 << 16):
                cut = slice(c, c + (1 << 16))
                ok = _verified(searching, words, wide_s, wide_w, i[cut], j[cut], gap[cut], size_w[j[cut]] > width)
                x, y = i[cut][ok], j[cut][ok]
                real = np.array([len(searching[p]) < len(words[q]) or searching[p] < words[q] for p, q in zip(x, y)], bool)
                yield x[real], order[y[real]]

    def walk(level, low, high, at, more, less):
        while level == 0 or level < N and high - low > FEW:
            column = counts[low:high, level]
            if column[0] != column[-1]:
                break
            ok, more, less = _spent(column[0] - own[at, level], level, more, less)
            at, more, less, level = at[ok], more[ok], less[ok], level + 1
        if not len(at):
            return
        if level == N or level > 0 and high - low <= FEW:
            yield from leaf(level, low, high, at, more, less)
            return
        values, first = np.unique(column, return_index=True)
        for value, a, b in zip(values, first, np.append(first[1:], high - low)):
            ok, m, l_ = _spent(value - own[at, level], level, more, less)
            if ok.any():
                yield from walk(level + 1, low + a, low + b, at[ok], m[ok], l_[ok])

    none = np.zeros(len(searching), bool)
    yield from walk(0, 0, len(words), np.arange(len(searching)), none, none)


_NEAR = "word string, near string, near_n long"


def _searched(rows: pa.Table) -> pa.Table:
    """Both ways of each pair found in one part of one block."""
    mask = rows.column("searching").to_numpy()
    names, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    sides = [np.flatnonzero(mask), np.flatnonzero(~mask)]
    searching, words = ([names[x].encode("latin-1") for x in side] for side in sides)
    pairs = [(sides[0][i], sides[1][j]) for i, j in found(searching, words)] if searching and words else []
    a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    one, other = np.concatenate([a, b]), np.concatenate([b, a])
    text = pa.array(names, pa.string())
    return pa.table({"word": text.take(pa.array(one)), "near": text.take(pa.array(other)), "near_n": pa.array(n[other])})


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, near, near_n): both ways of every pair of words (word, n, counts) that differ by one letter."""
    top, blocks = top_of_trie(words, shard)
    sent = words.mapInArrow(lambda batches: _sent(batches, top, blocks), "subtree int, block int, part int, searching boolean, word string, n long")
    return sent.groupBy("subtree", "block", "part").applyInArrow(_searched, _NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root), written: the last form of each word of forms (word, form)."""
    out = C.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = out.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = C.written(out.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        C.drop(out)
        out = moved
        if not out.where("moved").take(1):
            return out.drop("moved")


def spelling_variants(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs (doc_id, text)."""
    C.tune(docs.sparkSession)
    words = vocabulary(docs)
    near = near_words(words, shard).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    known = words.select("word", "n").join(near, "word", "left")
    has = -F.col("best.minus") >= FACTOR * F.col("n")
    known = known.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.minus")).alias("form_n"))
    known = C.written(known, "variants")
    C.drop(words)
    ends = roots(known.where("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_trie(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
