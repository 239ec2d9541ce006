"""Brown class-based n-grams: exchange clustering, class transitions, word emissions, and scores of all texts.

Words are counted over all training texts. The HEAD most frequent have numbers; the CLUSTERED most frequent of
these are assigned to CLASSES classes by exchange: each pass over the texts counts every word's neighbouring
classes, and words go to the class that raises the likelihood of the class bigrams most. Every other training word
then goes to the class in which its tokens are likeliest among their neighbours: numbered words first, then all
others, whose neighbours and classes stay in tables and come to the texts by shuffled joins. So each word of the
training texts has a class, however many there are; what is collected or broadcast is bounded by HEAD and
CLUSTERED * CLASSES.

A token's probability is that of its class after the class before it, times that of the word in its class; the end
of a text is a class of its own. Each class leaves to unseen words the share that words seen once hold in it; the
word after an unseen one follows the classes by those shares.

Results for odd input: null and empty texts are the end alone; a null id counts as an empty one (held out); rows
that share an id are scored apart; with nothing to learn from, all words are unseen; other columns are left alone.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from torquil.llm import common as C

HEAD, CLUSTERED, CLASSES, SWEEPS = 60_000, 4096, 64, 2
END_WORD, RARE, HELD = b"\n", 0xFFFF, 0xFFFF
#: Weight of the class frequencies in the transitions.
ALPHA = 5.0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _counts(batches):
    """Counts of training words, summed over some batches so that they stay in bounds."""
    seen: Counter = Counter()

    def sent():
        return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), C.texts_of(batch)):
            if not held_out(doc_id):
                seen.update(tokens(text))
                seen[END_WORD] += 1
        if len(seen) > 300_000:
            yield sent()
            seen = Counter()
    yield sent()


def _encoded(batches, words):
    """Texts as 16-bit word numbers with the end (0), and their rare words."""
    head = words.value
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts = C.texts_of(batch)
        for a in range(0, len(ids), 200):
            out, get = [], head.get
            for doc_id, text in zip(ids[a : a + 200], texts[a : a + 200]):
                ws = tokens(text)
                numbers = np.array([*[get(w, RARE) for w in ws], 0], np.uint16)
                out.append(((part << 33) + row, doc_id, held_out(doc_id), len(numbers), numbers.tobytes(), [ws[i] for i in np.flatnonzero(numbers == RARE)]))
                row += 1
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], ["row", "doc_id", "held_out", "n_tokens", "ids", "rare"])


def _neighbours(batches, classes: np.ndarray, kinds: int, first: int, step: int):
    """Of the clustered words first, first + step, ...: how often each class stands before and after; and the class bigrams, as word -1."""
    moved = np.full(1 << 16, -1, np.int64)
    chosen = np.arange(1 + first, CLUSTERED + 1, step) if step else np.zeros(0, np.int64)
    moved[chosen] = np.arange(len(chosen))
    before, after, both = np.zeros(len(chosen) * kinds, np.int64), np.zeros(len(chosen) * kinds, np.int64), np.zeros(kinds * kinds, np.int64)
    for batch in batches:
        data = batch.column("ids").to_pylist()
        for a in range(0, len(data), 500):
            ids = np.frombuffer(b"".join(data[a : a + 500]), np.uint16)
            c = classes[ids]
            previous = np.concatenate((classes[:1], c[:-1]))  # each text ends with 0, which is also what precedes the next
            both += np.bincount(previous * kinds + c, minlength=kinds * kinds)
            if step:
                m = moved[ids]
                at = np.flatnonzero(m >= 0)
                before += np.bincount(m[at] * kinds + previous[at], minlength=len(before))
                after += np.bincount(m[at] * kinds + c[np.minimum(at + 1, len(c) - 1)], minlength=len(after))
    rows = [(-1, both.tobytes())]
    rows += [(int(w), np.concatenate((x, y)).astype(np.int64).tobytes()) for w, x, y in zip(chosen, before.reshape(-1, kinds), after.reshape(-1, kinds)) if x.any() or y.any()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["word", "counts"])


def _summed(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for w, c in zip(batch.column("word").to_pylist(), batch.column("counts").to_pylist()):
            x = np.frombuffer(c, np.int64)
            total[w] = total[w] + x if w in total else x
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["word", "counts"])


def _count_classes(encoded: DataFrame, classes: np.ndarray, kinds: int, first: int = 0, step: int = 0):
    """Class bigrams, and the neighbours of the chosen words: CLUSTERED rows at most."""
    rows = encoded.where("not held_out").select("ids").mapInArrow(lambda it: _neighbours(it, classes, kinds, first, step), "word int, counts binary")
    found = {r.word: np.frombuffer(r.counts, np.int64) for r in rows.repartition("word").mapInArrow(_summed, "word int, counts binary").collect()}
    return found.pop(-1, np.zeros(kinds * kinds, np.int64)).reshape(kinds, kinds), found


def _other_neighbours(batches, classes: np.ndarray, kinds: int):
    """Of the numbered words that were not clustered: how often each class stands before and after."""
    total = np.zeros((HEAD - CLUSTERED) * 2 * kinds, np.int32)
    for batch in batches:
        data = batch.column("ids").to_pylist()
        for a in range(0, len(data), 500):
            ids = np.frombuffer(b"".join(data[a : a + 500]), np.uint16)
            c = classes[ids]
            at = np.flatnonzero((ids > CLUSTERED) & (ids <= HEAD))
            word = (ids[at].astype(np.int64) - CLUSTERED - 1) * 2 * kinds
            before = np.where(at > 0, c[at - 1], classes[0])
            keys, n = np.unique(np.concatenate((word + before, word + kinds + c[np.minimum(at + 1, len(c) - 1)])), return_counts=True)
            total[keys] += n.astype(np.int32)
    found = total.reshape(-1, 2 * kinds)
    words = np.flatnonzero(found.any(1))
    for a in range(0, len(words), 2000):
        part = words[a : a + 2000]
        yield pa.RecordBatch.from_arrays([pa.array((part + CLUSTERED + 1).astype(np.int32)), pa.array([x.tobytes() for x in found[part].astype(np.int64)], pa.binary())], ["word", "counts"])


def _transitions(both: np.ndarray) -> np.ndarray:
    """Smoothed log10 probabilities of a class after a class."""
    share = (both.sum(0) + 1) / (both.sum() + len(both))
    return np.log10((both + ALPHA * share) / (both.sum(1, keepdims=True) + ALPHA))


def _likeliest(before: np.ndarray, after: np.ndarray, both: np.ndarray, clusters: int) -> np.ndarray:
    """For each word (row) with these neighbours: the class in which its tokens are likeliest."""
    log, size, n = _transitions(both), both.sum(0)[:clusters], before.sum(1, keepdims=True)
    return (before @ log[:, :clusters] + after @ log[:clusters].T - n * np.log10(np.maximum(size + n, 1))).argmax(1).astype(np.int32)


def _assigned(batches, both: np.ndarray, clusters: int):
    """The class in which each word's tokens are likeliest; all counts of a word are in this task."""
    for batch in _summed(batches):
        counts = np.array([np.frombuffer(c, np.int64) for c in batch.column("counts").to_pylist()], float).reshape(-1, 2 * len(both))
        before, after = counts[:, : len(both)], counts[:, len(both) :]
        yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(_likeliest(before, after, both, clusters))], ["word", "class"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _best_class(both: np.ndarray, before: np.ndarray, after: np.ndarray, clusters: int) -> int:
    """Where a word with these neighbours raises the likelihood of the class bigrams most."""
    small = both[:, :clusters]
    i, j = np.flatnonzero(before), np.flatnonzero(after)
    gain = (_f(small[i] + before[i, None]) - _f(small[i])).sum(0)
    small = both[:clusters]
    gain += (_f(small[:, j] + after[j]) - _f(small[:, j])).sum(1)
    rows, columns = both[:clusters].sum(1), both[:, :clusters].sum(0)
    gain -= _f(rows + after.sum()) - _f(rows) + _f(columns + before.sum()) - _f(columns)
    return int(np.argmax(gain))


def exchange(both: np.ndarray, words: dict[int, np.ndarray], classes: np.ndarray, clusters: int) -> None:
    """Moves each word to the class that raises the class bigrams' likelihood most. Changes both and classes."""
    both, kinds = both.astype(float), len(both)
    for w in sorted(words):
        before, after = words[w][:kinds].astype(float), words[w][kinds:].astype(float)
        a = classes[w]
        both[:, a] = np.maximum(both[:, a] - before, 0)
        both[a] = np.maximum(both[a] - after, 0)
        b = _best_class(both, before, after, clusters)
        classes[w] = b
        both[:, b] += before
        both[b] += after


def _places(batches, classes: np.ndarray, kinds: int):
    """(word, row, place) of each token without a number. place: which of its text's it is, then the pair of classes around it (HELD in held-out texts) in 16 bits."""
    for batch in batches:
        ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.uint16)
        at = np.flatnonzero(ids == RARE)
        c = classes[ids]
        pair = np.where(at > 0, c[at - 1], classes[0]) * kinds + c[np.minimum(at + 1, len(c) - 1)]  # an end follows each
        rare = batch.column("rare")
        first = rare.offsets.to_numpy().astype(np.int64) - rare.offsets[0].as_py()
        text = np.repeat(np.arange(batch.num_rows), np.diff(first))
        pair[batch.column("held_out").to_numpy(zero_copy_only=False)[text]] = HELD
        place = (np.arange(len(at)) - first[text] << 16) + pair
        yield pa.RecordBatch.from_arrays([rare.flatten(), pa.array(batch.column("row").to_numpy()[text]), pa.array(place)], ["word", "row", "place"])


def _rare_assigned(word: np.ndarray, pair: np.ndarray, words: int, both: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and the likeliest class of each of `words` words, from the pairs of classes around their training tokens; -1 without any."""
    kinds = len(both)
    n, classes = np.bincount(word, minlength=words), np.full(words, -1, np.int64)
    for a in range(0, words, 2000):
        some = (word >= a) & (word < a + 2000)
        size = min(2000, words - a)
        before = np.bincount((word[some] - a) * kinds + pair[some] // kinds, minlength=size * kinds).reshape(size, kinds).astype(float)
        after = np.bincount((word[some] - a) * kinds + pair[some] % kinds, minlength=size * kinds).reshape(size, kinds).astype(float)
        classes[a : a + size] = _likeliest(before, after, both, clusters)
    classes[n == 0] = -1
    return n, classes


def _resolved(batches, both: np.ndarray, clusters: int, unseen: int, rows: int = 50_000):
    """(row, at, class, n) of each place, sorted by word with training places first. Only a word's training places are held together."""
    held: list[pa.Table] = []
    size, known = 0, (None, 0, 0)

    def resolve(table: pa.Table, last: bool):
        nonlocal known
        words = table.column("word").combine_chunks()
        place = table.column("place").to_numpy()
        fresh = np.concatenate(([True], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
        word = np.cumsum(fresh) - 1
        pair = place & 0xFFFF
        training = pair != HELD
        done = len(word)
        if not last and training[-1]:  # more training places of this word may follow
            done = int(np.flatnonzero(fresh)[-1])
        n_words = int(word[done - 1]) + 1 if done else 0
        w, p, t = word[:done], pair[:done], training[:done]
        n, classes = _rare_assigned(w[t], p[t], n_words, both, clusters)
        if n_words and words[0].as_py() == known[0]:  # held-out places of a word whose training places have gone
            n[0], classes[0] = known[1:]
        if n_words:
            known = (words[done - 1].as_py(), int(n[-1]), int(classes[-1]))
        shown = np.where(classes < 0, unseen, classes)
        yield pa.RecordBatch.from_arrays([pa.array(table.column("row").to_numpy()[:done]), pa.array((place[:done] >> 16).astype(np.int32)), pa.array(shown[w].astype(np.int16)), pa.array(n[w].astype(np.int64))], ["row", "at", "class", "n"])
        return table.slice(done)

    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
        if size >= rows:
            rest = yield from resolve(pa.concat_tables(held).combine_chunks(), False)
            held, size = [rest], 0  # a word's training places are bounded by the last numbered word's
    if sum(t.num_rows for t in held):
        yield from resolve(pa.concat_tables(held).combine_chunks(), True)


def rare_places(encoded: DataFrame, classes: np.ndarray, both: np.ndarray, clusters: int, unseen: int) -> DataFrame:
    """(row, at, class, n) of every place of a word without a number: its class, or `unseen`, and its training tokens.

    The places are shuffled once, by word, and the class is found where a word's places meet. No such word is as frequent
    in training texts as a numbered one, so no key is hot there; held-out places of a word stream by.
    """
    kinds = len(both)
    places = encoded.where("size(rare) > 0").select("row", "held_out", "ids", "rare").mapInArrow(lambda it: _places(it, classes, kinds), "word binary, row long, place long")
    sorted_ = places.repartition("word").sortWithinPartitions("word", F.col("place").bitwiseAND(0xFFFF) == HELD)
    return sorted_.mapInArrow(lambda it: _resolved(it, both.astype(float), clusters, unseen), "row long, at int, class short, n long")


def _classes_of(batch: pa.RecordBatch, classes: np.ndarray):
    """Numbers and classes of a batch's tokens, and the counts of those without a number."""
    ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), np.uint16)
    c = classes[ids]
    c[ids == RARE] = batch.column("rare_class").flatten().to_numpy(zero_copy_only=False)
    return ids, c, np.concatenate((classes[:1], c[:-1])), batch.column("rare_n").flatten().to_numpy(zero_copy_only=False)


def _bigrams(batches, classes: np.ndarray, kinds: int):
    """Counts of class bigrams, then of words seen once by class (numbers from kinds * kinds)."""
    both, single = np.zeros(kinds * kinds, np.int64), np.zeros(kinds, np.int64)
    for batch in batches:
        ids, c, previous, rare_n = _classes_of(batch, classes)
        both += np.bincount(previous * kinds + c, minlength=kinds * kinds)
        single += np.bincount(c[ids == RARE][rare_n == 1], minlength=kinds)
    both = np.concatenate((both, single))
    at = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(both[at])], ["pair", "n"])


def _model(both: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probabilities of classes after classes, with unseen words as one more, and each class' share for unseen words.

    both: class bigrams, the end last; single: words seen once by class.
    """
    size = both.sum(0)
    unseen = np.minimum((single + 1) / (size + 2), 0.5)
    unseen[size == 0] = 1.0
    unseen[-1] = 0.0
    p = 10 ** _transitions(both)
    p = np.hstack((p, (p @ unseen)[:, None]))
    by = unseen * np.maximum(size, 1)
    p = np.vstack((p, by / by.sum() @ p))
    return np.log10(p), unseen


def _scored(batch: pa.RecordBatch, base: np.ndarray, rare_base: tuple[float, float], log_classes: np.ndarray, classes: np.ndarray, emission: np.ndarray, of_class: np.ndarray):
    """Sums over each text."""
    ids, c, previous, rare_n = _classes_of(batch, classes)
    starts = np.concatenate(([0], np.cumsum(batch.column("n_tokens").to_numpy())[:-1]))
    at = np.flatnonzero(ids == RARE)
    known, plain, own = (ids != RARE).astype(np.int64), base[ids], emission[ids]
    known[at] = rare_n > 0
    plain[at] = np.log10(rare_n + rare_base[0]) - rare_base[1]
    own[at] = np.where(rare_n > 0, np.log10(np.maximum(rare_n, 1)) - of_class[c[at]], 0.0)
    sums = [np.add.reduceat(x, starts) for x in (plain, log_classes[previous, c] + own, known)]
    yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "held_out", "n_tokens")), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "base_score", "score", "known"])


def class_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    C.tune(spark)
    docs = C.with_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    counts = C.written(docs.mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    head = [(bytes(r.word), r.n) for r in counts.where(F.col("word") != F.lit(END_WORD)).orderBy(F.desc("n"), "word").limit(HEAD).collect()]
    C.drop(counts)
    words = spark.sparkContext.broadcast({w: i + 1 for i, (w, _) in enumerate(head)})
    encoded = C.written(docs.mapInArrow(lambda it: _encoded(it, words), "row long, doc_id long, held_out boolean, n_tokens long, ids binary, rare array<binary>"), "encoded")
    # classes: clusters, then the end, other numbered words, rare words
    kinds = CLASSES + 3
    classes = np.full(1 << 16, CLASSES + 1, np.int64)
    classes[0], classes[RARE] = CLASSES, CLASSES + 2
    classes[1 : CLUSTERED + 1] = np.arange(CLUSTERED) % CLASSES
    for _ in range(SWEEPS):
        for half in (0, 1):
            exchange(*_count_classes(encoded, classes, kinds, half, 2), classes, CLASSES)
    both, _ = _count_classes(encoded, classes, kinds)
    others = encoded.where("not held_out").select("ids").mapInArrow(lambda it: _other_neighbours(it, classes, kinds), "word int, counts binary")
    others = others.repartition("word").mapInArrow(lambda it: _assigned(it, both.astype(float), CLASSES), "word int, class int").collect()  # HEAD rows at most
    classes[[r.word for r in others]] = [r["class"] for r in others]
    both, _ = _count_classes(encoded, classes, kinds)
    # the end and unseen words come after the clusters; of the former kinds for words without a class none is left
    final, unseen_class = CLASSES + 1, CLASSES + 1
    found = rare_places(encoded, classes, both, CLASSES, unseen_class)
    found = found.repartition("row").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "class", "n"))).alias("found"))
    columns = "row", "doc_id", "held_out", "n_tokens", "ids"
    texts = encoded.select(*columns).join(found, "row", "left")
    texts = C.written(texts.select(*columns, *[F.coalesce(F.col(f"found.{k}"), F.array().cast(f"array<{t}>")).alias(f"rare_{k}") for k, t in (("class", "short"), ("n", "long"))]), "classed")
    C.drop(encoded)
    both = np.zeros(final * final + final, np.int64)
    for r in texts.where("not held_out").mapInArrow(lambda it: _bigrams(it, classes, final), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # a row for each pair of classes
        both[r.pair] = r.n
    both, single = both[: final * final].reshape(final, final), both[final * final :].astype(float)
    n = np.zeros(1 << 16)
    n[1 : len(head) + 1] = [k for _, k in head]
    n[0] = both[:, CLASSES].sum()
    single += np.bincount(classes[1 : len(head) + 1][n[1 : len(head) + 1] == 1], minlength=final)
    log_classes, unseen = _model(both, single)
    # log10 of what a word's count is divided by
    of_class = np.append(np.log10(np.maximum(both.sum(0), 1)) - np.log10(np.where(unseen < 1, 1 - unseen, 1)), 0.0)
    classes = np.where(classes > CLASSES, unseen_class, classes)
    emission = np.log10(np.maximum(n, 1)) - of_class[classes]
    emission[0] = 0.0
    room = np.log10(total.n + 0.1 * (total.v + 1))
    out = C.mapped(texts, _scored, "doc_id long, held_out boolean, n_tokens long, base_score double, score double, known long", base=np.log10(n + 0.1) - room, rare_base=(0.1, float(room)), log_classes=log_classes, classes=classes, emission=emission, of_class=of_class)
    # the end is no known token where there was no training text
    n_known = F.col("known") - F.lit(0 if n[0] else 1)
    return out.select("doc_id", "held_out", "n_tokens", n_known.alias("n_known"), F.lit(int(total.n)).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op1_class_lm(spark, sf_dir: str) -> DataFrame:
    return class_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
