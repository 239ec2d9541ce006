"""Packing by power-of-two decomposition: every sequence is one piece of one document and a power of two long.

A document's ids are cut into pieces of 2048 while they last and then of the binary digits of the rest, longest
first. Pieces of one length form a bucket; sequences are numbered bucket by bucket, longest first, so a batch can
be drawn from one bucket with no padding and no sequence crosses documents.

Results for odd input: a null or empty text is the end id alone, one piece of length 1; rows that share an id are
packed apart; a null id stays null; other columns are left alone; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from torquil.llm import common as C

VOCABULARY = "word_bpe_49k.json"
END = 1
LONGEST = 2048
#: Texts of these characters are split at white space and lower-cased as the tokenizer does it; it does all others itself.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ɏ]*", re.S)
#: The tokenizer's splitting of a word of these characters, and the characters by which it writes bytes.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = dict(zip([b for b in range(256) if b not in _SHOWN], map(chr, range(256, 512))))
#: Entries of each generation of a cache; the older generation is forgotten when the younger is full.
CACHE = 250_000


class Kept(dict):
    """What a function made of strings; its memory is bounded, and strings in use stay."""

    def __init__(self, function):
        super().__init__()
        self.function, self.older = function, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= CACHE:
            self.older = self.copy()
            self.clear()
        out = self.older.get(key)
        if out is None:
            out = self.function(key)
        self[key] = out
        return out


class Encoder:
    """Ids of texts; a word between white space always has the same ids, so most are looked up."""

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        assert self.tokenizer.get_vocab_size() < 1 << 16
        self.model = self.tokenizer.model
        self.pieces = Kept(self._piece)
        self.words = Kept(self._word)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def _piece(self, piece: str) -> bytes:
        """Ids of what the tokenizer's own splitting leaves whole."""
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        return self._piece(word) if word.isalpha() else b"".join(map(self.pieces.__getitem__, _PIECE.findall(word)))

    def forget(self) -> None:
        for kept in (self.pieces, self.words):
            kept.clear()
            kept.older = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        get, out = self.words.__getitem__, []
        for t in texts:
            plain = _PLAIN.fullmatch(t) and "oftext|>" not in t
            out.append(np.frombuffer(b"".join(map(get, t.lower().split())), np.uint16) if plain else self._whole(t))
        return out


@functools.cache
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """n as powers of two up to the longest, largest first."""
    return [longest] * (n // longest) + [1 << i for i in reversed(range(longest.bit_length())) if n % longest >> i & 1]


def _pieces(batches, vocabulary: str, longest: int, with_ids: bool):
    part, seen = TaskContext.get().partitionId(), [0] * (longest.bit_length() + 1)
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        for a in range(0, len(ids), 200):
            rows = []
            for doc_id, tokens in zip(ids[a : a + 200], encoder(vocabulary)(texts[a : a + 200])):
                data = np.append(tokens, END).astype("<u4")
                start = 0
                for size in piece_lengths(len(data), longest):
                    piece = data[start : start + size]
                    k = size.bit_length()
                    rows.append((doc_id, start, size, zlib.crc32(piece.tobytes()), len(data), part, seen[k], piece.tobytes() if with_ids else None))
                    seen[k] += 1
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary() if i == 7 else pa.int64()) for i in range(8)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth", "ids"])
    encoder(vocabulary).forget()  # the worker goes on to other operators


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, longest: int = LONGEST, with_ids: bool = False) -> DataFrame:
    """A row for each piece of docs (doc_id, text) with its sequence; with_ids adds its ids as little-endian 32-bit integers."""
    C.tune(docs.sparkSession)
    plain = C.with_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long, ids binary"
    # written once: the numbers below count rows per task and must not see another attempt's tasks
    pieces = C.written(plain.mapInArrow(lambda it: _pieces(it, vocabulary, longest, with_ids), schema), "pieces")
    tasks = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = tasks.groupBy("length").agg(F.sum("n").alias("n"))
    buckets = buckets.select("length", before(Window.orderBy(F.desc("length"))).alias("bucket"))  # one row for each power of two
    tasks = tasks.select("length", "part", before(Window.partitionBy("length").orderBy("part")).alias("task"))
    tasks = C.written(tasks.join(F.broadcast(buckets), "length"), "tasks")
    out = pieces.join(C.if_small(tasks), ["length", "part"]).withColumn("sequence_id", F.expr("bucket + task + nth")).withColumn("offset", F.lit(0).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
