"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice; lossless decoding.

Forward, each place in a text gets the summed weight of all segmentations that lead to it; backward, pieces are
drawn from the end in proportion to what leads to them, so whole segmentations are drawn by their weights. Draws
depend on the row key, the word's number and the step alone, so any partitioning gives the same pieces. No piece
spans a space that follows other characters, so lattices are made for the distinct words of some texts at a time,
and all their words are sampled side by side.

A piece's weight is 1 / (rank + SHIFT) ** sharpness; characters without a piece are written as bytes, and so is a
text's own U+2581, which stands for a space in pieces. Results for odd input: null and empty texts have no pieces;
rows that share an id and text are sampled alike; a null id is the key 0; other columns are left alone.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from torquil.llm import common as C

MODEL = "piece_bpe_32k.model"
SHIFT, SHARPNESS = 8.0, 3.0
SPACE = "▁"
#: Codes from here on are characters to be written as bytes.
BYTES = 1 << 20
#: A word that is the text's own U+2581; other words have it at their start only.
OWN = "\n" + SPACE
#: Texts sampled side by side.
ROWS = 250
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Sampler:
    def __init__(self, model: str, sharpness: float):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
        size = sp.get_piece_size()
        usual = [i for i in range(size) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        rank = {i: min(-sp.get_score(i), size) if sp.get_score(i) > -1e8 else size for i in usual}
        pieces = {sp.id_to_piece(i): i for i in usual}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("pieces may not span spaces")
        self.byte_weight = -sharpness * np.log(size + SHIFT)
        # by length: sorted hashes of the pieces' beginnings, their codes (-1 if no pieces), log weights, and whether pieces go on
        starts: list[dict[int, list]] = [{} for _ in range(max(map(len, pieces)))]
        for p, i in pieces.items():
            h = 0
            for k, c in enumerate(p):
                h = (h * int(C.M1) + ord(c) + 1) & (1 << 64) - 1
                entry = starts[k].setdefault(h, [-1, 0.0, False])
                if k + 1 == len(p):
                    entry[0], entry[1] = i, -sharpness * np.log(rank[i] + SHIFT)
                else:
                    entry[2] = True
        self.tables = []
        for t in starts:
            keys = np.array(sorted(t), np.uint64)
            self.tables.append((keys, *(np.array([t[int(k)][x] for k in keys], kind) for x, kind in enumerate((np.int64, np.float64, bool)))))
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b""] * size
        for p, i in pieces.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])

    def lattices(self, words: list[str]):
        """Of the words' places, one after another: first edge and number of edges. Of each edge: the place before it, its code and its summed chance.

        The edges of a place stand together. Forward filtering goes over all words at once, by the place in the word.
        """
        own = np.array([w == OWN for w in words])
        chars = np.frombuffer("".join([SPACE if w == OWN else w for w in words]).encode("utf-32-le"), np.uint32)
        sizes = np.array([1 if w == OWN else len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        last, local = ends[word], np.arange(len(chars)) - (ends - sizes)[word]
        values = chars.astype(np.uint64) + np.uint64(1)
        i, h, found = np.flatnonzero(~own[word]), np.zeros(int((~own[word]).sum()), np.uint64), []
        plain = np.zeros(len(chars), bool)
        for size, (keys, codes, weights, more) in enumerate(self.tables, 1):
            h = h * C.M1 + values[i + size - 1]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            ok = keys[k] == h
            i, h, k = i[ok], h[ok], k[ok]
            hit = codes[k] >= 0
            found.append((i[hit], np.full(int(hit.sum()), size), codes[k[hit]], weights[k[hit]]))
            if size == 1:
                plain[i[hit]] = True
            on = more[k] & (i + size < last[i])
            i, h = i[on], h[on]
            if not len(i):
                break
        rest = np.flatnonzero(~plain)
        found.append((rest, np.ones(len(rest), np.int64), BYTES + chars[rest].astype(np.int64), np.full(len(rest), self.byte_weight)))
        i, size, code, weight = (np.concatenate(x) for x in zip(*found))
        reached = local[i] + size
        order = np.lexsort((i, word[i], reached))
        i, size, code, weight, reached = i[order], size[order], code[order], weight[order], reached[order]
        before = i + word[i]  # a word has a place more than characters
        at = before + size
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        first, edges = np.zeros(len(chars) + len(words), np.int64), np.zeros(len(chars) + len(words), np.int64)
        edges[at[new]] = np.diff(np.concatenate((new, [len(at)])))
        first[at[new]] = new
        chance, alpha = np.empty(len(at)), np.zeros(len(first))
        cuts = np.searchsorted(reached[new], np.arange(1, int(reached[-1]) + 2))  # of the places, by their number in the word
        bounds = np.concatenate((new, [len(at)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            x, y = bounds[a], bounds[b]
            by = new[a:b] - x
            times = np.diff(bounds[a : b + 1])
            logs = alpha[before[x:y]] + weight[x:y]
            top = np.maximum.reduceat(logs, by)
            e = np.exp(logs - np.repeat(top, times))
            total = np.add.reduceat(e, by)
            alpha[at[new[a:b]]] = top + np.log(total)
            run = np.cumsum((e / np.repeat(total, times) * 2.0**40).astype(np.int64))  # exact, whatever else is in the batch
            chance[x:y] = (run - np.repeat(np.concatenate(([0], run[by[1:] - 1])), times)) * 2.0**-40
        chance[bounds[1:] - 1] = 2.0  # no draw gets past the last edge
        return sizes + 1, first, edges, before, code, chance

    def words(self, text: str) -> list[str]:
        """Words to segment; the text's own U+2581 is a word of its own, marked by a leading newline."""
        out: list[str] = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(OWN)
            out += _WORD.findall((SPACE if not k else "") + part.replace(" ", SPACE))
        return out

    def __call__(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Sampled ids of each text."""
        lists = [self.words(t) if t else [] for t in texts]
        sizes = np.array([len(x) for x in lists], np.int64)
        if not sizes.sum():
            return [np.zeros(0, np.int32) for _ in texts]
        number: dict[str, int] = {}
        which = np.array([number.setdefault(w, len(number)) for x in lists for w in x], np.int64)
        places, first, edges, before, codes, chance = self.lattices(list(number))
        base = np.cumsum(places) - places
        # of each occurrence of a word: a seed from its row and its number in the row
        row = np.repeat(np.arange(len(texts)), sizes)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seeds = C.mix(C.mix(np.array(keys, np.int64).view(np.uint64) + C.M1)[row] + nth.astype(np.uint64) * C.M2)
        at, live = base[which] + places[which] - 1, np.arange(len(which))
        steps = []
        for step in itertools.count():
            if not len(live):
                break
            u = (C.mix(seeds[live] + np.array([step], np.uint64) * C.M1) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            here = at[live]
            edge = first[here].copy()
            wide = edges[here] > 1
            k = np.flatnonzero(wide)
            while len(k):  # the first edge whose summed chance exceeds the draw
                k = k[chance[edge[k]] <= u[k]]
                edge[k] += 1
            steps.append((live, codes[edge]))
            at[live] = before[edge]
            live = live[at[live] != base[which[live]]]
        counts = np.zeros(len(which), np.int64)
        for o, _ in steps:
            counts[o] += 1
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]), np.int64)
        for step, (o, code) in enumerate(steps):
            out[ends[o] - 1 - step] = code
        owner = np.repeat(row, counts)
        if (out >= BYTES).any():
            out, owner = self._as_bytes(out, owner)
        cuts = np.searchsorted(owner, np.arange(1, len(texts)))
        return np.split(out.astype(np.int32), cuts)

    def _as_bytes(self, codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(codes >= BYTES)
        spelled = [[self.byte_ids[b] for b in chr(c - BYTES).encode()] for c in codes[at].tolist()]
        times = np.ones(len(codes), np.int64)
        times[at] = [len(s) for s in spelled]
        out, ends = np.repeat(codes, times), np.cumsum(times)
        fill = np.concatenate([np.arange(ends[k] - len(s), ends[k]) for k, s in zip(at, spelled)])
        out[fill] = [b for s in spelled for b in s]
        return out, np.repeat(owner, times)

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; the space put before it goes."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode()[1:]


@functools.cache
def sampler(model: str, sharpness: float) -> Sampler:
    return Sampler(model, sharpness)


def _encode(batch: pa.RecordBatch, model: str, sharpness: float, digest: bool):
    s = sampler(model, sharpness)
    keys, texts = [k or 0 for k in batch.column("doc_id").to_pylist()], [t or "" for t in batch.column("text").to_pylist()]
    for a in range(0, len(texts), ROWS):
        part = texts[a : a + ROWS]
        ids = s(keys[a : a + ROWS], part)
        column = batch.column("doc_id").slice(a, ROWS)
        n = pa.array([len(i) for i in ids], pa.int64())
        if digest:
            crc = pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([column, n, crc, pa.array([s.decode(i) == t for i, t in zip(ids, part)])], ["doc_id", "n_pieces", "ids_crc32", "lossless"])
        else:
            yield pa.RecordBatch.from_arrays([column, n, pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_pieces", "ids"])


def _decode(batch: pa.RecordBatch, model: str, sharpness: float):
    s = sampler(model, sharpness)
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.decode(np.array(i or [], np.int32)) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])


def encode(docs: DataFrame, model: str = MODEL, sharpness: float = SHARPNESS, digest: bool = False) -> DataFrame:
    """(doc_id, n_pieces, ids) of each row of docs (doc_id, text); with digest the ids' CRC and whether they decode to the text."""
    C.tune(docs.sparkSession)
    plain = C.with_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, n_pieces long, " + ("ids_crc32 long, lossless boolean" if digest else "ids array<int>")
    return C.mapped(plain, _encode, schema, model=model, sharpness=sharpness, digest=digest)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""
    return C.mapped(rows.select("doc_id", "ids"), _decode, "doc_id long, text string", model=model, sharpness=SHARPNESS)


def op7_sample_pieces(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
