import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from conftest import ODD
from torquil.llm import packing as P


def test_pieces(documents):
    rows = [(1, "Hello, world's 12 dogs'll don't! ÉCOLE naïve x²½ ªº"), (2, "word " * 5000), (3, "<|endoftext|> raw <|startoftext|>"), (4, "Ünïcödé ﬁ Å é ﬁx"), *ODD]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(P.VOCABULARY))
    got = P.pack(documents(rows), with_ids=True).collect()
    want = sorted(str((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    of: dict = {}
    for r in got:
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        of.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    texts = []
    for (i, n), pieces in of.items():
        copies = sum(r.start == 0 for r in pieces)
        pieces = sorted(pieces, key=lambda r: r.start)[::copies]
        ids = np.concatenate([np.frombuffer(bytes(r.ids), "<u4") for r in pieces]).tolist()
        assert len(ids) == n
        texts += [str((i, ids))] * copies
    assert sorted(texts) == want
    numbers = sorted((r.sequence_id, -r.length) for r in got)
    assert [n for n, _ in numbers] == list(range(len(got))) and [s for _, s in numbers] == sorted(s for _, s in numbers)
    assert P.pack(documents([])).count() == 0


def test_binary_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        sizes = P.piece_lengths(n)
        assert sum(sizes) == n and sizes == sorted(sizes, reverse=True) and sizes.count(2048) == n // 2048
