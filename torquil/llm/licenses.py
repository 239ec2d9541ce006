"""License scans by diagonal voting.

Every rolling hash of k words of every text is joined in Spark to its places in the license templates. A hit votes
for the diagonal (place in the text less place in the template); neighbouring diagonals merge, so insertions and
deletions stay in one candidate, and candidates with enough votes are verified on the words. The three base phrases
are templates too: a diagonal with all of a phrase's votes is a place where its words stand in order.

Results for odd input: null and empty texts have no words and no labels; rows that share an id are scanned apart;
a null id stays null; other columns are left alone; an empty table gives no rows.
"""

from __future__ import annotations

import difflib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from torquil.llm import common as C

K = 3
#: Diagonals so near each other are one candidate.
NEAR = 8
#: Least share of a template's hashes that vote, and of its words that agree in the span.
VOTES, AGREE = 0.4, 0.7

# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Passages of public license texts.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "gpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/""",
}

#: A-Z in lower case; digits, letters and all bytes above ASCII stay; all else is white space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def grams(ws: list[bytes], k: int = K) -> np.ndarray:
    """A hash of each k words; none of fewer words."""
    return C.rolling(C.WORDS.of(ws), k) if len(ws) >= k else np.zeros(0, np.uint64)


def _grams(batch: pa.RecordBatch):
    texts = C.texts_of(batch)
    hashes = [grams(words(t)) for t in texts]
    sizes = [len(h) for h in hashes]
    ids = pa.array(np.arange(len(texts)).repeat(sizes))
    at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(ids), batch.column("row").take(ids), pa.array(at), pa.array(np.concatenate(hashes).view(np.int64))], ["doc_id", "row", "at", "gram"])


def _templates(phrases: dict[str, str], templates: dict[str, str]) -> list[tuple[str, str, bool, list[bytes]]]:
    """(name, label, whether it is a phrase, words)."""
    out = [(f"phrase {i}", label, True, words(p.encode())) for i, (p, label) in enumerate(phrases.items())]
    return out + [(f"text {label}", label, False, words(t.encode())) for label, t in templates.items()]


def places(spark: SparkSession, all_templates: list) -> DataFrame:
    """(gram, template, place, whole, phrase): the templates' hashes, as many rows as they have words at most."""
    rows = [(int(g), name, i, len(hs), phrase) for name, _, phrase, ws in all_templates for hs in [grams(ws).view(np.int64)] for i, g in enumerate(hs)]
    return spark.createDataFrame(rows, "gram long, template string, place int, whole int, phrase boolean")


def _verify(batch: pa.RecordBatch, all_templates: list):
    """Counts and labels of each row from its verified candidates."""
    known = {name: (label, phrase, ws) for name, label, phrase, ws in all_templates}
    out = []
    for text, found in zip(C.texts_of(batch), batch.column("found").to_pylist()):
        ws = words(text)
        base, labels, best, spans = [], set(), 0.0, []
        for f in sorted(found or [], key=lambda f: (f["start"], f["template"])):
            label, phrase, want = known[f["template"]]
            if phrase:
                if ws[f["start"] : f["start"] + len(want)] == want:
                    base.append((f["start"], label))
                    best = 1.0
                    spans.append((label, f["start"], f["start"] + len(want)))
            else:
                a = max(0, f["start"])
                span = ws[a : f["end"]]
                agree = sum(m.size for m in difflib.SequenceMatcher(None, want, span, False).get_matching_blocks()) / len(want)
                if agree >= AGREE:
                    labels.add(label)
                    best = max(best, agree)
                    spans.append((label, a, min(len(ws), f["end"])))
        of_base = sorted({label for _, label in base})
        starts = [s for s, _ in base]
        out.append((len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(of_base), ",".join(sorted(labels | set(of_base))), best, ",".join(f"{x}:{a}:{b}" for x, a, b in spans)))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], ["doc_id", *names])


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of each row of docs (doc_id, text). Phrases have K words or more."""
    spark = docs.sparkSession
    C.tune(spark)
    docs = C.with_text(docs, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("row", F.xxhash64("text"))  # tells texts of one id, or of none, apart
    all_templates = _templates(phrases, templates)
    hits = C.mapped(docs, _grams, "doc_id long, row long, at int, gram long").join(F.broadcast(places(spark, all_templates)), "gram")
    key = ["doc_id", "row", "template"]
    votes = C.written(hits.withColumn("diagonal", F.col("at") - F.col("place")).groupBy(*key, "diagonal", "whole", "phrase").agg(F.count_distinct("place").alias("votes"), F.min("place").alias("first"), F.max("place").alias("last")), "votes")
    phrase = votes.where("phrase and votes = whole").select(*key, F.col("diagonal").alias("start"), (F.col("diagonal") + F.col("whole") + K - 1).alias("end"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    merged = votes.where("not phrase").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > NEAR).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(along))
    merged = merged.groupBy(*key, "run", "whole").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("start"), (F.max("diagonal") + F.col("whole") + K - 1).alias("end")).where(F.col("votes") >= VOTES * F.col("whole"))
    found = phrase.union(merged.select(*key, "start", "end"))
    lists = C.written(found.groupBy("doc_id", "row").agg(F.collect_set(F.struct("template", "start", "end")).alias("found")), "candidates")
    C.drop(votes)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("hash"))
    joined = docs.join(C.if_small(lists, C.BROADCAST_ROWS // 4).toDF("id", "hash", "found"), same, "left").select("doc_id", "text", "found")
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return C.mapped(joined, _verify, schema, all_templates=all_templates)


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
