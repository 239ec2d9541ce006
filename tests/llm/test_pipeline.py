import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages_take_effect(documents, spark):
    g = np.random.default_rng(7)
    text = lambda n: " ".join("".join(g.choice(list("abcdefgh"), 6)) for _ in range(n))
    passage = text(70)
    clean = [(i, text(60) + f" end{i}") for i in range(60)]
    near = clean[0][1].split()
    near[30] = "changed"
    rows = clean + [(100, clean[1][1]), (101, " ".join(near)), (102, "too short"), (103, "same words all over " * 60), (104, text(40) + " " + passage), (105, text(40) + " " + passage), (106, text(50) + " password=abcdef012345XY"), (107, None), (1, clean[1][1])]
    docs = documents(rows)
    seen = []
    for name, stage in P.STAGES:
        columns = docs.columns
        docs = P.C.written(stage(spark, docs, ""), "test")
        if name != "packing":
            assert docs.columns == columns
            seen.append({r.doc_id: r.text for r in docs.collect()})
            if name == "near duplicates":
                assert docs.count() == len(seen[-1])
    quality, single, cut, masked = seen
    assert quality.keys() == {i for i, _ in rows} - {102, 103, 107}
    assert single.keys() == quality.keys() - {100, 101}
    assert cut.keys() == single.keys() and all(cut[i] == t for i, t in clean)
    assert passage not in cut[104] and passage not in cut[105] and len(cut[104].split()) >= 40
    assert "abcdef012345XY" not in masked[106] and masked[104] == cut[104]
    assert docs.select("doc_id").distinct().count() == len(masked)
    assert docs.agg(F.count_distinct("sequence_id") == F.count("*")).first()[0]
