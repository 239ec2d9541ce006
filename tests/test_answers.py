"""Sections, histories, triage, admission and rebuilds: cases by hand and brute force."""

import datetime as dt
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from torquil import config, plans, sources
from torquil.operators import catalogue as K, model as M, rules as H, search as R
from torquil.operators.features import STATISTICS
from torquil.sources import snapshot


def cut(text, pages):
    """Sections of a text by a loop over its lines."""
    out, top = [], 0
    for i, line in enumerate(text.split("\n")):
        bare = line.strip(" \t\r\f\v")
        m = re.match(r"^(\d[\d.]*)\s+(\S.*)$", bare)
        number = m and re.sub(r"\.$", "", m[1])
        if m and ".." not in number and not number.endswith(".") and not re.search(r"[.;:]$", m[2]):
            first = int(number.split(".")[0])
            if first == top + 1 if "." not in number else top > 0 and first == top:
                top = first if "." not in number else top
                plain = unicodedata.normalize("NFKD", m[2]).encode("ascii", "ignore").decode().lower()
                field = next((name for name, p in config.FIELD_PATTERNS if re.search(p, plain)), None)
                out.append([number, m[2], len(number.split(".")), field, pages[i], pages[i], i])
                continue
        if out and bare and pages[i] is not None:
            out[-1][5] = pages[i]
    return [tuple(x) for x in out]


def test_sections_have_fields_and_pages(spark):
    text = "Title\n1. Objetivo\ntext\n\n2. Ferramentas e Instrumentos\n2.1 Sub\nx\n\n3. Validação Final\nlast"
    rows = [(1, text, [1, 1, 1, 2, 2, 3, 3, 4, 4, 5]), (2, text, None), (3, text, [None, 7]), (4, None, [1]), (5, "", [])]
    got = {}
    for r in R.sections(spark.createDataFrame(rows, "id int, t string, p array<int>"), "id", "t", "p").orderBy("first_line").collect():
        got.setdefault(r.id, []).append((r.number, r.field, r.first_page, r.last_page))
    assert got[1] == [("1", "objetivo", 1, 1), ("2", "ferramentas", 2, 2), ("2.1", None, 3, 3), ("3", "validacao", 4, 5)]
    assert got[3][0] == ("1", "objetivo", 7, 7) and set(got) == {1, 2, 3} and all(x[2] is None for x in got[2])


def test_cut_sections_read_whole_texts(spark):
    from torquil.queries import QUERIES, load

    load()
    d = "/root/testdata/sf0.001"
    got = {}
    for r in QUERIES["cut_sections"](spark, d).collect():
        got.setdefault(r.doc_id, []).append((r.number, r.title, r.level, r.field, r.first_page, r.last_page, r.first_line, r.body))
    lost = 0
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        numbered = []
        for i, line in enumerate(r.text.split("\n")):
            if i % 3 == 0:
                numbered.append(f"{i // 3 + 1}. {'Sintomas' if i % 2 == 0 else 'Validação'} {i}")
            numbered.append(line)
        want = cut("\n".join(numbered), [i // 10 + 1 for i in range(len(numbered))])
        mine = sorted(got.get(r.doc_id, []), key=lambda x: x[6])
        assert [x[:7] for x in mine] == want
        # every letter of the text is in a body or a title
        letters = lambda s: sum(c.isalpha() for c in s)
        lost += letters(r.text) - letters("".join(x[7] for x in mine)) - sum(letters(x[1]) for x in mine if not re.match(r"(Sintomas|Validação) \d+$", x[1]))
    assert lost == 0


def test_history(spark):
    turns = [(1, 1, "a1", False, False, True, False, None), (1, 2, "a2", True, False, True, False, None), (1, 3, "a3", False, False, False, False, "why"), (1, 4, "a4", False, True, False, False, None), (1, 5, "a5", False, False, True, True, None), (2, 1, "b1", None, None, None, None, None)]
    excerpts = [(1, 5, 1, "Doc1, section 2", " one "), (1, 5, 3, "Doc1, section 9", "three"), (1, 5, 2, "Doc1, section 3", "two"), (1, 1, 1, "Doc1", "unused")]
    got = K.history(
        spark.createDataFrame(turns, "c int, t int, answer string, refused boolean, classified boolean, verified boolean, degraded boolean, reason string"),
        spark.createDataFrame(excerpts, "c int, t int, rank int, reference string, text string"), "c", "t", 3,
    )
    assert {(r.c, r.t): (r.back, r.author, r.content) for r in got.collect()} == {
        (1, 5): (1, "system", "[Doc1, section 2] one\n\n[Doc1, section 3] two"), (1, 4): (2, "system", "a4"), (1, 3): (3, "system", "why"), (2, 1): (1, "system", "(nothing verified in this turn)"),
    }


def test_triage_adds_symptoms(spark):
    rng = np.random.default_rng(1)
    chunks = spark.createDataFrame([(i, i % 4, [float(x) for x in rng.normal(size=6)]) for i in range(60)], "chunk int, document int, vec array<double>")
    symptoms = spark.createDataFrame([(q % 5, q, [float(x) for x in rng.normal(size=6)]) for q in range(15)], "case int, query int, qvec array<double>")
    whole = sorted(map(tuple, R.triage(R.symptom_scores(symptoms, chunks, 8), 8).collect()))
    first, later = symptoms.where("query < 6"), symptoms.where("query >= 6")
    stored = R.symptom_scores(first, chunks, 8)
    assert sorted(map(tuple, R.triage(R.symptom_scores(later, chunks, 8, stored), 8).collect())) == whole and len(whole) == 5
    near = spark.createDataFrame([(1, 1, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], symptoms.schema)
    one = spark.createDataFrame([(1, 7, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (2, 8, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])], chunks.schema)
    assert R.triage(R.symptom_scores(near, one, 8), 8).first().asDict() == {"case": 1, "best": 1.0, "outcome": "fixed", "document": 7}
    assert R.triage(R.symptom_scores(near, one.where("chunk = 2"), 8), 8).first().outcome == "no_procedure"


def test_scope_is_one_document(spark):
    chunks = spark.createDataFrame([(1, 10, "a", [1.0, 0.0]), (2, 20, "a", [0.0, 1.0]), (3, 20, "b", [1.0, 0.0])], "chunk int, document int, model string, vec array<double>")
    asked = spark.createDataFrame([(1, 10, "a", [1.0, 0.0]), (2, 20, "a", [1.0, 0.0]), (3, 30, "a", [1.0, 0.0])], "query int, document int, model string, qvec array<double>")
    got = {r["query"]: (r.best, r.in_scope) for r in R.scope_of_document(asked, chunks).collect()}
    assert got == {1: (1.0, True), 2: (0.0, False), 3: (0.0, False)}


def test_admission_by_a_forest(spark):
    """The model's family decides, whatever label the record has."""
    names = tuple(f"x__{s}" for s in STATISTICS)
    rows = [("fault" if e % 2 else "normal", e, k, float(e % 2) * 5 + k * 0.1, 1.0, 0.0, 0.5, 0.2) for e in range(8) for k in range(4)]
    samples = spark.createDataFrame(rows, "family string, event int, k int, " + ", ".join(f"{n} double" for n in names))
    forest = M.Forest(names, "family", trees=6, depth=3)
    said = M.top_family(forest.blocks(forest.fit(samples), samples, "event"), "event")
    catalogue = K.Catalogue.of(spark, [{"name": "fault", "is_problem": True, "aliases": ["f"], "documents": ["d"]}, {"name": "normal", "is_problem": False, "aliases": ["n"]}, {"name": "bare", "is_problem": True, "aliases": ["b"]}])
    ok, bad = '{"rpm": 1}', '{"rpm": "x"}'
    records = spark.createDataFrame([(1, "n", ok), (2, "f", ok), (3, "f", bad), (5, "unknown", ok), (90, "f", ok), (91, "b", ok), (92, "n", ok), (93, None, ok)], "event int, label string, j string")
    got = {r.event: (r.family, r.failed, r.diverges) for r in H.admitted(records, "event", "j", "label", said, catalogue, ("rpm",), {"rpm": (0.0, 10.0)}).collect()}
    assert got == {1: ("fault", None, True), 2: ("normal", "G2", True), 3: ("fault", "G0", False), 5: ("fault", None, False), 90: ("fault", None, False), 91: ("bare", "G3", False), 92: ("normal", "G2", False), 93: (None, "G2", False)}
    unsure = said.withColumn("confidence", F.lit(0.2))
    assert H.admitted(records, "event", "j", "label", unsure, catalogue, ("rpm",), {"rpm": (0.0, 10.0)}).where("event = 1").first().failed == "G1"


def test_first_of_and_raw_answers(spark):
    df = spark.createDataFrame([(None, 3, "c"), (None, 1, "a"), ("x", 2, "b"), ("x", 2, "b2")], "k string, at int, v string")
    assert {(r.k, r.v) for r in K.first_of(df, ("k",), ("at", "v")).collect()} == {(None, "a"), ("x", "b")}
    hits = spark.createDataFrame([(1, 7, 2, 0.5), (1, 8, 1, 0.9), (2, 9, 1, 0.4)], "query int, chunk int, rank int, score double")
    sections = spark.createDataFrame([(7, "Doc1", "2.1", "Tools", "4-5", " use it "), (8, "Doc2", "3", "Aim", "", None)], "chunk int, document string, number string, title string, pages string, body string")
    assert {r["query"]: r.raw for r in R.raw_answers(hits, sections).collect()} == {1: "[1] Doc2, section 3 - Aim\n\n\n[2] Doc1, section 2.1, p. 4-5 - Tools\nuse it"}


def readings(spark, n):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + dt.timedelta(hours=i), "a" if i % 7 < 4 else "b", 500.0, float(i)) for i in range(n)], "id int, created_at timestamp, fault string, rpm double, m double")


def test_a_rebuild_that_dies_leaves_the_old_tables(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    documents = spark.createDataFrame([(1, "t")], "id int, text string")
    sections = spark.createDataFrame([(1, "s", [1.0]), (2, "u", None)], "id int, body string, embedding array<double>")
    once = plans.rebuild(readings(spark, 40), path, ("m",), documents, sections)
    assert once == {"readings": 40, "events": snapshot.latest(spark, path).read("events").count(), "documents": 1, "sections": 2}
    assert sources.with_vectors(snapshot.latest(spark, path).read("sections")).count() == 1
    with monkeypatch.context() as m:
        m.setattr(plans.S, "events_split_first", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            plans.rebuild(readings(spark, 90), path, ("m",))  # the readings are written by now
    now = snapshot.latest(spark, path)
    assert now.version == 1 and now.read("readings").count() == 40 and now.read("readings", ["2024-01-01"]).count() == 24
    assert plans.rebuild(readings(spark, 90), path, ("m",))["readings"] == 90
    assert snapshot.latest(spark, path).read("documents").count() == 1 and snapshot.clean(spark, path) >= 2


def test_a_rebuild_numbers_events_on_the_columns_it_needs(spark, tmp_path, monkeypatch):
    seen, whole = [], (plans.S.events, plans.S.events_split_first)
    for f in whole:
        monkeypatch.setattr(plans.S, f.__name__, lambda df, f=f: seen.append(sorted(df.columns)) or f(df))
    path = str(tmp_path / "db")
    plans.rebuild(readings(spark, 40).withColumn("other", F.lit("x")), path, ("m",))
    assert seen == [["created_at", "fault", "id", "m", "rpm"]] * 2
    now = snapshot.latest(spark, path)
    assert "other" in now.read("readings").columns and {r.version for r in now.read("events").collect()} == {"A", "B"}


def test_streamed_rows_without_a_time(spark, tmp_path):
    from torquil.streaming import entity_events

    t0 = dt.datetime(2024, 1, 1)
    for i, rows in enumerate([[(1, "a", t0), (1, "a", None), (2, None, None)], [(1, "a", t0 + dt.timedelta(seconds=50)), (1, "a", t0 + dt.timedelta(seconds=111)), (2, "b", t0)]]):
        spark.createDataFrame(rows, "m int, l string, t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("m int, l string, t timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = entity_events(stream, "m", "l", "t", 60.0).writeStream.format("memory").queryName("timeless").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.entity, r.event) for r in spark.table("timeless").collect())
    assert got == [(1, 1), (1, 1), (1, 1), (1, 2), (2, 1), (2, 2)]
