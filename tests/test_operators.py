"""Small cases worked out by hand, and what SQL can't express."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from torquil import functions as X, plans, sources
from torquil.operators import catalogue as K, features as M, profile as P, rules as H, search as R, segment as S
from torquil.operators.timeline import Timeline

T0 = dt.datetime(2024, 1, 1)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_nulls_break(spark):
    df = spark.createDataFrame([(i, at(i), x) for i, x in enumerate(["a", "a", None, None, "a"])], "id int, created_at timestamp, fault string")
    got = S.events(df, ("fault",)).orderBy("id")
    assert [r.event for r in got.collect()] == [1, 1, 2, 3, 4]


def test_gap_is_strict(spark):
    df = spark.createDataFrame([(0, at(0), "a"), (1, at(10), "a"), (2, at(20.001), "a")], "id int, created_at timestamp, fault string")
    assert [r.event for r in S.events(df, ("fault",), gap_s=10.0).orderBy("id").collect()] == [1, 1, 2]


def test_order_across_buckets_equals_one_window(spark):
    df = spark.range(1000).select(F.col("id"), (F.hash("id") % 3).alias("x"), ((F.col("id") * 7919) % 1000).alias("pos"))
    df = df.where("pos < 200 or pos > 450")
    line, one = Timeline.by_position("pos", 37), Timeline.within((), "pos")
    a, b = ([(r.pos, r.p, r["__first"]) for r in t.previous(df, p="x").orderBy("pos").collect()] for t in (line, one))
    assert a == b
    a, b = ([(r.pos, r.s) for r in t.running_sum(df, F.col("x"), "s").orderBy("pos").collect()] for t in (line, one))
    assert a == b


def test_duplicates_and_nulls(spark):
    label = spark.createDataFrame([(i, x, 1) for i, x in enumerate(["a", "a", None, None, "a"])], "pos int, l string, m int")
    assert {r.l: r.duplicates for r in P.consecutive_duplicates(label, "pos", "l", ("m",)).collect()} == {"a": 2, None: 2}
    measure = spark.createDataFrame([(0, 1, None), (1, 1, None), (2, 2, 3), (3, 2, 3)], "pos int, a int, b int").withColumn("l", F.lit("x"))
    assert [r.duplicates for r in P.consecutive_duplicates(measure, "pos", "l", ("a", "b")).collect()] == [1]


def test_slope_and_windows(spark):
    def features(values):
        df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "event int, id int, x double")
        return M.summarised(M.whole(df, "event", ("id",)), ("event",), ("x",)).first()

    assert features([1.0, None, 3.0]).x__slope == 1.0
    assert features([10.0, None, None]).x__slope == 0.0
    assert features([5.0]).x__slope == 0.0 and features([None, None]).x__median == 0.0
    df = spark.range(5).withColumn("event", F.lit(1))
    got = {}
    for r in M.windowed(df, "event", ("id",), 3, 1).collect():
        got.setdefault(r.k, set()).add(r.id)
    assert got == {0: {0, 1, 2}, 1: {1, 2, 3}, 2: {2, 3, 4}}
    assert M.windowed(df.where("id < 2"), "event", ("id",), 3).count() == 0


def test_headings(spark):
    text = "1. Goal\n1. Unplug it.\n2. Tools\n4. Skipped\n2.1 Sub\nwrapped\nline\n3. Steps\n• one\n• two"
    got = R.sections(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string"), "id", "text").orderBy("first_line").collect()
    assert [(r.number, r.level) for r in got] == [("1", 1), ("2", 1), ("2.1", 2), ("3", 1)]
    assert got[2].body == "wrapped line" and got[3].body == "- one\n- two"


def test_headings_of_any_size(spark):
    title = "long " * 60 + "title"
    lines = [f"{i}. Part" for i in range(1, 121)] + ["120.1.2.3.4.5.6 " + title + " \r", "120.345 Sub", "120..1 no", "120.1.. no", "99999999999999999999999 no", "1" + ".1" * 20_000 + " no"]
    got = R.sections(spark.createDataFrame([(1, "\n".join(lines))], "id int, text string"), "id", "text").orderBy("first_line").collect()
    assert [r.number for r in got] == [*map(str, range(1, 121)), "120.1.2.3.4.5.6", "120.345"]
    assert got[120].title == title and got[120].level == 7


def test_symptoms_of_whole_texts(spark, tmp_path):
    from torquil.queries import QUERIES, load

    load()
    spark.createDataFrame([("c", 1, "user", "a, b; " * 20 + "motor vibrates, hot bearing")], "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert QUERIES["cleaned_symptoms"](spark, str(tmp_path)).first().symptoms == ["motor vibrates", "hot bearing"]


def test_free_search_breaks_ties_by_chunk(spark):
    v = [0.3, -0.7, 0.1, 0.9, 0.2]
    rows = [(3000 - i, 1, v) for i in range(3000)] + [(9000 + i, 2, [-x for x in v]) for i in range(50)]
    chunks = spark.createDataFrame(rows, "chunk long, document int, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(q, [x * (1 + q % 3) for x in v]) for q in range(1200)], "query long, qvec array<double>")
    got = {}
    for r in R.free_search(queries, chunks, 5).collect():
        got.setdefault(r.query, {})[r["rank"]] = r.chunk
    assert len(got) == 1200 and all(x == {i: i for i in range(1, 6)} for x in got.values())
    few = R.free_search(queries.where("query = 0"), chunks.where("chunk < 4"), 5)
    assert few.count() == 3 and R.free_search(queries.limit(0), chunks, 5).count() == 0


def test_one_document_decides(spark):
    def decide(weights):
        df = spark.createDataFrame([(1, f"d{i}", float(w), i + 1) for i, w in enumerate(weights)], "query int, document string, weight double, rank int")
        return R.decided(df).first().decision

    assert decide([1, 0.5, 0.5, 0.5, 0.5]) == "choose" and decide([1.43, 1.39]) == "choose" and decide([0.2]) == "fixed" and decide([2, 1]) == "fixed" and decide([0.0]) == "none"


def test_citations_and_numbers(spark):
    answers = spark.createDataFrame([(1, "(doc1, secao 4)"), (2, "(Doc1, seção 4.1)"), (3, "none")], "id int, t string")
    supplied = spark.createDataFrame([(i, "Doc1", "4") for i in (1, 2, 3)], "id int, document string, section string")
    assert {r.id: r.passed for r in H.citations(answers, "id", "t", supplied).collect()} == {1: True, 2: False, 3: False}
    texts = spark.createDataFrame([(1, "72% and 0,72 and 50"), (2, "73%"), (3, "50")], "id int, t string")
    facts = spark.createDataFrame([(1, 0.72), (1, 50.0), (2, 0.72), (3, 5.0)], "id int, value double")
    assert {r.id: r.passed for r in H.numbers(texts, "id", "t", facts).collect()} == {1: True, 2: False, 3: False}
    texts = spark.createDataFrame([(1, "12mm/s"), (2, "1.234.567"), (3, "500"), (4, "0.723 or 72.3%"), (5, "100000000000000"), (6, None)], "id int, t string")
    facts = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 5.0), (4, 0.7231), (5, 1e14), (6, 1.0)], "id int, value double")
    assert {r.id: r.passed for r in H.numbers(texts, "id", "t", facts).collect()} == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True}


def test_unit_copies_to_drop(spark):
    rows = spark.createDataFrame([(1.0, 25.4, 20.0, 68.0, 7.0), (2.0, 50.8, 30.0, 86.0, 7.0)], "v_in double, v_mm double, t_c double, t_f double, one double")
    got = P.droppable(rows, ("v_mm", "one"), [("v_in", "v_mm", 25.4, 0.0, "v_in"), ("t_c", "t_f", 1.8, 32.0, "t_f")], ("id",))
    assert {(r.column, r.reason) for r in got.collect()} == {("v_in", "unit copy"), ("t_f", "unit copy"), ("id", "leak"), ("one", "constant")}


def test_input_records(spark):
    rows = [(1, '{"t": 1}'), (2, '{"rpm": "x", "t": 1}'), (3, '{"rpm": -1, "t": 1}'), (4, '{"rpm": 0, "t": 1}'), (5, None), (6, "no json")]
    got = H.input_verdicts(spark.createDataFrame(rows, "id int, j string"), "j", ("rpm",), {"rpm": (0.0, 10.0)})
    assert {r.id: r.reason for r in got.collect()} == {1: "missing:rpm", 2: "not_numeric:rpm", 3: "out_of_range:rpm", 4: None, 5: "missing:rpm", 6: "missing:rpm"}


def test_alias_in_two_families(spark):
    with pytest.raises(ValueError, match="is in"):
        K.Catalogue.of(spark, [{"name": "a", "is_problem": True, "aliases": ["x"]}, {"name": "b", "is_problem": True, "aliases": ["x"]}])


def test_symptoms(spark):
    df = spark.createDataFrame([(1, "The motor vibrates badly", ["Vibrates a lot", "motor hot", "MOTOR HOT", "unrelated thing"]), (2, "noise", ["nothing here"]), (3, "noise", None)], "id int, t string, s array<string>")
    got = {r.id: r.symptoms for r in H.cleaned_symptoms(df, "id", "t", "s").collect()}
    assert got == {1: ["Vibrates a lot", "motor hot"], 2: ["noise"], 3: ["noise"]}


def test_sources_and_rebuild(spark, tmp_path):
    raw = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 00:00:0{i}", " a " if i < 4 else "b", 500.0, float("nan") if i == 2 else float(i)) for i in range(8)], "id int, created_at string, fault string, rpm double, m double")
    sources.export_csv(raw, str(tmp_path / "csv"))
    df = sources.read_csv(spark, str(tmp_path / "csv"), "id int, created_at string, fault string, rpm double, m double")
    assert df.where("fault = 'a'").count() == 4 and df.where("m is null").count() == 1
    assert sources.numeric_columns(df, ("id",)) == ["rpm", "m"]
    once = plans.rebuild(df, str(tmp_path / "db"), ("m",))
    assert once == plans.rebuild(df, str(tmp_path / "db"), ("m",)) and once["readings"] == 8
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "p"))
    placed = sources.with_position(spark.read.parquet(str(tmp_path / "p")))
    assert sorted(r.pos for r in placed.collect()) == list(range(10))
    _, report = plans.staged_samples(df, ("m",), 2)
    assert [r[0] for r in report] == ["events", "windows", "samples"]
    assert set(plans.quality_report(df.withColumn("pos", F.col("id")), ("m",), [("m", "m", 1.0, 0.0)], "pos")) == {"dominant", "redundant", "duplicates", "repeated_times", "outliers"}


def test_streamed_events(spark, tmp_path):
    from torquil.streaming import entity_events

    rows = [(1, "a", at(0)), (1, "a", at(5)), (1, "b", at(6)), (2, "a", at(0)), (2, "a", at(100)), (1, None, at(7)), (1, None, at(8))]
    spark.createDataFrame(rows, "m int, l string, t timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("m int, l string, t timestamp").parquet(str(tmp_path / "in"))
    q = entity_events(stream, "m", "l", "t", 60.0).writeStream.format("memory").queryName("numbered").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.entity, r.time, r.event) for r in spark.table("numbered").collect())
    assert [e for _, _, e in got] == [1, 1, 2, 3, 4, 1, 2]


def test_folded_words():
    assert X.ACCENTED and len(X.ACCENTED) == len(X.FOLDED)


def test_search_of_untyped_chunks_and_sessions(spark):
    from torquil.operators import search as R

    chunks = spark.createDataFrame([(1, 10, 1, "a", [1.0, 0.0]), (2, 10, None, "a", [0.8, 0.6]), (3, 20, 2, "a", [0.0, 1.0]), (4, 20, 2, "b", [1.0, 0.0]), (5, 30, 1, "a", [0.6, 0.8])], "chunk long, document long, field int, model string, vec array<double>")
    allowed = spark.createDataFrame([(1, 10), (2, 20)], "family int, document long")
    queries = spark.createDataFrame([(100, 1, 7, "a", [1.0, 0.0]), (200, 2, 7, "a", [1.0, 0.0]), (300, 1, None, "a", [1.0, 0.0]), (400, 1, 1, "a", [1.0, 0.0])], "query long, family int, field int, model string, qvec array<double>")
    got = sorted((r.query, r.chunk) for r in R.filtered_search(queries, allowed, chunks, 5).collect())
    # a chunk without a field counts as of any field; where no allowed one has the field, all of them count
    assert got == [(100, 2), (200, 3), (300, 1), (300, 2), (400, 1), (400, 2)]
    sessions = spark.createDataFrame([(1, 100, [1.0, 0.0]), (1, 200, [0.0, 1.0]), (2, 300, [0.0, 1.0])], "session int, query long, qvec array<double>")
    got = [(r.session, r.chunk, round(r.score, 6), r["rank"]) for r in R.multi_query_search(sessions, chunks, 2).orderBy("session", "rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 3, 1.0, 2), (2, 3, 1.0, 1), (2, 5, 0.8, 2)]
