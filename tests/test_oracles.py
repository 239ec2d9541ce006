"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from torquil import queries as Q

SF = "/root/testdata/sf0.001"
Q.load()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v if v is None or isinstance(v, (str, bool, int)) else float(v)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    out = duck.execute(Q.SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted([tuple(plain(row[i]) for i in at) for row in out.fetchall()], key=str)


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """The events of sf0.001 with two copies whose blocks of ids came to the same positions before: more than 211 blocks."""
    root = str(tmp_path_factory.mktemp("repeated"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    copies = [events.selectExpr(f"event_id + {by} AS event_id", f"ts + INTERVAL {hours} HOURS AS ts", "user_id", "event_type", "value", "props") for by, hours in ((0, 0), (105_500, 7), (316_500, 500))]
    copies[0].union(copies[1]).union(copies[2]).write.parquet(f"{root}/events.parquet")
    return root


def test_places_in_file_order_are_distinct_at_any_size(spark, repeated):
    df = Q.readings(spark, repeated)
    assert df.select("pos").distinct().count() == df.count()


@pytest.mark.parametrize("name", ["consecutive_duplicates", "disorder", "file_blocks", "file_jumps", "file_slice", "worst_backward", "label_transitions", "time_span"])
def test_same_rows_in_file_order_beyond_211_blocks(spark, repeated, name):
    c = duckdb.connect()
    c.execute(f"create view events as select * from read_parquet('{repeated}/events.parquet/*.parquet')")
    df = Q.QUERIES[name](spark, repeated)
    columns = sorted(df.columns)
    rows = c.execute(f"SELECT {', '.join(chr(34) + x + chr(34) for x in columns)} FROM ({Q.SQL[name]})").fetchall()
    assert sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str) == sorted([tuple(map(plain, row)) for row in rows], key=str)


@pytest.fixture(scope="module")
def tied(spark, tmp_path_factory):
    """The events of sf0.001 with copies that keep their ids: one two days later with other values, two as they are, and one of ids beyond 2**53."""
    root = str(tmp_path_factory.mktemp("tied"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    copies = [events.selectExpr(f"event_id + {by} AS event_id", f"ts + INTERVAL {hours} HOURS AS ts", "user_id", "event_type", f"value + {more} AS value", "props") for by, hours, more in ((0, 0, 0), (0, 55, 3), (0, 0, 0), (10**17 + 1, 0, 0))]
    copies[0].union(copies[1]).union(copies[2]).union(copies[3]).write.parquet(f"{root}/events.parquet")
    return root


def test_places_in_file_order_of_large_ids_are_distinct(spark, tied):
    df = Q.readings(spark, tied)
    assert df.select("pos").distinct().count() == df.select("id").distinct().count()


@pytest.mark.parametrize("name", ["consecutive_duplicates", "disorder", "file_blocks", "file_jumps", "file_slice", "worst_backward", "label_transitions"])
def test_same_rows_in_file_order_with_repeated_ids(spark, tied, name):
    test_same_rows_in_file_order_beyond_211_blocks(spark, tied, name)
