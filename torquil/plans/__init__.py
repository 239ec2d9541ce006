"""Jobs made of operators."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, functions as F

from torquil import sources
from torquil.config import DEFAULTS
from torquil.operators import features as M, profile as P, segment as S
from torquil.sources import snapshot


def rebuild(readings: DataFrame, path: str, columns: tuple[str, ...], documents: DataFrame | None = None, sections: DataFrame | None = None, time: str = DEFAULTS.time) -> dict[str, int]:
    """Replaces readings (in parts by day), both versions' events with dispersion and gaps, and, if given, documents and sections; returns row counts.

    All tables change at once at the end (sources/snapshot.py): a job that dies on the way leaves the old ones. Running it again gives the same tables.
    """
    spark = readings.sparkSession
    old = snapshot.latest(spark, path)
    seen = Observation("readings")
    dated = readings.observe(seen, F.count("*").alias("n")).withColumn("day", F.to_date(time))
    tables = {"readings": snapshot.staged(dated, path, "readings", "day")}
    # events are numbered on the columns that their tables need; both versions side by side, as each is a row of jobs
    needed = readings.select(*dict.fromkeys((time, DEFAULTS.tie, *DEFAULTS.breaks, *columns)))
    with ThreadPoolExecutor(2) as pool:
        numbered = list(pool.map(lambda split: split(needed), (S.events, S.events_split_first)))
    versions = [S.summary(df).join(S.cohesion(df, columns), "event", "left").withColumn("version", F.lit(name)) for name, df in zip(("A", "B"), numbered)]
    tables["events"] = snapshot.staged(versions[0].unionByName(versions[1]).withColumn("part", F.col("version")), path, "events", "part")
    for name, df in (("documents", documents), ("sections", sections)):
        if df is not None:
            tables[name] = snapshot.staged(df, path, name)
        elif old and name in old.tables:
            tables[name] = old.tables[name]
    now = snapshot.commit(spark, path, tables, None, old)
    return {"readings": seen.get["n"]} | {name: now.read(name).count() for name in tables if name != "readings"}


def quality_report(df: DataFrame, columns: tuple[str, ...], pairs: list[tuple[str, str, float, float]], position: str, label: str = DEFAULTS.label, time: str = DEFAULTS.time, id: str = DEFAULTS.tie) -> dict[str, DataFrame]:
    """All quality tables, by name."""
    return {
        "dominant": P.dominant_values(df, columns),
        "redundant": P.unit_redundancy(df, pairs),
        "duplicates": P.consecutive_duplicates(df, position, label, columns),
        "repeated_times": P.repeated_times(df, time, label, id, columns),
        "outliers": P.tukey_outliers(df, columns),
    }


def staged_samples(df: DataFrame, columns: tuple[str, ...], size: int, label: str = DEFAULTS.label, time: str = DEFAULTS.time, tie: str = DEFAULTS.tie) -> tuple[DataFrame, list[tuple[str, int, float]]]:
    """Window samples, and (stage, rows, seconds) of each stage on the way."""
    report = []

    def done(stage: str, out: DataFrame) -> DataFrame:
        began = time_now()
        report.append((stage, out.count(), time_now() - began))
        return out

    events = done("events", S.events(df, (label,), time, tie))
    windows = done("windows", M.windowed(events, "event", (time, tie), size))
    return done("samples", M.summarised(windows, (label, "event"), columns)), report


time_now = time.monotonic
