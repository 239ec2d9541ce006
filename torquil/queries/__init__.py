"""The registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The readings that stand in for sensor data: expressions that Spark and DuckDB read alike. pos, the place in file order, deals
#: blocks of 500 ids anew within each 211 of them, in whole numbers alone, so that it is one of its own for each id of any size.
READINGS = [
    "event_id AS id",
    "ts AS created_at",
    "concat('L', CAST(floor(hour(ts)/6) AS INT)) AS fault",
    "CAST(500*(1+floor(hour(ts)/3)%2) AS DOUBLE) AS rpm",
    "event_id - event_id%105500 + (event_id%105500 - event_id%500)*97%105500 + event_id%500 AS pos",
    "CASE WHEN event_id%97=0 THEN NULL ELSE value END AS m1",
    "round(value/25.4,4) AS m1_in",
    "CAST(regexp_extract(props,'[0-9]+',0) AS DOUBLE) AS m2",
    "user_id AS machine",
    "event_type",
]
WITH_READINGS = f"r AS (SELECT {', '.join(READINGS)} FROM events)"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir). sql may use {r} for the readings' common table expression."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{r}", WITH_READINGS)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*READINGS)


def load() -> None:
    """Imports the modules that register queries."""
    from torquil.queries import catalogue, features, monitoring, rules, search  # noqa: F401
