"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from torquil.config import DEFAULTS
from torquil.functions import cleaned
from torquil.sources import shared


def typed_readings(raw: DataFrame, time: str = DEFAULTS.time, label: str = DEFAULTS.label) -> DataFrame:
    """UTC timestamps of any precision, trimmed labels, NaN as null."""
    out = raw.withColumn(time, F.to_timestamp(F.col(time))).withColumn(label, F.trim(F.col(label)))
    for f in out.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out = out.withColumn(f.name, cleaned(f.name))
    return out


def read_csv(spark: SparkSession, path: str, schema: str, time: str = DEFAULTS.time, label: str = DEFAULTS.label, rows: int | None = None) -> DataFrame:
    """Readings from CSV with a header and a given schema; rows limits them (a preview)."""
    out = typed_readings(spark.read.option("header", True).schema(schema).csv(path), time, label)
    return out if rows is None else out.limit(rows)


def with_position(df: DataFrame, name: str = "pos") -> DataFrame:
    """Rows of a Parquet table with their place in file order: files by name, rows as they stand."""
    files = df.select(F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"), *df.columns)
    sizes = files.groupBy("__f").agg(F.count("*").alias("__n"))
    from pyspark.sql import Window

    before = sizes.withColumn("__o", F.coalesce(F.sum("__n").over(Window.orderBy("__f").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each file
    return files.join(shared.if_small(before.select("__f", "__o")), "__f").withColumn(name, F.col("__o") + F.col("__r")).drop("__f", "__r", "__o")


def numeric_columns(df: DataFrame, leaks: tuple[str, ...] = (), copies: tuple[str, ...] = (), regime: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns but leaks, unit copies and, if given, regime columns."""
    out = {*leaks, *copies, *regime}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in out]


def write_readings(df: DataFrame, path: str, time: str = DEFAULTS.time) -> None:
    """Replaces the table, in a folder for each day; writing twice gives the same table."""
    df.withColumn("day", F.to_date(time)).repartition("day").sortWithinPartitions(time).write.mode("overwrite").partitionBy("day").parquet(path)


def write_events(tables: dict[str, DataFrame], path: str) -> None:
    """Event tables of several versions as one, in a folder for each."""
    out = None
    for version, df in tables.items():
        df = df.withColumn("version", F.lit(version))
        out = df if out is None else out.unionByName(df)
    out.write.mode("overwrite").partitionBy("version").parquet(path)


def write_sections(documents: DataFrame, sections: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").parquet(f"{path}/documents")
    sections.write.mode("overwrite").parquet(f"{path}/sections")


def with_vectors(sections: DataFrame, vector: str = "embedding") -> DataFrame:
    return sections.where(F.col(vector).isNotNull())


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
