"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. SQL can't express the outlier rule or the suffix arrays, so
ORACLE_SQL is None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from torquil.llm import common as C
from torquil.llm.ngram_join import one_of_each
from torquil.llm.packing import pack
from torquil.llm.quality import kept_documents
from torquil.llm.secrets import mask
from torquil.llm.suffix_dedup import suffix_dedup

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or their group's robust estimate reject go."""
    return kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: five words a shingle, Jaccard similarity 0.8 or more. Documents without an id or words stay."""
    return one_of_each(docs, k=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 256 bytes (50 short words and their spaces) that occur more than once go from the texts; documents stay."""
    return suffix_dedup(docs, 256)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; documents stay."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length with their ids."""
    return pack(docs, with_ids=True)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("repeated strings", repeated_strings), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = C.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        C.drop(*([last] if last else []))  # the next table holds all that it gave
        last = docs
    return docs
