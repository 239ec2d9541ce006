"""Tables between the steps of a job, in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a short record that may be broadcast; larger tables are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Spark's setting by which the files of a query's shuffles are deleted at its end, not when the driver collects garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a session in one process may leave it unset and has a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="torquil-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def active() -> SparkSession:
    """The session in use."""
    found = SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("there is no active Spark session")
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own: read many times, computed once, and whole when executors are lost. Shuffles on the way to it go once it is there, as nothing reads them again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    ours = conf.get(CLEANED, None) in (None, "false")
    if ours:
        conf.set(CLEANED, "true")
    try:
        df.write.parquet(path)
    finally:
        if ours:  # other queries may be run twice, and then read theirs again
            conf.unset(CLEANED)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def removed(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        removed(df.sparkSession, df.kept_at)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has few rows. Pass a written table or a cheap plan: it is counted."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df
