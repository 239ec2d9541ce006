"""Tables between the steps of a job."""

import time

from pyspark.sql import functions as F

from torquil.sources import shared as T


def shuffled(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffles_go_once_a_table_is_written(spark):
    setting, before = spark.conf.get(T.CLEANED, None), shuffled(spark)
    out = T.written(spark.range(2000).groupBy((F.col("id") % 700).alias("k")).agg(F.sum("id").alias("s")), "sums")
    for _ in range(20):
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.25)
    assert not left and spark.conf.get(T.CLEANED, None) == setting
    assert out.count() == 700 and out.agg(F.sum("s")).first()[0] == 1999 * 1000
    twice = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()  # queries of others keep theirs
    assert sorted(twice.collect()) == sorted(twice.collect())
