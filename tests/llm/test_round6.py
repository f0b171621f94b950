"""What a step leaves on disk while it runs: prefixes and texts of the n-gram join, and shuffle files."""

import time

from pyspark.sql import functions as F

from lodestrata.llm import common
from lodestrata.llm.ngram_join import jaccard_components


def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(blocks.size()) if (name := blocks.apply(i).getName()).startswith("shuffle_")}


def test_ngram_join_keeps_only_what_its_result_reads(spark, tiny):
    before = set(common._WRITTEN)
    found = jaccard_components(common.documents(spark, tiny))
    left = [spark.read.parquet(path) for path in common._WRITTEN - before]
    assert not [df.columns for df in left if {"p1", "_text", "x"} & set(df.columns)]
    assert found.count() == common.documents(spark, tiny).count()


def test_written_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key)
    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table = common.written(grouped)
    for _ in range(50):  # they are removed in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(key) == setting
    # the same frame can be read again, before and after
    assert sorted(table.collect()) == sorted(grouped.collect()) == sorted(common.written(grouped).collect())
