"""Written intermediates."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lumencat.sources.storage import materialize


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def test_a_written_intermediate_leaves_no_shuffle_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, given = _shuffle_files(spark), spark.conf.get(setting, None)
    summed = spark.range(10_000).groupBy((F.col("id") % 997).alias("k")).count()
    assert materialize(summed, "sums").count() == 997
    # They are removed in the background; the count above left one file of a row.
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if len({name.split("_")[1] for name in left}) <= 1:
            break
        time.sleep(0.1)
    assert len({name.split("_")[1] for name in left}) <= 1
    assert spark.conf.get(setting, None) == given
    assert sum(r["count"] for r in summed.collect()) == 10_000  # the same DataFrame runs again
