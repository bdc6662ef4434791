"""Written tables: their shuffle files go with the write, the session's settings stay."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from doctopics import runtime


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for folder in folders for p in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    df = spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 5000).alias("k")).agg(F.sum("id").alias("s"))
    out = runtime.run_parallel([lambda: runtime.materialise(df, "sums") for _ in range(3)], 3)
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert [t.agg(F.sum("s")).first()[0] for t in out] == [20_000 * 19_999 // 2] * 3
    assert spark.conf.get(runtime._REMOVE_SHUFFLES, None) is None
