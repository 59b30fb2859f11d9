"""What the corpus operators share: reading tables and cutting lineage."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from alertweave.session import cut_lineage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(spark: SparkSession) -> None:
    """Small Arrow batches: texts come in all lengths, and a Python worker holds a batch several times over."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def cut(df: DataFrame) -> DataFrame:
    """`df` stored in the shared checkpoint folder; shuffle files of the steps behind it may then go."""
    stored = cut_lineage(df)
    for _ in range(2):  # the driver forgets the last stages of a job only a moment after it
        time.sleep(0.3)
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return stored
