"""Where intermediate tables go: the folder in spark.checkpoint.dir, shared by all executors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir.

    Only where that setting is missing and all runs in one process (tests) is a folder of our own used; a cluster
    without it is refused, as its executors would write to different disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master}")
        base = f"file:///tmp/kgspark-checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"


def shared_store(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """store(df, name): writes df as Parquet in a fresh shared folder and reads it back, which cuts its lineage."""
    folder = shared_folder(spark)

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return store
