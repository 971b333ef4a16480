"""Session settings and lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Keep ``df`` for several readers.

    With ``spark.checkpoint.dir`` it is written there as a column table and read
    back, which cuts its lineage and lets readers prune columns. Without the
    setting it is cached with its lineage, so nothing depends on a folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *steps: Callable) -> list:
    """Results of steps that store tables and do not need each other; their jobs share the cores."""
    with ThreadPoolExecutor(len(steps)) as threads:
        running = [threads.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [step.result() for step in running]
