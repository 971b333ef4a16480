"""Long steps that survive their run.

The keys still to do are dealt into hash buckets and staged. Each bucket is one job:
its results are written first, then one line in the ledger names them. What the
ledger does not name was not written in full and is never read; a restart does the
keys of such buckets again, and only those.

    folder/staged/<run>/bucket=N    rows a run set out to do
    folder/results/<run>/bucket=N   what the step made of them
    folder/ledger                   one line for each finished bucket
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import read_or_empty

LEDGER = "run string, bucket int, at timestamp"
BUCKETS = 64


def finished(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(run, bucket) of the finished buckets in the order they were finished; a line a bucket reaches the driver."""
    lines = read_or_empty(spark, f"{folder}/ledger", LEDGER).orderBy("at", "run", "bucket").collect()
    return [(r["run"], r["bucket"]) for r in lines]


def _read(spark: SparkSession, folder: str, part: str, schema) -> DataFrame:
    paths = [f"{folder}/{part}/{run}/bucket={bucket}" for run, bucket in finished(spark, folder)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_steps(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Results of all finished buckets. Rows of half-written ones are not among them."""
    return _read(spark, folder, "results", schema)


def run_steps(
    rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], folder: str,
    buckets: int = BUCKETS, again: DataFrame | None = None,
) -> DataFrame:
    """Apply ``step`` to the rows of every key that no finished bucket holds; returns all results.

    ``step`` turns the rows of some keys into their results and sees a bucket at a
    time. A key with a null is done once like any other. ``again`` lists keys to do
    although they are done; their old results stay beside the new ones. Keys are
    spread by hash, so a bucket is a ``buckets``-th of the keys; a step that fails
    ends the run and leaves the finished buckets.
    """
    if "bucket" in rows.columns:
        raise ValueError("rows have a column named bucket")
    spark = rows.sparkSession
    kind = f"`{key}` {rows.schema[key].dataType.simpleString()}"
    done = _read(spark, folder, "staged", kind).distinct().withColumnRenamed(key, "_done")
    left = rows.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    if again is not None:
        twice = again.select(F.col(key).alias("_again")).distinct().join(
            done, F.col("_again").eqNullSafe(F.col("_done")), "left_semi")
        left = left.unionAll(rows.join(twice, F.col(key).eqNullSafe(F.col("_again")), "left_semi"))
    run = uuid.uuid4().hex
    staged = f"{folder}/staged/{run}"
    dealt = left.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    dealt.write.partitionBy("bucket").parquet(staged)
    # Buckets that hold rows; the list of partitions has one entry for each.
    held = read_or_empty(spark, staged, f"{kind}, bucket int").select("bucket").distinct()
    numbers = sorted(r["bucket"] for r in held.collect())
    schema = None
    for number in numbers:
        part = spark.read.schema(rows.schema).parquet(f"{staged}/bucket={number}")
        result = step(part)
        schema = result.schema
        result.write.mode("overwrite").parquet(f"{folder}/results/{run}/bucket={number}")
        line = spark.range(1).select(F.lit(run).alias("run"), F.lit(number).alias("bucket"), F.current_timestamp().alias("at"))
        line.coalesce(1).write.mode("append").parquet(f"{folder}/ledger")
    if schema is None:
        schema = step(rows.limit(0)).schema
    return read_steps(spark, folder, schema)
