"""Sinks. Each writes in parallel from the tasks that hold the rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import SEED, order_key
from ..operators.ranking import group_rank


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A stored table, or an empty one when nothing was written yet."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def group_index_json(items: DataFrame, path: str = "path", chunk: int = 10_000) -> DataFrame:
    """Nested index JSON, one document per group and ``chunk`` of its items.

    A group of ordinary size is one document. A large one is several documents
    with the same keys, which the reader merges by itself.
    """
    ranked = group_rank(items, ["group_id"], order_key("document", path), path, "_rank")
    cell = ranked.withColumn("part", F.floor(F.col("_rank") / chunk).cast("int"))
    key = ["group_id", "part"]
    by_source = cell.groupBy(*key, "entity_id", "source_id").agg(
        F.struct(*[
            F.sort_array(F.collect_list(F.when(F.col("role") == r, F.col(path)))).alias(r)
            for r in ("query", "gallery")
        ]).alias("held")
    )
    by_entity = by_source.groupBy(*key, "entity_id").agg(
        F.map_from_entries(F.collect_list(
            F.struct(F.col("source_id").cast("string"), "held"))).alias("sources")
    )
    entity = F.struct(F.col("entity_id").cast("string").alias("k"), F.col("sources").alias("v"))
    by_group = by_entity.groupBy(*key).agg(F.collect_list(entity).alias("entities"))
    nested = F.map_from_arrays(
        F.array(F.col("group_id").cast("string")), F.array(F.map_from_entries("entities"))
    )
    return by_group.select("group_id", "part", F.to_json(nested).alias("document"))


def flat_index_json(items: DataFrame, path: str = "path", chunk: int = 10_000) -> DataFrame:
    """Nested index JSON without roles: group, entity, source, then each path once."""
    once = items.dropDuplicates(["group_id", "entity_id", "source_id", path])
    ranked = group_rank(once, ["group_id"], order_key("document", path), path, "_rank")
    key = ["group_id", "part"]
    by_source = ranked.withColumn("part", F.floor(F.col("_rank") / chunk).cast("int")).groupBy(
        *key, "entity_id", "source_id"
    ).agg(F.sort_array(F.collect_list(path)).alias("held"))
    by_entity = by_source.groupBy(*key, "entity_id").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("source_id").cast("string"), "held"))).alias("sources"))
    by_group = by_entity.groupBy(*key).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("entity_id").cast("string"), "sources"))).alias("entities"))
    nested = F.map_from_arrays(F.array(F.col("group_id").cast("string")), F.array("entities"))
    return by_group.select("group_id", "part", F.to_json(nested).alias("document"))


def write_group_index(
    items: DataFrame, folder: str, path: str = "path", chunk: int = 10_000, flat: bool = False,
) -> None:
    """Index documents, one per line; ``flat`` leaves the roles out."""
    documents = (flat_index_json if flat else group_index_json)(items, path, chunk)
    documents.select("document").write.mode("overwrite").text(folder)


def write_benchmark(cases: DataFrame, summary: DataFrame, folder: str) -> None:
    """Cases by scenario as JSON lines, with a summary table beside them."""
    cases.write.mode("overwrite").partitionBy("scenario").json(f"{folder}/cases")
    summary.write.mode("overwrite").parquet(f"{folder}/summary")


def write_jsonl(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def write_predictions(rows: DataFrame, folder: str) -> None:
    """Quoted CSV: free text keeps its commas and line breaks."""
    rows.write.mode("overwrite").csv(folder, header=True, quoteAll=True, escape='"')


def write_sidecar(run: DataFrame, cases: DataFrame, folder: str) -> None:
    run.write.mode("overwrite").parquet(f"{folder}/run")
    cases.write.mode("overwrite").parquet(f"{folder}/cases")


def write_split_manifest(split: DataFrame, folder: str, seed: int = SEED) -> None:
    """The groups by split under ``groups``, and one row of seed and counts under ``summary``."""
    split.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/groups")
    counts = split.agg(
        F.count_if(F.col("split") == "test").alias("n_test"),
        F.count_if(F.col("split") == "train").alias("n_train"),
    )
    counts.select(F.lit(seed).alias("seed"), "n_test", "n_train").write.mode("overwrite").json(
        f"{folder}/summary"
    )


def write_decisions(decisions: DataFrame, folder: str, checkpoint: str):
    """Append a decision stream; returns the running query."""
    return (
        decisions.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint).start(folder)
    )


def resumable_write(rows: DataFrame, key: str, folder: str, buckets: int = 64) -> DataFrame:
    """Write the keys the folder does not hold yet, bucket by bucket; returns all rows written.

    An interrupted run is started again and does the unfinished buckets only. Read the
    rows through ``ledger.read_steps``, which leaves half-written buckets out.
    """
    from .ledger import run_steps

    return run_steps(rows, key, lambda part: part, folder, buckets)


def append_results(results: DataFrame, folder: str, key: tuple[str, ...] = ("model", "scenario")) -> None:
    """One accuracy line per (model, scenario), all scenarios in one job.

    A key that the folder holds already is not written again, so a repeated run
    leaves one line.
    """
    missing = [c for c in key if c not in results.columns]
    if missing:
        raise ValueError(f"results lack {missing}")
    held = read_or_empty(results.sparkSession, folder, results.schema).select(*key).distinct()
    results.join(held, list(key), "left_anti").select(results.columns).write.mode("append").parquet(folder)
