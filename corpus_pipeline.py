"""A corpus from raw documents to packed windows: toxicity, near duplicates,
repeated passages, mixing, packing. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineup.llm import common, toxicity
from lineup.llm.mixing import mix
from lineup.llm.ngram_join import ngram_join
from lineup.llm.packing import pack
from lineup.llm.suffix_dedup import without_repeats

#: Part of its expected tokens that each labelled domain keeps; texts of the good one stay whole.
KEEP = {"good": 1.0, "low": 0.5, "toxic": 0.5}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3; labels of held-out documents are not learned from."""
    labels = common.table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels.where(F.col("doc_id").isNotNull() & ~held)))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Rows without an id stay. Of rows that repeat an id the greatest stays.
    """
    if common.repeats(docs):
        whole = docs.where("doc_id is not null").groupBy("doc_id").agg(
            F.max(F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])).alias("_r"))
        docs = whole.select("doc_id", "_r.*").select(docs.columns).union(docs.where("doc_id is null"))
    gone = common.store(ngram_join(docs).where("component_id <> doc_id").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that a smaller document holds too; what is cut empty goes.

    Characters that a cut splits go as well. Rows without an id stay as they are.
    ``n_chars``, where there is one, follows the text that was cut.
    """
    if "n_chars" not in docs.columns:
        return without_repeats(docs)
    flag = "_was_cut"
    while flag in docs.columns:
        flag += "_"
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    kept = without_repeats(docs, flag=flag)
    return kept.withColumn("n_chars", F.when(F.col(flag), length).otherwise(F.col("n_chars"))).select(docs.columns)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the labelled domains to ``KEEP``.

    Columns named like those that the operator adds keep their own values.
    """
    wide = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    mixed = mix(wide, common.table(spark, sf_dir, "labels"), keep=KEEP, cap=1.0)
    return mixed.where("copies >= 1").select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", repeats_removed),
    ("mixing", to_target_weights),
    ("packing", packed),
]

#: SQL can express neither the learned stages nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
