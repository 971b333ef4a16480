"""Distributions over finished cases and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import query_status
from ..functions.hashing import order_key
from .ranking import chunked_lists


def gallery_size_distribution(cases: DataFrame) -> DataFrame:
    return cases.groupBy("scenario", "n_gallery").agg(F.count("*").alias("n_cases"))


def benchmark_summary(cases: DataFrame) -> DataFrame:
    """Entities and cases per scenario. ``cases`` has ``scenario, entity_id``."""
    per = cases.groupBy("scenario", "entity_id").agg(F.count("*").alias("n"))
    return per.groupBy("scenario").agg(
        F.count("*").alias("n_entities"), F.sum("n").alias("n_cases")
    )


def cases_per(cases: DataFrame, key: str) -> DataFrame:
    return cases.groupBy(key).agg(F.count("*").alias("n_cases"))


def case_category_stats(cases: DataFrame) -> DataFrame:
    """Counts by corpus, camera rule and family size, with the gallery size."""
    return cases.groupBy("corpus", "camera", "family_size", "n_gallery").agg(
        F.count("*").alias("n_cases")
    )


def letter_distribution(lettered: DataFrame) -> DataFrame:
    """Counts by answer letter, by stranger slot and by status, in one pass."""
    rows = lettered.select(
        "answer_letter", F.char(F.lit(65) + F.col("stranger_slot")).alias("stranger_letter"),
        query_status("label").alias("status"),
    )
    named = F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).alias("value"))
        for c in ("answer_letter", "stranger_letter", "status")
    ])).alias("m")
    return rows.select(named).groupBy("m.measure", "m.value").agg(F.count("*").alias("n_cases"))


def sample_cases(cases: DataFrame, n: int) -> DataFrame:
    """``n`` cases for inspection, without replacement."""
    return cases.orderBy(order_key("inspect", "case_id"), "case_id").limit(n)


def decision_summary(decisions: DataFrame) -> DataFrame:
    """Totals over the decision log, also usable on a stream."""
    verdict = F.col("verdict")
    return decisions.agg(
        F.count("*").alias("n_items"),
        F.count_if(verdict.startswith("new")).alias("n_new"),
        F.count_if(verdict == "matched").alias("n_matched"),
    )


def summary_by_key(decisions: DataFrame, key: str = "group_id") -> DataFrame:
    verdict = F.col("verdict")
    return decisions.groupBy(key).agg(
        F.count("*").alias("n_items"),
        F.count_if(verdict.startswith("new")).alias("n_new"),
        F.count_if(verdict == "matched").alias("n_matched"),
    )


def items_per_entity(decisions: DataFrame, key: str = "group_id", chunk: int = 10_000) -> DataFrame:
    """Items of each assigned entity, in rows of at most ``chunk`` items."""
    lists = chunked_lists(
        decisions.select(key, "assigned_to", "item_id"), [key, "assigned_to"], "item_id",
        "assigned", "items", chunk,
    )
    return lists.withColumn("n_items", F.size("items"))


def representative(decisions: DataFrame, key: str = "group_id") -> DataFrame:
    """First item assigned to each entity."""
    return decisions.groupBy(key, "assigned_to").agg(
        F.min_by("item_id", F.struct("ts", "item_id")).alias("representative"),
        F.count("*").alias("n_items"),
    )


def answer_pivot(answers: DataFrame, models: list[str]) -> DataFrame:
    """One row per question, one column per model. ``answers`` has ``question,
    model, answer``; a repeated answer keeps the smallest."""
    return answers.groupBy("question").pivot("model", models).agg(F.min("answer"))
