"""Scoring cases with embeddings, reading answers, and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import answer_kind, extract_answer, index_to_letter, is_correct
from ..functions.text import fill_product, product_name
from ..functions.vectors import cosine
from .cases import CASE, letter_cases, score

STRANGER_THRESHOLD = 0.5


def best_of_gallery(scored: DataFrame) -> DataFrame:
    """Highest similarity and its 1-based position; ties take the first."""
    best = F.max(F.struct("sim", (-F.col("pos")).alias("minus")))
    return scored.groupBy(*CASE, "label", "n_gallery").agg(best.alias("best")).select(
        *CASE, "label", "n_gallery", F.col("best.sim").alias("max_sim"),
        (-F.col("best.minus")).alias("argmax"),
    )


def rank_similarities(scored: DataFrame) -> DataFrame:
    """Gallery positions by falling similarity, as one list per case."""
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("minus"), "pos")))
    return scored.groupBy("case_id").agg(
        F.array_join(F.transform(pairs, lambda p: p["pos"].cast("string")), ",").alias("ranking")
    )


def predict(best: DataFrame, threshold: Column | float) -> DataFrame:
    """Letter and index predictions; below the threshold it is the stranger."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    stranger = F.col("max_sim") < t
    letter = F.when(stranger, F.char(F.lit(65) + F.col("stranger_slot"))).otherwise(
        index_to_letter(F.col("argmax") - 1, "stranger_slot")
    )
    return best.withColumns({
        "prediction": letter,
        "prediction_index": F.when(stranger, F.lit(-1)).otherwise(F.col("argmax")),
        "correct": is_correct(letter, "answer_letter"),
    })


def score_embeddings(
    slots: DataFrame, vectors: DataFrame, threshold: float = STRANGER_THRESHOLD,
) -> DataFrame:
    """One scored row per case: best match, prediction and correctness."""
    return predict(letter_cases(best_of_gallery(score(slots, vectors, 6))), threshold)


def threshold_sweep(best: DataFrame, thresholds: list[float]) -> DataFrame:
    """Accuracy per scenario at many thresholds; cases are scored once.

    ``best`` holds lettered cases with ``max_sim`` and ``argmax``.
    """
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    tried = predict(best.select("*", steps), F.col("threshold"))
    return tried.groupBy("scenario", "threshold").agg(
        F.count("*").alias("n_cases"),
        F.count_if("correct").alias("n_correct"),
        F.round(F.avg(F.col("correct").cast("int")) * 100, 2).alias("accuracy"),
    )


def accuracy(rows: DataFrame, by: list[str], correct: str = "correct",
             answered: str | None = None) -> DataFrame:
    """Accuracy over all rows; with ``answered`` also over the answered ones."""
    ok = F.count_if(F.col(correct))
    measures = [
        F.count("*").alias("n_cases"), ok.alias("n_correct"),
        F.round(ok * 100.0 / F.count("*"), 2).alias("accuracy"),
    ]
    if answered:
        replied = F.count_if(F.col(answered))
        measures += [
            replied.alias("n_answered"),
            F.round(
                F.when(replied > 0, ok * 100.0 / replied), 2
            ).alias("accuracy_answered"),
        ]
    return rows.groupBy(*by).agg(*measures)


def evaluate_responses(rows: DataFrame, profile: str = "full") -> DataFrame:
    """Read each response and compare it with the label as text."""
    answer = extract_answer("response", profile)
    return rows.withColumn("prediction", answer).withColumns({
        "answer_kind": answer_kind("prediction"),
        "correct": is_correct("prediction", "label"),
    })


def fill_predictions(rows: DataFrame, default: str = "-1", profile: str = "api") -> DataFrame:
    """Fill empty predictions from the response; ``conflict`` marks a row whose
    given prediction differs from its response."""
    given = F.nullif(F.trim(F.col("prediction")), F.lit(""))
    read = extract_answer("response", profile)
    return rows.withColumns({"_given": given, "_read": read}).select(
        *[c for c in rows.columns if c != "prediction"],
        F.coalesce("_given", "_read", F.lit(default)).alias("prediction"),
        F.col("_given").isNull().alias("filled"),
        (F.col("_given").isNotNull() & F.col("_read").isNotNull()
         & (F.col("_given") != F.col("_read"))).alias("conflict"),
    )


def prediction_conflicts(filled: DataFrame) -> DataFrame:
    return filled.filter("conflict")


def assert_no_conflicts(filled: DataFrame, where: str, key: str) -> DataFrame:
    """Pass rows through; fail naming the first conflicting file and row."""
    message = F.concat(
        F.lit("prediction differs from response in "), F.col(where).cast("string"),
        F.lit(" row "), F.col(key).cast("string"),
    )
    checked = F.when(F.col("conflict"), F.raise_error(message).cast("string")).otherwise(
        F.col("prediction")
    )
    return filled.withColumn("prediction", checked)


SOURCES = ("expert", "model", "hybrid")


def compare_sources(
    cases: DataFrame, expert: DataFrame, model: DataFrame, hybrid: DataFrame,
) -> DataFrame:
    """Three predictions side by side for the cases all sources have.

    ``cases`` has ``case_id, scenario, answer_letter``; each source ``case_id,
    prediction``.
    """
    wide = cases
    for name, source in zip(SOURCES, (expert, model, hybrid)):
        wide = wide.join(
            source.select("case_id", F.col("prediction").alias(f"{name}_pred")), "case_id"
        )
    return wide.withColumns({
        f"{name}_correct": is_correct(f"{name}_pred", "answer_letter") for name in SOURCES
    })


def common_index(cases: DataFrame, *sources: DataFrame) -> DataFrame:
    """How many cases each input and their intersection hold."""
    tagged = cases.select("case_id", F.lit(1).alias("bit"))
    for i, source in enumerate(sources, start=1):
        tagged = tagged.union(source.select("case_id", F.lit(1 << i)))
    everywhere = (1 << (len(sources) + 1)) - 1
    masks = tagged.groupBy("case_id").agg(F.bit_or("bit").alias("mask"))
    counts = [
        F.count_if(F.col("mask").bitwiseAND(1 << i) != 0).alias(f"n_{i}")
        for i in range(len(sources) + 1)
    ]
    return masks.agg(*counts, F.count_if(F.col("mask") == everywhere).alias("n_common"))


def limit_common(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.orderBy(key).limit(n)


def accuracy_rollup(compared: DataFrame) -> DataFrame:
    """Accuracies and differences per scenario, and ``OVERALL`` over all cases."""
    n = F.count("*")
    ok = {name: F.count_if(F.col(f"{name}_correct")) for name in SOURCES}

    def pct(x):
        return F.round(x * 100.0 / n, 2)

    return compared.rollup("scenario").agg(
        F.grouping("scenario").alias("_all"), n.alias("n_cases"),
        *[pct(ok[name]).alias(f"{name}_acc") for name in SOURCES],
        pct(ok["hybrid"] - ok["model"]).alias("delta_vs_model"),
        pct(ok["hybrid"] - ok["expert"]).alias("delta_vs_expert"),
    ).withColumn(
        "scenario", F.when(F.col("_all") == 1, "OVERALL").otherwise(F.col("scenario"))
    ).drop("_all")


def follow_override(compared: DataFrame) -> DataFrame:
    """How often the hybrid repeats the expert and how often it departs."""
    same = F.count_if(F.col("hybrid_pred").eqNullSafe(F.col("expert_pred")))
    n = F.count("*")
    return compared.groupBy("scenario").agg(
        n.alias("n_cases"), same.alias("n_follow"), (n - same).alias("n_override"),
        F.round(same * 100.0 / n, 2).alias("pct_follow"),
    )


def trivial_baseline(cases: DataFrame) -> DataFrame:
    """Accuracy of always answering the first position, per scenario."""
    return cases.groupBy("scenario").agg(
        F.count("*").alias("n_cases"),
        F.round(F.avg((F.col("label") == 1).cast("int")) * 100, 2).alias("first_position_acc"),
    )


def caption_similarity(pairs: DataFrame, generated: str = "generated_vec",
                       truth: str = "true_vec") -> DataFrame:
    """Cosine of generated and true caption vectors."""
    return pairs.withColumn("similarity", F.round(cosine(generated, truth), 6))


def fill_products(rows: DataFrame, texts: list[str], path: str) -> DataFrame:
    """Put the product's readable name in place of its tag."""
    return rows.withColumns({t: fill_product(t, product_name(path)) for t in texts})


def attach_captions(rows: DataFrame, captions: DataFrame, key: Column) -> DataFrame:
    """Look captions up by path suffix; rows without one get null."""
    keyed = rows.withColumn("caption_key", key)
    return keyed.join(captions.select("caption_key", "caption"), "caption_key", "left").select(
        *keyed.columns, "caption"
    )


def filter_captioned(rows: DataFrame, captions: DataFrame, key: Column) -> DataFrame:
    keyed = rows.withColumn("caption_key", key)
    return keyed.join(captions.select("caption_key"), "caption_key", "left_semi").select(
        keyed.columns
    )
