"""Scoring, answers, comparison and accuracy."""

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.hashing import hash_int
from ..operators import cases as K
from ..operators import reports as R
from ..operators import scoring as S
from ..session import cut
from . import views
from .oracle import REPLIES, TABLES, hint
from .queries_cases import suite
from .queries_neighbors import pool
from .registry import register

THRESHOLD = 0.2

TABLES["v_best"] = """
SELECT case_id, any_value(label) AS label, any_value(scenario) AS scenario, any_value(n_gallery) AS n_gallery, max(sim) AS max_sim, arg_min(pos, (-sim, pos)) AS argmax
FROM (SELECT s.*, v.sim FROM v_suite s JOIN v_items g USING (item_id) JOIN v_items q ON q.item_id = s.query_id
      JOIN v_sims v ON v.a = q.vec_id AND v.b = g.vec_id) GROUP BY case_id"""
_LETTER_OF = "chr((65 + CASE WHEN argmax - 1 < stranger_slot THEN argmax - 1 ELSE argmax END)::INT)"


def _predicted(threshold: str) -> str:
    return f"""
SELECT *, CASE WHEN max_sim < {threshold} THEN chr((65 + stranger_slot)::INT) ELSE {_LETTER_OF} END AS prediction,
       CASE WHEN max_sim < {threshold} THEN -1 ELSE argmax END AS prediction_index"""


TABLES["v_expert"] = _predicted(str(THRESHOLD)) + """
FROM v_best JOIN (SELECT case_id, stranger_slot, answer_letter FROM v_lettered) USING (case_id)"""


def scored(spark, folder):
    return S.score_embeddings(suite(spark, folder), pool(spark, folder).vectors, THRESHOLD)


@register("argmax_gallery", "SELECT case_id, max_sim, argmax FROM v_best")
def argmax_gallery(spark, folder):
    slots = K.score(suite(spark, folder), pool(spark, folder).vectors, 6)
    return S.best_of_gallery(slots).select("case_id", "max_sim", "argmax")


@register("rank_similarities", """
SELECT case_id, string_agg(pos::VARCHAR, ',' ORDER BY v.sim DESC, pos) AS ranking
FROM v_suite s JOIN v_items g USING (item_id) JOIN v_items q ON q.item_id = s.query_id
JOIN v_sims v ON v.a = q.vec_id AND v.b = g.vec_id GROUP BY 1""")
def rank_similarities(spark, folder):
    return S.rank_similarities(K.score(suite(spark, folder), pool(spark, folder).vectors, 6))


@register("score_embeddings", """
SELECT case_id, scenario, max_sim, argmax, stranger_slot, answer_letter, prediction, prediction_index, prediction = answer_letter AS correct FROM v_expert""")
def score_embeddings(spark, folder):
    return scored(spark, folder).drop("query_id", "label", "n_gallery")


@register("threshold_sweep", f"""
SELECT scenario, threshold, count(*) AS n_cases, count(*) FILTER (prediction = answer_letter) AS n_correct,
       round(count(*) FILTER (prediction = answer_letter) * 1.0::DOUBLE / count(*) * 100, 2) AS accuracy
FROM ({_predicted('threshold')} FROM v_best JOIN (SELECT case_id, stranger_slot, answer_letter FROM v_lettered) USING (case_id),
      (VALUES (0.0::DOUBLE), (0.1), (0.2), (0.3), (0.4), (0.5)) t(threshold)) GROUP BY ALL""")
def threshold_sweep(spark, folder):
    slots = K.score(suite(spark, folder), pool(spark, folder).vectors, 6)
    return S.threshold_sweep(
        K.letter_cases(S.best_of_gallery(slots)), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5]
    )


@register("accuracy_by_scenario", """
SELECT scenario, count(*) AS n_cases, count(*) FILTER (prediction = answer_letter) AS n_correct,
       round(count(*) FILTER (prediction = answer_letter) * 100.0::DOUBLE / count(*), 2) AS accuracy FROM v_expert GROUP BY 1""")
def accuracy_by_scenario(spark, folder):
    return S.accuracy(scored(spark, folder), ["scenario"])


@register("trivial_baseline", """
SELECT scenario, count(*) AS n_cases, round(avg((label = 1)::INT) * 100, 2) AS first_position_acc FROM v_heads GROUP BY 1""")
def trivial_baseline(spark, folder):
    return S.trivial_baseline(K.heads(suite(spark, folder)))


TABLES["v_cases3"] = "SELECT case_id, scenario, answer_letter, n_gallery FROM v_lettered"
TABLES["v_model"] = f"""
SELECT case_id, chr((65 + {hint('0', 'n_gallery', 'model', 'case_id')})::INT) AS prediction FROM v_cases3 WHERE {hint('0', '9', 'seen', 'case_id')} > 0"""
TABLES["v_hybrid"] = """
SELECT m.case_id, CASE WHEN m.prediction < e.prediction THEN m.prediction ELSE e.prediction END AS prediction FROM v_model m JOIN v_expert e USING (case_id)"""
TABLES["v_compared"] = """
SELECT c.case_id, c.scenario, c.answer_letter, e.prediction AS expert_pred, m.prediction AS model_pred, h.prediction AS hybrid_pred,
       e.prediction = c.answer_letter AS expert_correct, m.prediction = c.answer_letter AS model_correct, h.prediction = c.answer_letter AS hybrid_correct
FROM v_cases3 c JOIN v_expert e USING (case_id) JOIN v_model m USING (case_id) JOIN v_hybrid h USING (case_id)"""


def _sources(spark, folder):
    """The expert scores; a second source answers by hash and misses some cases;
    the third takes the earlier of the two letters."""
    expert = cut(scored(spark, folder))  # read by every source
    model = expert.filter(hash_int(0, 9, "seen", "case_id") > 0).select(
        "case_id",
        F.char(F.lit(65) + hash_int(F.lit(0), F.col("n_gallery"), "model", "case_id")).alias("prediction"),
    )
    hybrid = model.join(expert.select("case_id", F.col("prediction").alias("e")), "case_id").select(
        "case_id", F.least("prediction", "e").alias("prediction")
    )
    cases = expert.select("case_id", "scenario", "answer_letter")
    return cases, expert.select("case_id", "prediction"), model, hybrid


@register("compare_sources", "SELECT * FROM v_compared")
def compare_sources(spark, folder):
    return S.compare_sources(*_sources(spark, folder))


@register("common_index", """
SELECT (SELECT count(*) FROM v_cases3) AS n_0, (SELECT count(*) FROM v_expert) AS n_1, (SELECT count(*) FROM v_model) AS n_2,
       (SELECT count(*) FROM v_hybrid) AS n_3, (SELECT count(*) FROM v_compared) AS n_common""")
def common_index(spark, folder):
    return S.common_index(*_sources(spark, folder))


@register("limit_common", "SELECT case_id, hybrid_pred FROM v_compared ORDER BY case_id LIMIT 20")
def limit_common(spark, folder):
    compared = S.compare_sources(*_sources(spark, folder))
    return S.limit_common(compared, "case_id", 20).select("case_id", "hybrid_pred")


_PCT = "round(({x}) * 100.0::DOUBLE / count(*), 2)"
_E, _M, _H = (f"count(*) FILTER ({n}_correct)" for n in ("expert", "model", "hybrid"))


@register("accuracy_rollup", f"""
SELECT CASE WHEN grouping(scenario) = 1 THEN 'OVERALL' ELSE scenario END AS scenario, count(*) AS n_cases,
       {_PCT.format(x=_E)} AS expert_acc, {_PCT.format(x=_M)} AS model_acc, {_PCT.format(x=_H)} AS hybrid_acc,
       {_PCT.format(x=f'{_H} - {_M}')} AS delta_vs_model, {_PCT.format(x=f'{_H} - {_E}')} AS delta_vs_expert
FROM v_compared GROUP BY ROLLUP (scenario)""")
def accuracy_rollup(spark, folder):
    return S.accuracy_rollup(S.compare_sources(*_sources(spark, folder)))


@register("follow_override", """
SELECT scenario, count(*) AS n_cases, count(*) FILTER (hybrid_pred = expert_pred) AS n_follow, count(*) FILTER (hybrid_pred <> expert_pred) AS n_override,
       round(count(*) FILTER (hybrid_pred = expert_pred) * 100.0::DOUBLE / count(*), 2) AS pct_follow FROM v_compared GROUP BY 1""")
def follow_override(spark, folder):
    return S.follow_override(S.compare_sources(*_sources(spark, folder)))


_LIST = ", ".join("'" + r + "'" for r in REPLIES)
TABLES["v_replies"] = f"""
SELECT conv_id, turn, concat('run_', conv_id % 3, '.csv') AS file,
       concat(([{_LIST}])[((conv_id + turn) % {len(REPLIES)} + 1)::INT], ' ', text) AS response,
       (['B', '3', '-1', 'C'])[((conv_id + turn) % 4 + 1)::INT] AS label FROM conversations"""
# RE2 has ASCII word boundaries; the word class is written out instead.
_END = r"(?:$|[^\p{L}\p{N}\p{M}_])"
_START = r"(?:^|[^\p{L}\p{N}\p{M}_])"
_STEP = {
    "letter": rf"nullif(regexp_extract(response, 'Answer:\s*([A-Z]){_END}', 1), '')",
    "number": r"TRY_CAST(nullif(regexp_extract(response, '(?i)Answer:\s*(-?\d+)', 1), '') AS HUGEINT)::VARCHAR",
    "none": "CASE WHEN regexp_matches(response, '(?i)does not match any') THEN '-1' END",
    "gallery": r"TRY_CAST(nullif(regexp_extract(response, '(?i)gallery image\s+(-?\d+)', 1), '') AS HUGEINT)::VARCHAR",
    "capital": f"nullif(regexp_extract(response, '{_START}([A-Z]){_END}', 1), '')",
    "int": r"TRY_CAST(nullif(regexp_extract(response, '(-?\d+)', 1), '') AS HUGEINT)::VARCHAR",
}


def _cascade(*steps: str) -> str:
    return "coalesce(" + ", ".join(_STEP[s] for s in steps) + ")"


_FULL = _cascade("letter", "number", "none", "gallery", "capital", "int")
_API = _cascade("letter", "number", "none", "capital", "int")
TABLES["v_read"] = f"""
SELECT *, {_FULL} AS a_full, {_API} AS a_api, {_cascade('letter', 'capital')} AS a_letter,
       {_cascade('letter', 'number', 'none', 'gallery')} AS a_strict FROM v_replies"""


@register("extract_answers", "SELECT conv_id, turn, a_full, a_api, a_letter, a_strict FROM v_read")
def extract_answers(spark, folder):
    return views.replies(spark, folder).select("conv_id", "turn", *[
        A.extract_answer("response", p).alias(f"a_{p}") for p in ("full", "api", "letter", "strict")
    ])


@register("evaluate_responses", """
SELECT conv_id, turn, file, label, a_full AS prediction,
       CASE WHEN a_full IS NULL THEN 'none' WHEN regexp_full_match(a_full, '[A-Z]') THEN 'letter' ELSE 'number' END AS answer_kind,
       coalesce(a_full = label, false) AS correct FROM v_read""")
def evaluate_responses(spark, folder):
    return S.evaluate_responses(views.replies(spark, folder)).drop("response")


@register("accuracy_by_file", """
SELECT file, count(*) AS n_cases, count(*) FILTER (a_full = label) AS n_correct,
       round(count(*) FILTER (a_full = label) * 100.0::DOUBLE / count(*), 2) AS accuracy, count(a_full) AS n_answered,
       round(count(*) FILTER (a_full = label) * 100.0::DOUBLE / count(a_full), 2) AS accuracy_answered FROM v_read GROUP BY 1""")
def accuracy_by_file(spark, folder):
    rows = S.evaluate_responses(views.replies(spark, folder)).withColumn(
        "answered", F.col("prediction").isNotNull()
    )
    return S.accuracy(rows, ["file"], answered="answered")


_GIVEN = "CASE WHEN turn % 2 = 0 THEN '' ELSE ' ' || label END"


@register("fill_predictions", f"""
SELECT conv_id, turn, coalesce(nullif(trim({_GIVEN}), ''), a_api, '-1') AS prediction, turn % 2 = 0 AS filled,
       turn % 2 = 1 AND a_api IS NOT NULL AND a_api <> label AS conflict FROM v_read""")
def fill_predictions(spark, folder):
    given = F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.col("label")))
    rows = views.replies(spark, folder).withColumn("prediction", given)
    return S.fill_predictions(rows).select("conv_id", "turn", "prediction", "filled", "conflict")


@register("append_results", """
SELECT file, count(*) AS n_cases, count(*) FILTER (a_strict = label) AS n_correct,
       round(count(*) FILTER (a_strict = label) * 100.0::DOUBLE / count(*), 2) AS accuracy FROM v_read GROUP BY 1""")
def append_results(spark, folder):
    rows = S.evaluate_responses(views.replies(spark, folder), "strict")
    return S.accuracy(rows, ["file"])


@register("answer_pivot", """
SELECT conv_id AS question, min(text) FILTER (role = 'system') AS "system", min(text) FILTER (role = 'user') AS "user",
       min(text) FILTER (role = 'assistant') AS assistant
FROM conversations GROUP BY 1""")
def answer_pivot(spark, folder):
    answers = views.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("question"), F.col("role").alias("model"), F.col("text").alias("answer")
    )
    return R.answer_pivot(answers, ["system", "user", "assistant"])


@register("caption_similarity", """
SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
                       / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""")
def caption_similarity(spark, folder):
    """Each vector against the next one, as generated and true caption."""
    vectors = views.vectors(spark, folder)
    n = vectors.agg(F.count("*")).scalar()
    generated = vectors.select(
        "vec_id", ((F.col("vec_id") + 1) % n).alias("next"), F.col("vec").alias("generated_vec")
    )
    truth = vectors.select(F.col("vec_id").alias("next"), F.col("vec").alias("true_vec"))
    return S.caption_similarity(generated.join(truth, "next")).select("vec_id", "similarity")
