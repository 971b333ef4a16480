"""Case builders over the item view."""

from pyspark.sql import functions as F

from ..operators import cases as K
from ..operators import corpus as C
from ..operators import reports as R
from ..operators.ranking import top_n
from ..session import cut
from . import views
from .oracle import (
    SLOT, TABLES, family, four_draws, hint, known, okey, shuffled, singleton, stratified, variant,
)
from .queries_neighbors import pool, pool_of
from .registry import register

TABLES["v_heads"] = """
SELECT case_id, scenario, query_id, label, n_gallery FROM v_suite WHERE pos = 1"""
TABLES["v_lettered"] = f"""
SELECT *, chr((65 + CASE WHEN label = -1 THEN stranger_slot WHEN label - 1 < stranger_slot THEN label - 1 ELSE label END)::INT) AS answer_letter
FROM (SELECT *, {hint('0', 'n_gallery', 'slot', 'case_id')} AS stranger_slot FROM v_heads)"""


def suite(spark, folder):
    """The ten scenarios, built anew for each query that reads them."""
    return K.scenario_suite(views.items(spark, folder), pool(spark, folder))


@register("known_cases", f"SELECT {SLOT} FROM v_requests_s")
def known_cases(spark, folder):
    items = views.items(spark, folder)
    return K.known_cases(K.exhaustive_requests(items), items, pool(spark, folder))


@register("known_cases_sampled", f"SELECT {SLOT} FROM v_sampled_s")
def known_cases_sampled(spark, folder):
    items = views.items(spark, folder)
    return K.known_cases(K.sampled_requests(items), items, pool(spark, folder))


@register("stranger_cases_single", f"SELECT {SLOT} FROM v_all_singleton_s")
def stranger_cases_single(spark, folder):
    return K.exhaustive_strangers(views.items(spark, folder), pool(spark, folder), "singleton")


@register("stranger_cases_family", f"SELECT {SLOT} FROM v_all_family_s")
def stranger_cases_family(spark, folder):
    return K.exhaustive_strangers(views.items(spark, folder), pool(spark, folder), "family")


@register("stranger_cases_even_single", f"SELECT {SLOT} FROM v_even_singleton_s")
def stranger_cases_even_single(spark, folder):
    return K.stratified_strangers(views.items(spark, folder), pool(spark, folder), "singleton")


@register("stranger_cases_even_family", f"SELECT {SLOT} FROM v_even_family_s")
def stranger_cases_even_family(spark, folder):
    return K.stratified_strangers(views.items(spark, folder), pool(spark, folder), "family")


@register("scenario_suite", f"SELECT {SLOT} FROM v_suite")
def scenario_suite(spark, folder):
    return suite(spark, folder)


@register("resampled_requests", "SELECT scenario, case_id, group_id, source_id, camera FROM v_requests")
def resampled_requests(spark, folder):
    requests = K.exhaustive_requests(views.items(spark, folder))
    return requests.select("scenario", "case_id", "group_id", "source_id", "camera")


@register("letter_cases", "SELECT case_id, scenario, label, n_gallery, stranger_slot, answer_letter FROM v_lettered")
def letter_cases(spark, folder):
    return K.letter_cases(K.heads(suite(spark, folder))).drop("query_id")


@register("letter_distribution", """
SELECT 'answer_letter' AS measure, answer_letter AS value, count(*) AS n_cases FROM v_lettered GROUP BY ALL
UNION ALL SELECT 'stranger_letter', chr((65 + stranger_slot)::INT), count(*) FROM v_lettered GROUP BY ALL
UNION ALL SELECT 'status', CASE WHEN label > 0 THEN 'known' ELSE 'unknown' END, count(*) FROM v_lettered GROUP BY ALL""")
def letter_distribution(spark, folder):
    return R.letter_distribution(K.letter_cases(K.heads(suite(spark, folder))))


@register("gallery_size_distribution", "SELECT scenario, n_gallery, count(*) AS n_cases FROM v_heads GROUP BY ALL")
def gallery_size_distribution(spark, folder):
    return R.gallery_size_distribution(K.heads(suite(spark, folder)))


@register("benchmark_summary", """
SELECT scenario, count(DISTINCT entity_id) AS n_entities, count(*) AS n_cases FROM v_requests GROUP BY 1""")
def benchmark_summary(spark, folder):
    return R.benchmark_summary(K.exhaustive_requests(views.items(spark, folder)))


@register("cases_per_entity", "SELECT entity_id, count(*) AS n_cases FROM v_requests GROUP BY 1")
def cases_per_entity(spark, folder):
    return R.cases_per(K.exhaustive_requests(views.items(spark, folder)), "entity_id")


@register("sample_cases", f"""
SELECT case_id, scenario FROM v_requests ORDER BY {okey('inspect', 'case_id')}, case_id LIMIT 25""")
def sample_cases(spark, folder):
    requests = K.exhaustive_requests(views.items(spark, folder))
    return R.sample_cases(requests.select("case_id", "scenario"), 25)


@register("enrich_cases", """
SELECT s.case_id, s.pos, s.item_id, g.group_id::VARCHAR AS group_id, g.entity_id::VARCHAR AS entity_id,
       q.group_id::VARCHAR AS query_group_id, q.entity_id::VARCHAR AS query_entity_id
FROM v_suite s JOIN v_items g USING (item_id) JOIN v_items q ON q.item_id = s.query_id""")
def enrich_cases(spark, folder):
    meta = views.items(spark, folder).select("item_id", "group_id", "entity_id")
    return K.enrich(suite(spark, folder), meta).drop(
        "scenario", "query_id", "kind", "label", "n_gallery"
    )


@register("score_cases", """
SELECT case_id, pos, s.item_id, round(v.sim, 4) + 0.0 AS sim FROM v_suite s JOIN v_items g USING (item_id)
JOIN v_items q ON q.item_id = s.query_id
JOIN (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim FROM embeddings x, embeddings y) v
  ON v.a = q.vec_id AND v.b = g.vec_id""")
def score_cases(spark, folder):
    return K.score(suite(spark, folder), pool(spark, folder).vectors, 4).select(
        "case_id", "pos", "item_id", "sim"
    )


@register("unique_items", "SELECT query_id AS item_id FROM v_suite UNION SELECT item_id FROM v_suite")
def unique_items(spark, folder):
    return C.unique_items(suite(spark, folder))


@register("train_leakage_filter", """
SELECT case_id, pos, item_id FROM v_suite WHERE case_id NOT IN (
  SELECT case_id FROM (SELECT case_id, item_id FROM v_suite UNION SELECT case_id, query_id FROM v_suite)
  JOIN v_items USING (item_id) JOIN v_split USING (group_id) WHERE tier = 'tier2')""")
def train_leakage_filter(spark, folder):
    items = views.items(spark, folder)
    test = C.group_tiers(items).filter("tier = 'tier2'")
    kept = C.filter_train_leakage(suite(spark, folder), items.select("item_id", "group_id"), test)
    return kept.select("case_id", "pos", "item_id")


TABLES["v_merged"] = """
SELECT i.* EXCLUDE (role), r.role FROM v_items i, (VALUES ('query'), ('gallery')) r(role)"""
TABLES["v_feasible"] = """
SELECT a.corpus, a.group_id, a.entity_id, a.source_id, c.camera, s.family_size
FROM (SELECT corpus, group_id, entity_id, source_id, count(*) AS n FROM v_items GROUP BY ALL) a
CROSS JOIN (VALUES ('same'), ('cross')) c(camera) JOIN v_sizes s USING (corpus, group_id)
JOIN (SELECT corpus, group_id, entity_id, source_id, count(*) AS n FROM v_items GROUP BY ALL) m
  ON m.corpus = a.corpus AND m.group_id = a.group_id
 AND ((c.camera = 'same' AND m.source_id = a.source_id AND (m.entity_id <> a.entity_id OR m.n >= 2))
   OR (c.camera = 'cross' AND m.source_id <> a.source_id))
GROUP BY ALL HAVING count(DISTINCT m.entity_id) = s.family_size"""
TABLES["v_training"] = f"""
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY corpus, entity_id ORDER BY {okey('pair', 'camera', 'source_id')}, concat_ws('|', camera, source_id)) - 1 AS rank,
                       count(*) OVER (PARTITION BY corpus, entity_id) AS n FROM v_feasible),
draws AS (SELECT DISTINCT corpus, entity_id, n, draw FROM ranked, LATERAL (SELECT unnest(range(1, CASE WHEN family_size = 1 THEN 2 ELSE 3 END)) AS draw))
SELECT r.* EXCLUDE (rank, n), d.draw, 'train' AS scenario, concat_ws('|', 'train', r.corpus, r.entity_id, d.draw) AS case_id
FROM ranked r JOIN draws d ON d.corpus = r.corpus AND d.entity_id = r.entity_id
 AND r.rank = {hint('0', 'd.n - 1', 'pair', 'd.corpus', 'd.entity_id', 'd.draw')}"""
TABLES.update(known("v_training", merged=True, diverse=True, max_gallery=6, source="v_merged"))
TABLES["v_wanted"] = stratified(
    "v_targets", "train_stranger", "(SELECT floor(count(*) * 0.4::DOUBLE)::BIGINT FROM v_training)"
)
TABLES["v_wanted_single"] = "SELECT * FROM v_wanted WHERE family_size = 1"
TABLES["v_wanted_family"] = "SELECT * FROM v_wanted WHERE family_size > 1"
TABLES.update(singleton("v_wanted_single", 6, "v_merged"))
TABLES.update(family("v_wanted_family", 6, "v_merged", diverse=True))
TABLES["v_alone"] = f"""
SELECT corpus, entity_id, group_id, source_id, camera, 1 AS family_size, 'synthetic' AS scenario, concat_ws('|', 'synthetic', corpus, entity_id) AS case_id
FROM (SELECT p.*, row_number() OVER (PARTITION BY p.corpus, p.entity_id ORDER BY {okey('alone', 'p.corpus', 'p.entity_id', 'camera', 'source_id')}) AS r FROM (
  SELECT a.corpus, a.group_id, a.entity_id, a.source_id, c.camera
  FROM (SELECT *, sum(n) OVER (PARTITION BY corpus, entity_id) AS total FROM (SELECT corpus, group_id, entity_id, source_id, count(*) AS n FROM v_items GROUP BY ALL)) a
  CROSS JOIN (VALUES ('same'), ('cross')) c(camera) JOIN v_sizes s USING (corpus, group_id)
  WHERE s.family_size > 1 AND ((c.camera = 'same' AND a.n >= 2) OR (c.camera = 'cross' AND a.total > a.n))) p) WHERE r = 1"""
TABLES.update(known("v_alone", merged=True, whole=False, max_gallery=6, source="v_merged"))
TABLES["v_alone_stranger"] = """
SELECT DISTINCT i.corpus, i.group_id, i.entity_id, 'synthetic_stranger' AS scenario, concat_ws('|', 'synthetic_stranger', i.corpus, i.entity_id) AS case_id
FROM v_items i JOIN v_sizes s USING (corpus, group_id) WHERE s.family_size > 1"""
TABLES.update(singleton("v_alone_stranger", 6, "v_merged"))


@register("training_requests", "SELECT case_id, group_id, source_id, camera, family_size FROM v_training")
def training_requests(spark, folder):
    requests = K.training_requests(C.merge_roles(views.items(spark, folder)))
    return requests.select("case_id", "group_id", "source_id", "camera", "family_size")


@register("training_mix", f"""
SELECT {SLOT} FROM v_training_s UNION ALL SELECT {SLOT} FROM v_wanted_single_s UNION ALL SELECT {SLOT} FROM v_wanted_family_s""")
def training_mix(spark, folder):
    return K.training_set(views.items(spark, folder), pool(spark, folder))


@register("synthetic_singletons", f"SELECT {SLOT} FROM v_alone_s UNION ALL SELECT {SLOT} FROM v_alone_stranger_s")
def synthetic_singletons(spark, folder):
    return K.synthetic_singletons(C.merge_roles(views.items(spark, folder)), pool(spark, folder))


@register("case_category_stats", """
SELECT corpus, camera, family_size, n_gallery, count(*) AS n_cases FROM v_training JOIN (SELECT case_id, n_gallery FROM v_training_s WHERE pos = 1) USING (case_id)
GROUP BY ALL""")
def case_category_stats(spark, folder):
    merged = C.merge_roles(views.items(spark, folder))
    requests = K.training_requests(merged)
    slots = K.known_cases(requests, merged, pool(spark, folder), 6, merged=True, diverse=True)
    heads = K.heads(slots).select("case_id", "n_gallery")
    return R.case_category_stats(requests.join(heads, "case_id"))


TABLES["v_hh_pairs"] = """
SELECT q.corpus, q.group_id, q.entity_id, q.source_id, q.item_id AS query_id, c.camera,
       CASE WHEN s.family_size = 1 THEN 'singleton' ELSE 'family' END AS group_kind
FROM v_items q JOIN v_sizes s USING (corpus, group_id) CROSS JOIN (VALUES ('same'), ('cross')) c(camera) WHERE q.role = 'query'"""
TABLES["v_hh_pos"] = f"""
SELECT p.query_id, p.camera, g.item_id, count(*) OVER w AS n,
       row_number() OVER (w ORDER BY {okey('source', 'g.source_id')}, g.source_id, {okey('item', 'g.item_id')}, g.item_id) - 1 AS idx
FROM v_hh_pairs p JOIN v_items g ON g.role = 'gallery' AND g.corpus = p.corpus AND g.entity_id = p.entity_id
 AND (g.source_id = p.source_id) = (p.camera = 'same')
WINDOW w AS (PARTITION BY p.query_id, p.camera)"""
TABLES["v_hh_neg"] = f"""
SELECT p.query_id, p.camera, g.item_id, count(*) OVER w AS n,
       row_number() OVER (w ORDER BY {okey('source', 'g.source_id')}, g.source_id, {okey('entity', 'g.entity_id')}, g.entity_id, {okey('item', 'g.item_id')}, g.item_id) - 1 AS idx
FROM v_hh_pairs p JOIN v_items g ON g.role = 'gallery' AND g.corpus = p.corpus AND g.group_id = p.group_id AND g.entity_id <> p.entity_id
 AND (g.source_id = p.source_id) = (p.camera = 'same')
WHERE p.group_kind = 'family' WINDOW w AS (PARTITION BY p.query_id, p.camera)"""
TABLES["v_hh_corpus"] = f"""
SELECT corpus, group_id, item_id, row_number() OVER (PARTITION BY corpus ORDER BY {okey('groups', 'group_id')}, group_id, {okey('item', 'item_id')}, item_id) - 1 AS idx,
       count(*) OVER (PARTITION BY corpus) AS n_corpus, count(*) OVER (PARTITION BY corpus, group_id) AS n_group
FROM v_items WHERE role = 'gallery'"""
TABLES["v_hh_sizes"] = """
SELECT p.*, concat('cropped_', p.corpus, 'clothes_', p.group_kind, '_', p.camera, 'camera') AS scenario,
       a.n AS positives, CASE WHEN p.group_kind = 'family' THEN b.n ELSE c.n_corpus - c.n_group END AS negatives, c.first, c.n_group
FROM v_hh_pairs p JOIN (SELECT DISTINCT query_id, camera, n FROM v_hh_pos) a USING (query_id, camera)
LEFT JOIN (SELECT DISTINCT query_id, camera, n FROM v_hh_neg) b USING (query_id, camera)
LEFT JOIN (SELECT corpus, group_id, any_value(n_corpus) AS n_corpus, any_value(n_group) AS n_group, min(idx) AS first FROM v_hh_corpus GROUP BY ALL) c
  ON c.corpus = p.corpus AND c.group_id = p.group_id
WHERE a.n > 1 AND CASE WHEN p.group_kind = 'family' THEN b.n ELSE c.n_corpus - c.n_group END > 4"""


def _household(draws: int) -> dict[str, str]:
    q = f"v_hh{draws}_q"
    return {
        q: f"""
SELECT *, concat_ws('|', scenario, query_id, draw) AS case_id FROM v_hh_sizes, range(1, {draws + 1}) t(draw)""",
        f"v_hh{draws}_i": four_draws(q, "negatives", "negatives", "case_id", "i"),
        f"v_hh{draws}_s": shuffled(f"""
SELECT q.case_id, p.item_id, 'own' AS kind FROM {q} q JOIN v_hh_pos p ON p.query_id = q.query_id AND p.camera = q.camera
 AND p.idx = {hint('0', 'q.positives - 1', 'positive', 'q.case_id')}
UNION ALL SELECT i.case_id, n.item_id, 'negative' FROM v_hh{draws}_i i JOIN v_hh_neg n ON n.query_id = i.query_id AND n.camera = i.camera AND n.idx = i.i
WHERE i.group_kind = 'family'
UNION ALL SELECT i.case_id, c.item_id, 'negative' FROM v_hh{draws}_i i JOIN v_hh_corpus c ON c.corpus = i.corpus
 AND c.idx = i.i + CASE WHEN i.i >= i.first THEN i.n_group ELSE 0 END WHERE i.group_kind = 'singleton'""", q),
    }


TABLES.update(_household(1))
TABLES.update(_household(3))


@register("household_cases", f"SELECT {SLOT} FROM v_hh1_s")
def household_cases(spark, folder):
    return K.household_cases(views.items(spark, folder))


@register("household_cases_train", f"SELECT {SLOT} FROM v_hh3_s")
def household_cases_train(spark, folder):
    return K.household_cases(views.items(spark, folder), draws=3)


@register("household_test_selection", """
WITH h AS (SELECT s.scenario, q.entity_id, s.query_id, s.case_id FROM (SELECT * FROM v_hh1_s WHERE pos = 1) s JOIN v_items q ON q.item_id = s.query_id),
counts AS (SELECT scenario, entity_id, count(*) AS n FROM h GROUP BY scenario, entity_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY n DESC, entity_id) AS r FROM counts) WHERE r <= 50)
SELECT scenario, entity_id, query_id FROM (
  SELECT h.*, row_number() OVER (PARTITION BY scenario, entity_id ORDER BY query_id) - 1 AS p, count(*) OVER (PARTITION BY scenario, entity_id) AS n
  FROM h JOIN top USING (scenario, entity_id)) WHERE n <= 3 OR p IN (0, n // 3, 2 * n // 3)""")
def household_test_selection(spark, folder):
    """The test split keeps at most 50 entities and three cases of each."""
    items = views.items(spark, folder)
    heads = cut(K.heads(K.household_cases(items)).join(
        items.select(F.col("item_id").alias("query_id"), "entity_id"), "query_id"
    ).select("scenario", "entity_id", "query_id"))
    counts = heads.groupBy("scenario", "entity_id").agg(F.count("*").alias("n"))
    best = top_n(counts, ["scenario"], [F.desc("n"), F.col("entity_id")], 50)
    kept = heads.join(best.select("scenario", "entity_id"), ["scenario", "entity_id"], "left_semi")
    return C.spread_three(kept, ["scenario", "entity_id"], "query_id")


# The builders on the inputs that real corpora have: text ids out of paths, items
# that are query and gallery item at once, splits, and galleries without padding.
TABLES["v_one_singleton"] = "SELECT * FROM v_all_singleton"
TABLES.update(singleton("v_one_singleton", 1))
TABLES["v_requests_u"] = shuffled("SELECT * FROM v_requests_m", "v_requests_q")
TABLES["v_all_family_u"] = shuffled("SELECT * FROM v_all_family_m", "v_all_family_q")
_TRAINING = f"""
SELECT {SLOT} FROM v_training_s UNION ALL SELECT {SLOT} FROM v_wanted_single_s UNION ALL SELECT {SLOT} FROM v_wanted_family_s"""
TABLES["v_training_set"] = _TRAINING

variant("names", """
SELECT item_id, concat('10', group_id, '_20') AS group_id, concat('10', group_id, '_20_', entity_id) AS entity_id,
       concat('CAM', source_id) AS source_id, role, corpus, vec_id, ts, value FROM v_items""")
variant("flat", """
SELECT i.* EXCLUDE (role), r.role FROM (SELECT DISTINCT ON (corpus, group_id, entity_id, source_id, item_id) * FROM v_items) i
CROSS JOIN (VALUES ('query'), ('gallery')) r(role)""")
variant("test", "SELECT i.* FROM v_items i JOIN v_split s USING (group_id) WHERE s.split = 'test'")
variant("train", "SELECT i.* FROM v_items i JOIN v_split s USING (group_id) WHERE s.split = 'train'")


@register("suite_from_names", f"SELECT {SLOT} FROM v_suite__names")
def suite_from_names(spark, folder):
    """Group, entity and source ids are the text that the item paths hold."""
    named = cut(C.items_from_paths(views.paths(spark, folder)))  # every step reads it
    return K.scenario_suite(named, pool_of(spark, folder, named))


@register("suite_flat", f"SELECT {SLOT} FROM v_suite__flat")
def suite_flat(spark, folder):
    """Every item is a query and a gallery item; no case lists its own query."""
    return K.scenario_suite(C.merge_roles(views.items(spark, folder)), pool(spark, folder))


@register("suite_unpadded", f"""
SELECT {SLOT} FROM v_requests_u UNION ALL SELECT {SLOT} FROM v_one_singleton_s UNION ALL SELECT {SLOT} FROM v_all_family_u""")
def suite_unpadded(spark, folder):
    return K.scenario_suite(views.items(spark, folder), pool(spark, folder), padded=False)


def _splits(spark, folder):
    return C.split_by_tier(C.group_tiers(views.items(spark, folder)))


@register("suite_by_split", f"SELECT {SLOT} FROM v_suite__test")
def suite_by_split(spark, folder):
    items = views.items(spark, folder)
    return K.suite_by_split(items, _splits(spark, folder), pool(spark, folder), "test")


@register("training_by_split", f"SELECT {SLOT} FROM v_training_set__train")
def training_by_split(spark, folder):
    items = views.items(spark, folder)
    return K.training_by_split(items, _splits(spark, folder), pool(spark, folder), "train")
