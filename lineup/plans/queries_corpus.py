"""Corpus index, counts, splits, filters and audits."""

from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..operators import corpus as C
from ..operators import models, pools
from ..operators.cases import stranger_requests
from ..operators.ranking import contiguous_positions
from . import views
from .oracle import okey
from .registry import register


@register("corpus_counts", """
SELECT c.corpus, count(DISTINCT c.group_id) AS n_groups, count(DISTINCT entity_id) AS n_entities,
       count(*) FILTER (role = 'query') AS n_query, count(*) FILTER (role = 'gallery') AS n_gallery,
       count(DISTINCT c.group_id) FILTER (family_size = 1) AS n_singleton_groups, count(DISTINCT item_id) AS n_events
FROM v_items c JOIN v_sizes USING (corpus, group_id) GROUP BY 1""")
def corpus_counts(spark, folder):
    return C.corpus_counts(views.items(spark, folder), "item_id")


@register("cells", "SELECT * FROM v_cells")
def cells(spark, folder):
    return C.cells(views.items(spark, folder))


@register("group_index", f"""
SELECT corpus, group_id, entity_id, source_id, role, chunk, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM (
  SELECT *, ((row_number() OVER (PARTITION BY corpus, group_id, entity_id, source_id, role ORDER BY {okey('index', 'item_id')}, item_id) - 1) // 5)::INT AS chunk
  FROM v_items) GROUP BY ALL""")
def group_index(spark, folder):
    index = C.group_index(views.items(spark, folder), chunk=5)
    return index.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@register("family_size_histogram", "SELECT corpus, family_size, count(*) AS n_groups FROM v_sizes GROUP BY ALL")
def family_size_histogram(spark, folder):
    return C.family_size_histogram(views.items(spark, folder))


@register("size_coverage", """
SELECT family_size, n_groups, round(n_groups * 100.0::DOUBLE / sum(n_groups) OVER (), 2) AS pct,
       round(sum(n_groups) OVER (ORDER BY family_size) * 100.0::DOUBLE / sum(n_groups) OVER (), 2) AS running_pct
FROM (SELECT family_size, count(*) AS n_groups FROM (SELECT group_id, count(DISTINCT entity_id) AS family_size FROM v_items GROUP BY 1) GROUP BY 1)""")
def size_coverage(spark, folder):
    return C.size_coverage(views.items(spark, folder))


@register("group_profile", """
SELECT corpus, group_id, count(DISTINCT entity_id) AS n_entities, count(DISTINCT source_id) AS n_sources FROM v_items GROUP BY ALL""")
def group_profile(spark, folder):
    return C.group_profile(views.items(spark, folder))


@register("groups_above", """
SELECT corpus, k, count(*) FILTER (family_size > k) AS n_groups FROM v_sizes, range(1, 6) t(k) GROUP BY ALL""")
def groups_above(spark, folder):
    return C.groups_above(views.items(spark, folder))


@register("sources_per_entity", """
SELECT corpus, entity_id, count(DISTINCT source_id) AS n_sources, count(DISTINCT source_id) > 1 AS several_sources
FROM v_items GROUP BY ALL""")
def sources_per_entity(spark, folder):
    return C.sources_per_entity(views.items(spark, folder))


@register("group_tiers", "SELECT * FROM v_tiers")
def group_tiers(spark, folder):
    return C.group_tiers(views.items(spark, folder))


@register("split_by_tier", "SELECT * FROM v_split")
def split_by_tier(spark, folder):
    return C.split_by_tier(C.group_tiers(views.items(spark, folder)))


@register("split_entities", f"""
SELECT entity_id, CASE WHEN row_number() OVER (ORDER BY {okey('entities', 'entity_id')}, entity_id) <= 100 THEN 'train' ELSE 'test' END AS split
FROM (SELECT DISTINCT entity_id FROM v_items)""")
def split_entities(spark, folder):
    return C.split_entities(views.items(spark, folder), 100)


@register("split_fraction", f"""
SELECT item_id, CASE WHEN row_number() OVER (ORDER BY {okey('fraction', 'item_id')}, item_id) <= floor(count(*) OVER () * 0.9::DOUBLE) THEN 'train' ELSE 'eval' END AS split
FROM v_items""")
def split_fraction(spark, folder):
    return C.split_fraction(views.items(spark, folder), "item_id", 0.9)


@register("group_adjacent_order", f"""
SELECT group_id, item_id, row_number() OVER (ORDER BY {okey('adjacent', 'group_id')}, group_id, item_id) - 1 AS pos FROM v_items""")
def group_adjacent_order(spark, folder):
    rows = views.items(spark, folder).select("group_id", "item_id")
    return C.group_adjacent_order(rows, "group_id", "item_id")


@register("contiguous_positions", f"""
SELECT group_id, item_id, row_number() OVER (ORDER BY {okey('numbering', 'group_id')}, group_id, {okey('numbering', 'item_id')}, item_id) - 1 AS pos
FROM v_items""")
def positions(spark, folder):
    rows = views.items(spark, folder).select("group_id", "item_id")
    return contiguous_positions(rows, ["group_id"], "item_id", "numbering")[0]


@register("filter_split", "SELECT item_id, group_id, role FROM v_items JOIN (SELECT group_id FROM v_split WHERE split = 'test') USING (group_id)")
def filter_split(spark, folder):
    items = views.items(spark, folder)
    split = C.split_by_tier(C.group_tiers(items))
    return C.filter_split(items, split, "test").select("item_id", "group_id", "role")


@register("complement_split", "SELECT group_id FROM v_split WHERE split = 'train'")
def complement_split(spark, folder):
    split = C.split_by_tier(C.group_tiers(views.items(spark, folder)))
    return C.complement_split(split, split.filter("split = 'test'"))


@register("filter_membership", "SELECT item_id, entity_id FROM v_items WHERE vec_id IN (SELECT vec_id FROM embeddings WHERE label < 5)")
def filter_membership(spark, folder):
    listed = views.table(spark, folder, "embeddings").filter("label < 5")
    return C.filter_membership(views.items(spark, folder), listed, "vec_id").select("item_id", "entity_id")


@register("filter_group_kind", """
SELECT corpus, item_id, CASE WHEN family_size = 1 THEN 'singleton' ELSE 'family' END AS kind
FROM v_items JOIN v_sizes USING (corpus, group_id)""")
def filter_group_kind(spark, folder):
    items = views.items(spark, folder)
    kinds = [
        C.filter_group_kind(items, kind).select("corpus", "item_id", F.lit(kind).alias("kind"))
        for kind in ("singleton", "family")
    ]
    return kinds[0].unionByName(kinds[1])


@register("merge_roles", """
SELECT corpus, group_id, entity_id, source_id, item_id, r.role FROM v_items, (VALUES ('query'), ('gallery')) r(role)""")
def merge_roles(spark, folder):
    return C.merge_roles(views.items(spark, folder)).select(*C.CELL, "item_id", "role")


@register("stranger_pool", "SELECT corpus, group_id, entity_id, item_id FROM v_items WHERE role = 'query'")
def stranger_pool(spark, folder):
    return C.stranger_pool(views.items(spark, folder))


@register("item_metadata", """
SELECT vec_id AS item_id, arg_max(group_id, r) AS group_id, arg_max(entity_id, r) AS entity_id FROM (
  SELECT vec_id, corpus, max(group_id * 1000000 + entity_id) // 1000000 AS group_id, max(group_id * 1000000 + entity_id) % 1000000 AS entity_id,
         CASE corpus WHEN 'same' THEN 1 ELSE 2 END AS r FROM v_items GROUP BY vec_id, corpus) GROUP BY 1""")
def item_metadata(spark, folder):
    """Vectors shared by several items stand for items listed twice."""
    items = views.items(spark, folder).groupBy(F.col("vec_id").alias("item_id"), "corpus").agg(
        F.max(F.struct("group_id", "entity_id")).alias("o")
    ).select("item_id", "corpus", "o.*")
    return C.item_metadata(items, ["same", "cross"])


@register("corpus_overlap", "SELECT entity_id FROM v_items WHERE corpus = 'same' INTERSECT SELECT entity_id FROM v_items WHERE corpus = 'cross'")
def corpus_overlap(spark, folder):
    return C.entity_overlap(views.items(spark, folder), "same", "cross")


@register("drop_eval_overlap", """
SELECT item_id, group_id FROM v_items WHERE group_id NOT IN (SELECT group_id FROM v_split WHERE split = 'test' AND tier = 'tier1')
  AND group_id NOT IN (SELECT group_id FROM v_split WHERE split = 'test' AND tier = 'tier3')""")
def drop_eval_overlap(spark, folder):
    items = views.items(spark, folder)
    test = C.split_by_tier(C.group_tiers(items)).filter("split = 'test'")
    kept = C.drop_eval_overlap(items, test.filter("tier = 'tier1'"), test.filter("tier = 'tier3'"))
    return kept.select("item_id", "group_id")


@register("leakage_by_scenario", """
SELECT t.corpus AS scenario, count(DISTINCT t.entity_id) AS n_entities,
       count(DISTINCT t.entity_id) FILTER (t.entity_id IN (SELECT entity_id FROM v_items JOIN v_split USING (group_id) WHERE tier <> 'tier2')) AS leaked_entities,
       count(DISTINCT t.group_id) AS n_groups,
       count(DISTINCT t.group_id) FILTER (t.group_id IN (SELECT group_id FROM v_split WHERE tier <> 'tier2')) AS leaked_groups
FROM v_items t JOIN v_split s USING (group_id) WHERE s.split = 'test' GROUP BY 1""")
def leakage_by_scenario(spark, folder):
    """Train on tiers one and three, audit the test groups: leaks are certain."""
    items = views.items(spark, folder)
    split = C.split_by_tier(C.group_tiers(items))
    train = items.join(split.filter("tier <> 'tier2'").select("group_id"), "group_id", "left_semi")
    test = C.filter_split(items, split, "test").withColumn("scenario", F.col("corpus"))
    return C.leakage_by_scenario(train, test, ["same", "cross"])


@register("entity_index", f"""
SELECT entity_id, role, chunk, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM (
  SELECT *, ((row_number() OVER (PARTITION BY entity_id, role ORDER BY {okey('entity_index', 'position')}, position) - 1) // 10)::INT AS chunk
  FROM (SELECT entity_id, role, row_number() OVER (PARTITION BY role ORDER BY {okey('listing', 'item_id')}, item_id) - 1 AS position FROM v_items))
GROUP BY ALL""")
def entity_index(spark, folder):
    index = C.entity_index(views.items(spark, folder), chunk=10)
    return index.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@register("orphan_queries", """
SELECT DISTINCT corpus, entity_id FROM v_items WHERE role = 'query'
  AND (corpus, entity_id) NOT IN (SELECT (corpus, entity_id) FROM v_items WHERE role = 'gallery' AND source_id = 0)""")
def orphan_queries(spark, folder):
    """Audit of a corpus whose gallery kept one source only."""
    kept = views.items(spark, folder).filter("role = 'query' OR source_id = 0")
    return C.orphan_queries(kept)


_REJECTED = "SELECT doc_id FROM labels WHERE quality = 0"


def _cleaned(spark, folder):
    """Gallery items rejected by the labels of the documents they point to."""
    items = views.items(spark, folder)
    bad = views.table(spark, folder, "labels").filter("quality = 0").select(F.col("doc_id").alias("vec_id"))
    gone = items.filter("role = 'gallery'").join(bad, "vec_id", "left_semi").select("item_id")
    return items, items.join(gone, "item_id", "left_anti")


@register("removed_items", f"""
SELECT corpus, group_id, entity_id, source_id, item_id FROM v_items WHERE role = 'gallery' AND vec_id IN ({_REJECTED})""")
def removed_items(spark, folder):
    return C.removed_items(*_cleaned(spark, folder))


@register("removal_report", f"""
SELECT corpus, count(*) AS n_original, count(*) FILTER (NOT bad) AS n_kept, count(*) FILTER (bad) AS n_removed,
       round(count(*) FILTER (bad) * 100.0::DOUBLE / count(*), 2) AS pct_removed,
       count(DISTINCT group_id) FILTER (bad) AS affected_groups, count(DISTINCT entity_id) FILTER (bad) AS affected_entities
FROM (SELECT *, vec_id IN ({_REJECTED}) AS bad FROM v_items WHERE role = 'gallery') GROUP BY 1""")
def removal_report(spark, folder):
    return C.removal_report(*_cleaned(spark, folder))


@register("emptied_entities", """
SELECT corpus, group_id, entity_id FROM v_items WHERE role = 'gallery' GROUP BY ALL HAVING count(*) FILTER (source_id = 0) = 0""")
def emptied_entities(spark, folder):
    """Cleaning that kept one source empties the entities never seen there."""
    items = views.items(spark, folder)
    return C.emptied_entities(items, items.filter("role = 'query' OR source_id = 0"))


@register("verdict_filter", """
SELECT item_id, role, NOT (role = 'gallery' AND contains(path, '_CAM3_')) AS keep FROM v_paths""")
def verdict_filter(spark, folder):
    """A rule stands in for the model: it answers NO for one camera."""

    def rule(paths):
        return "\n".join("no" if "_CAM3_" in p else "YES" for p in paths)

    rows = views.paths(spark, folder).join(
        views.items(spark, folder).select("item_id", "group_id", "entity_id", "source_id"), "item_id"
    )
    return models.filter_by_verdict(rows, rule).select("item_id", "role", "keep")


@register("embed_items", """
SELECT path, round(length(path) / n, 5) AS a, round(ones / n, 5) AS b, round(1 / n, 5) AS c
FROM (SELECT *, sqrt(length(path) * length(path) + ones * ones + 1) AS n
      FROM (SELECT path, length(path) - length(replace(path, '1', '')) AS ones FROM v_paths))""")
def embed_items(spark, folder):
    """Two counts of the path stand in for a model's output."""

    def encode(paths):
        return [[len(p), p.count("1"), 1] for p in paths]

    vectors = models.embed_items(views.paths(spark, folder), encode)
    return vectors.select("path", *[
        F.round(F.col("vec")[i].cast("double"), 5).alias(n) for i, n in enumerate("abc")
    ])


@register("cache_misses", "SELECT DISTINCT path FROM v_paths WHERE role = 'query'")
def cache_misses(spark, folder):
    paths = views.paths(spark, folder)
    cache = paths.filter("role = 'gallery'").select("path", F.lit("m1").alias("model")).union(
        paths.select("path", F.lit("m2"))
    )
    return models.cache_misses(paths, cache, "m1")


@register("valid_triples", "SELECT * FROM v_triples")
def valid_triples(spark, folder):
    return pools.valid_triples(views.items(spark, folder))


@register("feasible_pairs", """
WITH n AS (SELECT corpus, group_id, entity_id, source_id, count(*) AS n FROM v_items GROUP BY ALL)
SELECT a.corpus, a.group_id, a.entity_id, a.source_id, c.camera, s.family_size
FROM n a CROSS JOIN (VALUES ('same'), ('cross')) c(camera) JOIN v_sizes s USING (corpus, group_id)
JOIN n m ON m.corpus = a.corpus AND m.group_id = a.group_id
 AND ((c.camera = 'same' AND m.source_id = a.source_id AND (m.entity_id <> a.entity_id OR m.n >= 2))
   OR (c.camera = 'cross' AND m.source_id <> a.source_id))
GROUP BY ALL HAVING count(DISTINCT m.entity_id) = s.family_size""")
def feasible_pairs(spark, folder):
    cell = views.items(spark, folder).groupBy(*C.CELL).agg(F.count("*").alias("n"))
    return pools.feasible_pairs(cell)


@register("pool_sizes", """
SELECT q.corpus, q.group_id, q.entity_id, q.source_id, q.item_id, c.camera,
       count(*) FILTER (g.group_id = q.group_id AND g.entity_id = q.entity_id AND (g.source_id = q.source_id) = (c.camera = 'same')) AS positives,
       count(*) FILTER (g.group_id = q.group_id AND g.entity_id <> q.entity_id AND (g.source_id = q.source_id) = (c.camera = 'same')) AS family_negatives,
       (SELECT count(*) FROM v_items o WHERE o.role = 'gallery' AND o.corpus = q.corpus AND o.group_id <> q.group_id) AS outside
FROM v_items q CROSS JOIN (VALUES ('same'), ('cross')) c(camera)
LEFT JOIN (SELECT * FROM v_items WHERE role = 'gallery') g ON g.corpus = q.corpus AND g.group_id = q.group_id
WHERE q.role = 'query' GROUP BY ALL""")
def pool_sizes(spark, folder):
    return pools.pool_sizes(views.items(spark, folder))


@register("stranger_draw", """
SELECT case_id, query_id, stranger_group FROM v_all_family_q""")
def stranger_draw(spark, folder):
    items = views.items(spark, folder)
    requests = stranger_requests(items, "family")
    return pools.draw_strangers(requests, C.stranger_pool(items)).select(
        "case_id", "query_id", "stranger_group"
    )


@register("top_entities", """
SELECT entity_id, n_cases, rank FROM (
  SELECT entity_id, count(*) AS n_cases, row_number() OVER (ORDER BY count(*) DESC, entity_id) AS rank
  FROM v_items WHERE role = 'query' GROUP BY 1) WHERE rank <= 50""")
def top_entities(spark, folder):
    return C.top_entities(views.items(spark, folder).filter("role = 'query'"))


@register("spread_three", """
SELECT corpus, entity_id, item_id FROM (
  SELECT *, row_number() OVER (PARTITION BY corpus, entity_id ORDER BY item_id) - 1 AS p, count(*) OVER (PARTITION BY corpus, entity_id) AS n
  FROM v_items WHERE role = 'query') WHERE n <= 3 OR p IN (0, n // 3, 2 * n // 3)""")
def spread_three(spark, folder):
    queries = views.items(spark, folder).filter("role = 'query'").select("corpus", "entity_id", "item_id")
    return C.spread_three(queries, ["corpus", "entity_id"], "item_id")


@register("even_quota", f"""
SELECT entity_id, 1001 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY {okey('quota', 'entity_id')}, entity_id) <= 1001 % count(*) OVER () THEN 1 ELSE 0 END AS quota
FROM (SELECT DISTINCT entity_id FROM v_items)""")
def even_quota(spark, folder):
    return C.even_quota(views.items(spark, folder).select("entity_id").distinct(), "entity_id", 1001)


@register("sample_rates", """
SELECT corpus, group_id, family_size, CASE family_size WHEN 1 THEN 1 WHEN 2 THEN 4 ELSE 4 END AS n_wanted FROM v_sizes""")
def sample_rates(spark, folder):
    return C.sample_rates(C.family_sizes(views.items(spark, folder)), {1: 1, 2: 4})


@register("capped_union", f"""
SELECT corpus, item_id, {okey('union', 'corpus', 'item_id')} AS order_key FROM (
  SELECT corpus, item_id, row_number() OVER (PARTITION BY corpus ORDER BY {okey('cap', 'item_id')}, item_id) AS r FROM v_items) WHERE r <= 1000""")
def capped_union(spark, folder):
    items = views.items(spark, folder).select("corpus", "item_id")
    parts = [items.filter(F.col("corpus") == c) for c in ("same", "cross")]
    return C.union_corpora(parts, "corpus", "item_id", 1000)


@register("hash_order", f"SELECT item_id, {okey('show', 'item_id', 'corpus')} AS k FROM v_items")
def hash_order(spark, folder):
    return views.items(spark, folder).select("item_id", order_key("show", "item_id", "corpus").alias("k"))
