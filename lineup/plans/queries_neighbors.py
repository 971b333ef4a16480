"""Nearest neighbours and similarity pools."""

from pyspark.sql import functions as F

from ..operators import cases as K
from ..operators import knn
from ..session import cut
from . import views
from .oracle import TABLES, four_draws, hbits, hint, okey, pair_key, shuffled
from .registry import register

THRESHOLD = 0.15


def owned(spark, folder):
    """Vectors with their label as owner."""
    return views.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").alias("owner_id"),
        F.col("embedding").alias("vec"),
    )


def pool(spark, folder) -> K.Pool:
    """All items, with the vector store written once."""
    items = views.items(spark, folder)
    vectors = items.select("item_id", "group_id", "vec_id").join(views.vectors(spark, folder), "vec_id")
    owned = cut(vectors.select("item_id", "group_id", "vec"))
    return K.Pool(
        items.select("item_id", "group_id", "entity_id"), owned.select("item_id", "vec"), owned=owned
    )


def pool_of(spark, folder, named) -> K.Pool:
    """The same items under the groups that ``named`` gives them: ``item_id, group_id, entity_id``."""
    meta = named.select("item_id", "group_id", "entity_id")
    groups = meta.groupBy("item_id").agg(F.collect_set("group_id").alias("groups"))
    keyed = views.items(spark, folder).select("item_id", "vec_id").join(groups, "item_id", "left")
    stored = cut(keyed.join(views.vectors(spark, folder), "vec_id").select("item_id", "groups", "vec"))
    owned = stored.select("item_id", F.explode("groups").alias("group_id"), "vec")
    return K.Pool(meta, stored.select("item_id", "vec"), owned=owned)


TABLES["v_owned"] = "SELECT vec_id AS item_id, label AS owner_id FROM embeddings"


@register("knn_topk", """
SELECT query_id, nbr_id, rank, sim FROM (
  SELECT a AS query_id, b AS nbr_id, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS rank FROM v_sims) WHERE rank <= 20""")
def knn_topk(spark, folder):
    vectors = owned(spark, folder)
    return knn.knn_topk(vectors, vectors, 20)


@register("knn_items", """
SELECT query_id, nbr_id, rank, sim FROM (
  SELECT q.item_id AS query_id, c.item_id AS nbr_id, s.sim,
         row_number() OVER (PARTITION BY q.item_id ORDER BY s.sim DESC, c.item_id) AS rank
  FROM v_items q JOIN v_sims s ON s.a = q.vec_id JOIN v_items c ON c.vec_id = s.b WHERE q.role = 'query') WHERE rank <= 10""")
def knn_items(spark, folder):
    p = pool(spark, folder)
    queries = views.items(spark, folder).filter("role = 'query'").select("item_id")
    return knn.knn_topk(p.vectors.join(queries, "item_id", "left_semi"), p.vectors, 10)


@register("intra_group_similarity", """
WITH pairs AS (SELECT a.item_id, a.owner_id, b.item_id AS other, s.sim, list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS exact
               FROM v_owned a JOIN v_owned b ON b.owner_id = a.owner_id AND b.item_id <> a.item_id
               JOIN v_sims s ON s.a = a.item_id AND s.b = b.item_id
               JOIN embeddings x ON x.vec_id = a.item_id JOIN embeddings y ON y.vec_id = b.item_id)
SELECT item_id, owner_id, count(*) + 1 AS n_items, round(avg(exact), 6) AS mean_sim,
       arg_min(other, (-sim, other)) AS nearest, max(sim) AS nearest_sim FROM pairs GROUP BY ALL""")
def intra_group_similarity(spark, folder):
    return knn.intra_group_similarity(owned(spark, folder))


TABLES["v_pool"] = f"""
SELECT a.item_id AS query_id, b.item_id, s.sim, {pair_key(hbits('pool_query', 'a.item_id'), hbits('pool_item', 'b.item_id'))} AS key
FROM v_owned a JOIN v_sims s ON s.a = a.item_id JOIN v_owned b ON b.item_id = s.b
WHERE b.owner_id <> a.owner_id AND s.sim >= {THRESHOLD}"""


@register("threshold_pool", """
SELECT query_id, count(*) AS pool_size FROM v_pool GROUP BY 1""")
def threshold_pool(spark, folder):
    vectors = owned(spark, folder)
    return knn.sampled_pool(vectors, vectors, THRESHOLD, 4).filter("rank = 1").select("query_id", "pool_size")


TABLES["v_threshold_negatives"] = """
SELECT query_id, item_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY key, item_id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM v_pool)
WHERE r <= 4 AND n >= 4"""


@register("threshold_negatives", "SELECT * FROM v_threshold_negatives")
def threshold_negatives(spark, folder):
    vectors = owned(spark, folder)
    return knn.threshold_negatives(knn.sampled_pool(vectors, vectors, THRESHOLD, 4), 5)


TABLES["v_own_order"] = f"""
SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY {okey('item', 'item_id')}, item_id) - 1 AS rank,
       count(*) OVER (PARTITION BY owner_id) AS n FROM v_owned"""

TABLES["v_positive"] = f"""
SELECT q.item_id AS query_id, g.item_id FROM v_own_order q JOIN v_own_order g ON g.owner_id = q.owner_id
WHERE q.n > 1 AND g.rank = {hint('0', 'q.n - 2', 'positive', 'q.item_id')}
   + CASE WHEN {hint('0', 'q.n - 2', 'positive', 'q.item_id')} >= q.rank THEN 1 ELSE 0 END"""


def _cases_sql(scenario: str, negatives: str) -> None:
    TABLES[f"v_{scenario}_q"] = f"""
SELECT DISTINCT concat_ws('|', '{scenario}', p.query_id) AS case_id, '{scenario}' AS scenario, p.query_id
FROM v_positive p JOIN {negatives} n USING (query_id)"""
    TABLES[f"v_{scenario}_s"] = shuffled(f"""
SELECT q.case_id, p.item_id, 'own' AS kind FROM v_{scenario}_q q JOIN v_positive p USING (query_id)
UNION ALL SELECT q.case_id, n.item_id, 'negative' FROM v_{scenario}_q q JOIN {negatives} n USING (query_id)""", f"v_{scenario}_q")


_cases_sql("similarity", "v_threshold_negatives")


@register("similarity_cases", "SELECT case_id, scenario, query_id, pos, item_id, kind, label, n_gallery FROM v_similarity_s")
def similarity_cases(spark, folder):
    vectors = owned(spark, folder)
    return K.similarity_cases(vectors, vectors, 5, THRESHOLD)


# Products: twelve vectors each; the first one represents the product.
def products(spark, folder):
    return views.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.expr("vec_id div 12").alias("owner_id"),
        F.col("embedding").alias("vec"),
    )


TABLES["v_products"] = "SELECT vec_id AS item_id, vec_id // 12 AS owner_id FROM embeddings"
TABLES["v_product_pool"] = f"""
SELECT q.item_id AS query_id, g.item_id, s.sim,
       row_number() OVER (PARTITION BY q.item_id ORDER BY {hbits('product', 'g.owner_id')}, g.owner_id, {okey('item', 'g.item_id')}, g.item_id) - 1 AS spot,
       count(*) OVER (PARTITION BY q.item_id) AS n
FROM v_products q JOIN v_sims s ON s.a = q.owner_id * 12 AND s.sim > {THRESHOLD}
JOIN v_products g ON g.owner_id * 12 = s.b AND g.owner_id <> q.owner_id"""
TABLES["v_product_draws"] = four_draws("(SELECT DISTINCT query_id, n FROM v_product_pool WHERE n >= 4)", "n", "product_pool", "query_id", "spot")
TABLES["v_product_negatives"] = "SELECT query_id, item_id, sim FROM v_product_pool JOIN v_product_draws USING (query_id, n, spot)"

TABLES["v_product_order"] = TABLES["v_own_order"].replace("v_owned", "v_products")
TABLES["v_product_positive"] = TABLES["v_positive"].replace("v_own_order", "v_product_order")
_cases_sql("product", "v_product_negatives")
for _name in ("v_product_q", "v_product_s"):
    TABLES[_name] = TABLES[_name].replace("v_positive", "v_product_positive")


@register("product_pool", f"""
SELECT q.item_id AS query_id, count(*) AS pool_size FROM v_products q JOIN v_sims s ON s.a = q.owner_id * 12 AND s.sim > {THRESHOLD}
JOIN v_products g ON g.owner_id * 12 = s.b AND g.owner_id <> q.owner_id GROUP BY 1""")
def product_pool(spark, folder):
    return knn.product_pool(products(spark, folder), THRESHOLD, 4).filter("rank = 1").select("query_id", "pool_size")


@register("product_negatives", "SELECT * FROM v_product_negatives")
def product_negatives(spark, folder):
    return knn.threshold_negatives(knn.product_pool(products(spark, folder), THRESHOLD, 4), 5)


@register("product_cases", "SELECT case_id, scenario, query_id, pos, item_id, kind, label, n_gallery FROM v_product_s")
def product_cases(spark, folder):
    return K.product_cases(products(spark, folder), 5, THRESHOLD)


@register("hard_negatives", """
WITH firsts AS (
  SELECT q.item_id AS query_id, c.group_id AS nbr_group, arg_min(c.item_id, (-s.sim, c.item_id)) AS nbr_id, max(s.sim) AS sim
  FROM v_items q JOIN v_sims s ON s.a = q.vec_id JOIN v_items c ON c.vec_id = s.b
  WHERE q.role = 'query' AND c.group_id <> q.group_id GROUP BY ALL)
SELECT query_id, nbr_group, nbr_id, sim, group_rank
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, nbr_id) AS group_rank FROM firsts) WHERE group_rank <= 10""")
def hard_negatives(spark, folder):
    p = pool(spark, folder)
    queries = views.items(spark, folder).filter("role = 'query'").select(F.col("item_id").alias("query_id"))
    return K.candidates_for(queries, p, 10)
