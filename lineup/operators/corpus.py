"""Corpus index, counts, tiers, filters and audits over the item table.

The item table has ``item_id, group_id, entity_id, source_id, role, corpus``.
Most operators start from ``cells``, the counts per (corpus, group, entity,
source), so items are shuffled once, after map-side counting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import (
    chunked_lists, fine_buckets, group_rank, prefix_sum, quota, range_buckets, skew_join, top_n,
)
from ..functions.hashing import order_key
from ..functions.names import entity_of_path, group_of_entity, source_of_path

CELL = ["corpus", "group_id", "entity_id", "source_id"]


def cells(items: DataFrame) -> DataFrame:
    """Query and gallery counts per (corpus, group, entity, source)."""
    return items.groupBy(*CELL).agg(
        F.count_if(F.col("role") == "query").alias("n_query"),
        F.count_if(F.col("role") == "gallery").alias("n_gallery"),
    )


def group_index(items: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Item lists per cell and role, in rows of at most ``chunk`` items."""
    return chunked_lists(items, [*CELL, "role"], "item_id", "index", "items", chunk)


def corpus_counts(items: DataFrame, event: str = "event_id") -> DataFrame:
    """Groups, entities, events, items per role and singleton groups per corpus."""
    entities = items.groupBy("corpus", "group_id", "entity_id").agg(
        F.count_if(F.col("role") == "query").alias("q"),
        F.count_if(F.col("role") == "gallery").alias("g"),
    )
    groups = entities.groupBy("corpus", "group_id").agg(
        F.count("*").alias("members"), F.sum("q").alias("q"), F.sum("g").alias("g")
    )
    totals = groups.groupBy("corpus").agg(
        F.count("*").alias("n_groups"),
        F.sum("members").alias("n_entities"),
        F.sum("q").alias("n_query"),
        F.sum("g").alias("n_gallery"),
        F.count_if(F.col("members") == 1).alias("n_singleton_groups"),
    )
    events = (
        items.select("corpus", event).distinct()
        .groupBy("corpus").agg(F.count("*").alias("n_events"))
    )
    return totals.join(events, "corpus")


def family_sizes(items: DataFrame, by_corpus: bool = True) -> DataFrame:
    """Distinct entities per group."""
    by = ["corpus", "group_id"] if by_corpus else ["group_id"]
    return items.select(*by, "entity_id").distinct().groupBy(*by).agg(
        F.count("*").alias("family_size")
    )


def family_size_histogram(items: DataFrame) -> DataFrame:
    return family_sizes(items).groupBy("corpus", "family_size").agg(
        F.count("*").alias("n_groups")
    )


def size_coverage(items: DataFrame) -> DataFrame:
    """Percent and running percent of groups by size, over both corpora."""
    sizes = family_sizes(items, by_corpus=False).groupBy("family_size").agg(
        F.count("*").alias("n_groups")
    )
    everything = W.partitionBy()
    running = everything.orderBy("family_size").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("n_groups").over(everything)
    # One row per distinct size: a histogram, so one task is enough.
    return sizes.select(
        "family_size", "n_groups",
        F.round(F.col("n_groups") * 100.0 / total, 2).alias("pct"),
        F.round(F.sum("n_groups").over(running) * 100.0 / total, 2).alias("running_pct"),
    )


def group_profile(items: DataFrame) -> DataFrame:
    """Distinct sources and entities per group and corpus."""
    cell = items.select(*CELL).distinct()
    by_source = cell.select("corpus", "group_id", "source_id").distinct()
    by_entity = cell.select("corpus", "group_id", "entity_id").distinct()
    return by_entity.groupBy("corpus", "group_id").agg(
        F.count("*").alias("n_entities")
    ).join(
        by_source.groupBy("corpus", "group_id").agg(F.count("*").alias("n_sources")),
        ["corpus", "group_id"],
    )


def groups_above(items: DataFrame, up_to: int = 5) -> DataFrame:
    """Groups with more than k entities, k = 1..up_to, per corpus."""
    steps = F.explode(F.sequence(F.lit(1), F.lit(up_to))).alias("k")
    sizes = family_size_histogram(items)
    return sizes.select("*", steps).groupBy("corpus", "k").agg(
        F.coalesce(
            F.sum(F.when(F.col("family_size") > F.col("k"), F.col("n_groups"))), F.lit(0)
        ).alias("n_groups")
    )


def sources_per_entity(items: DataFrame) -> DataFrame:
    return items.select("corpus", "entity_id", "source_id").distinct().groupBy(
        "corpus", "entity_id"
    ).agg(F.count("*").alias("n_sources"), (F.count("*") > 1).alias("several_sources"))


def group_tiers(items: DataFrame) -> DataFrame:
    """tier1: some source holds gallery items of two members; tier2: no such
    source; tier3: at most one member over both corpora."""
    cell = cells(items)
    members = cell.select("group_id", "entity_id").distinct().groupBy("group_id").agg(
        F.count("*").alias("family_size")
    )
    shared = (
        cell.filter("n_gallery > 0").groupBy("corpus", "group_id", "source_id")
        .agg(F.count("*").alias("members")).filter("members >= 2")
        .select("group_id").distinct().withColumn("shared", F.lit(True))
    )
    tier = (
        F.when(F.col("family_size") <= 1, "tier3")
        .when(F.col("shared"), "tier1").otherwise("tier2")
    )
    return members.join(shared, "group_id", "left").select(
        "group_id", "family_size", tier.alias("tier")
    )


# Groups set aside for test per tier.
TEST_SIZES = {"tier1": 30, "tier2": 15, "tier3": 70}


def split_by_tier(tiers: DataFrame, sizes: dict[str, int] = TEST_SIZES) -> DataFrame:
    """Per tier, the first ``sizes[tier]`` groups in hash order are test."""
    wanted = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    first = top_n(
        tiers, ["tier"], [order_key("split", "group_id"), F.col("group_id")],
        max(sizes.values()),
    )
    test = first.filter(F.col("rank") <= F.element_at(wanted, F.col("tier"))).select(
        "group_id", F.lit("test").alias("split")
    )
    return tiers.join(test, "group_id", "left").select(
        "group_id", "tier", F.coalesce("split", F.lit("train")).alias("split")
    )


def split_entities(items: DataFrame, n_train: int) -> DataFrame:
    """The first ``n_train`` entities in hash order are train."""
    entities = items.select("entity_id").distinct()
    ranked = group_rank(entities, [], order_key("entities", "entity_id"), "entity_id")
    return ranked.select(
        "entity_id",
        F.when(F.col("rank") < n_train, "train").otherwise("test").alias("split"),
    )


def split_fraction(rows: DataFrame, key: str, fraction: float) -> DataFrame:
    """The first ``floor(n * fraction)`` rows in hash order are train."""
    ranked = group_rank(rows.select(key), [], order_key("fraction", key), key, total="n")
    is_train = F.col("rank") < F.floor(F.col("n") * F.lit(fraction))
    return ranked.select(key, F.when(is_train, "train").otherwise("eval").alias("split"))


def group_adjacent_order(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """Shuffle groups but keep each group's rows adjacent, in ``seq`` order, a
    number or text that no two rows of a group share."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    starts = prefix_sum(sizes, [], order_key("adjacent", group), group, "n", "offset")
    bucket = range_buckets(rows, seq)
    inside = group_rank(
        rows, [group], seq, seq, "_in", bucket, attach=starts.select(group, "offset")
    )
    return inside.select(
        *rows.columns, (F.col("offset") + F.col("_in")).alias("pos")
    )


def filter_split(items: DataFrame, split: DataFrame, name: str) -> DataFrame:
    """Items whose group is in one split."""
    chosen = split.filter(F.col("split") == name).select("group_id")
    return skew_join(items, chosen, ["group_id"], "left_semi")


def filter_membership(items: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """Items listed in ``names`` (one column ``on``)."""
    return items.join(names.select(on).distinct(), on, "left_semi").select(items.columns)


def filter_group_kind(items: DataFrame, kind: str) -> DataFrame:
    """Singleton groups have one member in their corpus, families two or more."""
    sizes = family_sizes(items)
    keep = F.col("family_size") == 1 if kind == "singleton" else F.col("family_size") >= 2
    chosen = sizes.filter(keep).select("corpus", "group_id")
    return skew_join(items, chosen, ["corpus", "group_id"], "left_semi")


def items_from_paths(paths: DataFrame, path: str = "path") -> DataFrame:
    """Items with the group, entity and source that their paths name, as text.

    ``paths`` has ``item_id, role, corpus`` and the path. A path that names no
    entity gives no item.
    """
    parsed = paths.select(
        "item_id", "role", "corpus",
        entity_of_path(path).alias("entity_id"), source_of_path(path).alias("source_id"),
    )
    return parsed.filter("entity_id is not null").withColumn(
        "group_id", group_of_entity("entity_id")
    ).filter("group_id is not null")


def merge_roles(items: DataFrame) -> DataFrame:
    """Each distinct item, once as query and once as gallery."""
    rest = [c for c in items.columns if c != "role"]
    roles = F.explode(F.array(F.lit("query"), F.lit("gallery"))).alias("role")
    return items.dropDuplicates([*CELL, "item_id"]).select(*rest, roles)


def stranger_pool(items: DataFrame) -> DataFrame:
    """Every query-role item of both corpora; an item in both counts twice."""
    return items.filter(F.col("role") == "query").select(
        "corpus", "group_id", "entity_id", "item_id"
    )


def item_metadata(items: DataFrame, corpus_order: list[str]) -> DataFrame:
    """Item -> (group, entity); the last corpus named in the list wins."""
    rank = F.array_position(F.array(*[F.lit(c) for c in corpus_order]), F.col("corpus"))
    newest = F.max_by(F.struct("group_id", "entity_id"), rank)
    return items.groupBy("item_id").agg(newest.alias("owner")).select(
        "item_id", "owner.group_id", "owner.entity_id"
    )


def unique_items(cases: DataFrame) -> DataFrame:
    """Distinct items named by any case, as query or in its gallery."""
    return cases.select(F.col("query_id").alias("item_id")).union(
        cases.select("item_id")
    ).distinct()


def entity_overlap(items: DataFrame, left: str, right: str) -> DataFrame:
    """Entities present in both corpora."""
    one = items.filter(F.col("corpus") == left).select("entity_id")
    two = items.filter(F.col("corpus") == right).select("entity_id")
    return one.intersect(two)


def drop_eval_overlap(items: DataFrame, *evaluations: DataFrame) -> DataFrame:
    """Items of groups that occur in no evaluation corpus."""
    seen = evaluations[0].select("group_id")
    for other in evaluations[1:]:
        seen = seen.union(other.select("group_id"))
    return skew_join(items, seen.distinct(), ["group_id"], "left_anti")


def complement_split(groups: DataFrame, test: DataFrame) -> DataFrame:
    return groups.select("group_id").exceptAll(test.select("group_id"))


def filter_train_leakage(slots: DataFrame, meta: DataFrame, test: DataFrame) -> DataFrame:
    """Drop a case when its query or any gallery item is in a test group."""
    owners = meta.join(test.select("group_id"), "group_id", "left_semi").select("item_id")
    named = slots.select("case_id", F.col("query_id").alias("item_id")).union(
        slots.select("case_id", "item_id")
    )
    leaking = named.join(owners, "item_id", "left_semi").select("case_id").distinct()
    return slots.join(leaking, "case_id", "left_anti")


def leakage_by_scenario(train: DataFrame, evaluation: DataFrame, scenarios: list[str]) -> DataFrame:
    """Overlapping entities and groups per scenario.

    Inputs name ``group_id, entity_id``; ``evaluation`` also ``scenario``. A
    scenario without rows raises: an audit of nothing must not pass.
    """
    known_e = train.select("entity_id").distinct().withColumn("_e", F.lit(1))
    known_g = train.select("group_id").distinct().withColumn("_g", F.lit(1))
    entities = evaluation.select("scenario", "entity_id").distinct()
    groups = evaluation.select("scenario", "group_id").distinct()
    per_entity = entities.join(known_e, "entity_id", "left").groupBy("scenario").agg(
        F.count("*").alias("n_entities"), F.count("_e").alias("leaked_entities")
    )
    per_group = groups.join(known_g, "group_id", "left").groupBy("scenario").agg(
        F.count("*").alias("n_groups"), F.count("_g").alias("leaked_groups")
    )
    spark = evaluation.sparkSession
    wanted = spark.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario")
    )
    missing = F.raise_error(F.concat(F.lit("no cases to audit in "), F.col("scenario")))
    checked = F.coalesce(F.col("n_entities"), missing.cast("long"))
    return (
        wanted.join(per_entity.join(per_group, "scenario"), "scenario", "left")
        .withColumn("n_entities", checked)
    )


def entity_index(items: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Positions of each entity's items in the query and gallery lists."""
    key = order_key("listing", "item_id")
    ranked = group_rank(items, ["role"], key, "item_id", "position", fine_buckets(key))
    return chunked_lists(
        ranked.select("entity_id", "role", "position"), ["entity_id", "role"],
        "position", "entity_index", "positions", chunk,
    )


def orphan_queries(items: DataFrame) -> DataFrame:
    """Query entities without any gallery item: an error in a split."""
    q = items.filter(F.col("role") == "query").select("corpus", "entity_id").distinct()
    g = items.filter(F.col("role") == "gallery").select("corpus", "entity_id").distinct()
    return q.join(g, ["corpus", "entity_id"], "left_anti")


def removed_items(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Gallery items of the original that the cleaned corpus no longer has."""
    key = [*CELL, "item_id"]
    was = original.filter(F.col("role") == "gallery").select(*key)
    now = cleaned.filter(F.col("role") == "gallery").select(*key)
    return was.join(now, key, "left_anti")


def removal_report(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Counts before and after, per corpus, all from the full tables."""
    before = original.filter(F.col("role") == "gallery").groupBy("corpus").agg(
        F.count("*").alias("n_original")
    )
    lost = removed_items(original, cleaned).groupBy("corpus", "group_id", "entity_id").agg(
        F.count("*").alias("n")
    )
    groups = lost.groupBy("corpus", "group_id").agg(
        F.sum("n").alias("n"), F.count("*").alias("entities")
    )
    total = groups.groupBy("corpus").agg(
        F.sum("n").alias("removed"),
        F.count("*").alias("groups"),
        F.sum("entities").alias("entities"),
    )
    joined = before.join(total, "corpus", "left").na.fill(0)
    return joined.select(
        "corpus", "n_original",
        (F.col("n_original") - F.col("removed")).alias("n_kept"),
        F.col("removed").alias("n_removed"),
        F.round(F.col("removed") * 100.0 / F.col("n_original"), 2).alias("pct_removed"),
        F.col("groups").alias("affected_groups"),
        F.col("entities").alias("affected_entities"),
    )


def emptied_entities(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Entities that had gallery items and have none left."""
    key = ["corpus", "group_id", "entity_id"]
    was = original.filter(F.col("role") == "gallery").select(*key).distinct()
    now = cleaned.filter(F.col("role") == "gallery").select(*key).distinct()
    return was.join(now, key, "left_anti")


def top_entities(cases: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` entities with most cases; ties by id."""
    counts = cases.groupBy("entity_id").agg(F.count("*").alias("n_cases"))
    best = counts.orderBy(F.desc("n_cases"), "entity_id").limit(n)
    # At most n rows from here on.
    order = W.partitionBy().orderBy(F.desc("n_cases"), "entity_id")
    return best.withColumn("rank", F.row_number().over(order))


def spread_three(cases: DataFrame, by: list[str], order: str) -> DataFrame:
    """Up to three cases per group at positions 0, n/3 and 2n/3 of the order, a
    number or text such as a path."""
    bucket = range_buckets(cases, order)
    ranked = group_rank(cases, by, order, order, "_pos", bucket, total="_n")
    n, pos = F.col("_n"), F.col("_pos")
    third = F.floor(n / 3)
    keep = (n <= 3) | pos.isin(0) | (pos == third) | (pos == F.floor(2 * n / 3))
    return ranked.filter(keep).drop("_n", "_pos")


def even_quota(keys: DataFrame, key: str, total: int, remainder: str = "first") -> DataFrame:
    """Share ``total`` over the keys; the remainder goes to the first or last."""
    ranked = group_rank(keys.select(key), [], order_key("quota", key), key, total="n")
    share = quota(F.lit(total).cast("long"), F.col("n"), F.col("rank"), remainder)
    return ranked.select(key, share.alias("quota"))


def cap_dataset(rows: DataFrame, source: str, key: str, n: int) -> DataFrame:
    """First ``n`` rows per source in hash order."""
    return top_n(rows, [source], [order_key("cap", key), F.col(key)], n).drop("rank")


def union_corpora(corpora: list[DataFrame], source: str, key: str, n: int) -> DataFrame:
    """Cap each corpus and append them; ``order_key`` gives the shuffled order."""
    whole = corpora[0]
    for other in corpora[1:]:
        whole = whole.unionByName(other, allowMissingColumns=True)
    return cap_dataset(whole, source, key, n).withColumn(
        "order_key", order_key("union", source, key)
    )


def sample_rates(
    sizes: DataFrame, rates: dict[int, int], size: str = "family_size",
) -> DataFrame:
    """Cases wanted per entity; a size without a rate gets the largest rate."""
    table = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])
    rate: Column = F.coalesce(
        F.try_element_at(table, F.col(size).cast("int")), F.lit(max(rates.values()))
    )
    return sizes.withColumn("n_wanted", rate)
