"""Candidate pools and draws from them.

A pool is never listed per request. Items are numbered inside their entity and
inside their (group, source); a draw is an index into such a numbering with the
excluded range skipped, and the item is fetched by an equi-join on its number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_int, order_key
from ..session import cut
from .corpus import CELL, cells
from .ranking import contiguous_positions, group_rank, prefix_sum, skew_join

ENTITY = ["corpus", "entity_id"]
GROUP_SOURCE = ["corpus", "group_id", "source_id"]


@dataclass(frozen=True)
class Layout:
    """Numbered items and the extents of their cells.

    items: ``CELL, item_id, pos_entity`` and, numbered by source, ``pos_source, pos_group``
    cells: ``CELL, n, off_entity, n_entity`` and ``off_source, n_source, off_group``
    """

    items: DataFrame
    cells: DataFrame

    @property
    def entities(self) -> DataFrame:
        return self.cells.select("corpus", "group_id", "entity_id", "n_entity").distinct()


def layout(items: DataFrame, by_source: bool = False, counted: DataFrame | None = None) -> Layout:
    """Number items by (source, item) in an entity.

    ``by_source`` also numbers them by (entity, item) in a (group, source), and by
    (source, entity, item) in a group; ``off_group`` is where the source begins there.
    ``counted`` gives the items' cells, ``CELL, n``, where they are stored already.
    """
    cell = counted if counted is not None else cut(items.groupBy(*CELL).agg(F.count("*").alias("n")))
    extents = prefix_sum(
        cell, ENTITY, order_key("source", "source_id"), "source_id", "n", "off_entity",
        total="n_entity",
    )
    offsets = ["off_entity"]
    if by_source:
        extents = prefix_sum(
            extents, GROUP_SOURCE, order_key("entity", "entity_id"), "entity_id", "n",
            "off_source", total="n_source",
        )
        sources = prefix_sum(
            extents.select(*GROUP_SOURCE, "n_source").distinct(), ["corpus", "group_id"],
            order_key("source", "source_id"), "source_id", "n_source", "off_group",
        )
        extents = extents.join(sources.select(*GROUP_SOURCE, "off_group"), GROUP_SOURCE)
        offsets.append("off_source")
    # Both tables are read several times by every builder.
    extents = cut(extents)
    placed = group_rank(
        items.select(*CELL, "item_id"), CELL, order_key("item", "item_id"), "item_id", "_in",
        attach=extents.select(*CELL, *offsets, *(["off_group"] if by_source else [])),
    )
    in_group = [(F.col("off_group") + F.col("off_source") + F.col("_in")).alias("pos_group")] if by_source else []
    numbered = cut(placed.select(
        *CELL, "item_id",
        *[(F.col(o) + F.col("_in")).alias(o.replace("off", "pos")) for o in offsets], *in_group,
    ))
    return Layout(numbered, extents)


def valid_triples(items: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(group, entity, source) where a case can be built, per camera rule.

    The entity has a query item on the source, and every member has a gallery
    item on that source (``same``) or on some other source (``cross``). A member
    fails ``cross`` only when it has no gallery item off the source, so counting
    members replaces the comparison of every member with every triple. Where an
    item has both roles, ``same`` needs a gallery item besides the query. ``counted`` is
    ``cells(items)`` where that is stored already.
    """
    # Read for the members, the sources and the candidates.
    cell = cut((counted if counted is not None else cells(items)).join(_twofold(items), CELL, "left").na.fill(0, ["n_both"]))
    key = ["corpus", "group_id"]
    members = cell.groupBy(*key, "entity_id").agg(F.sum("n_gallery").alias("g"))
    sizes = members.groupBy(*key).agg(
        F.count("*").alias("family_size"), F.count_if(F.col("g") > 0).alias("with_gallery")
    )
    on_source = (
        cell.filter("n_gallery > 0").join(members, [*key, "entity_id"])
        .groupBy(*key, "source_id").agg(
            F.count("*").alias("here"),
            F.count_if(F.col("n_gallery") == F.col("g")).alias("only_here"),
        )
    )
    rules = F.explode(F.array(F.lit("same"), F.lit("cross"))).alias("camera")
    candidates = (
        cell.filter("n_query > 0").join(sizes, key)
        .join(on_source, [*key, "source_id"], "left").na.fill(0)
    ).select("*", rules)
    lone = (F.col("n_gallery") == 1) & (F.col("n_both") == F.col("n_query"))
    complete = F.when(
        F.col("camera") == "same", (F.col("here") == F.col("family_size")) & ~lone
    ).otherwise(
        (F.col("with_gallery") == F.col("family_size")) & (F.col("only_here") == 0)
    )
    kind = F.when(F.col("family_size") == 1, "singleton").otherwise("family")
    return candidates.filter(complete).select(
        *CELL, "camera", "family_size", kind.alias("group_kind")
    )


def _twofold(items: DataFrame) -> DataFrame:
    """Number of items per cell that are both query and gallery item."""
    role = lambda name: F.max((F.col("role") == name).cast("int"))
    sides = items.groupBy(*CELL, "item_id").agg(role("query").alias("_asked"), role("gallery").alias("_shown"))
    return sides.filter("_asked = 1 AND _shown = 1").groupBy(*CELL).agg(F.count("*").alias("n_both"))


def feasible_pairs(cell: DataFrame, whole_group: bool = True) -> DataFrame:
    """(entity, camera rule, source) that yields a case when roles are merged.

    ``cell`` has ``CELL, n``. ``same`` needs two items of the entity on the source;
    ``cross`` needs one elsewhere. With ``whole_group`` every other member must
    be able to contribute as well.
    """
    key = ["corpus", "group_id"]
    members = cell.groupBy(*key, "entity_id").agg(F.sum("n").alias("n_entity"))
    full = cell.join(members, [*key, "entity_id"])
    same, cross = F.col("n") >= 2, F.col("n_entity") > F.col("n")
    sizes = members.groupBy(*key).agg(F.count("*").alias("family_size"))
    full = full.join(sizes, key)
    if whole_group:
        here = full.groupBy(*key, "source_id").agg(
            F.count("*").alias("here"),
            F.count_if(F.col("n_entity") == F.col("n")).alias("only_here"),
        )
        full = full.join(here, [*key, "source_id"])
        same &= F.col("here") == F.col("family_size")
        cross &= F.col("only_here") == 0
    rules = F.explode(F.array(F.lit("same"), F.lit("cross"))).alias("camera")
    ok = F.when(F.col("camera") == "same", same).otherwise(cross)
    return full.select("*", rules).filter(ok).select(*CELL, "camera", "family_size")


def skip(index: Column, start: Column, length: Column) -> Column:
    """Index into a range with ``[start, start + length)`` taken out."""
    return index + F.when(index >= start, length).otherwise(0)


@dataclass(frozen=True)
class Strangers:
    """Numbered items to draw strangers from, the range of each group, and the number of items."""

    items: DataFrame
    extents: DataFrame
    total: Column


def strangers(pool: DataFrame, stored: bool = False) -> Strangers:
    """Number a pool with ``corpus, group_id, item_id``; ``stored`` where several draws read it."""
    keyed = pool.withColumn("pool_key", F.concat_ws("|", "corpus", F.col("item_id").cast("string")))
    numbered, extents = contiguous_positions(keyed, ["group_id"], "pool_key", "strangers")
    numbered, total = numbered.select("pos", "item_id", "group_id"), pool.agg(F.count("*")).scalar()
    return Strangers(cut(numbered), cut(extents), total) if stored else Strangers(numbered, extents, total)


def draw_strangers(requests: DataFrame, pool: DataFrame | Strangers) -> DataFrame:
    """One item of any other group per request, uniform over those items.

    ``requests`` has ``case_id, group_id``; ``pool`` has ``corpus, group_id,
    item_id``, or is numbered. Adds ``query_id`` and ``stranger_group``. The pool is numbered
    with each group in one range, so the target's own range is skipped by
    arithmetic and no pair of groups is compared.
    """
    drawn_from = pool if isinstance(pool, Strangers) else strangers(pool)
    numbered, extents, total = drawn_from.items, drawn_from.extents, drawn_from.total
    own = requests.join(extents, "group_id", "left").na.fill(0, ["n", "offset"])
    drawn = own.withColumn("_total", total).filter("_total > n").withColumn(
        "pos",
        skip(
            hash_int(F.lit(0), F.col("_total") - F.col("n") - 1, "stranger", "case_id"),
            F.col("offset"), F.col("n"),
        ),
    ).drop("n", "offset", "_total")
    found = numbered.select(
        "pos", F.col("item_id").alias("query_id"), F.col("group_id").alias("stranger_group")
    )
    return drawn.join(found, "pos").drop("pos")


def pool_sizes(items: DataFrame) -> DataFrame:
    """Positive and negative pool sizes of every query item, per camera rule.

    Gallery items only. ``positives``: the same entity; ``family_negatives``:
    other entities of the group; both on the query's source (``same``) or off it
    (``cross``). ``outside``: gallery items of other groups in the corpus.
    """
    gallery = layout(items.filter(F.col("role") == "gallery"), by_source=True)
    queries = items.filter(F.col("role") == "query").select(*CELL, "item_id")
    wanted = queries.select(*CELL).distinct()
    sums = _cell_sums(wanted, gallery)
    same = F.col("camera") == "same"
    rules = F.explode(F.array(F.lit("same"), F.lit("cross"))).alias("camera")
    sized = sums.select("*", rules).select(
        *CELL, "camera",
        F.when(same, F.col("n")).otherwise(F.col("n_entity") - F.col("n")).alias("positives"),
        F.when(same, F.col("n_source") - F.col("n")).otherwise(
            F.col("n_group") - F.col("n_source") - F.col("n_entity") + F.col("n")
        ).alias("family_negatives"),
        (F.col("n_corpus") - F.col("n_group")).alias("outside"),
    )
    return skew_join(queries, sized, CELL)


def _cell_sums(wanted: DataFrame, gallery: Layout) -> DataFrame:
    """Gallery counts around each wanted (corpus, group, entity, source)."""
    c = gallery.cells
    by_source = c.select(*GROUP_SOURCE, "n_source").distinct()
    by_group = c.groupBy("corpus", "group_id").agg(F.sum("n").alias("n_group"))
    by_corpus = by_group.groupBy("corpus").agg(F.sum("n_group").alias("n_corpus"))
    return (
        wanted.join(c.select(*CELL, "n", "off_entity", "off_source"), CELL, "left")
        .join(gallery.entities.select(*ENTITY, "n_entity"), ENTITY, "left")
        .join(by_source, GROUP_SOURCE, "left")
        .join(by_group, ["corpus", "group_id"], "left")
        .join(by_corpus, "corpus", "left")
        .na.fill(0)
    )
