"""Building cases: a query, an ordered gallery and the position of the answer.

Cases are kept as *slots*, one row per gallery position: ``case_id, scenario,
query_id, pos, item_id, kind, label, n_gallery``. ``kind`` is ``own`` (the
answer), ``member``, ``resident`` or ``negative``. A case is one question shown
to a model, so a case, unlike a group, is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import answer_letter
from ..functions.hashing import hash_int, order_key
from ..functions.vectors import dot
from ..session import cut, together
from .corpus import CELL, cells, family_sizes, merge_roles, sample_rates, stranger_pool
from .knn import (
    distinct_draws, most_similar_of_resident, nearest_groups, pick_hard_negatives, product_pool, sampled_pool,
    threshold_negatives,
)
from .pools import (
    ENTITY, GROUP_SOURCE, Layout, Strangers, _cell_sums, draw_strangers, feasible_pairs, layout, skip,
    strangers, valid_triples,
)
from .ranking import fine_buckets, group_rank, prefix_sum, quota, skew_join, top_n

MAX_GALLERY = 5
CASE = ["case_id", "scenario", "query_id"]
# Rows made from one row in a first step; each gives as many in a second step.
STEP = 10_000
FEW_IDS = 100_000


@dataclass(frozen=True)
class Pool:
    """Where hard negatives come from.

    meta: ``item_id, group_id, entity_id``; vectors: ``item_id, vec``. Negatives
    are sampled from the ``sample_from`` nearest other groups. A store that holds each
    vector with its item's group is given as owned: ``item_id, group_id, vec``; without
    it the search joins the two tables and stores the vectors a second time.
    """

    meta: DataFrame
    vectors: DataFrame
    sample_from: int = 10
    owned: DataFrame | None = None


def numbered(df: DataFrame, count: str, name: str) -> DataFrame:
    """Repeat each row ``count`` times, numbered from 1.

    Two steps keep the arrays short, and the middle shuffle spreads the copies
    of one row over the cluster.
    """
    steps = F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / STEP).cast("long"))
    first = df.filter(F.col(count) > 0).withColumn("_step", F.explode(steps))
    spread = first.repartition(F.xxhash64(*[F.col(c) for c in first.columns]))
    low = F.col("_step") * STEP + 1
    high = F.least(F.col("_step") * STEP + STEP, F.col(count).cast("long"))
    return spread.withColumn(name, F.explode(F.sequence(low, high))).drop("_step")


def case_key(*parts) -> Column:
    """Parts joined by ``|``. A part's own ``|`` is escaped, so different parts never give
    one key; a null part stands as ``\\N``."""
    def escaped(part: str) -> Column:
        text = F.replace(F.col(part).cast("string"), F.lit("\\"), F.lit("\\\\"))
        return F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\\N"))

    return F.concat_ws("|", *[escaped(p) for p in parts])


def shuffle_gallery(slots: DataFrame) -> DataFrame:
    """Order each gallery by hash; the label is the answer's position or -1."""
    case = W.partitionBy("case_id")
    order = case.orderBy(order_key("shuffle", "case_id", "item_id"), "item_id")
    placed = slots.withColumn("pos", F.row_number().over(order))
    own = F.max(F.when(F.col("kind") == "own", F.col("pos"))).over(case)
    return placed.select(
        *CASE, "pos", "item_id", "kind",
        F.coalesce(own, F.lit(-1)).alias("label"),
        F.count("*").over(case).cast("int").alias("n_gallery"),
    )


def in_turn(cases: DataFrame, by: list[str]) -> DataFrame:
    """``_turn``: the number of cases of ``by`` before this one, in hash order of their keys."""
    return group_rank(cases, by, order_key("turn", "case_id"), "case_id", "_turn")


def pick_queries(requests: DataFrame, queries: Layout, diverse: bool = False) -> DataFrame:
    """One query item on the requested (entity, source).

    ``diverse`` goes round the items in turn, so none is used twice for an
    (entity, source) before all were used once.
    """
    cell = queries.cells.select(
        *ENTITY, "source_id", F.col("n").alias("n_query"), F.col("off_entity").alias("q_off")
    )
    drawn = requests.join(cell, [*ENTITY, "source_id"])
    if diverse:
        # Turns are counted by buckets of their order: one entity may be asked for often.
        drawn = in_turn(drawn, [*ENTITY, "source_id"])
        index = F.pmod(F.col("_turn"), F.col("n_query"))
    else:
        index = hash_int(F.lit(0), F.col("n_query") - 1, "query", "case_id")
    placed = drawn.withColumn("q_index", index.cast("long")).drop("_turn").withColumn(
        "q_pos", F.col("q_off") + F.col("q_index")
    )
    found = queries.items.select(
        *ENTITY, F.col("pos_entity").alias("q_pos"), F.col("item_id").alias("query_id")
    )
    return placed.join(found, [*ENTITY, "q_pos"]).drop("q_pos", "q_off", "n_query")


def pick_members(
    queries: DataFrame, gallery: Layout, whole_group: bool = True, diverse: bool = False,
) -> DataFrame:
    """One gallery item per member, on the query's source or off it.

    The query item is skipped wherever it is a gallery item too. A case of which
    any member has no item left is dropped as a whole.
    """
    members = gallery.entities.withColumnRenamed("entity_id", "member_id")
    listed = gallery.items.select(
        *ENTITY, F.col("item_id").alias("query_id"), F.col("pos_entity").alias("q_gallery")
    )
    base = queries.select(*CASE, *CELL, "camera", "family_size").join(
        listed, [*ENTITY, "query_id"], "left"
    )
    if whole_group:
        # One row per member by definition; a large group's cases are spread out.
        pairs = skew_join(cut(base), members, ["corpus", "group_id"])
    else:
        pairs = base.withColumn("member_id", F.col("entity_id")).join(
            members, ["corpus", "group_id", "member_id"]
        )
    cell = gallery.cells.select(
        "corpus", F.col("entity_id").alias("member_id"), "source_id", "n", "off_entity"
    )
    pairs = pairs.join(cell, ["corpus", "member_id", "source_id"], "left").na.fill(
        0, ["n", "off_entity"]
    )
    same = F.col("camera") == "same"
    own = F.col("member_id") == F.col("entity_id")
    hole = own & same & F.col("q_gallery").isNotNull()
    free = F.when(same, F.col("n") - F.when(hole, 1).otherwise(0)).otherwise(
        F.col("n_entity") - F.col("n")
    )
    # A case has one row per member, so this window is as large as one gallery.
    least = F.min("free").over(W.partitionBy("case_id"))
    drawn = pairs.withColumn("free", free).withColumn("_least", least).filter("_least > 0")
    if diverse:
        drawn = in_turn(drawn, ["corpus", "member_id", "camera", "source_id"])
        index = F.pmod(F.col("_turn"), F.col("free"))
    else:
        index = hash_int(F.lit(0), F.col("free") - 1, "member", "case_id", "member_id")
    drawn = drawn.withColumn("i", index.cast("long"))
    on_source = F.col("off_entity") + skip(
        F.col("i"), F.when(hole, F.col("q_gallery") - F.col("off_entity")).otherwise(F.col("n")),
        F.when(hole, 1).otherwise(0),
    )
    off_source = skip(F.col("i"), F.col("off_entity"), F.col("n"))
    placed = drawn.withColumn("pos_entity", F.when(same, on_source).otherwise(off_source))
    found = gallery.items.select(
        "corpus", F.col("entity_id").alias("member_id"), "pos_entity", "item_id"
    )
    kind = F.when(own, "own").otherwise("member")
    return placed.join(found, ["corpus", "member_id", "pos_entity"]).select(
        *CASE, "group_id", "family_size", "item_id", kind.alias("kind")
    )


def candidates_for(queries: DataFrame, pool: Pool, n_groups: int) -> DataFrame:
    """The ``n_groups`` nearest other groups of each distinct query item, with their best items.

    Groups are counted, not items: a group of any size is one candidate, and the
    query's own costs none.
    """
    wanted = cut(queries.select(F.col("query_id").alias("item_id")).distinct())
    if pool.owned is None:
        owned = cut(pool.vectors.join(pool.meta.select("item_id", "group_id").distinct(), "item_id"))
    else:
        owned = pool.owned.filter(F.col("item_id").isNotNull())
    if wanted.count() <= FEW_IDS:
        # A bounded list of ids; the vectors are not shuffled for it.
        wanted = F.broadcast(wanted)
    return nearest_groups(owned.join(wanted, "item_id", "left_semi"), owned, n_groups)


def pad_with_negatives(cases: DataFrame, pool: Pool, max_gallery: int) -> DataFrame:
    """Negatives up to a size drawn from ``[natural, max(natural, max_gallery)]``.

    ``cases`` has ``CASE, natural, other_group``; the last names a second
    excluded group or is null.
    """
    size = F.col("natural")
    target = hash_int(size, F.greatest(size, F.lit(max_gallery)), "target", "case_id")
    wanted = cases.select(*CASE, (target - size).alias("n_pad"), "other_group")
    # One candidate more than a case may use, as it may exclude a second group.
    n_groups = max(max_gallery, pool.sample_from) + 1
    chosen = pick_hard_negatives(wanted, candidates_for(cases, pool, n_groups), pool.sample_from)
    return chosen.join(wanted.select(*CASE), "case_id").select(
        *CASE, "item_id", F.lit("negative").alias("kind")
    )


@dataclass(frozen=True)
class Roles:
    """Numbered gallery and query items of one corpus build."""

    gallery: Layout
    queries: Layout
    merged: bool


def roles(items: DataFrame, merged: bool = False, counted: DataFrame | None = None) -> Roles:
    """Number both roles once, for all builders that share the items; ``counted`` is their stored ``cells``."""
    names = ["gallery"] if merged else ["gallery", "query"]

    def numbered_items(name: str) -> Layout:
        held = None if counted is None else counted.select(*CELL, F.col(f"n_{name}").alias("n")).filter("n > 0")
        return layout(items.filter(F.col("role") == name), counted=held)

    found = together(items.sparkSession, *[lambda name=name: numbered_items(name) for name in names])
    return Roles(found[0], found[-1], merged)


def known_parts(
    requests: DataFrame, numbering: Roles, whole_group: bool = True, diverse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Cases awaiting negatives, and their member slots."""
    if not whole_group:
        requests = requests.withColumn("family_size", F.lit(1).cast("long"))
    picked = pick_queries(requests, numbering.queries, diverse)
    members = cut(pick_members(picked, numbering.gallery, whole_group, diverse))
    # A whole case has its answer once; its second excluded group is null.
    open_cases = members.filter("kind = 'own'").select(
        *CASE, F.col("family_size").cast("long").alias("natural"),
        F.nullif("group_id", "group_id").alias("other_group"),
    )
    return open_cases, members.select(*CASE, "item_id", "kind")


def known_cases(
    requests: DataFrame, items: DataFrame, pool: Pool, max_gallery: int = MAX_GALLERY,
    merged: bool = False, whole_group: bool = True, diverse: bool = False,
    numbering: Roles | None = None, padded: bool = True,
) -> DataFrame:
    """One case per request: an item per member plus hard negatives.

    ``requests`` has ``case_id, scenario, CELL, camera, family_size``. With
    ``whole_group`` off the entity is its group's only member (the rest of the
    group still gives no negatives). ``padded`` off leaves negatives out.
    """
    numbering = numbering or roles(items, merged)
    waiting, members = known_parts(requests, numbering, whole_group, diverse)
    if not padded:
        return shuffle_gallery(members)
    return shuffle_gallery(members.unionByName(pad_with_negatives(waiting, pool, max_gallery)))


def scenario_name(corpus, group_kind, camera) -> Column:
    return F.concat_ws(
        "_", F.lit("cropped"), F.concat(corpus, F.lit("clothes")), group_kind,
        F.concat(camera, F.lit("camera")),
    )


def named_triples(items: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Valid triples with their scenario, stored for the draws that follow."""
    return cut(valid_triples(items, counted).withColumn(
        "scenario", scenario_name(F.col("corpus"), F.col("group_kind"), F.col("camera"))
    ))


def exhaustive_requests(items: DataFrame, min_cases: int = 150, counted: DataFrame | None = None) -> DataFrame:
    """One request per valid triple; short scenarios are topped up by redrawing."""
    triples = named_triples(items, counted)
    key = order_key("triple", "scenario", "entity_id", "source_id")
    ranked = cut(group_rank(
        triples.withColumn("_tie", case_key("entity_id", "source_id")), ["scenario"], key, "_tie",
        bucket=fine_buckets(key),
    ).drop("_tie"))
    counts = triples.groupBy("scenario").agg(F.count("*").alias("n"))
    draws = numbered(
        counts.withColumn("gap", F.lit(min_cases) - F.col("n")), "gap", "draw"
    ).select(
        "scenario", "draw",
        hash_int(F.lit(0), F.col("n") - 1, "redraw", "scenario", "draw").alias("rank"),
    )
    again = ranked.join(draws, ["scenario", "rank"])
    once = ranked.withColumn("draw", F.lit(0).cast("long"))
    return once.unionByName(again).drop("rank").withColumn(
        "case_id", case_key("scenario", "entity_id", "source_id", "draw")
    )


def sampled_requests(items: DataFrame, n_entities: int = 50, n_cases: int = 150) -> DataFrame:
    """``n_cases`` requests per scenario, spread evenly over ``n_entities``."""
    triples = named_triples(items)
    per_entity = triples.groupBy("scenario", "entity_id").agg(F.count("*").alias("n_triples"))
    chosen = top_n(
        per_entity, ["scenario"],
        [order_key("sample", "scenario", "entity_id"), F.col("entity_id")], n_entities, "turn",
    )
    taken = chosen.groupBy("scenario").agg(F.count("*").alias("n_taken"))
    wanted = chosen.join(taken, "scenario").withColumn(
        "quota", quota(F.lit(n_cases).cast("long"), F.col("n_taken"), F.col("turn") - 1)
    )
    draws = numbered(wanted, "quota", "draw").select(
        "scenario", "entity_id", "draw",
        hash_int(
            F.lit(0), F.col("n_triples") - 1, "draw", "scenario", "entity_id", "draw"
        ).alias("rank"),
    )
    ranked = group_rank(
        triples, ["scenario", "entity_id"], order_key("source", "source_id"), "source_id"
    )
    return ranked.join(draws, ["scenario", "entity_id", "rank"]).drop("rank").withColumn(
        "case_id", case_key("scenario", "entity_id", "draw")
    )


def singleton_strangers(
    requests: DataFrame, items: DataFrame, pool: Pool, max_gallery: int = MAX_GALLERY,
    drawn_from: Strangers | None = None,
) -> DataFrame:
    """Stranger query; gallery = the resident's items most similar to it.

    ``requests`` has ``case_id, scenario, corpus, group_id, entity_id``.
    """
    # Read by the search and by the cases.
    drawn = cut(draw_strangers(requests, drawn_from or stranger_pool(items)))
    gallery = items.filter(F.col("role") == "gallery").select(*ENTITY, "item_id")
    asked = drawn.select(*ENTITY).distinct()
    shown = gallery.join(asked, ENTITY, "left_semi")
    # Strangers and residents get their vectors in one join: all vectors are shuffled for it.
    both = drawn.select(*ENTITY, F.col("query_id").alias("item_id"), "case_id", F.lit(True).alias("_asks")).unionByName(
        shown.withColumns({"case_id": F.lit(None).cast("string"), "_asks": F.lit(False)}))
    known = cut(both.join(pool.vectors, "item_id"))
    with_vec = known.filter("_asks").select(*ENTITY, "case_id", F.col("vec").alias("query_vec"))
    residents = known.filter("not _asks").select(*ENTITY, "item_id", "vec")
    best = most_similar_of_resident(with_vec, residents, ENTITY, max_gallery)
    cases = drawn.select(
        *CASE, hash_int(F.lit(1), F.lit(max_gallery), "target", "case_id").alias("target")
    )
    chosen = best.join(cases, "case_id").filter(F.col("rank") <= F.col("target"))
    return shuffle_gallery(chosen.select(*CASE, "item_id", F.lit("resident").alias("kind")))


def family_parts(
    requests: DataFrame, items: DataFrame, gallery: Layout, diverse: bool = False,
    drawn_from: Strangers | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Stranger cases awaiting negatives, and one slot per member.

    ``diverse`` goes round each member's items, so none is shown twice before all
    were shown once.
    """
    members = gallery.entities
    sizes = members.groupBy("corpus", "group_id").agg(F.count("*").alias("natural"))
    drawn = cut(
        draw_strangers(requests, drawn_from or stranger_pool(items)).join(sizes, ["corpus", "group_id"])
    )
    # One row per member by definition; a group that many cases ask for is spread out.
    shown = skew_join(drawn.select(*CASE, "corpus", "group_id"), members, ["corpus", "group_id"])
    if diverse:
        shown = in_turn(shown, ENTITY)
        index = F.pmod(F.col("_turn"), F.col("n_entity"))
    else:
        index = hash_int(F.lit(0), F.col("n_entity") - 1, "member", "case_id", "entity_id")
    one_each = (
        shown.withColumn("pos_entity", index)
        .join(gallery.items.select(*ENTITY, "pos_entity", "item_id"), [*ENTITY, "pos_entity"])
        .select(*CASE, "item_id", F.lit("member").alias("kind"))
    )
    return drawn.select(*CASE, "natural", F.col("group_id").alias("other_group")), one_each


def family_strangers(
    requests: DataFrame, items: DataFrame, pool: Pool, max_gallery: int = MAX_GALLERY,
    numbering: Roles | None = None,
) -> DataFrame:
    """Stranger query; one item per member plus negatives from neither group.

    ``requests`` has ``case_id, scenario, corpus, group_id``.
    """
    gallery = numbering.gallery if numbering else layout(items.filter(F.col("role") == "gallery"))
    waiting, members = family_parts(requests, items, gallery)
    return shuffle_gallery(members.unionByName(pad_with_negatives(waiting, pool, max_gallery)))


def _targets(items: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Every (corpus, group) with a gallery, its size, and one entity; ``counted`` is ``cells(items)`` where stored."""
    sizes = family_sizes(items if counted is None else counted)
    shown = items.filter(F.col("role") == "gallery") if counted is None else counted.filter("n_gallery > 0")
    owners = (
        shown.groupBy("corpus", "group_id").agg(F.min("entity_id").alias("entity_id"))
    )
    return sizes.join(owners, ["corpus", "group_id"])


def of_kind(targets: DataFrame, kind: str) -> DataFrame:
    size = F.col("family_size")
    return targets.filter(size == 1 if kind == "singleton" else size >= 2)


def stranger_requests(items: DataFrame, kind: str, counted: DataFrame | None = None) -> DataFrame:
    """One request per (corpus, group) of the kind."""
    return of_kind(_targets(items, counted), kind).withColumn(
        "scenario", F.lit(f"distractor_cropped_{kind}")
    ).withColumn("case_id", case_key("scenario", "corpus", "group_id"))


def exhaustive_strangers(items: DataFrame, pool: Pool, kind: str,
                         max_gallery: int = MAX_GALLERY) -> DataFrame:
    """One stranger case per (corpus, group) of the kind."""
    build = singleton_strangers if kind == "singleton" else family_strangers
    return build(stranger_requests(items, kind), items, pool, max_gallery)


def stratified_requests(targets: DataFrame, scenario: str, total: Column) -> DataFrame:
    """``total`` requests shared over family sizes, groups redrawn within a size.

    ``targets`` has ``corpus, group_id, entity_id, family_size``.
    """
    sizes = targets.groupBy("family_size").agg(F.count("*").alias("n_groups"))
    # One row per distinct family size.
    order = W.partitionBy().orderBy("family_size")
    shares = sizes.withColumn("turn", F.row_number().over(order) - 1).withColumn(
        "n_sizes", F.count("*").over(W.partitionBy())
    ).withColumn("total", total).withColumn(
        "quota", quota(F.col("total"), F.col("n_sizes"), F.col("turn"), "last")
    )
    draws = numbered(shares, "quota", "draw").select(
        "family_size", "draw",
        hash_int(F.lit(0), F.col("n_groups") - 1, "target_group", F.lit(scenario),
                 "family_size", "draw").alias("rank"),
    )
    key = order_key("targets", "corpus", "group_id")
    ranked = group_rank(
        targets.withColumn("_tie", case_key("corpus", "group_id")), ["family_size"], key, "_tie",
        bucket=fine_buckets(key),
    ).drop("_tie")
    return ranked.join(draws, ["family_size", "rank"]).drop("rank").withColumn(
        "scenario", F.lit(scenario)
    ).withColumn("case_id", case_key("scenario", "family_size", "draw"))


def stratified_strangers(
    items: DataFrame, pool: Pool, kind: str, n_cases: int = 200, max_gallery: int = MAX_GALLERY,
) -> DataFrame:
    """``n_cases`` stranger cases, even over family sizes."""
    requests = stratified_requests(
        of_kind(_targets(items), kind), f"distractor_cropped_{kind}",
        F.lit(n_cases).cast("long"),
    )
    build = singleton_strangers if kind == "singleton" else family_strangers
    return build(requests, items, pool, max_gallery)


def scenario_suite(items: DataFrame, pool: Pool, max_gallery: int = MAX_GALLERY,
                   min_cases: int = 150, padded: bool = True) -> DataFrame:
    """All ten scenarios in one table; the scenario is a column.

    Items and strangers are numbered once and one neighbour search serves known and
    family cases. ``padded`` off searches no neighbours, and galleries are the members
    alone. The finished suite is stored, as every evaluation reads it.
    """
    # Cells are counted once; layouts, triples and targets read them instead of the items.
    counted, drawn_from = together(
        items.sparkSession, lambda: cut(cells(items)), lambda: strangers(stranger_pool(items), stored=True))
    numbering, requests = together(
        items.sparkSession, lambda: roles(items, counted=counted),
        lambda: exhaustive_requests(items, min_cases, counted),
    )
    (known, known_members), (family, family_members), single = together(
        items.sparkSession, lambda: known_parts(requests, numbering),
        lambda: family_parts(
            stranger_requests(items, "family", counted), items, numbering.gallery, drawn_from=drawn_from
        ),
        lambda: singleton_strangers(
            stranger_requests(items, "singleton", counted), items, pool, max_gallery if padded else 1, drawn_from
        ),
    )
    slots = known_members.unionByName(family_members)
    if padded:
        slots = slots.unionByName(
            pad_with_negatives(known.unionByName(family), pool, max_gallery)
        )
    return cut(shuffle_gallery(slots).unionByName(single))


def suite_by_split(
    items: DataFrame, splits: DataFrame, pool: Pool, split: str, max_gallery: int = MAX_GALLERY,
    min_cases: int = 150, padded: bool = True,
) -> DataFrame:
    """The suite of one split: queries, galleries, strangers and negatives from its groups only.

    ``splits`` has ``group_id, split``.
    """
    mine, near = _of_split(items, splits, pool, split)
    return scenario_suite(mine, near, max_gallery, min_cases, padded)


def training_by_split(
    items: DataFrame, splits: DataFrame, pool: Pool, split: str = "train", **options,
) -> DataFrame:
    """The training set of one split, from its groups only."""
    mine, near = _of_split(items, splits, pool, split)
    return training_set(mine, near, **options)


def _of_split(
    items: DataFrame, splits: DataFrame, pool: Pool, split: str,
) -> tuple[DataFrame, Pool]:
    groups = splits.filter(F.col("split") == split).select("group_id").distinct()
    mine = items.join(groups, "group_id", "left_semi")
    meta = pool.meta.join(groups, "group_id", "left_semi")
    # Every builder reads the split's vectors again.
    if pool.owned is not None:
        owned = pool.owned.filter(F.col("item_id").isNotNull()).join(groups, "group_id", "left_semi")
        owned = cut(owned.select("item_id", "group_id", "vec"))
        return mine, Pool(meta, owned.select("item_id", "vec"), pool.sample_from, owned)
    vectors = cut(pool.vectors.join(meta.select("item_id").distinct(), "item_id", "left_semi"))
    return mine, Pool(meta, vectors, pool.sample_from)


# Training cases per entity by family size.
TRAINING_RATES = {1: 1, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 6, 9: 6}


def training_requests(merged: DataFrame, rates: dict[int, int] = TRAINING_RATES) -> DataFrame:
    """Draws over the feasible (camera, source) pairs of each entity."""
    cell = merged.filter(F.col("role") == "gallery").groupBy(*CELL).agg(F.count("*").alias("n"))
    pairs = cut(feasible_pairs(cell)).withColumn("_tie", case_key("camera", "source_id"))
    ranked = group_rank(pairs, ENTITY, order_key("pair", "camera", "source_id"), "_tie").drop("_tie")
    per_entity = pairs.groupBy(*ENTITY).agg(
        F.count("*").alias("n_pairs"), F.max("family_size").alias("family_size")
    )
    draws = numbered(sample_rates(per_entity, rates), "n_wanted", "draw").select(
        *ENTITY, "draw",
        hash_int(F.lit(0), F.col("n_pairs") - 1, "pair", *ENTITY, "draw").alias("rank"),
    )
    return ranked.join(draws, [*ENTITY, "rank"]).drop("rank").withColumn(
        "scenario", F.lit("train")
    ).withColumn("case_id", case_key("scenario", "corpus", "entity_id", "draw"))


def synthetic_requests(merged: DataFrame) -> DataFrame:
    """One feasible (camera, source) per entity of a family, taken alone."""
    cell = merged.filter(F.col("role") == "gallery").groupBy(*CELL).agg(F.count("*").alias("n"))
    pairs = feasible_pairs(cell, whole_group=False).filter("family_size > 1")
    first = F.min_by(
        F.struct("group_id", "source_id", "camera"), order_key("alone", *ENTITY, "camera", "source_id")
    )
    return pairs.groupBy(*ENTITY).agg(first.alias("p")).select(
        *ENTITY, "p.*", F.lit(1).cast("long").alias("family_size"),
        F.lit("synthetic").alias("scenario"),
    ).withColumn("case_id", case_key("scenario", *ENTITY))


def synthetic_singletons(
    merged: DataFrame, pool: Pool, max_gallery: int = 6, numbering: Roles | None = None,
) -> DataFrame:
    """A known and a stranger case for each family member taken as sole resident."""
    known = known_cases(
        synthetic_requests(merged), merged, pool, max_gallery, merged=True, whole_group=False,
        numbering=numbering,
    )
    entities = merged.select("corpus", "group_id", "entity_id").distinct()
    alone = entities.join(
        family_sizes(merged).filter("family_size > 1"), ["corpus", "group_id"]
    ).withColumn("scenario", F.lit("synthetic_stranger")).withColumn(
        "case_id", case_key("scenario", *ENTITY)
    )
    strangers = singleton_strangers(alone, merged, pool, max_gallery)
    return known.unionByName(strangers)


def training_set(
    items: DataFrame, pool: Pool, rates: dict[int, int] = TRAINING_RATES,
    stranger_fraction: float = 0.4, max_gallery: int = 6, synthetic: bool = False,
) -> DataFrame:
    """Known cases at the rates, strangers as a fraction of them by family size."""
    merged = merge_roles(items)
    numbering = roles(merged, merged=True)
    requests = cut(training_requests(merged, rates))
    known, known_members = known_parts(requests, numbering, diverse=True)
    total = requests.agg(
        F.floor(F.count("*") * F.lit(stranger_fraction)).cast("long").alias("total")
    ).scalar()
    wanted = cut(stratified_requests(_targets(merged), "train_stranger", total))
    drawn_from = strangers(stranger_pool(merged), stored=True)
    family, family_members = family_parts(
        wanted.filter("family_size > 1"), merged, numbering.gallery, True, drawn_from
    )
    negatives = pad_with_negatives(known.unionByName(family), pool, max_gallery)
    padded = shuffle_gallery(known_members.unionByName(family_members).unionByName(negatives))
    single = singleton_strangers(wanted.filter("family_size = 1"), merged, pool, max_gallery, drawn_from)
    cases = padded.unionByName(single)
    if synthetic:
        cases = cases.unionByName(synthetic_singletons(merged, pool, max_gallery, numbering))
    return cases


def _sampled_cases(positives: DataFrame, negatives: DataFrame, scenario: str) -> DataFrame:
    """A positive and its negatives per query, shuffled; both or no case."""
    ready = positives.join(negatives.select("query_id").distinct(), "query_id", "left_semi")
    kept = negatives.join(positives.select("query_id").distinct(), "query_id", "left_semi")
    both = ready.select("query_id", "item_id", F.lit("own").alias("kind")).unionByName(
        kept.select("query_id", "item_id", F.lit("negative").alias("kind"))
    )
    return shuffle_gallery(
        both.withColumn("scenario", F.lit(scenario)).withColumn(
            "case_id", case_key("scenario", "query_id")
        )
    )


def similarity_cases(
    queries: DataFrame, gallery: DataFrame, k: int = 5, threshold: float = 0.5, **options,
) -> DataFrame:
    """Per query, one item of the same owner and ``k - 1`` from the similar pool.

    Inputs have ``item_id, owner_id, vec``. An item drawn as its own positive is
    possible only when it is listed in both inputs; the next one is taken then.
    """
    numbered_items = group_rank(
        gallery.select("item_id", "owner_id"), ["owner_id"], order_key("item", "item_id"), "item_id"
    )
    sizes = gallery.groupBy("owner_id").agg(F.count("*").alias("n"))
    own = numbered_items.select(F.col("item_id").alias("query_id"), F.col("rank").alias("own_rank"))
    asked = skew_join(
        queries.select(F.col("item_id").alias("query_id"), "owner_id"), sizes, ["owner_id"]
    ).join(own, "query_id", "left")
    free = F.col("n") - F.when(F.col("own_rank").isNotNull(), 1).otherwise(0)
    index = hash_int(F.lit(0), F.col("free") - 1, "positive", "query_id")
    drawn = asked.withColumn("free", free).filter("free > 0").withColumn("i", index).withColumn(
        "rank", F.when(F.col("i") >= F.col("own_rank"), F.col("i") + 1).otherwise(F.col("i"))
    )
    positives = drawn.join(numbered_items, ["owner_id", "rank"]).select("query_id", "item_id")
    pool = sampled_pool(queries, gallery, threshold, k - 1, **options)
    return _sampled_cases(positives, threshold_negatives(pool, k), "similarity")


def product_cases(items: DataFrame, k: int = 5, threshold: float = 0.2, **options) -> DataFrame:
    """Every item as query; negatives from products with a similar first item.

    Products with a single item give no query.
    """
    ranked = group_rank(
        items.select("item_id", "owner_id"), ["owner_id"], order_key("item", "item_id"),
        "item_id", total="n",
    )
    asked = ranked.filter("n > 1")
    index = hash_int(F.lit(0), F.col("n") - 2, "positive", "item_id")
    drawn = asked.select(
        F.col("item_id").alias("query_id"), "owner_id",
        skip(index, F.col("rank"), F.lit(1)).alias("rank"),
    )
    positives = drawn.join(
        ranked.select("owner_id", "rank", "item_id"), ["owner_id", "rank"]
    ).select("query_id", "item_id")
    pool = product_pool(items, threshold, k - 1, **options)
    return _sampled_cases(positives, threshold_negatives(pool, k), "product")


N_NEGATIVES = 4


def household_cases(items: DataFrame, draws: int = 1) -> DataFrame:
    """One positive and four negatives per query item, ``draws`` times.

    Families take negatives from other members, on the query's source or off it;
    singletons from any other group of the corpus. A query needs more than one
    positive and more than four negatives. The four negatives are different
    positions of the pool, each uniform over those left, and the pool is not listed.
    """
    gallery = layout(items.filter(F.col("role") == "gallery"), by_source=True)
    queries = items.filter(F.col("role") == "query").select(
        *CELL, F.col("item_id").alias("query_id")
    )
    wanted = queries.select(*CELL).distinct()
    rules = F.explode(F.array(F.lit("same"), F.lit("cross"))).alias("camera")
    same, single = F.col("camera") == "same", F.col("group_kind") == "singleton"
    kind = F.when(F.col("family_size") == 1, "singleton").otherwise("family")
    sums = (
        _cell_sums(wanted, gallery).join(family_sizes(items), ["corpus", "group_id"])
        .withColumn("group_kind", kind).select("*", rules)
        .withColumns({
            "positives": F.when(same, F.col("n")).otherwise(F.col("n_entity") - F.col("n")),
            "negatives": F.when(single, F.col("n_corpus") - F.col("n_group"))
            .when(same, F.col("n_source") - F.col("n"))
            .otherwise(F.col("n_group") - F.col("n_source") - F.col("n_entity") + F.col("n")),
        }).filter((F.col("positives") > 1) & (F.col("negatives") > N_NEGATIVES))
    )
    asked = skew_join(queries, sums, CELL)
    cases = cut(asked.withColumn(
        "draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))
    ).withColumn(
        "scenario", scenario_name(F.col("corpus"), F.col("group_kind"), F.col("camera"))
    ).withColumn("case_id", case_key("scenario", "query_id", "draw")).withColumn(
        # Drawn once; the joins below read them several times.
        "drawn", distinct_draws(F.col("negatives"), N_NEGATIVES, "negatives", "case_id")
    ))

    i = hash_int(F.lit(0), F.col("positives") - 1, "positive", "case_id")
    own = cases.withColumn(
        "pos_entity",
        F.when(same, F.col("off_entity") + i).otherwise(skip(i, F.col("off_entity"), F.col("n"))),
    ).join(gallery.items.select(*ENTITY, "pos_entity", "item_id"), [*ENTITY, "pos_entity"])

    indexed = cases.select(
        *CASE, *CELL, "camera", "group_kind", "n", "off_source", "n_group",
        F.explode("drawn").alias("i"),
    )

    negative = F.lit("negative").alias("kind")
    chosen = _family_negatives(indexed.filter(~single), gallery).unionByName(
        _outside_negatives(indexed.filter(single), gallery)
    )
    return shuffle_gallery(
        own.select(*CASE, "item_id", F.lit("own").alias("kind"))
        .unionByName(chosen.select(*CASE, "item_id", negative))
    )


def _family_negatives(indexed: DataFrame, gallery: Layout) -> DataFrame:
    """Resolve an index among the group's other members.

    On the source, the asking entity's own range is skipped. Off it, the group's items
    are numbered once, by source; an index becomes a position there by stepping over
    the asked source and over the ranges of the asking entity that begin before it.
    """
    same = indexed.filter("camera = 'same'").select(
        *CASE, *GROUP_SOURCE, skip(F.col("i"), F.col("off_source"), F.col("n")).alias("pos_source")
    ).join(gallery.items.select(*GROUP_SOURCE, "pos_source", "item_id"), [*GROUP_SOURCE, "pos_source"])

    # The entity's ranges in the group's order. ``key`` is where a range stands among
    # what is left without the entity, ``past`` what is stepped over from there on.
    own = gallery.cells.select(*CELL, "n", "n_source", "off_group", (F.col("off_group") + F.col("off_source")).alias("at"))
    # An entity without gallery items on the asked source has an empty range there.
    sources = gallery.cells.select(*GROUP_SOURCE, "n_source", "off_group").distinct()
    absent = indexed.filter("camera = 'cross'").select(*CELL).distinct().join(own, CELL, "left_anti").join(
        sources, GROUP_SOURCE).select(*CELL, F.lit(0).cast("long").alias("n"), "n_source", "off_group", F.col("off_group").alias("at"))
    own = own.unionByName(absent)
    stepped = prefix_sum(own, ENTITY, order_key("source", "source_id"), "source_id", "n", "before")
    ranges = stepped.select(
        *CELL, "off_group", "n_source", "n", (F.col("at") - F.col("before")).alias("key"), "before",
        (F.col("before") + F.col("n")).alias("past"))
    asked = skew_join(
        indexed.filter("camera = 'cross'").drop("n", "off_source"),
        ranges.select(*CELL, (F.col("off_group") - F.col("before")).alias("_low"), (F.col("n_source") - F.col("n")).alias("_gap")),
        CELL, "left",
    ).na.fill(0, ["_low", "_gap"]).withColumn("f", F.col("i") + F.when(F.col("i") >= F.col("_low"), F.col("_gap")).otherwise(0))
    past = _stepped_over(asked.select(*CASE, "corpus", "group_id", "entity_id", "f"), ranges.select(*ENTITY, "key", "past"))
    cross = past.select(*CASE, "corpus", "group_id", (F.col("f") + F.col("past")).alias("pos_group")).join(
        gallery.items.select("corpus", "group_id", "pos_group", "item_id"), ["corpus", "group_id", "pos_group"])
    return same.select(*CASE, "item_id").unionByName(cross.select(*CASE, "item_id"))


def _stepped_over(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """``asked`` with ``past`` of the last range of its entity whose ``key`` is at most ``f``, or 0.

    ``f`` is cut into as many equal buckets as the entity has ranges, so a row meets
    the ranges of its bucket instead of all. Each range is one row, and one more for
    every bucket that it reaches into.
    """
    wide = asked.groupBy(*ENTITY).agg(F.max("f").alias("_most"))
    parts = ranges.groupBy(*ENTITY).agg(F.count("*").alias("_ranges"))
    width = wide.join(parts, ENTITY).select(
        *ENTITY, "_most", F.greatest(F.ceil((F.col("_most") + 1) / F.col("_ranges")), F.lit(1)).cast("long").alias("_width"))
    # Ranges of one key end where they begin; the one that steps over most counts.
    firsts = ranges.groupBy(*ENTITY, "key").agg(F.max("past").alias("past"))
    zero = width.select(*ENTITY, F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("past")).join(
        firsts.filter("key = 0").select(*ENTITY), ENTITY, "left_anti")
    order = W.partitionBy(*ENTITY).orderBy("key")  # one row a source of the entity
    ends = firsts.unionByName(zero).withColumn("_next", F.lead("key").over(order))
    listed = ends.join(width, ENTITY).filter("key <= _most").withColumn(
        "_end", F.least(F.coalesce(F.col("_next") - 1, F.col("_most")), F.col("_most")))
    bucket = lambda c: F.floor(F.col(c) / F.col("_width")).cast("long")
    spread = listed.withColumn("_bucket", F.explode(F.sequence(bucket("key"), bucket("_end")))).select(
        *ENTITY, "_bucket", "key", "_end", "past")
    placed = skew_join(asked, width.select(*ENTITY, "_width"), ENTITY).withColumn("_bucket", bucket("f")).drop("_width")
    met = placed.join(spread, [*ENTITY, "_bucket"])
    return met.filter((F.col("f") >= F.col("key")) & (F.col("f") <= F.col("_end"))).drop("_bucket", "key", "_end")


def _outside_negatives(indexed: DataFrame, gallery: Layout) -> DataFrame:
    """Resolve an index among the corpus's other groups."""
    sizes = gallery.cells.groupBy("corpus", "group_id").agg(F.sum("n").alias("n_group"))
    key = order_key("groups", "group_id")
    groups = prefix_sum(
        sizes, ["corpus"], key, "group_id", "n_group", "off_group", fine_buckets(key)
    )
    inside = group_rank(
        gallery.items.select("corpus", "group_id", "item_id"), ["corpus", "group_id"],
        order_key("item", "item_id"), "item_id", "_in",
        attach=groups.select("corpus", "group_id", "off_group"),
    )
    numbered_items = inside.select(
        "corpus", (F.col("off_group") + F.col("_in")).alias("pos_corpus"), "item_id"
    )
    own = groups.select("corpus", "group_id", "off_group")
    asked = indexed.join(own, ["corpus", "group_id"], "left").na.fill(0, ["off_group"]).select(
        *CASE, "corpus", skip(F.col("i"), F.col("off_group"), F.col("n_group")).alias("pos_corpus")
    )
    return asked.join(numbered_items, ["corpus", "pos_corpus"]).select(*CASE, "item_id")


def case_rows(slots: DataFrame) -> DataFrame:
    """One row per case, the gallery as an array in order."""
    extra = [c for c in slots.columns if c not in (*CASE, "pos", "label", "n_gallery")]
    packed = F.array_sort(F.collect_list(F.struct("pos", *extra)))
    return slots.groupBy(*CASE, "label", "n_gallery").agg(packed.alias("gallery"))


def heads(slots: DataFrame) -> DataFrame:
    """One row per case without its gallery."""
    return slots.filter(F.col("pos") == 1).select(*CASE, "label", "n_gallery")


def letter_cases(cases: DataFrame) -> DataFrame:
    """Add the stranger's slot, uniform in ``[0, n]``, and the answer letter."""
    return cases.withColumn(
        "stranger_slot", hash_int(F.lit(0), F.col("n_gallery"), "slot", "case_id").cast("int")
    ).withColumn("answer_letter", answer_letter("label", "stranger_slot"))


def enrich(slots: DataFrame, meta: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Group and entity of the query and of each gallery item."""
    owner = meta.select(
        "item_id", F.col("group_id").cast("string").alias("group_id"),
        F.col("entity_id").cast("string").alias("entity_id"),
    )
    query = owner.withColumnsRenamed(
        {"item_id": "query_id", "group_id": "query_group_id", "entity_id": "query_entity_id"}
    )
    # Items are unique keys; a much-used item is split by the adaptive skew join.
    joined = slots.join(owner, "item_id", "left").join(query, "query_id", "left")
    return joined.na.fill(
        unknown, ["group_id", "entity_id", "query_group_id", "query_entity_id"]
    )


def score(slots: DataFrame, vectors: DataFrame, digits: int = 4) -> DataFrame:
    """Similarity of the query to each gallery item (unit vectors)."""
    item = vectors.withColumnRenamed("vec", "_vec")
    query = vectors.withColumnsRenamed({"item_id": "query_id", "vec": "_query_vec"})
    joined = slots.join(item, "item_id").join(query, "query_id")
    return joined.withColumn("sim", F.round(dot("_query_vec", "_vec"), digits)).drop(
        "_vec", "_query_vec"
    )

