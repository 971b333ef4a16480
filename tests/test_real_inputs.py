"""Builders and searches on the inputs that real corpora have."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineup.functions import answers
from lineup.operators import cases as K
from lineup.operators import corpus as C
from lineup.operators import knn, models
from lineup.plans import queries_cases, queries_online, views
from lineup.plans.queries_neighbors import pool
from lineup.streaming import assign


def sound(slots, items, roles_overlap=True):
    """Invariants of a suite: whole galleries, one answer, no query in its own gallery."""
    rows = slots.collect()
    by_case = {}
    for r in rows:
        by_case.setdefault(r.case_id, []).append(r)
    owner = {r.item_id: (r.group_id, r.entity_id) for r in items.select("item_id", "group_id", "entity_id").collect()}
    sizes = {(r.corpus, r.group_id): r.n for r in items.groupBy("corpus", "group_id").agg(
        F.count_distinct("entity_id").alias("n")).collect()}
    assert rows
    for case in by_case.values():
        assert sorted(r.pos for r in case) == list(range(1, len(case) + 1))
        assert all(r.item_id != r.query_id for r in case)
        own = [r for r in case if r.kind == "own"]
        assert len(own) == (0 if "distractor" in case[0].scenario else 1)
        assert case[0].label == (own[0].pos if own else -1)
        group = owner[case[0].query_id][0]
        assert all(owner[r.item_id][0] != group for r in case if r.kind == "negative")
        if own:
            assert owner[own[0].item_id] == owner[case[0].query_id]
            members = [r for r in case if r.kind in ("own", "member")]
            corpus = case[0].scenario.split("_")[1].removesuffix("clothes")
            assert len(members) == sizes[corpus, group]


def test_suite_from_names(spark, folder):
    named = C.items_from_paths(views.paths(spark, folder))
    assert named.schema["group_id"].dataType.simpleString() == "string"
    sound(queries_cases.suite_from_names(spark, folder), named)


def test_suite_on_flat_corpus(spark, folder):
    sound(queries_cases.suite_flat(spark, folder), views.items(spark, folder))


def test_incomplete_case_is_dropped_whole(spark, folder):
    """One member's only item on the source is the query itself."""
    rows = [(1, 1, 10, 5, r, "same") for r in ("query", "gallery")]
    rows += [(i, 1, 11, 5, "gallery", "same") for i in (2, 3)] + [(4, 1, 11, 6, "query", "same")]
    items = spark.createDataFrame(rows, "item_id long, group_id long, entity_id long, source_id long, role string, corpus string")
    requests = spark.createDataFrame(
        [("c1", "s", "same", 1, 10, 5, "same", 2)],
        "case_id string, scenario string, corpus string, group_id long, entity_id long, source_id long, camera string, family_size long")
    assert K.known_cases(requests, items, K.Pool(items, items), padded=False).count() == 0


def test_training_on_text_ids(spark, folder):
    named = C.items_from_paths(views.paths(spark, folder))
    meta = named.select("item_id", "group_id", "entity_id")
    slots = K.training_set(named, K.Pool(meta, pool(spark, folder).vectors))
    assert slots.filter("item_id = query_id").count() == 0 and slots.count() > 0


def test_split_suites_stay_inside_their_split(spark, folder):
    items = views.items(spark, folder)
    halves = items.select("group_id", F.when(F.col("group_id") % 2 == 0, "test").otherwise("train").alias("split")).distinct()
    slots = K.suite_by_split(items, halves, pool(spark, folder), "test", min_cases=10)
    owner = items.select("item_id", "group_id").distinct()
    seen = slots.select("item_id").union(slots.select("query_id")).distinct().join(owner, "item_id")
    assert seen.count() > 0 and seen.filter("group_id % 2 <> 0").count() == 0


def test_unsound_vectors_are_named(spark):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, "item_id long, vec array<double>")
    with pytest.raises(Exception, match=r"items \[2\]"):
        knn.knn_topk(vectors, vectors, 2).collect()
    with pytest.raises(Exception, match=r"items \[4\]"):
        gone = spark.createDataFrame([(1, [1.0]), (4, None)], "item_id long, vec array<double>")
        knn.knn_topk(gone, gone, 2).collect()


def test_many_blocks_merge_to_the_same_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "item_id long, vec array<double>")
    one = {tuple(r) for r in knn.knn_topk(vectors, vectors, 5, layout=(1, 1)).collect()}
    many = {tuple(r) for r in knn.knn_topk(vectors, vectors, 5, layout=(3, 7)).collect()}
    assert one == many and len(one) == 300


def test_letters_end_with_z(spark):
    row = spark.range(1).select(answers.index_to_letter(F.lit(24), F.lit(25)).alias("l"))
    assert row.first().l == "Y"
    with pytest.raises(Exception, match="more than 25"):
        spark.range(1).select(answers.index_to_letter(F.lit(30), F.lit(0))).collect()


def test_verdicts_keep_rows_of_items_in_two_corpora(spark):
    rows = [(1, "p", 1, 1, 1, "gallery", c) for c in ("same", "cross")] + [(2, "q", 1, 1, 1, "query", "same")]
    items = spark.createDataFrame(rows, "item_id long, path string, group_id long, entity_id long, source_id long, role string, corpus string")
    out = models.filter_by_verdict(items, lambda paths: "NO\n" * len(paths)).collect()
    assert sorted((r.item_id, r.corpus, r.keep) for r in out) == [(1, "cross", False), (1, "same", False), (2, "same", True)]


def test_online_assignment_on_text_ids(spark, folder):
    rows = queries_online.detections(spark, folder)
    text = rows.withColumn("group_id", F.concat(F.lit("g"), "group_id")).withColumn("item_id", F.format_string("i%09d", "item_id"))
    plain = {r.item_id: r.assigned_to for r in assign.assign_entities(rows, assign.cosine_matcher(0.25)).collect()}
    got = {int(r.item_id[1:]): r.assigned_to for r in assign.assign_entities(text, assign.cosine_matcher(0.25)).collect()}
    assert got == plain


def test_orders_may_be_text_or_sparse(spark):
    rows = [(g, f"/img/{g}/{i:04d}.jpg", i * 10**12 - 5) for g in range(3) for i in range(700 if g == 0 else 9)]
    table = spark.createDataFrame(rows, "g long, path string, at long")
    for order in ("path", "at"):
        got = sorted((r.g, r[order]) for r in C.spread_three(table, ["g"], order).collect())
        want = []
        for g in range(3):
            mine = sorted(r[1] if order == "path" else r[2] for r in rows if r[0] == g)
            want += [(g, mine[i]) for i in (0, len(mine) // 3, 2 * len(mine) // 3)]
        assert got == sorted(want)
        placed = C.group_adjacent_order(table, "g", order).orderBy("pos").collect()
        assert [r.pos for r in placed] == list(range(len(rows)))
        runs = [r.g for i, r in enumerate(placed) if i == 0 or placed[i - 1].g != r.g]
        assert len(runs) == 3
        for g in range(3):
            mine = [r[order] for r in placed if r.g == g]
            assert mine == sorted(mine)
