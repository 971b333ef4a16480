"""Ranking, neighbour search, cases and models against plain computations."""

import hashlib
import threading

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lineup.functions.hashing import PAIR_FACTORS, hash_int, order_key
from lineup.operators import cases as K
from lineup.operators import corpus as C
from lineup.operators import knn, models, pools, ranking, scoring
from lineup.plans import queries_neighbors, views
from lineup.session import together


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, F.lit(0).cast("long")).otherwise(F.col("id") % 50).alias("k"), "id"
    )


def test_group_rank_of_a_hot_key(skewed):
    got = ranking.group_rank(skewed, ["k"], order_key("t", "id"), "id", total="n")
    rows = [(r.k, r.id, r["rank"], r.n) for r in got.collect()]
    assert len(rows) == 3000
    for key in {k for k, *_ in rows}:
        ranks = sorted(r for k, _, r, _ in rows if k == key)
        assert ranks == list(range(len(ranks)))
        assert {n for k, *_, n in rows if k == key} == {len(ranks)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, skewed, how):
    right = spark.range(0, 50, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = skewed.join(right, "k", how)
    got = ranking.skew_join(skewed, right, ["k"], how).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_chunks_are_bounded_and_whole(skewed):
    lists = ranking.chunked_lists(skewed, ["k"], "id", "c", chunk=100).collect()
    assert max(len(r["items"]) for r in lists) <= 100
    assert sorted(i for r in lists for i in r["items"]) == list(range(3000))


def test_numbered_spreads_long_counts(spark):
    frame = spark.createDataFrame([("a", 25_001), ("b", 3), ("c", 0)], "k string, n long")
    got = K.numbered(frame, "n", "i").groupBy("k").agg(F.count("*").alias("c"), F.max("i").alias("m"))
    assert {(r.k, r.c, r.m) for r in got.collect()} == {("a", 25_001, 25_001), ("b", 3, 3)}


def _vectors(spark, n=300, d=8, copies=40):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(n, d))
    m[:copies] = m[0]
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m = m.astype(np.float32)
    rows = [(i, i % 7, [float(x) for x in v]) for i, v in enumerate(m)]
    return m.astype(np.float64), spark.createDataFrame(rows, "item_id long, owner_id int, vec array<float>")


@pytest.mark.parametrize("layout", [(1, 1), (3, 4)])
def test_knn_equals_brute_force_with_ties(spark, layout):
    m, frame = _vectors(spark)
    sims = np.round(m @ m.T, 6)
    got = {}
    for r in knn.knn_topk(frame, frame, 5, budget=4096, layout=layout).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.nbr_id, r.sim)
    for q in range(len(m)):
        best = sorted(range(len(m)), key=lambda j: (-sims[q, j], j))[:5]
        assert [got[q][i + 1][0] for i in range(5)] == best


def _pair_key(a, b):
    x = (a + b) * PAIR_FACTORS[0] % 2**64
    x ^= x >> 32
    return (x * PAIR_FACTORS[1] % 2**64) >> 4


@pytest.mark.parametrize("layout", [(1, 1), (4, 3)])
def test_sampled_pool_equals_brute_force(spark, layout):
    m, frame = _vectors(spark, copies=1)
    bits = frame.select(
        "item_id", knn.hash_bits("pool_query", "item_id").alias("q"), knn.hash_bits("pool_item", "item_id").alias("g")
    ).collect()
    q, g = ({r.item_id: r[c] for r in bits} for c in ("q", "g"))
    sims = np.round(m @ m.T, 6)
    got = {}
    for r in knn.sampled_pool(frame, frame, 0.3, 3, budget=4096, layout=layout).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.sim, r.pool_size))
    for i in range(len(m)):
        pool = [j for j in range(len(m)) if sims[i, j] >= 0.3 and i % 7 != j % 7]
        want = sorted(pool, key=lambda j: (_pair_key(q[i], g[j]), j))[:3]
        assert sorted(got.get(i, [])) == [(n, j, pytest.approx(sims[i, j]), len(pool)) for n, j in enumerate(want, 1)]


def test_sampled_pools_of_queries_are_independent(spark):
    """Items that share a sample once do not share the next more often than chance."""
    vectors = spark.range(400).select(F.col("id").alias("item_id"), F.col("id").alias("owner_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    sample = knn.sampled_pool(vectors, vectors, 0.5, 4)
    assert "collect_list" not in sample._jdf.queryExecution().toString()
    together, uses = {}, {}
    of = {}
    for r in sample.collect():
        of.setdefault(r.query_id, []).append(r.item_id)
        uses[r.item_id] = uses.get(r.item_id, 0) + 1
        assert r.pool_size == 399
    for items in of.values():
        for a in items:
            for b in items:
                if a < b:
                    together[a, b] = together.get((a, b), 0) + 1
    assert all(len(set(x)) == 4 for x in of.values())
    # 2,400 of 79,800 pairs: the expected counts are 0.03 a pair and 4 an item.
    assert max(together.values()) <= 3 and max(uses.values()) <= 16
    assert sum(n > 1 for n in together.values()) <= 90


def test_blocks_near_pivots_are_pruned(spark):
    """Clusters apart from each other: a query visits few blocks, with the same neighbours."""
    rng = np.random.default_rng(8)
    centers = 10 * rng.normal(size=(12, 6))
    points = np.concatenate([c + 0.1 * rng.normal(size=(40, 6)) for c in centers])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, i % 90, [float(x) for x in v]) for i, v in enumerate(points)], "item_id long, group_id int, vec array<double>")
    placed, middles, radii = knn._placed(frame.select("item_id", "vec"), 12, 1 << 20)
    assert placed.count() == 480 and placed.groupBy("_c").count().agg(F.max("count")).first()[0] <= 40 * 3
    floors = frame.withColumn("floor", F.lit(0.99))
    visits = knn._visits(floors, middles, radii, False).count() + 480
    assert visits < 480 * len(radii) / 2
    for layout in ((1, 1), (3, 12)):
        near = {(r.query_id, r["rank"]): (r.nbr_id, r.sim) for r in knn.knn_topk(frame, frame, 7, layout=layout).collect()}
        sims = np.round(points @ points.T, 6)
        for i in range(480):
            best = sorted(range(480), key=lambda j: (-sims[i, j], j))[:7]
            assert [near[i, n + 1][0] for n in range(7)] == best


@pytest.mark.parametrize("layout", [(1, 1), (2, 5)])
def test_nearest_groups_equal_brute_force(spark, layout):
    """A third of all rows in one group, ties, and text ids."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(300, 5))
    m[:60] = m[0]
    group = ["big" if i % 3 == 0 else f"g{i % 23}" for i in range(300)]
    frame = spark.createDataFrame([(f"i{i:03d}", group[i], [float(x) for x in v]) for i, v in enumerate(m)], "item_id string, group_id string, vec array<double>")
    got = {}
    for r in knn.nearest_groups(frame, frame, 6, layout=layout).collect():
        got.setdefault(r.query_id, []).append((r.group_rank, r.nbr_group, r.nbr_id, r.sim))
    sims = np.round(m @ m.T, 6)
    for i in range(300):
        best = {}
        for j in sorted(range(300), key=lambda j: (-sims[i, j], j)):
            if group[j] != group[i]:
                best.setdefault(group[j], j)
        want = [(n, g, f"i{j:03d}", pytest.approx(sims[i, j])) for n, (g, j) in enumerate(list(best.items())[:6], 1)]
        assert sorted(got[f"i{i:03d}"]) == want


def _clustered(rng, n):
    """Clusters with exact copies, and unit vectors that lie alone."""
    centers = rng.normal(size=(24, 16))
    m = np.concatenate([centers[rng.integers(0, 24, n // 2)] + 0.05 * rng.normal(size=(n // 2, 16)), rng.normal(size=(n - n // 2, 16))])
    m[: n // 8] = m[n // 8 : 2 * (n // 8)]
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


def _block(m, groups):
    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))
    return pa.table({"item_id": pa.array(np.arange(len(m))), "group_id": pa.array(groups), "vec": vec})


@pytest.mark.parametrize("wide", [0.0, 0.25, 1.0])
def test_leaves_leave_out_no_neighbour(monkeypatch, wide):
    """A block in leaves gives the rows of the whole block; few products are looked at."""
    rng = np.random.default_rng(12)
    m = _clustered(rng, 3000)
    block = _block(m, rng.integers(0, 300, len(m)))
    seen = []
    look = knn._Products.look
    monkeypatch.setattr(knn._Products, "look", lambda self, *at: (seen.append(look(self, *at).size), look(self, *at))[1])
    for kernel in (knn._best_items(5, 1 << 20), knn._best_groups(5, 1 << 20)):
        with monkeypatch.context() as patch:
            patch.setattr(knn, "LEAF", 1 << 30)
            want = kernel(block, block)
        for name, value in (("LEAF", 32), ("ASKED", 500), ("PENDING", 700), ("WIDE", wide)):
            monkeypatch.setattr(knn, name, value)
        key = [("query_id", "ascending"), ("rank", "ascending")]
        assert kernel(block, block).sort_by(key).equals(want.sort_by(key))
        floors = want.filter(pc.equal(want.column("rank"), 5)).sort_by("query_id")
        asked = block.append_column("floor", pa.array(-floors.column("neg").to_numpy()))
        assert kernel(asked, block).sort_by(key).equals(want.sort_by(key))
    # The clustered half has floors that exclude most leaves.
    near = _block(m[:1500], np.zeros(1500, np.int64)).append_column("floor", pa.array(np.full(1500, 0.9)))
    monkeypatch.setattr(knn, "WIDE", 0.25)
    seen.clear()
    knn._best_items(5, 1 << 20)(near, block)
    assert sum(seen) < 1500 * 3000 / 3


def test_cells_leave_out_no_neighbour(spark, monkeypatch):
    """Blocks of cells give the neighbours of one block, whatever the lengths; near copies visit one block."""
    monkeypatch.setattr(knn, "CELL_ROWS", 8)
    rng = np.random.default_rng(21)
    m = np.concatenate([_clustered(rng, 400), np.zeros((2, _clustered(rng, 4).shape[1]))])
    m = np.concatenate([m, m[:150], np.repeat(m[:1], 120, axis=0)])  # copies, and one cell larger than a block
    m[::7] *= rng.uniform(0.01, 30, size=(len(m[::7]), 1))
    rows = [(i, i % 61, [float(x) for x in v]) for i, v in enumerate(m)]
    frame = spark.createDataFrame(rows, "item_id long, group_id int, vec array<double>")
    for search, k in ((knn.knn_topk, 6), (knn.nearest_groups, 5)):
        some = frame.filter("item_id % 3 = 0")
        want, got = (sorted(map(tuple, search(some, frame, k, layout=layout).collect())) for layout in ((1, 1), (2, 7)))
        assert got == want
    # Copies have floors that exclude every cell but their own, and nothing travels for them again.
    unit = m[:400] / np.linalg.norm(m[:400], axis=1, keepdims=True)
    same = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(np.tile(unit, (6, 1)))], "item_id long, vec array<double>")
    placed, cells, blocks = knn._placed(same, 8, 1 << 20)
    assert len(blocks) > 4 and placed.count() == 2400
    visits, units = knn._counted(same.withColumn("floor", F.lit(1.0)), cells, False)
    assert visits.sum() < 2400 / 4 and units.sum() < len(cells.block) / 2
    assert knn._counted(same, cells, True)[0].sum() == 2400


def test_candidates_store_no_vectors_again(spark, monkeypatch):
    """A store with groups is searched as it is, with the candidates of the joined tables; items without id take no part."""
    m = _clustered(np.random.default_rng(5), 60)
    rows = [(i if i % 50 else None, i % 9 if i % 11 else None, [float(x) for x in v]) for i, v in enumerate(m)]
    owned = spark.createDataFrame([*rows, rows[3]], "item_id long, group_id long, vec array<double>")
    queries = owned.filter("item_id % 4 = 1").select(F.col("item_id").alias("query_id"))
    meta, kept, keep = owned.select("item_id", "group_id"), [], K.cut
    monkeypatch.setattr(K, "cut", lambda df: (kept.append(df.columns), keep(df))[1])
    want = K.candidates_for(queries, K.Pool(meta, owned.select("item_id", "vec")), 4)
    assert sum("vec" in columns for columns in kept) == 1
    got = K.candidates_for(queries, K.Pool(meta, owned.select("item_id", "vec"), owned=owned), 4)
    assert sum("vec" in columns for columns in kept) == 1
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect())) and got.count() > 0


def test_visited_blocks_are_those_of_the_marks(spark, monkeypatch):
    """Few and many marks give the blocks of the reached units, a query's own left out, and are found once a search."""
    m = _clustered(np.random.default_rng(31), 500)
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "item_id long, vec array<double>")
    monkeypatch.setattr(knn, "CELL_ROWS", 8)
    _, cells, _ = knn._placed(frame, 9, 1 << 20)
    own = cells.block[cells.first[cells.cell(m)]]
    for share in (0.99, 0.3, -1.0):
        floor = share * (m**2).sum(1)
        marked = np.concatenate([x for _, _, x in cells.reached(m, floor)])
        want = [sorted(set(cells.block[np.flatnonzero(row)]) - {mine}) for row, mine in zip(marked, own)]
        for many in (1, 1 << 40):
            monkeypatch.setattr(knn, "MANY", many)
            parts = list(knn._asked(m, floor, cells))
            assert [sorted(np.flatnonzero(row)) for _, _, visited, _ in parts for row in visited] == want
            needed = {u for row, mine in zip(marked, own) for u in np.flatnonzero(row) if cells.block[u] != mine}
            assert needed <= {u for *_, units in parts for u in units}
    made, make = [], knn._addressed
    monkeypatch.setattr(knn, "_addressed", lambda *a: (made.append(1), make(*a))[1])
    knn.knn_topk(frame, frame, 3, layout=(2, 9)).count()
    assert len(made) == 1


def test_few_queries_do_not_shuffle_the_corpus(spark):
    """Ten queries against many blocks: the corpus is read where it lies, with the same neighbours."""
    rng = np.random.default_rng(13)
    m = _clustered(rng, 600)
    frame = spark.createDataFrame([(i, i % 50, [float(x) for x in v]) for i, v in enumerate(m)], "item_id long, group_id long, vec array<float>").repartition(3)
    few = frame.filter("item_id % 60 = 7")
    found = knn.nearest_groups(few, frame, 6, budget=4096)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    want = knn.nearest_groups(few, frame, 6, layout=(1, 1))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and want.count() == 60


def test_pools_keep_single_precision(monkeypatch):
    """A block's vectors stand in memory once, and keys are made for similar pairs only."""
    m = _clustered(np.random.default_rng(14), 400)
    block = _block(m, np.zeros(400, np.int64))
    held = knn._Products(knn._matrix(block, dtype=None), knn._matrix(block, dtype=None))
    assert held.block.dtype == np.float32 and np.shares_memory(held.block, held._c)
    near = np.zeros((3, 400), bool)
    near[0, :50], near[2, 7] = True, True
    made = []
    keys = knn.pair_keys
    monkeypatch.setattr(knn, "pair_keys", lambda a, b: (made.append(np.broadcast(a, b).size), keys(a, b))[1])
    rows, cols = knn._smallest_keys(near, np.arange(3), np.arange(400), 4)
    assert sum(made) <= 51 and (rows == 0).sum() == 4 and cols[rows == 2].tolist() == [7] and not (rows == 1).any()


def test_a_large_own_group_takes_no_candidates(spark):
    """300 items of the query's group are nearer than any other; the case pads in full."""
    near = [(i, 1, [1.0, i * 1e-6]) for i in range(300)]
    others = [(1000 + i, 2 + i % 8, [0.5, 0.5 + i * 1e-3]) for i in range(40)]
    rows = near + others
    meta = spark.createDataFrame([(i, g, g) for i, g, _ in rows], "item_id long, group_id long, entity_id long")
    pool = K.Pool(meta, spark.createDataFrame([(i, v) for i, _, v in rows], "item_id long, vec array<double>"))
    cases = spark.createDataFrame([(f"c{i}", "s", i, 1, None) for i in range(20)], "case_id string, scenario string, query_id long, natural long, other_group long")
    sizes = {r.case_id: r.n for r in cases.select("case_id", hash_int(F.lit(1), F.lit(5), "target", "case_id").alias("n")).collect()}
    got = K.pad_with_negatives(cases, pool, 5).groupBy("case_id").count().collect()
    assert {r["case_id"]: r["count"] + 1 for r in got} == {c: n for c, n in sizes.items() if n > 1}


@pytest.mark.parametrize("layout", [(1, 1), (3, 4)])
def test_product_pool_equals_brute_force(spark, layout):
    """Products of very different sizes; draws are positions in the listed pool."""
    rng = np.random.default_rng(10)
    owners = [0] * 120 + [int(x) for x in rng.integers(1, 40, 240)]
    m = rng.normal(size=(360, 4))
    frame = spark.createDataFrame([(i, owners[i], [float(x) for x in v]) for i, v in enumerate(m)], "item_id long, owner_id int, vec array<double>")
    keys = {r.item_id: r for r in frame.select(
        "item_id", knn.order_key("item", "item_id").alias("k"), knn.hash_bits("product", "owner_id").alias("b"),
        *[knn.hash_bits("product_pool", "item_id", F.lit(str(j))).alias(f"d{j}") for j in range(3)]).collect()}
    first = {o: min(i for i in range(360) if owners[i] == o) for o in set(owners)}
    sims = np.round(m @ m.T, 6)
    got = {}
    for r in knn.product_pool(frame, 0.5, 3, layout=layout, draws_per_part=50).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.pool_size, r.sim))
    for i in range(360):
        mine = first[owners[i]]
        similar = [o for o in first if o != owners[i] and sims[mine, first[o]] > 0.5]
        pool = sorted((keys[j].b, owners[j], keys[j].k, j) for j in range(360) if owners[j] in similar)
        drawn = []
        for j in range(min(3, len(pool))):
            x = keys[i][f"d{j}"] % (len(pool) - j)
            for taken in sorted(drawn):
                x += x >= taken
            drawn.append(x)
        want = [(n, pool[x][3], len(pool), pytest.approx(sims[mine, first[owners[pool[x][3]]]])) for n, x in enumerate(drawn, 1)]
        assert sorted(got.get(i, [])) == want


def test_product_pool_compares_products_only(spark):
    frame = spark.range(3000).select(F.col("id").alias("item_id"), (F.col("id") % 10).cast("int").alias("owner_id"), F.array(F.lit(1.0)).alias("vec"))
    got = knn.product_pool(frame, 0.5, 4)
    assert got.groupBy("query_id").count().filter("count = 4").count() == 3000
    assert got.filter("pool_size = 2700").count() == 12_000
    spread = got.groupBy("item_id").count().agg(F.max("count")).first()[0]
    assert spread < 20  # four draws an item on average


@pytest.mark.parametrize("layout", [None, (2, 3)])
def test_intra_group_blocks(spark, layout):
    m, frame = _vectors(spark, n=60, copies=1)
    got = {r.item_id: r for r in knn.intra_group_similarity(frame, layout=layout).collect()}
    sims = np.round(m @ m.T, 6)
    for i in range(60):
        others = [j for j in range(60) if j % 7 == i % 7 and j != i]
        assert got[i].nearest == min(others, key=lambda j: (-sims[i, j], j))


def _slots(suite):
    return suite.collect()


def test_case_invariants(spark, folder, suite):
    owner = {r.item_id: r for r in views.items(spark, folder).collect()}
    cases = {}
    for s in _slots(suite):
        cases.setdefault(s.case_id, []).append(s)
    assert cases
    for slots in cases.values():
        head = slots[0]
        query = owner[head.query_id]
        assert sorted(s.pos for s in slots) == list(range(1, head.n_gallery + 1))
        assert len({s.item_id for s in slots}) == len(slots)
        assert head.query_id not in {s.item_id for s in slots}
        same = [s for s in slots if owner[s.item_id].entity_id == query.entity_id]
        negatives = [owner[s.item_id].group_id for s in slots if s.kind == "negative"]
        assert len(set(negatives)) == len(negatives)
        assert query.group_id not in negatives
        if head.label == -1:
            assert all(owner[s.item_id].group_id != query.group_id for s in slots)
        else:
            assert [s.pos for s in same] == [head.label]
            camera = "same" if head.scenario.endswith("samecamera") else "cross"
            for s in slots:
                if s.kind != "negative":
                    assert (owner[s.item_id].source_id == query.source_id) == (camera == "same")
        natural = sum(s.kind != "negative" for s in slots)
        assert head.n_gallery <= max(natural, K.MAX_GALLERY)


def test_every_scenario_has_its_minimum(suite):
    counts = dict(
        (r.scenario, r.n) for r in K.heads(suite).groupBy("scenario").agg(F.count("*").alias("n")).collect()
    )
    assert len(counts) == 10
    assert all(n >= 150 for s, n in counts.items() if s.startswith("cropped"))


def test_result_does_not_depend_on_partitions(spark, folder):
    results = []
    for partitions in ("1", "4", "32"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        items = views.items(spark, folder).repartition(int(partitions))
        results.append(sorted(map(tuple, K.household_cases(items).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2] and results[0]


def test_split_is_disjoint_and_whole(spark, folder):
    items = views.items(spark, folder)
    split = C.split_by_tier(C.group_tiers(items), {"tier1": 1, "tier2": 1, "tier3": 1})
    rows = split.collect()
    assert len(rows) == len({r.group_id for r in rows})
    assert sum(r.split == "test" for r in rows) == 3


def test_audit_of_nothing_fails(spark, folder):
    items = views.items(spark, folder).withColumn("scenario", F.col("corpus"))
    with pytest.raises(Exception, match="no cases to audit in other"):
        C.leakage_by_scenario(items, items, ["same", "other"]).collect()


def test_removal_counts_come_from_full_tables(spark, folder):
    items = views.items(spark, folder)
    report = C.removal_report(items, items.filter("role = 'query' OR entity_id > 2")).collect()
    assert all(r.n_kept + r.n_removed == r.n_original and r.pct_removed <= 100 for r in report)


def test_conflicting_prediction_is_reported(spark):
    rows = spark.createDataFrame(
        [("f.csv", 1, "B", "Answer: C."), ("f.csv", 2, "", "Answer: C."), ("f.csv", 3, "", "?")],
        "file string, idx int, prediction string, response string",
    )
    filled = scoring.fill_predictions(rows)
    assert {(r.idx, r.prediction, r.conflict) for r in filled.collect()} == {
        (1, "B", True), (2, "C", False), (3, "-1", False)}
    with pytest.raises(Exception, match="f.csv row 1"):
        scoring.assert_no_conflicts(filled, "file", "idx").collect()


def test_single_item_products_give_no_query(spark):
    m, frame = _vectors(spark, n=20, copies=1)
    lonely = frame.withColumn("owner_id", F.when(F.col("item_id") == 5, 99).otherwise(F.col("owner_id")))
    queries = {r.query_id for r in K.product_cases(lonely, 3, -1.0).collect()}
    assert queries == set(range(20)) - {5}


def test_household_negatives_in_a_group_of_many_sources(spark):
    """2,000 sources: negatives are other members' items under the camera rule, each position equally likely."""
    rng = np.random.default_rng(12)
    rows, i = [], 0
    for source in range(2000):
        for entity in range(3):
            for _ in range(int(rng.integers(0, 3))):
                rows.append((i, 1, entity, source, "query" if rng.random() < 0.05 else "gallery", "same"))
                i += 1
    items = spark.createDataFrame(rows, "item_id long, group_id long, entity_id long, source_id long, role string, corpus string")
    of = {r[0]: r for r in rows}
    slots = K.household_cases(items, draws=2).collect()
    cases = {}
    for s in slots:
        cases.setdefault(s.case_id, []).append(s)
    assert len(cases) > 300
    for case in cases.values():
        query = of[case[0].query_id]
        own = [of[s.item_id] for s in case if s.kind == "own"]
        negatives = [of[s.item_id] for s in case if s.kind == "negative"]
        cross = "crosscamera" in case[0].scenario
        assert len(own) == 1 and len({n[0] for n in negatives}) == 4 and all(n[4] == "gallery" for n in negatives)
        assert own[0][2] == query[2] and all(n[2] != query[2] for n in negatives)
        assert all((n[3] != query[3]) == cross for n in (*own, *negatives))
    uses = [of[s.item_id][3] for s in slots if s.kind == "negative"]
    halves = sum(u < 1000 for u in uses) / len(uses)
    assert 0.4 < halves < 0.6


@pytest.mark.parametrize("seed", range(3))
def test_interval_lookup_equals_a_scan(spark, seed):
    rng = np.random.default_rng(seed)
    ranges, want, asked = [], {}, []
    for entity in range(6):
        keys = np.sort(rng.integers(0, [5, 50, 5000][seed], [1, 3, 40, 200, 7, 12][entity]))
        past = np.cumsum(rng.integers(1, 9, len(keys)))
        ranges += [("c", entity, int(k), int(p)) for k, p in zip(keys, past)]
        for n in range(50):
            f = int(rng.integers(0, keys.max() + 20))
            asked.append((f"{entity}-{n}", "s", 0, "c", 1, entity, f))
            want[f"{entity}-{n}"] = max([int(p) for k, p in zip(keys, past) if k <= f], default=0)
    got = K._stepped_over(
        spark.createDataFrame(asked, "case_id string, scenario string, query_id int, corpus string, group_id int, entity_id int, f long"),
        spark.createDataFrame(ranges, "corpus string, entity_id int, key long, past long"))
    assert {r.case_id: r.past for r in got.collect()} == want and got.count() == len(asked)


def test_distinct_draws_are_uniform(spark):
    rows = spark.range(6000).select(F.col("id"), knn.distinct_draws(F.lit(6).cast("long"), 4, "t", "id").alias("d"))
    lists = [r.d for r in rows.collect()]
    assert all(len(set(d)) == 4 and min(d) >= 0 and max(d) < 6 for d in lists)
    for place in range(4):
        counts = np.bincount([d[place] for d in lists], minlength=6)
        assert abs(counts - 1000).max() < 150
    assert spark.range(1).select(knn.distinct_draws(F.lit(2).cast("long"), 4, "t", "id").alias("d")).first().d in ([0, 1], [1, 0])
    assert spark.range(1).select(knn.distinct_draws(F.lit(0).cast("long"), 4, "t", "id").alias("d")).first().d == []


def test_turns_go_round_when_one_entity_is_asked_often(spark):
    """20,000 cases of one entity: its items are used equally often, in known and in stranger cases."""
    rows = [(i, 1, 1 + i % 2, 7, "gallery", "same") for i in range(14)] + [(100 + i, 2 + i, 50 + i, 8, "query", "same") for i in range(5)]
    items = spark.createDataFrame(rows, "item_id long, group_id long, entity_id long, source_id long, role string, corpus string")
    numbering = K.roles(items.filter("role = 'gallery'"), merged=True)
    asked = spark.range(20_000).select(
        F.concat(F.lit("c"), "id").alias("case_id"), F.lit("s").alias("scenario"), F.lit("same").alias("corpus"),
        F.lit(1).cast("long").alias("group_id"), F.lit(1).cast("long").alias("entity_id"), F.lit(7).cast("long").alias("source_id"),
        F.lit("same").alias("camera"), F.lit(2).cast("long").alias("family_size"))
    picked = K.pick_queries(asked, numbering.queries, diverse=True)
    uses = [r["count"] for r in picked.groupBy("query_id").count().collect()]
    assert len(uses) == 7 and max(uses) - min(uses) <= 1
    plan = picked._jdf.queryExecution().toString()
    assert "_bucket" in plan
    _, members = K.family_parts(asked, items, numbering.gallery, diverse=True)
    shown = {r.item_id: r["count"] for r in members.groupBy("item_id").count().collect()}
    for entity in (0, 1):
        own = [n for i, n in shown.items() if i % 2 == entity]
        assert sum(own) == 20_000 and max(own) - min(own) <= 1


def test_case_keys_tell_parts_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a\\", "|b|c"), ("a", None), ("a", "\\N"), ("x", "y")], "p string, q string")
    keys = [r.k for r in rows.select(K.case_key("p", "q").alias("k")).collect()]
    assert len(set(keys)) == 6 and keys[-1] == "x|y"


def test_failing_verdict_keeps_items(spark, folder):
    rows = views.paths(spark, folder).limit(40).withColumn("group_id", F.lit(1))

    def broken(paths):
        raise TimeoutError("no reply")

    got = models.filter_by_verdict(rows, broken, report=True)
    assert got.filter("NOT keep").count() == 0
    assert {(r.failure, r.attempts) for r in got.filter("role = 'gallery'").collect()} == {("TimeoutError", 3)}


def test_a_mistake_in_the_verdict_ends_the_job(spark, folder):
    rows = views.paths(spark, folder).limit(40).withColumn("group_id", F.lit(1))

    def wrong(paths):
        return paths.no_such_thing

    with pytest.raises(Exception, match="no_such_thing"):
        models.filter_by_verdict(rows, wrong).collect()


def test_hot_group_of_a_third(spark, folder):
    """A third of all items moves into one group: the checks still hold."""
    items = views.items(spark, folder).withColumn(
        "group_id", F.when(F.col("item_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("group_id"))
    ).withColumn("entity_id", F.when(F.col("item_id") % 3 == 0, F.lit(900).cast("long")).otherwise(F.col("entity_id")))
    pool = queries_neighbors.pool(spark, folder)
    pool = K.Pool(items.select("item_id", "group_id", "entity_id"), pool.vectors)
    slots = K.exhaustive_strangers(items, pool, "singleton").collect()
    assert slots and all(s.label == -1 for s in slots)
    assert C.filter_split(items, items.select("group_id").distinct().withColumn("split", F.lit("a")), "a").count() == 1000


@pytest.mark.parametrize("whole", [0, 3, 50_000])
def test_only_large_groups_are_cut_into_buckets(spark, monkeypatch, whole):
    rows = [("big", i) for i in range(40)] + [("small", i) for i in range(3)] + [(None, 1)]
    df = spark.createDataFrame(rows, "k string, id long")
    monkeypatch.setattr(ranking, "WHOLE", whole)
    got = ranking.group_rank(df, ["k"], order_key("t", "id"), "id", total="n").collect()
    want = {}
    for k in ("big", "small"):
        ids = sorted((i for key, i in rows if key == k), key=lambda i: hashlib.md5(f"42|t|{i}".encode()).hexdigest())
        want |= {(k, i): (at, len(ids)) for at, i in enumerate(ids)}
    assert {(r.k, r.id): (r["rank"], r.n) for r in got} == want and len(got) == len(want)


def test_a_group_of_few_rows_has_one_bucket(spark):
    df = spark.range(300).selectExpr("id % 3 AS k", "id")
    keyed = df.withColumns({"_order": order_key("t", "id"), "_bucket": order_key("t", "id"), "_value": F.lit(1)})
    running, starts = ranking._by_size(keyed, ["k"], None)
    assert starts.count() == 3 and running.select("_bucket").distinct().count() == 1


def test_strangers_numbered_once_are_drawn_alike(spark):
    pool = spark.range(60).selectExpr("'same' AS corpus", "id % 7 AS group_id", "id AS item_id")
    asked = spark.range(20).selectExpr("concat('c', id) AS case_id", "id % 8 AS group_id")
    numbered = pools.strangers(pool, stored=True)
    draw = lambda p: sorted(pools.draw_strangers(asked, p).collect())
    assert draw(numbered) == draw(pool) and len(draw(pool)) == 20


@pytest.mark.parametrize("dim", [1, 3, 64, 300])
def test_products_of_directions_are_exact_in_single_precision(dim):
    grid = knn._grid(np.random.default_rng(dim).normal(size=(50, dim)))
    whole = grid.astype(np.int64)
    assert grid.dtype == np.float32 and (np.abs(grid).max(1) > 0).all()
    assert (grid @ grid.T == whole @ whole.T).all()


def test_steps_run_together_and_raise(spark):
    met = threading.Barrier(2, timeout=30)
    assert together(spark, lambda: met.wait() >= 0, lambda: met.wait() >= 0) == [True, True]
    with pytest.raises(ZeroDivisionError):
        together(spark, lambda: 1 // 0, lambda: 1)
