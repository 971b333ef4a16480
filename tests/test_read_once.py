"""Tables that several steps read are built once."""

import datetime

import pytest
from pyspark.sql import functions as F

from lineup.operators import cases as K
from lineup.plans import queries_cases, queries_eval, queries_neighbors, views


READS = 9  # passes over the items; 14 when each step counted for itself


def _counting(spark, kind):
    """A function that passes its argument through, and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    def passed(x):
        calls.add(1)
        return x

    return F.udf(passed, kind).asNondeterministic(), calls


def test_compared_sources_share_one_scoring(spark, monkeypatch):
    """compare_sources reads the expert's rows five times; they are scored once."""
    seen, calls = _counting(spark, "string")
    rows = [(f"c{i}", "s", "ABC"[i % 3], "ABC"[i % 2], 3) for i in range(200)]
    frame = spark.createDataFrame(rows, "case_id string, scenario string, answer_letter string, prediction string, n_gallery int")
    monkeypatch.setattr(queries_eval, "scored", lambda *_: frame.withColumn("prediction", seen("prediction")))
    got = queries_eval.compare_sources(spark, None).collect()
    assert got and all(r.hybrid_pred == min(r.expert_pred, r.model_pred) for r in got)
    assert {r.case_id: r.expert_pred for r in got}.items() <= {r[0]: r[3] for r in rows}.items()
    assert calls.value == len(rows)


@pytest.fixture
def small(spark, tmp_path):
    """Events, some of them twice, one under two users and one without an id, and a few vectors."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at, i % 9, "click", 1.0) for i in range(40)] + [(3, at, 3, "click", 1.0), (4, at, 8, "view", 1.0), (None, at, 1, "view", 1.0)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    vectors = [(i, [float(i), 1.0]) for i in range(7)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    return str(tmp_path)


def test_named_groups_stand_in_the_store_of_vectors(spark, small, monkeypatch):
    """suite_from_names stores its vectors once, with the groups that the paths name."""
    given = {}
    monkeypatch.setattr(K, "scenario_suite", lambda items, pool: given.update(items=items, pool=pool))
    queries_cases.suite_from_names(spark, small)
    pool = given["pool"]
    assert pool.owned is not None
    plain = queries_neighbors.pool(spark, small).vectors
    want = plain.join(given["items"].select("item_id", "group_id").distinct(), "item_id")
    columns = ["item_id", "group_id", "vec"]
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(pool.owned.select(columns)) == rows(want.select(columns))
    assert rows(pool.vectors.filter("item_id is not null").select("item_id", "vec")) == rows(
        plain.filter("item_id is not null").select("item_id", "vec"))


def test_suite_reads_its_items_a_few_times(spark, folder):
    """The cells are counted once; layouts, triples, requests and targets read them."""
    seen, calls = _counting(spark, "string")
    items = views.items(spark, folder)
    n = items.count()
    pool = queries_neighbors.pool(spark, folder)
    suite = K.scenario_suite(items.withColumn("corpus", seen("corpus")), pool, padded=False)
    assert suite.count() > 0
    assert calls.value <= READS * n
