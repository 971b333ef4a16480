"""Every registered query against its SQL, value by value."""

import math

import pytest

import __spark_entry__ as entry
from lineup.plans import queries_cases, queries_eval, queries_text

# The smallest tables have so few groups that every one is a test group.
MAY_BE_EMPTY = {"complement_split", "training_by_split"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows(records, order):
    return sorted(tuple(str(plain(r[i])) for i in order) for r in records)


@pytest.fixture(scope="module", autouse=True)
def one_suite(spark, folder):
    """Queries that read the suite share one build here; ``scenario_suite`` checks it."""
    built = queries_cases.suite(spark, folder).persist()
    with pytest.MonkeyPatch.context() as patch:
        for module in (queries_cases, queries_eval, queries_text):
            patch.setattr(module, "suite", lambda *_: built)
        yield
    built.unpersist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, folder, name):
    frame = QUERIES[name](spark, folder)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    got = rows([tuple(r) for r in frame.collect()], [frame.columns.index(c) for c in sorted(columns)])
    want = rows(result.fetchall(), [columns.index(c) for c in sorted(columns)])
    assert got == want
    assert got or name in MAY_BE_EMPTY, "a check of nothing passes too easily"


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
