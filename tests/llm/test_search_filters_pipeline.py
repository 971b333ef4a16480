"""Top-k search, URL filters, the pipeline and the registered queries."""

import datetime
import random
import re

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lineup.llm import queries, topk_search as ts, url_filters as uf

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, scale=64):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)
            good[i] = max(good.get(i, w), w)
    out = {}
    for q, a in good.items():
        scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in good.items() if i != q and len(b) == len(a)))
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def found(frame, k):
    v = ts.quantise(frame)
    out = {}
    for r in ts.topk_search(v, v, k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


@pytest.mark.parametrize("block", [8192, 37])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ts, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(300, None), (301, [None] + [0.1] * 7), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, [0.1] * 8)]
    rows += [(304, [0.0] * 8), (305, [-0.7] * 8), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    assert found(frame, 7) == {q: x for q, x in brute(rows, 7).items() if x}


def test_topk_few_and_none(spark):
    frame = spark.createDataFrame([(1, [0.5], 0), (2, [0.25], 0)], VECTORS)
    assert found(frame, 20) == {1: [(1, 2, 512)], 2: [(1, 1, 512)]}
    assert found(frame.limit(0), 20) == {}
    assert found(spark.createDataFrame([(1, [], 0), (2, [], 0), (3, [0.1], 0)], VECTORS), 2) == {1: [(1, 2, 0)], 2: [(1, 1, 0)]}


def test_reading_stops_early():
    """One direction dominates, so few bands decide; the answer stays exact."""
    rng = np.random.default_rng(2)
    m = np.round(rng.exponential(20, (4000, 4))).astype(np.float64)
    q = np.array([[9.0, 1.0, 0.0, -1.0]])
    rows, ids, score = ts.search(ts.Lists(m), np.arange(4000), q, np.array([-1]), 5)
    want = sorted((-s, i) for i, s in enumerate(m @ q[0]))[:5]
    assert [(-int(s), int(i)) for s, i in zip(score, ids)] == [(int(a), b) for a, b in want]


# -- URL filters ---------------------------------------------------------------------

CAPTURES = "page_id long, url string, fetched date, category string, salt int, host string"
ENTRIES = "pattern string, category string, action string, day date"
D = datetime.date


def keys_of(url):
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.\-]*://)?([^/?#]*)(/[^?#]*)?", url.strip())
    host = re.sub(r":[0-9]*$", "", re.sub(r"^.*@", "", m[1])).lower().rstrip(".")
    host = re.sub(r"^www\.", "", host)
    labels, path = host.split("."), m[2] or ""
    keys = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))}
    parts = path.split("/")
    if path:
        keys |= {host + "/".join(parts[:i]) + ("/" if i < len(parts) else "") for i in range(1, len(parts) + 1)}
    return host, keys


def active(entries, pattern, category, day):
    state = {}
    for p, c, a, d in entries:
        if (p, c) == (pattern, category) and d <= day:
            state.setdefault(d, set()).add(a)
    return bool(state) and state[max(state)] == {"add"}


def test_filters_equal_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.com", "www.A.com", "x.a.com", "b.org", "hot.net", "c.co.uk"]
    urls = [f"http{s}://{h}{p}" for s in ("", "s") for h in hosts for p in ("", "/", "/x/y", "/x/?q=1", "/x#t", ":80/x")]
    captures = [(i, rng.choice(urls), D(2023, 1, 1) + datetime.timedelta(rng.randrange(60))) for i in range(300)]
    captures += [(1000 + i, "http://hot.net/x", D(2023, 1, 15)) for i in range(300)]
    captures += [(2000, None, D(2023, 1, 1)), (2001, "", D(2023, 1, 1)), (2002, "http://a.com", None), (2003, "http://a.com/" + "x/" * 500, D(2023, 2, 1))]
    patterns = ["a.com", "hot.net", "b.org/x/", "x.a.com", "co.uk", "hot.net/x"]
    entries = [(rng.choice(patterns), rng.choice("pq"), rng.choice(["add", "add", "remove"]),
                D(2023, 1, 1) + datetime.timedelta(rng.randrange(50))) for _ in range(60)]
    junk = [(None, "p", "add", D(2023, 1, 1)), ("a.com", None, "add", D(2023, 1, 1)), ("a.com", "p", "other", D(2023, 1, 1)), ("a.com", "p", "add", None)]
    got = {r.page_id: r for r in uf.url_filters(
        spark.createDataFrame([(*c, "z", 1, "h") for c in captures], CAPTURES),
        spark.createDataFrame(entries + entries[:3] + junk, ENTRIES)).collect()}
    assert len(got) == len(captures)
    for i, url, day in captures:
        want = set()
        if url and day:
            for p in keys_of(url)[1]:
                want |= {c for c in "pq" if active(entries, p, c, day)}
        assert got[i].categories == ",".join(sorted(want)), (url, day)
        assert got[i].blocked == bool(want)


def test_filters_on_nothing(spark):
    captures = spark.createDataFrame([(1, "http://a.com", D(2023, 1, 1), "", 0, "")], CAPTURES)
    entries = spark.createDataFrame([("a.com", "p", "add", D(2022, 1, 1))], ENTRIES)
    assert uf.url_filters(captures.limit(0), entries).count() == 0
    assert [r.blocked for r in uf.url_filters(captures, entries.limit(0)).collect()] == [False]
    assert [r.blocked for r in uf.url_filters(captures, entries).collect()] == [True]


def test_captures_of_one_page_are_judged_by_their_own_date(spark):
    """An entry between two fetches blocks the later one only; a null key is judged as well."""
    day = [D(2023, 1, 1), D(2023, 6, 1)]
    captures = spark.createDataFrame(
        [(1, "http://a.com/x", d, "", 0, "") for d in day] + [(None, "http://a.com/y", d, "", 0, "") for d in day] + [(1, "http://b.com", day[1], "", 0, "")], CAPTURES)
    entries = spark.createDataFrame([("a.com", "p", "add", D(2023, 3, 1))], ENTRIES)
    got = {(r.page_id, r.host, r.fetched): r.blocked for r in uf.url_filters(captures, entries).collect()}
    assert got == {(1, "a.com", day[0]): False, (1, "a.com", day[1]): True, (None, "a.com", day[0]): False,
                   (None, "a.com", day[1]): True, (1, "b.com", day[1]): False}


def test_filter_plan_is_native(spark, folder):
    plan = queries.QUERIES["op5_url_filters"](spark, folder)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


# -- pipeline ------------------------------------------------------------------------

def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "suffix_dedup", "mixing", "packing"]
    from lineup.llm import common

    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.store(stage(spark, docs, folder), "t")
        assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        assert rows and set(rows) <= set(before)
        if name != "suffix_dedup":
            assert all(rows[i].text == before[i].text for i in rows)
        else:
            assert all(r.n_chars == len(r.text) for i, r in rows.items() if r.text != before[i].text)
        docs, before = after, rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(before)


@pytest.mark.parametrize("number", range(5))
def test_stage_odd_rows(spark, folder, number):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = "word " * 30_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (4, "a b c d e f g", "en", "s", 13),
            (4, "a b c d e f g", "en", "s", 13), (None, "no id here", None, "s", 10)]
    stage = corpus_pipeline.STAGES[number][1]
    got = stage(spark, spark.createDataFrame(rows, schema), folder).collect()
    if number < 4:
        assert {r.doc_id for r in got} >= {1, 3, 4, None} or number == 3
    else:
        assert len(got) > len(rows)
    assert stage(spark, spark.createDataFrame([], schema), folder).count() == 0


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns_of_any_name(spark, folder, number):
    """Names that the operators use themselves, other types, and no ``n_chars``."""
    passage = "every word of this passage stands in two documents of the table "
    docs = spark.createDataFrame(
        [(1, passage + "first \ufffd text", 1.5), (2, "zwei \ufffdé " + passage, 2.5), (3, "something else entirely", None), (None, passage, 4.0)],
        "doc_id long, text string, rate double").selectExpr(
        "*", *[f"concat('{c}', doc_id) as {c}" for c in ("kept", "words", "f", "p", "n_tokens", "copies", "domains", "rest", "n_removed", "chunk", "c0", "slot", "_row_key")],
        "timestamp'2024-01-02 03:04:05.678901' as at", "cast(rate as decimal(10, 3)) as d", "array(doc_id) as many", "binary('x') as raw")
    got = corpus_pipeline.STAGES[number][1](spark, docs, folder)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    before = {r.doc_id: r for r in docs.collect()}
    rows = got.collect()
    assert {r.doc_id for r in rows} >= {1, 3}
    for r in rows:
        old, new = before[r.doc_id].asDict(), r.asDict()
        text, was = new.pop("text"), old.pop("text")
        assert new == old
        if number != 2:
            assert text == was
    if number == 2:
        texts = {r.doc_id: r.text for r in rows}
        assert texts[1] == before[1].text and texts[2].startswith("zwei \ufffdé") and "passage" not in texts[2]


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
