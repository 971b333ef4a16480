"""Dual-tree search, graph search and collocations against plain computations."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lineup.llm import collocations as C
from lineup.llm import graph_search as G
from lineup.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# -- lexical search ------------------------------------------------------------


def plain_search(docs, items, k=20):
    terms = {d: Counter(TERM.findall(lowered(t))) for d, t in docs}
    length = {d: sum(c.values()) for d, c in terms.items()}
    n_docs, n_terms = sum(1 for n in length.values() if n), sum(length.values())
    df = Counter(t for c in terms.values() for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in terms.items():
            m = 75 + (25 * length[d] * n_docs) // n_terms if n_terms else 0
            s = 0
            for t in TERM.findall(lowered(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(frame):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in frame.collect())


def random_texts(seed, n, words, length):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(words)], k=rng.randint(0, length))) for _ in range(n)]


def test_lexical_search_equals_plain(spark, make):
    texts = random_texts(1, 300, 200, 60)
    texts += texts[:40]  # ties
    texts += ["Über ÜBER über w1-W1", "ß日本 w3", None, "", "...", "w5 " * 70_000 + "w9"]
    docs = list(enumerate(texts))
    items = [(i, t) for i, t in enumerate(random_texts(2, 30, 200, 25))] + [
        (100, None), (101, ""), (102, "Über w1 w1 w1"), (103, "nowhere"), (104, "w5 w9 W9")]
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, score int")
    assert found(L.lexical_search(make(docs), asked)) == plain_search(docs, items)


def test_lexical_search_repeated_and_missing_ids(spark, make):
    docs = [(1, "a b"), (1, "a c"), (2, "a"), (None, "a a a"), (3, "b b")]
    asked = spark.createDataFrame([(7, "a"), (7, "b"), (None, "a")], "item_id long, text string")
    assert found(L.lexical_search(make(docs), asked)) == plain_search([(1, "a c"), (2, "a"), (3, "b b")], [(7, "b")])


def test_lexical_search_empty_tables(spark, make, none):
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert found(L.lexical_search(none, asked)) == []
    assert found(L.lexical_search(make([(1, "a")]), asked.where("item_id < 0"))) == []


def test_lexical_search_blocks_of_items(spark, make, monkeypatch):
    texts = random_texts(3, 60, 50, 30)
    docs, items = list(enumerate(texts)), list(enumerate(random_texts(4, 12, 50, 10)))
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(L, "ITEM_BYTES", 100)
    assert found(L.lexical_search(make(docs), asked, 3)) == plain_search(docs, items, 3)


@pytest.mark.parametrize("kind", [np.float64, np.int64])
@pytest.mark.parametrize("floors", [False, True])
def test_tree_walk_is_exact_and_prunes(kind, floors):
    """Documents and items of separate topics: most pairs of nodes go unscored."""
    rng = np.random.default_rng(5)
    docs, items = np.zeros((800, 80), kind), np.zeros((40, 80), kind)
    for i in range(800):
        docs[i, (i % 8) * 10 + rng.integers(0, 10, 6)] = rng.integers(1, 1000, 6)
    for i in range(40):
        items[i, (i % 8) * 10 + rng.integers(0, 10, 4)] = rng.integers(1, 50, 4)
    ids = rng.permutation(800)
    scores = (items @ docs.T).astype(np.int64)
    want = [sorted((-scores[i, d], ids[d]) for d in range(800) if scores[i, d] > 0)[:5] for i in range(40)]
    floor = np.array([-w[-1][0] for w in want]) if floors else np.zeros(40, np.int64)
    best = L.Best(40, 5, floor)
    scored = L.walk(L.Tree(items, 1), L.Tree(docs, 16), ids, best)
    got = [[(-s, d) for s, d in zip(best.score[i], best.doc[i]) if s > 0] for i in range(40)]
    assert got == want
    assert scored < 40 * 800 // 4


def test_tree_covers_every_row():
    rows = np.random.default_rng(1).random((37, 5))
    for leaf in (1, 4, 64):
        tree = L.Tree(rows, leaf)
        assert sorted(tree.order) == list(range(37))
        for bounds, maxima in zip(tree.bounds, tree.maxima):
            assert bounds[0] == 0 and bounds[-1] == 37
            for a, b, top in zip(bounds, bounds[1:], maxima):
                assert (rows[tree.order[a:b]].max(0) == top).all()
        assert (np.diff(tree.bounds[-1]) <= leaf).all()


# -- graph search --------------------------------------------------------------


def plain_nearest(vectors, queries, k):
    out = {}
    for q, x in queries:
        away = sorted((float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, v in vectors if i != q and len(v) == len(x))
        out[q] = away[:k]
    return out


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in vectors],
                                 "vec_id long, embedding array<float>, score string")


def answers(result):
    out = {}
    for r in sorted(result.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_graph_search_recall(spark, monkeypatch):
    """Spread points, a tight cluster that holds a third of all rows, and copies."""
    rng = np.random.default_rng(3)
    spread = rng.normal(size=(1500, 32))
    tight = rng.normal(size=32) + 1e-3 * rng.normal(size=(900, 32))
    vectors = np.concatenate([spread, tight, np.repeat(spread[:1], 300, axis=0)]).astype(np.float32).astype(float)
    rows = [(int(i), v) for i, v in enumerate(vectors)]
    monkeypatch.setattr(G, "SHARD", 1000)
    table = G.sound(frame(spark, rows))
    queries = table.where("vec_id % 50 = 0")
    got = answers(G.search_index(G.build_index(table, shard=1000), queries, 10))
    want = plain_nearest(rows, [r for r in rows if r[0] % 50 == 0], 10)
    assert recall(got, want) >= 0.95
    exact = {q: dict((i, s) for s, i in plain_nearest(rows, [rows[q]], len(rows))[q]) for q in list(want)[:5]}
    for q, near in exact.items():
        assert [s for s, _ in got[q]] == pytest.approx([near[i] for _, i in got[q]], abs=1e-12)
    # Copies: ties go to the smallest ids.
    assert [i for _, i in got[2450]][:10] == [0, *range(2400, 2409)]


def test_graph_search_whole_on_the_tables(spark, folder):
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in vectors.collect()]
    table = G.sound(vectors)
    got = answers(G.graph_search(table, table.where("vec_id % 100 = 0"), 10))
    assert recall(got, plain_nearest(rows, [r for r in rows if r[0] % 100 == 0], 10)) >= 0.95


def test_graph_index_holds_and_reaches_every_row(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).round(1)) for i in range(700)]
    index = G.build_index(G.sound(frame(spark, rows)), shard=300).collect()
    zero = {i for i, v in rows if not np.any(v)}
    assert sorted(i for r in index for i in r["ids"]) == [i for i, _ in rows if i not in zero]
    for shard in {r["shard"] for r in index}:
        nodes = {r["node"]: r for r in index if r["shard"] == shard and r["lead"]}
        assert {r["node"] for r in index if r["shard"] == shard} == set(nodes)
        assert all(len(r["edges"]) <= G.DEGREE and r["node"] not in r["edges"] for r in nodes.values())
        seen, front = set(), [n for n, r in nodes.items() if r["entry"]]
        while front:
            seen |= set(front)
            front = list({e for n in front for e in nodes[n]["edges"]} - seen)
        assert seen == set(nodes)


def test_a_dense_group_does_not_hide_the_rest(spark):
    """A third of all rows in one tight group that is nearer than most: the few nearer rows are found."""
    rng = np.random.default_rng(21)
    spread = rng.normal(size=(2000, 48))
    spread /= np.linalg.norm(spread, axis=1, keepdims=True)
    tight = spread[0] + 0.015 * rng.normal(size=(1000, 48))
    rows = [(i, v) for i, v in enumerate(np.concatenate([spread, tight]))]
    table = G.sound(frame(spark, [(i, v.astype(np.float32)) for i, v in rows]))
    index = G.build_index(table, shard=4000)
    got = answers(G.search_index(index, table.where("vec_id % 40 = 0"), 10))
    kept = [(r["vec_id"], r["v"]) for r in table.collect()]
    want = plain_nearest(kept, [r for r in kept if r[0] % 40 == 0], 10)
    assert recall(got, want) >= 0.98 and min(recall({q: got[q]}, {q: want[q]}) for q in want) >= 0.7
    assert index.where("lead").count() < 2100


def test_pruning_keeps_diverse_edges():
    points = np.array([[0.0, 0], [1, 0], [1.1, 0], [0, 2], [0, -3]])
    kept = G.Graph(points, degree=3).prune(np.array([0]), np.array([[1, 2, 3, 4, 1, -1, 0]]))
    assert kept.tolist() == [[1, 3, 4]]


def test_graph_search_odd_rows(spark):
    rows = [(1, [1, 0]), (2, [0, 0]), (3, None), (4, [1, None]), (5, [float("nan"), 1]), (6, [float("inf"), 1]),
            (7, [1, 0]), (8, [3, 0]), (9, [1, 2, 3]), (8, [2, 0]), (None, [1, 1])]
    table = G.sound(frame(spark, rows))
    assert answers(G.graph_search(table, table, 10)) == {
        1: [(0.0, 7), (2.0, 8)], 7: [(0.0, 1), (2.0, 8)], 8: [(2.0, 1), (2.0, 7)]}
    empty = table.where("vec_id < 0")
    assert answers(G.graph_search(empty, table)) == {} and answers(G.graph_search(table, empty)) == {}


# -- collocations --------------------------------------------------------------


def plain_collocations(rows, least, top=2000):
    f = Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for size in range(1, 5):
                f.update((lang or "und", *words[i : i + size]) for i in range(len(words) - size + 1))
    n = Counter()
    for (lang, *words), count in f.items():
        n[lang] += count * (len(words) == 1)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for (lang, *w), a in candidates.items():
        score, k = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        inside = any(q[0] == lang and len(q) > len(w) + 1 and 100 * b >= 80 * a and any(list(q[1 + i : 1 + i + len(w)]) == w for i in range(len(q) - len(w)))
                     for q, b in candidates.items())
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s)
                  for lang, rows in out.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def listed(result):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in result.collect())


def phrases(spark, rows):
    return spark.createDataFrame([(i, lang, t, "x", 1) for i, (lang, t) in enumerate(rows)], "doc_id int, lang string, text string, phrase string, n int")


def phrase_rows(seed=6):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        words = [rng.choice(["a", "b", "c", "É", "New York City", "d e", "rare%d" % rng.randint(0, 500), "Zürich", "x\x1cy"]) for _ in range(40)]
        rows.append((rng.choice(["en", "de", None]), "".join(w + rng.choice([" ", " ", "\t", "  ", ", ", ".\n", "\r", " \x0b"]) for w in words)))
    return rows + [("en", None), ("de", ""), (None, "..."), ("xx", "once only"), ("und", "a b a b a b"), ("en", "to be or " * 4000)]


@pytest.mark.parametrize("budget", [50, 400, 1 << 19])
def test_collocations_equal_plain(spark, budget):
    """Small budgets extend frequent prefixes and spread their subtrees over groups."""
    rows = phrase_rows()
    assert listed(C.collocations(phrases(spark, rows), least=5, budget=budget)) == plain_collocations(rows, 5)


def test_collocations_combine_in_steps(spark, monkeypatch):
    monkeypatch.setattr(C, "HELD", 100)
    monkeypatch.setattr(C, "STEP", 500)
    rows = phrase_rows(7)
    got = C.collocations(phrases(spark, rows), least=5, top=7)
    assert listed(got) == plain_collocations(rows, 5, 7)


def test_collocations_wide_counts(spark):
    """Products that pass 64 bits."""
    row = spark.sql("""SELECT (cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r) AS s
                       FROM VALUES (4000000000000000001L, 4000000000000000003L, 9000000000000000007L) t(a, l, r)""").first()
    assert row["s"] == 2_000_000 * 4000000000000000001 // (4000000000000000003 + 9000000000000000007)


def test_collocations_empty(spark):
    assert listed(C.collocations(phrases(spark, [("en", "a b")]).limit(0))) == []
    assert listed(C.collocations(phrases(spark, [("en", "a b c")]))) == []


def test_subtree_counts_leaves():
    rows = [(1, 2, 0, 0, 3), (1, 2, 3, 0, 2), (1, 2, 3, 4, 5), (1, 3, 1, 1, 1), (2, 2, 3, 4, 7)]
    nodes, n = C.subtree([np.array(c, np.uint64) for c in list(zip(*rows))[:4]], np.array([r[4] for r in rows]))
    got = {tuple(int(x) for x in p): int(c) for p, c in zip(zip(*nodes), n)}
    assert got == {(1, 2, 0, 0): 10, (1, 3, 0, 0): 1, (2, 2, 0, 0): 7, (1, 2, 3, 0): 7, (1, 3, 1, 0): 1, (2, 2, 3, 0): 7,
                   (1, 2, 3, 4): 5, (1, 3, 1, 1): 1, (2, 2, 3, 4): 7}
