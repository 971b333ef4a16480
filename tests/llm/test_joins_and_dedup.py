"""Shingle join, components and substring deduplication against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from lineup.llm import common, ngram_join as nj, suffix_dedup as suffix
from lineup.llm.components import components
from lineup.llm.ngram_join import ngram_join
from lineup.llm.suffix_dedup import suffix_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_join(rows, size=5, percent=75):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else (
            frozenset([tuple(w)]) if w else frozenset())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def brute_cut(rows, length=50):
    raw = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(raw):
        for k in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][k:k + length], i)
    out = {}
    for i, b in raw.items():
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                mark[k:k + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mark) if not m)
        runs = len([x for x in bytes(mark).split(b"\0") if x])
        out[i] = (len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def family(seed=1):
    """Near copies with few and many edits, passages, short and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6, 12])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    for i in range(60, 90):
        own = [word() for _ in range(rng.choice([3, 10, 60]))]
        rows.append((i, " ".join(own) + "\n" + passage + " " + " ".join(word() for _ in range(5))))
    rows += [(90, None), (91, ""), (92, " \n\t "), (93, "one two"), (94, "ONE  two"), (95, "one two three four five"),
             (96, "a" * 5000), (97, "b" + "a" * 4999), (98, "ab " * 3000), (99, passage.upper())]
    return rows


def joined(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame).collect()}


def test_join_equals_brute_force(make):
    rows = family()
    assert joined(make(rows)) == brute_join(rows)


@pytest.mark.parametrize("percent", [60, 90])
def test_join_thresholds(make, percent):
    rows = family(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(make(rows), percent=percent).collect()}
    assert got == brute_join(rows, percent=percent)


def test_join_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert joined(documents) == brute_join(rows)


def test_remaining_pairs_are_complete(make, monkeypatch):
    """Without any tie round the exact search alone finds every component."""
    monkeypatch.setattr(nj, "TIES", 0)
    rows = family(5)
    assert joined(make(rows)) == brute_join(rows)


def test_join_repeated_rows_and_empty(make, none):
    assert joined(make([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x")])) == {1: (2, 1), 2: (2, 1)}
    assert ngram_join(none).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(80)] + [(7, 7), (None, 3)]
    pairs += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}
    for a, b in pairs:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a in root and b in root and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root


def cut(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept))
            for r in suffix_dedup(frame, keep_bytes=True).collect()}


@pytest.mark.parametrize("seed", [1, 4])
def test_cut_equals_brute_force(make, seed):
    rows = family(seed)
    assert cut(make(rows)) == brute_cut(rows)


def test_cut_exact_lengths(make):
    """Strings of exactly the length, one less, touching runs, and order by id and not by row."""
    a = "".join(chr(97 + (i * 7 + i * i) % 26) for i in range(49))
    rows = [(5, "x" + a + "q" + "tail"), (2, "y" + a + "q"), (9, "z" + a + "r"), (7, a + "q" + a + "q"), (1, "é" * 60), (3, "é" * 61)]
    assert cut(make(rows)) == brute_cut(rows)


def test_cut_whole_table(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(documents).collect()}
    assert got == {k: v[:4] for k, v in brute_cut(rows).items()}


def test_cut_repeated_rows_and_empty(make, none):
    text = "word " * 30
    rows = [(1, text), (1, text), (2, text), (None, text)]
    got = cut(make(rows))
    assert {k: v[:2] for k, v in got.items()} == {1: (150, 0), 2: (150, 150)}
    assert suffix_dedup(none).count() == 0


def test_hashes_do_not_depend_on_the_place():
    import numpy as np

    data = np.frombuffer(b"one two one two one two", np.uint8)
    p = common.prefix_hash(data)
    h = common.span_hash(p, np.array([0, 8, 16]), np.array([7, 15, 23]))
    assert len(set(h.tolist())) == 1
    assert collections.Counter(common.rolling_hash(data, 7).tolist()).most_common(1)[0][1] == 3


def test_cut_of_small_chunks(spark):
    """Chunks of 0 to 60 bytes: every total in the parse, and one document a partition in the query."""
    for n in range(61):
        kinds, names, which = suffix._Parse(
            np.array([1]), np.array([0, n]), np.full(n, 97, np.uint8), 50).minimizers()
        assert len(kinds) == len(names) and (which >= 0).sum() == max(0, n - 49)
    text = "".join(chr(97 + i * i % 23) for i in range(60))
    sizes = [0, 1, 23, 24, 28, 29, 30, 35, 36, 37, 44, 45, 48, 49, 50, 51, 59, 60]
    rows = [(i, text[:n]) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    want = brute_cut(rows)
    got = {r.doc_id: r for r in suffix_dedup(frame, keep_bytes=True).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == {i: w[:4] for i, w in want.items()}
    short = spark.createDataFrame([(1, text[:29])], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup(short).collect()] == [0]
