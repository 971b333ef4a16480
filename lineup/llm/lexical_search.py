"""Exact top-k lexical search by a dual-tree walk.

Documents are counted once into vectors over the terms of the queried items. A task
takes a block of them, splits it along the terms whose weights vary most into a tree,
and holds for every node the greatest weight of each term among its documents. The
items of a query block form a tree of their own, again with coordinate maxima. The
product of two nodes' maxima bounds every score between them: a pair of nodes whose
bound is below the weakest k-th score among the items goes away as a whole, with all
its items and documents. What is left at the leaves is scored in whole numbers.

k-th scores start from those that a fixed share of the documents yields. They are
reached by real documents, so nothing that belongs to the answer is below them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import one_row_per_id, store, text_slices

BLOCK_BYTES = 64 << 20  # of a block's dense matrix
BLOCK = 2048  # documents in a block, at most
LEAF = 32  # documents in a leaf, at most
ITEM_BYTES = 4 << 20  # text of the items that are searched together, on average
SEED = 32  # one document in so many gives the first k-th scores
STEP = 4 << 20  # bytes of text that are split at once
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return text.translate(_TABLE).split()


def _vectors(vocabulary):
    """``doc_id, n_terms, term, tf``: the terms of the vocabulary in each text, ascending."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_terms", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])

    def rows(batches):
        place = {term: i for i, term in enumerate(vocabulary.value)}
        get = place.get
        for batch, a, b, data, offsets in text_slices(batches, size=STEP):
            n_terms, sizes, term, tf = [], [], [], []
            whole = data.tobytes().translate(_TABLE)
            for i in range(b - a):
                words = whole[offsets[i] : offsets[i + 1]].split()
                found = Counter(map(get, words))
                found.pop(None, None)
                held = sorted(found.items())
                n_terms.append(len(words))
                sizes.append(len(held))
                term += [t for t, _ in held]
                tf += [c for _, c in held]
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("doc_id")).slice(a, b - a), pa.array(n_terms, pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], schema=schema)

    return rows


class Tree:
    """Rows of a matrix in an order in which each node is a range, and the maxima of
    each node's columns, level by level from the root to the leaves."""

    def __init__(self, rows: np.ndarray, leaf: int):
        self.order = np.arange(len(rows))
        levels = max(0, math.ceil(math.log2(max(1, len(rows) / leaf))))
        self.bounds = [np.array([0, len(rows)])]
        for _ in range(levels):
            cuts = [0]
            for a, b in zip(self.bounds[-1][:-1], self.bounds[-1][1:]):
                part = self.order[a:b]
                if len(part) > 1:
                    # The term whose weights vary most here; equal weights are split as they come.
                    inside = rows[part].astype(np.float32)
                    widest = int(inside.var(axis=0).argmax())
                    self.order[a:b] = part[np.argsort(-inside[:, widest], kind="stable")]
                cuts += [(a + b + 1) // 2, b]
            self.bounds.append(np.unique(cuts))
        self.rows = rows[self.order]
        self.maxima = [np.maximum.reduceat(self.rows, bounds[:-1], axis=0) for bounds in self.bounds]

    def children(self, level: int) -> np.ndarray:
        """Parent of each node of ``level`` among those one level up."""
        return np.searchsorted(self.bounds[level - 1], self.bounds[level][:-1], side="right") - 1


class Best:
    """The best ``k`` so far of every item, and the least score that still matters."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.full((items, k), np.iinfo(np.int64).max)
        self.floor = floor.copy()

    def add(self, items: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        score = np.concatenate([self.score[items], scores], 1)
        doc = np.concatenate([self.doc[items], np.broadcast_to(docs, scores.shape)], 1)
        order = np.lexsort((doc, -score), axis=1)[:, : self.k]
        self.score[items], self.doc[items] = np.take_along_axis(score, order, 1), np.take_along_axis(doc, order, 1)
        self.floor[items] = np.maximum(self.floor[items], self.score[items, -1])


def walk(items: Tree, docs: Tree, ids: np.ndarray, best: Best) -> int:
    """Score what no bound excludes. Items and documents are counted by their place in
    the trees' input; gives the number of (item, document) pairs that were scored."""
    pairs = np.zeros((1, 2), np.int64)
    i_level = d_level = 0
    floor_at = lambda level: np.minimum.reduceat(best.floor[items.order], items.bounds[level][:-1])

    def expand(pairs, tree, level, side):
        """Each pair with the children of its node on one side."""
        parent = tree.children(level)
        first = np.searchsorted(parent, np.arange(len(tree.bounds[level - 1])))
        count = (first[1:] - first[:-1])[pairs[:, side]]
        out = np.repeat(pairs, count, axis=0)
        out[:, side] = np.repeat(first[pairs[:, side]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return out

    def bounds_of(pairs):
        """Bound of each pair; the pairs are in order of their document nodes."""
        out = np.empty(len(pairs), items.rows.dtype)
        nodes, first = np.unique(pairs[:, 1], return_index=True)
        for node, a, b in zip(nodes, first, [*first[1:], len(pairs)]):
            out[a:b] = items.maxima[i_level][pairs[a:b, 0]] @ docs.maxima[d_level][node]
        return out

    while True:
        pairs = pairs[np.argsort(pairs[:, 1], kind="stable")]
        bound = bounds_of(pairs)
        # A score of 0 is no answer, an equal one may be by a smaller id.
        alive = (bound >= floor_at(i_level)[pairs[:, 0]]) & (bound > 0)
        pairs, bound = pairs[alive], bound[alive]
        more_items, more_docs = i_level + 1 < len(items.bounds), d_level + 1 < len(docs.bounds)
        if not len(pairs) or not (more_items or more_docs):
            break
        if more_docs:
            d_level += 1
            pairs = expand(pairs, docs, d_level, 1)
        if more_items:
            i_level += 1
            pairs = expand(pairs, items, i_level, 0)
    # Leaves in order of what they promise, so that k-th scores rise early.
    scored = 0
    nodes, first = np.unique(pairs[:, 1], return_index=True)
    ends = [*first[1:], len(pairs)]
    for n in np.argsort([-bound[a:b].max() for a, b in zip(first, ends)], kind="stable"):
        a, b = first[n], ends[n]
        lower = floor_at(i_level)
        kept = pairs[a:b][bound[a:b] >= lower[pairs[a:b, 0]], 0]
        if not len(kept):
            continue
        places = np.concatenate([np.arange(items.bounds[i_level][i], items.bounds[i_level][i + 1]) for i in kept])
        low, high = docs.bounds[d_level][nodes[n]], docs.bounds[d_level][nodes[n] + 1]
        scores = (items.rows[places] @ docs.rows[low:high].T).astype(np.int64)
        scored += scores.size
        best.add(items.order[places], ids[docs.order[low:high]], scores)
    return scored


def _impacts(n_terms: np.ndarray, tf: np.ndarray, of: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """Weight of each term occurrence count in its document, as whole numbers."""
    length = 75 + (25 * n_terms * total_docs) // total_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * length[of])


def _blocks(columns: int, batches):
    """Ids, lengths and term lists of blocks that fit the budget as dense matrices."""
    size = min(BLOCK, max(LEAF, BLOCK_BYTES // (8 * max(columns, 1))))
    held, count = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, size - count)
            held.append(part)
            at += part.num_rows
            count += part.num_rows
            if count == size:
                yield pa.Table.from_batches(held)
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _search(shared, k: int):
    def rows(batches):
        s = shared.value
        item_ids, items = s["item_ids"], Tree(s["items"], 1)
        best = Best(len(item_ids), k, s["floor"])
        for block in _blocks(s["items"].shape[1], batches):
            ids, n_terms = block.column("doc_id").to_numpy(), block.column("n_terms").to_numpy()
            terms, tfs = block.column("term").combine_chunks(), block.column("tf").combine_chunks()
            of = np.repeat(np.arange(len(ids)), np.diff(terms.offsets.to_numpy()))
            tf = tfs.flatten().to_numpy().astype(np.int64)
            matrix = np.zeros((len(ids), s["items"].shape[1]), s["items"].dtype)
            matrix[of, terms.flatten().to_numpy()] = _impacts(n_terms, tf, of, s["docs"], s["terms"])
            walk(items, Tree(matrix, LEAF), ids, best)
        item, rank = np.nonzero((best.score > 0) & (best.score >= s["floor"][:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(item_ids[item]), pa.array(best.doc[item, rank]), pa.array(best.score[item, rank])], names=["item_id", "doc_id", "score"])

    return rows


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list, k: int) -> DataFrame:
    """The answers of the items of one block, given as (id, text) pairs."""
    share = docs.sparkSession.sparkContext.broadcast
    counted = [(i, Counter(terms_of(text.encode()))) for i, text in sorted(block)]
    vocabulary = sorted({t for _, c in counted for t in c})
    vectors = store(docs.mapInArrow(_vectors(share(vocabulary)), "doc_id long, n_terms long, term array<int>, tf array<int>"), "vectors")
    totals = vectors.agg(F.count_if(F.col("n_terms") > 0), F.sum("n_terms")).first()
    n_docs, n_terms = int(totals[0]), int(totals[1] or 0)
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("term").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    place = {t: i for i, t in enumerate(vocabulary)}
    # A score is below 10**6 for each unit of weight: whole numbers that doubles hold, or else slower ones.
    most = max((sum(int(weight[place[t]]) * c for t, c in terms.items()) for _, terms in counted), default=0) * 1_000_000
    items = np.zeros((len(counted), len(vocabulary)), np.float64 if most < 1 << 53 else np.int64)
    for row, (_, terms) in enumerate(counted):
        for t, c in terms.items():
            items[row, place[t]] = c * int(weight[place[t]])
    shared = {"item_ids": np.array([i for i, _ in counted], np.int64), "items": items, "docs": n_docs, "terms": max(n_terms, 1),
              "floor": np.zeros(len(counted), np.int64)}
    columns = "item_id long, doc_id long, score long"
    some = vectors.where(F.pmod(F.xxhash64("doc_id"), F.lit(SEED)) == 0)
    first = _top(some.mapInArrow(_search(share(shared), k), columns), k).where(F.col("rank") == k)
    row_of = {int(i): n for n, i in enumerate(shared["item_ids"])}
    floor = shared["floor"].copy()
    for r in first.collect():
        floor[row_of[r["item_id"]]] = r["score"]
    return vectors.mapInArrow(_search(share(shared | {"floor": floor}), k), columns)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents that score highest for each item.

    ``docs`` has ``doc_id, text``, ``items`` ``item_id, text``; null texts have no
    terms, rows without an id are left out, of rows that repeat an id the greatest
    text counts, and further columns are ignored. Scores are above 0; equal ones are
    ordered by ``doc_id``. An item without terms, or whose terms no document holds,
    gives no row; so do empty tables. Items are searched in blocks of about
    ``ITEM_BYTES`` of text, which the tasks hold with their terms; every block reads
    the documents anew.
    """
    docs, items = one_row_per_id(docs), one_row_per_id(items, "item_id")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / ITEM_BYTES)
    dealt = items.where("text is not null").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1))))
    found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        block = [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == b).collect()]
        found = found.union(_search_block(docs, block, k))
    return _top(found, k).select("item_id", "rank", "doc_id", "score")
