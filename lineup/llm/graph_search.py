"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Vectors are dealt to shards of a bounded size. In a shard, points enter the graph
in batches: a greedy beam search from the medoid proposes neighbours for each, a
relaxed distance rule keeps those that no closer kept one stands in for, and the
chosen get edges back, pruned by the same rule where they exceed the degree. The
index is a table of nodes with their edges. A search walks a beam over every
shard's graph, measures what it found exactly, and merges the shards' answers.

Vectors much closer to each other than vectors usually are form a bundle. The graph
links one vector of each, its lead, so that a dense group neither fills all
places of a beam nor all edges of a node; a search measures the members of every bundle
that its lead's distance and its radius let among the nearest. Nodes that no walk from
the medoid reaches become entries of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, store

SHARD = 8192  # vectors in a shard, on average
QUERIES = 4096  # queries that meet a shard's graph at once, on average
DEGREE = 32  # edges that leave a node
BUILD_BEAM = 64  # nodes that a walk keeps while the graph is built
BEAM = 160  # nodes that a walk keeps while it searches
RELAX = 1.2  # an edge stays unless a kept node is this many times closer to its end
PATH = 16  # first nodes of a walk that are candidates for edges as well
BATCH = 1024  # points that enter the graph, or queries that walk it, together
WIDTH = 4  # nodes of each beam that are expanded in one step
BUNDLE = 0.2  # radius of a bundle, as a share of the median distance of two vectors
SAMPLE = 512  # vectors of a shard that the median is taken over
PAIRS = 1 << 17  # distances computed at once
INDEX = "dims int, shard int, node int, lead boolean, entry boolean, ids array<long>, v array<double>, edges array<int>"


def sound(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``vec_id, v``: vectors that are not null, not zero and finite throughout, one row
    per id; of rows that repeat an id the greatest vector stays. Null ids are left out."""
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    good = F.col(key).isNotNull() & F.col(column).isNotNull() & ~F.exists(
        x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(x, lambda c: c != 0)
    kept = vectors.where(good).select(F.col(key).cast("long").alias("vec_id"), x.alias("v"))
    return kept.groupBy("vec_id").agg(F.max("v").alias("v"))


class Graph:
    """Points with at most ``degree`` edges each; -1 fills unused places."""

    def __init__(self, points: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None, degree: int = DEGREE):
        self.points = points
        self.near = points.astype(np.float32)
        self.edges = np.full((len(points), degree), -1, np.int32) if edges is None else edges
        self.entries = entries

    def walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search: the nodes in each query's beam, -1 where it is not full,
        and the first nodes it expanded."""
        q, n, start = len(queries), len(self.points), self.entries
        beam = max(beam, len(start))
        queries = queries.astype(np.float32)
        ids = np.full((q, beam), -1, np.int32)
        far = np.full((q, beam), np.inf, np.float32)
        done = np.zeros((q, beam), bool)
        ids[:, : len(start)] = start
        for j, s in enumerate(start):
            far[:, j] = ((queries - self.near[s]) ** 2).sum(1)
        seen = np.zeros((q, n), bool)
        seen[:, start] = True
        path, step = np.full((q, PATH), -1, np.int32), 0
        live = np.arange(q)
        while True:
            open_far = np.where(done[live], np.inf, far[live])
            width = min(WIDTH, beam)
            best = np.argpartition(open_far, width - 1, axis=1)[:, :width] if width < beam else np.broadcast_to(np.arange(beam), open_far.shape)
            real = np.isfinite(np.take_along_axis(open_far, best, 1))
            some = real.any(1)
            live, best, real = live[some], best[some], real[some]
            if not len(live):
                return ids, path
            at = live[:, None]
            nodes = np.where(real, ids[at, best], -1)
            done[at, best] = True
            if step < PATH:
                # The nearest of those expanded together.
                first = np.where(real, far[at, best], np.inf).argmin(1)
                path[live, step] = nodes[np.arange(len(live)), first]
                step += 1
            found = np.where(nodes[:, :, None] >= 0, self.edges[nodes], -1).reshape(len(live), -1)
            found[(found >= 0) & seen[at, found]] = -1
            # A node that several expanded ones lead to counts once.
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            rows, columns = np.nonzero(found >= 0)
            new = found[rows, columns]
            seen[live[rows], new] = True
            reach = np.full(found.shape, np.inf, np.float32)
            reach[rows, columns] = ((self.near[new] - queries[live[rows]]) ** 2).sum(1)
            every = np.concatenate([far[live], reach], 1)
            kept = np.argpartition(every, beam - 1, axis=1)[:, :beam]
            ids[live] = np.take_along_axis(np.concatenate([ids[live], found], 1), kept, 1)
            far[live] = np.take_along_axis(every, kept, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.zeros(found.shape, bool)], 1), kept, 1)
            ids[live] = np.where(np.isfinite(far[live]), ids[live], -1)

    def prune(self, nodes: np.ndarray, candidates: np.ndarray, relax: float = RELAX) -> np.ndarray:
        """Edges of each node: its nearest candidate, then the nearest of those that
        no chosen one is ``relax`` times closer to, and so on."""
        degree = self.edges.shape[1]
        out = np.full((len(nodes), degree), -1, np.int32)
        for a in range(0, len(nodes), 128):
            node, c = nodes[a : a + 128], candidates[a : a + 128]
            m = np.arange(len(node))
            x = self.points[c]
            away = ((x - self.points[node][:, None, :]) ** 2).sum(2)
            away[(c < 0) | (c == node[:, None])] = np.inf
            order = np.argsort(away, axis=1, kind="stable")
            c, away = np.take_along_axis(c, order, 1), np.take_along_axis(away, order, 1)
            x = self.points[c]
            square = (x**2).sum(2)
            between = np.maximum(square[:, :, None] + square[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0)
            alive = np.isfinite(away)
            for r in range(degree):
                some = alive.any(1)
                if not some.any():
                    break
                first = alive.argmax(1)
                out[a + m[some], r] = c[m, first][some]
                alive &= relax * relax * between[m, first] > away
                alive[m, first] = False
                # A candidate that stands there twice goes with the first.
                alive &= c != c[m, first][:, None]
        return out

    def insert(self, nodes: np.ndarray) -> None:
        beam, path = self.walk(self.points[nodes], BUILD_BEAM)
        self.edges[nodes] = self.prune(nodes, np.concatenate([beam, path], 1))
        rows, columns = np.nonzero(self.edges[nodes] >= 0)
        source, target = nodes[rows], self.edges[nodes][rows, columns]
        away = ((self.points[source] - self.points[target]) ** 2).sum(1)
        order = np.lexsort((source, away, target))
        source, target = source[order], target[order]
        given, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        degree = self.edges.shape[1]
        back = np.full((len(given), 2 * degree), -1, np.int32)
        near = rank < 2 * degree
        back[np.repeat(np.arange(len(given)), counts)[near], rank[near]] = source[near]
        have = (self.edges[given] >= 0).sum(1)
        fits = have + counts <= degree
        for i in np.flatnonzero(fits):
            self.edges[given[i], have[i] : have[i] + counts[i]] = back[i, : counts[i]]
        full = ~fits
        if full.any():
            self.edges[given[full]] = self.prune(given[full], np.concatenate([self.edges[given[full]], back[full]], 1))

    def reached(self, entries: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(self.points), bool)
        front = np.asarray(entries)
        while len(front):
            seen[front] = True
            out = np.unique(self.edges[front])
            front = out[(out >= 0) & ~seen[out]]
        return seen


def build(points: np.ndarray, order: np.ndarray, degree: int = DEGREE) -> Graph:
    """The graph of different points that enter in ``order``."""
    graph = Graph(points, degree=degree)
    middle = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph.entries = np.array([middle], np.int32)
    order = order[order != middle]
    at = 0
    while at < len(order):
        # A batch is no larger than the graph it is added to.
        size = min(BATCH, at + 1)
        graph.insert(order[at : at + size].astype(np.int32))
        at += size
    seen = graph.reached(graph.entries)
    while not seen.all():
        lost = np.flatnonzero(~seen)[:1]
        graph.entries = np.concatenate([graph.entries, lost]).astype(np.int32)
        seen |= graph.reached(lost)
    return graph


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def bundles(points: np.ndarray, order: np.ndarray, share: float = BUNDLE) -> np.ndarray:
    """The lead of each point: the point itself, or the nearest or first lead before it in ``order`` within the radius."""
    sample = points[order[:SAMPLE]]
    gaps = _squares(sample, sample)[np.triu_indices(len(sample), 1)]
    reach = share**2 * (np.median(gaps) if len(gaps) else 0.0)
    lead, leads = np.full(len(points), -1), []
    for a in range(0, len(order), BATCH):
        batch = order[a : a + BATCH]
        if leads:
            away = _squares(points[batch], points[leads])
            nearest = away.argmin(1)
            near = away[np.arange(len(batch)), nearest] <= reach
            lead[batch[near]] = np.array(leads)[nearest[near]]
            batch = batch[~near]
        away = _squares(points[batch], points[batch])
        free = np.ones(len(batch), bool)
        for i, point in enumerate(batch):
            if free[i]:
                near = free & (away[i] <= reach)
                near[i] = True
                lead[batch[near]] = point
                free &= ~near
                leads.append(point)
    return lead


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _lists(counts, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


def _index_shard(degree: int):
    def rows(shard: pa.Table) -> pa.Table:
        ids = shard.column("vec_id").to_numpy()
        by_id = np.argsort(ids)
        ids, vectors = ids[by_id], _matrix(shard.column("v"))[by_id] + 0.0
        points, which = np.unique(vectors, axis=0, return_inverse=True)
        which = which.reshape(-1)
        of_point = np.lexsort((ids, which))
        counts = np.bincount(which, minlength=len(points))
        smallest = ids[of_point][np.cumsum(counts) - counts]
        order = np.lexsort((smallest, mix(smallest.view(np.uint64))))
        leads, node = np.unique(bundles(points, order), return_inverse=True)
        place = np.full(len(points), -1)
        place[leads] = np.arange(len(leads))
        graph = build(points[leads], place[order][place[order] >= 0], degree)
        n, lead, entry = len(points), place >= 0, np.zeros(len(points), bool)
        entry[leads[graph.entries]] = True
        real = graph.edges >= 0
        sizes = np.zeros(n, np.int64)
        sizes[leads] = real.sum(1)
        same = lambda name: pa.array(np.repeat(shard.column(name)[0].as_py(), n), pa.int32())
        return pa.table({
            "dims": same("dims"), "shard": same("shard"), "node": pa.array(node.reshape(-1), pa.int32()), "lead": pa.array(lead),
            "entry": pa.array(entry), "ids": _lists(counts, ids[of_point]),
            "v": _lists(np.full(n, points.shape[1]), points.reshape(-1)), "edges": _lists(sizes, graph.edges[real])})

    return rows


def build_index(vectors: DataFrame, shard: int = SHARD, degree: int = DEGREE) -> DataFrame:
    """The graphs of ``vectors`` (``vec_id, v``, see ``sound``) as a stored table with one row per
    different vector: ``dims, shard, node, lead, entry, ids, v, edges``. ``node`` numbers the
    bundles of a shard, whose lead holds the edges. Every vector is in it; vectors of
    different lengths are in different graphs."""
    shards = max(1, math.ceil(vectors.count() / shard))
    dealt = vectors.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"))
    return store(dealt.groupBy("dims", "shard").applyInArrow(_index_shard(degree), INDEX), "graphs")


def _distances(points: np.ndarray, targets: np.ndarray, point: np.ndarray, target: np.ndarray) -> np.ndarray:
    parts = [np.sqrt(((points[point[a : a + PAIRS]] - targets[target[a : a + PAIRS]]) ** 2).sum(1)) for a in range(0, len(point), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _search_shard(k: int, beam: int):
    names = ["query_id", "vec_id", "score"]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rows(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return schema.empty_table()
        index = index.sort_by([("node", "ascending"), ("lead", "descending")])
        points, lead = _matrix(index.column("v")), index.column("lead").to_numpy(zero_copy_only=False)
        first = np.flatnonzero(lead)
        size = np.diff(np.append(first, len(points)))
        radius = np.sqrt(np.maximum.reduceat(((points - np.repeat(points[first], size, axis=0)) ** 2).sum(1), first))
        edge_lists, id_lists = index.column("edges").combine_chunks(), index.column("ids").combine_chunks()
        count = np.diff(edge_lists.offsets.to_numpy())[first]
        edges = np.full((len(first), max(1, count.max(initial=0))), -1, np.int32)
        edges[np.repeat(np.arange(len(first)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = edge_lists.flatten().to_numpy()
        entries = np.flatnonzero(index.column("entry").to_numpy(zero_copy_only=False)[first])
        graph = Graph(points[first], edges, entries.astype(np.int32))
        starts, ids = id_lists.offsets.to_numpy(), id_lists.flatten().to_numpy()
        starts = starts - starts[0]
        query_ids, targets, out = queries.column("vec_id").to_numpy(), _matrix(queries.column("v")), []
        for a in range(0, len(targets), BATCH):
            found, _ = graph.walk(targets[a : a + BATCH], max(beam, k + 1))
            row, column = np.nonzero(found >= 0)
            node = found[row, column]
            # The k + 1 nearest leads bound what a member must reach.
            away = _distances(points, targets, first[node], a + row)
            by_row = np.lexsort((away, row))
            ends = np.cumsum(np.bincount(row, minlength=len(found)))
            begin = np.concatenate([[0], ends[:-1]])
            last = np.minimum(begin + k, ends - 1)
            bound = away[by_row][np.maximum(last, 0)]
            worth = away - radius[node] <= bound[row] * (1 + 1e-9)
            row, node = row[worth], node[worth]
            each = np.repeat(np.arange(len(node)), size[node])
            point = first[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(size[node]) - size[node], size[node])
            row, node = row[each], point
            score = _distances(points, targets, node, a + row)
            # Of equal vectors only the k + 1 smallest ids can be among the nearest.
            copies = np.minimum(starts[node + 1] - starts[node], k + 1)
            each = np.repeat(np.arange(len(node)), copies)
            vec = ids[starts[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(copies) - copies, copies)]
            row, score = row[each], score[each]
            other = vec != query_ids[a + row]
            row, score, vec = row[other], score[other], vec[other]
            order = np.lexsort((vec, score, row))
            row, score, vec = row[order], score[order], vec[order]
            sizes = np.bincount(row, minlength=1)
            best = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
            out.append(pa.table([pa.array(query_ids[a + row[best]]), pa.array(vec[best]), pa.array(score[best])], names=names))
        return pa.concat_tables(out)

    return rows


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest that a walk over every shard finds.

    ``queries`` has ``vec_id, v``. ``score`` is the Euclidean distance in double
    precision; ties go to the smaller ``vec_id``, and a row is never its own answer.
    A query of a length that no vector has gives no row; so do empty tables.
    """
    shards = index.agg(F.max("shard")).first()[0]
    if shards is None:
        shards = 0
    blocks = max(1, math.ceil(queries.count() / QUERIES))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n)))
    a = queries.select("vec_id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")).withColumn(
        "shard", copies(shards))
    b = index.withColumn("block", copies(blocks - 1))
    keys = ["dims", "shard", "block"]
    near = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_search_shard(k, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def graph_search(vectors: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM) -> DataFrame:
    """``search_index`` over a fresh index; both tables as ``sound`` gives them."""
    return search_index(build_index(vectors), queries, k, beam)
