"""Exact nearest neighbours and similarity pools by blocks.

The corpus is cut into blocks of a memory budget. A task holds one block and a part
of the queries, and keeps only what the operator needs: the best ``k`` items or
groups per query, or a sample of ``m`` with the pool's size. Pairs never leave the
task, and the corpus is never broadcast.

With several blocks, items lie in cells around pivots, and a block holds neighbouring
cells. Of a cell, the greatest angle to its pivot, the greatest length and a box of its
members are known. A query is searched in the block of its own cell first; what it
found there is a floor, and of the other blocks only those are visited which hold a
cell whose best possible product reaches it: at most the cosine of the query's angle
to the pivot less that greatest angle, and at most what the distance to the box
allows. Cells that no query reaches are not shuffled. In a block the same is done with
leaves of some hundred rows. Only rows that cannot be among the best are left out, so
the results are exact; where the floors exclude little, a query is compared with the
whole block.

A few queries against many blocks visit the corpus where it lies: each task holds the
queries and reads its part of the corpus, which is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import PAIR_FACTORS, hash_bits, hash_int, order_key
from ..functions.vectors import dot
from ..session import cut
from .ranking import group_rank, skew_join, top_n

BLOCK_BYTES = 128 << 20
POOL_BYTES = 64 << 20  # pools hold a block of either side and a matrix of marks
DIGITS = 6
STEP = 10.0**-DIGITS
CHUNK = 32  # columns whose maximum stands for them in a first look
PAIRS = 1 << 15  # pairs whose product is computed exactly at once
WORK_BYTES = 64 << 20  # at most that much of a task's budget for a matrix of products
FEW_BYTES = 2 << 20  # queries that each task may hold whole, as doubles
LEAF = 256  # rows of a block that share an axis
LEAVES = 1024  # axes of a block at most
ASKED = 4096  # queries whose leaves are looked up at once
PENDING = 1 << 21  # pairs kept before the best of them are chosen
CELL_ROWS = 512  # rows of the corpus for each cell
CELL_BYTES = 8 << 20  # cells' pivots that the driver and each task may hold, as doubles
EXACT = 24  # bits of a whole number that single precision holds
BOXES = 1024  # cells of a query whose boxes are looked at; beyond that all are visited
MANY = 16  # part of the units beyond which a query's blocks are read off whole rows of marks
WIDE = 0.25  # part of the leaves beyond which a query is compared with the whole block


def _blocks(rows: int, dim: int, budget: int) -> int:
    per_block = max(1, budget // (8 * max(dim, 1)))
    return max(1, -(-rows // per_block))


def _size(df: DataFrame) -> tuple[int, int]:
    """Rows and components; two scalars reach the driver."""
    size = df.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    return size["n"], max(1, size["d"] or 1)


def _layout(queries: DataFrame, corpus: DataFrame, budget: int, size: tuple[int, int] | None = None) -> tuple[int, int]:
    """Blocks per side: small enough for memory, many enough for the cores."""
    rows, dim = size or _size(corpus)
    n_queries = queries.count()
    corpus_blocks = _blocks(rows, dim, budget)
    wanted = queries.sparkSession.sparkContext.defaultParallelism
    query_blocks = max(
        _blocks(n_queries, dim, budget), -(-wanted // corpus_blocks) if n_queries else 1
    )
    return query_blocks, corpus_blocks


def _spread(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
    # Fresh columns: both sides of a cogroup may come from one table.
    fresh = df.select(*[F.col(c).alias(c) for c in df.columns])
    return fresh.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(
        other, copies
    )


def _spread_within(
    queries: DataFrame, corpus: DataFrame, within: str, budget: int,
    layout: tuple[int, int] | None,
) -> tuple[DataFrame, DataFrame]:
    """Blocks inside each group: only a group larger than a block is copied."""
    if layout:
        parts = F.lit(layout[1]).cast("long")
    else:
        dim = corpus.agg(F.max(F.size("vec"))).first()[0] or 1
        parts = F.ceil(F.col("_n") / max(1, budget // (8 * dim))).cast("long")
    sizes = corpus.groupBy(within).agg(F.count("*").alias("_n")).select(
        within, parts.alias("_parts")
    )

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        fresh = df.select(*[F.col(c).alias(c) for c in df.columns])
        placed = skew_join(fresh, sizes, [within])
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))
        return placed.withColumn(own, F.pmod(F.xxhash64("item_id"), F.col("_parts"))).withColumn(
            other, copies
        ).select(*[F.col(c).alias(c) for c in (*df.columns, own, other)])

    return spread(queries, "_q", "_c"), spread(corpus, "_c", "_q")


def _matrix(table: pa.Table, name: str = "vec", dtype=np.float64) -> np.ndarray:
    """The vectors as rows; ``dtype`` None keeps single precision where they have it."""
    column = table.column(name).combine_chunks()
    flat = column.flatten()
    if dtype is None:
        dtype = np.float32 if pa.types.is_float32(flat.type) else np.float64
    flat = np.asarray(flat, dtype=dtype)
    sound = column.null_count == 0 and flat.size % max(1, table.num_rows) == 0
    matrix = flat.reshape(table.num_rows, -1) if sound else None
    if matrix is None or not np.isfinite(matrix).all():
        bad = [
            key for key, vec in zip(table.column("item_id").to_pylist(), column.to_pylist())
            if vec is None or not all(x is not None and np.isfinite(x) for x in vec)
        ]
        raise ValueError(
            f"vectors that are null or not finite: items {bad[:5]}" if bad
            else "vectors differ in length"
        )
    return matrix


def _row_chunks(rows: int, columns: int, budget: int):
    step = max(1, min(budget, WORK_BYTES) // (8 * max(columns, 1)))
    return ((start, min(start + step, rows)) for start in range(0, rows, step))


def _best_per_row(values: np.ndarray, rows: np.ndarray, ties: np.ndarray, k: int):
    """Places of the best k entries per row, by ascending value and then tie."""
    order = np.lexsort((ties, values, rows))
    rows = rows[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return order[rank < k], rank[rank < k]


def _lengths(matrix: np.ndarray) -> np.ndarray:
    parts = [(matrix[a : a + PAIRS].astype(np.float64) ** 2).sum(1) for a in range(0, len(matrix), PAIRS)]
    return np.sqrt(np.concatenate(parts)) if parts else np.zeros(0)


def _units(matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Directions in single precision; a vector without length keeps none."""
    return (matrix / np.where(lengths > 0, lengths, 1.0)[:, None]).astype(np.float32)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class _Products:
    """Inner products of queries with a block: a quick look in single precision
    with a bound of its error, and exact values of chosen pairs."""

    def __init__(self, queries: np.ndarray, block: np.ndarray):
        if queries.shape[1] != block.shape[1]:
            raise ValueError("vectors differ in length")
        self.queries, self.block = queries, block
        with np.errstate(over="ignore"):
            self._q, self._c = queries.astype(np.float32, copy=False), block.astype(np.float32, copy=False)
        self.lengths, self.largest = _lengths(queries), _lengths(block).max(initial=0.0)
        # Rounding of the inputs and of each step; rounding a result lifts it by half a step.
        error = (block.shape[1] + 4) * 2.0**-23 * self.lengths * self.largest
        self.margin = 2 * error + STEP

    def look(self, rows, columns=slice(None)) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            quick = self._q[rows] @ self._c[columns].T
        # Beyond single precision nothing is excluded.
        if np.isfinite(quick).all():
            return quick
        return self.queries[rows].astype(np.float64) @ self.block[columns].T.astype(np.float64)

    def rounded(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        parts = [
            np.einsum(
                "ij,ij->i", self.queries[rows[a : a + PAIRS]].astype(np.float64),
                self.block[columns[a : a + PAIRS]].astype(np.float64))
            for a in range(0, len(rows), PAIRS)
        ]
        return np.round(np.concatenate(parts), DIGITS) + 0.0 if parts else np.zeros(0)


class _Leaves:
    """A block's rows in leaves around axes, each with the range of its members' angles.

    The product of a query and a member is at most ``|q| |x|`` times the cosine of the
    difference of their angles to the axis. ``slack`` covers the rounding of cosines.
    """

    def __init__(self, block: np.ndarray):
        n = len(block)
        pivots = block[np.linspace(0, n - 1, min(LEAVES, max(1, n // LEAF))).astype(np.int64)]
        pivots = _units(pivots, _lengths(pivots))
        units, cell = np.empty(block.shape, np.float32), np.empty(n, np.int64)
        for a in range(0, n, ASKED):
            part = block[a : a + ASKED].astype(np.float64)
            units[a : a + ASKED] = _units(part, _lengths(part))
            cell[a : a + ASKED] = (units[a : a + ASKED] @ pivots.T).argmax(1)
        order = np.argsort(cell, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
        self.slack = 2 * np.arccos(1 - (block.shape[1] + 8) * 2.0**-22)
        self.columns, axes, angles = [], [], []
        for a, b in zip(starts, [*starts[1:], n]):
            members = units[order[a:b]]
            axis = members.mean(0, dtype=np.float64)
            axis = (axis / (np.sqrt((axis**2).sum()) or 1.0)).astype(np.float32)
            range_of = _angles(members @ axis)
            # A large leaf is looked at in pieces.
            for at in range(a, b, 4 * LEAF):
                self.columns.append(order[at : min(at + 4 * LEAF, b)])
                axes.append(axis)
                angles.append((range_of.min(), range_of.max()))
        self.axes = np.stack(axes).T
        self.low, self.high = np.array(angles, np.float32).T

    def reached(self, toward: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Which leaves may hold a member at an angle of at most ``apart`` from a query."""
        angle, apart = _angles(toward), (apart + self.slack).astype(np.float32)[:, None]
        return (angle - self.high <= apart) & (self.low - angle <= apart)


def _apart(least: np.ndarray, lengths: np.ndarray, largest) -> np.ndarray:
    """The largest angle from a query at which a vector's product may be ``least``."""
    scale = lengths * largest
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where((least > 0) & (scale > 0), least / scale, -1.0)
    return _angles(cosine)


def _at_least(values: np.ndarray, k: int, margin: np.ndarray, floor: np.ndarray):
    """Rows and columns of the entries that may be among a row's ``k`` greatest.

    The k-th greatest of the chunks' maxima is no greater than the k-th entry, and
    chunks below it are not looked into.
    """
    n = values.shape[1]
    whole = n // CHUNK
    tops = values[:, : whole * CHUNK].reshape(len(values), whole, CHUNK).max(2) if whole else values[:, :0]
    tops = np.concatenate([tops, values[:, whole * CHUNK :]], 1)
    if tops.shape[1] >= k:
        low = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
    elif n > k:
        low = np.partition(values, n - k, axis=1)[:, n - k]
    else:
        low = np.full(len(values), -np.inf)
    # A floor is a rounded value; an entry of half a step less may round to it.
    low = np.maximum(low.astype(np.float64), floor) - margin
    rows, chunks = np.nonzero(tops >= low[:, None])
    inner = chunks < whole
    r, c = np.repeat(rows[inner], CHUNK), (chunks[inner][:, None] * CHUNK + np.arange(CHUNK)).reshape(-1)
    good = values[r, c] >= low[r]
    rows = np.concatenate([r[good], rows[~inner]])
    return rows, np.concatenate([c[good], chunks[~inner] - whole + whole * CHUNK])


def _floor(q: pa.Table) -> np.ndarray:
    if "floor" not in q.column_names:
        return np.full(q.num_rows, -np.inf)
    return q.column("floor").to_numpy()


def _candidates(products: _Products, k: int, floor: np.ndarray, budget: int, groups, own):
    """Rows and columns of pairs among which are the best ``k`` of each row, by parts of the rows.

    Yields ``rows, columns, done``; ``done`` says that no pair of those rows is still to
    come. With ``groups``, the group's number per column in ascending order, the best
    ``k`` groups count, and a row's own group, ``own``, does not.
    """
    n_rows, n = len(products.queries), len(products.block)
    whole = np.arange(n_rows)
    if n >= 4 * LEAF and np.isfinite(products.largest) and 1e-15 < products.largest < 1e15:
        leaves, wide = _Leaves(products.block), []
        for start in range(0, n_rows, ASKED):
            rows = np.arange(start, min(start + ASKED, n_rows))
            yield from _in_leaves(products, leaves, rows, k, floor, groups, own, wide)
        whole = np.concatenate(wide)
    starts = None if groups is None else np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    for a, b in _row_chunks(len(whole), n, budget):
        rows = whole[a:b]
        quick, margin = products.look(rows), products.margin[rows]
        if groups is None:
            at, columns = _at_least(quick, k, margin, floor[rows])
            yield rows[at], columns, True
            continue
        yield from _of_groups(quick, rows, k, margin, floor[rows], starts, own[rows])


def _in_leaves(products: _Products, leaves: _Leaves, rows: np.ndarray, k: int, floor, groups, own, wide: list):
    """Pairs of the leaves that each query's floor lets in; queries let into many go to ``wide``."""
    toward = _units(products.queries[rows].astype(np.float64), products.lengths[rows]) @ leaves.axes
    least = floor[rows].astype(np.float64)
    # The k-th best in the nearest leaf is a floor, too.
    near = toward.argmax(1)
    order = np.argsort(near, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
        columns = leaves.columns[near[some[0]]]
        if groups is None:
            if len(columns) < k:
                continue
        else:
            inside = groups[columns]
            starts = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))
            if len(starts) < k:
                continue
        for a in range(0, len(some), ASKED // 4):
            at = some[a : a + ASKED // 4]
            tops = products.look(rows[at], columns)
            if groups is not None:
                tops = np.maximum.reduceat(tops, starts, axis=1)
                tops[own[rows[at]][:, None] == inside[starts][None, :]] = -np.inf
            best = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k]
            least[at] = np.maximum(least[at], best)
    least -= products.margin[rows]
    reached = leaves.reached(toward, _apart(least, products.lengths[rows], products.largest))
    many = reached.mean(1) > WIDE
    wide.append(rows[many])
    reached[many] = False
    found, pending = [], 0
    for leaf in np.flatnonzero(reached.any(0)):
        some, columns = np.flatnonzero(reached[:, leaf]), leaves.columns[leaf]
        for a in range(0, len(some), ASKED // 4):
            at = some[a : a + ASKED // 4]
            i, j = np.nonzero(products.look(rows[at], columns) >= least[at][:, None])
            found.append((rows[at][i], columns[j]))
            pending += len(i)
            if pending > PENDING:
                yield *(np.concatenate(x) for x in zip(*found)), False
                found, pending = [], 0
    none = np.zeros(0, np.int64)
    yield *(np.concatenate(x) for x in zip((none, none), *found)), True


def _of_groups(quick: np.ndarray, rows: np.ndarray, k: int, margin, floor, starts, own):
    """The members of each chosen group that may be its best, a bounded number at a time."""
    sizes = np.diff(np.concatenate([starts, [quick.shape[1]]]))
    tops = np.maximum.reduceat(quick, starts, axis=1)
    mine = np.flatnonzero(own >= 0)
    tops[mine, own[mine]] = -np.inf
    at, cells = _at_least(tops, k, margin, floor)
    other = own[at] != cells
    at, cells = at[other], cells[other]
    ends = np.cumsum(sizes[cells])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 21), side="right")))
        each = np.repeat(np.arange(a, b), sizes[cells[a:b]])
        first = np.repeat(np.cumsum(sizes[cells[a:b]]) - sizes[cells[a:b]], sizes[cells[a:b]])
        columns = starts[cells[each]] + np.arange(len(each)) - first
        may = quick[at[each], columns] >= tops[at[each], cells[each]] - margin[at[each]]
        yield rows[at[each][may]], columns[may], b == len(at)
        a = b


def _chosen(parts, choose: Callable):
    """The best of each row, chosen from the pairs whenever some were found."""
    kept = None
    for rows, columns, done in parts:
        if kept is not None:
            rows, columns = np.concatenate([kept[0], rows]), np.concatenate([kept[1], columns])
        kept = choose(rows, columns)
        if done:
            yield kept
            kept = None


def _best_items(k: int, budget: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        id_type = q.schema.field("item_id").type
        target = pa.schema([("query_id", id_type), ("nbr", id_type), ("neg", pa.float64()), ("rank", pa.int32())])
        if q.num_rows == 0 or c.num_rows == 0:
            return target.empty_table()
        c = c.sort_by("item_id")
        ids, names, floor = c.column("item_id").combine_chunks(), q.column("item_id").combine_chunks(), _floor(q)
        products = _Products(_matrix(q, dtype=None), _matrix(c, dtype=None))

        def choose(rows, cols):
            sims = products.rounded(rows, cols)
            good = sims >= floor[rows]
            rows, cols, sims = rows[good], cols[good], sims[good]
            kept, rank = _best_per_row(-sims, rows, cols, k)
            return rows[kept], cols[kept], sims[kept], rank

        parts = []
        for rows, cols, sims, rank in _chosen(_candidates(products, k, floor, budget, None, None), choose):
            parts.append(pa.table(
                [names.take(pa.array(rows)), ids.take(pa.array(cols)), pa.array(-sims + 0.0),
                 pa.array(rank + 1, pa.int32())], schema=target))
        return pa.concat_tables(parts) if parts else target.empty_table()

    return best


def _codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Whole numbers that are equal where the values of all columns are."""
    every = pa.concat_arrays([c.combine_chunks() for c in columns])
    codes = every.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum([len(c) for c in columns])
    return np.split(codes, ends[:-1])


def _best_groups(k: int, budget: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best item of each of the ``k`` best groups other than the query's."""

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        id_type, group_type = q.schema.field("item_id").type, q.schema.field("group_id").type
        target = pa.schema([("query_id", id_type), ("nbr_group", group_type), ("nbr", id_type), ("neg", pa.float64()),
                            ("rank", pa.int32())])
        if q.num_rows == 0 or c.num_rows == 0:
            return target.empty_table()
        c = c.sort_by([("group_id", "ascending"), ("item_id", "ascending")])
        ids, groups, names, floor = c.column("item_id").combine_chunks(), c.column("group_id").combine_chunks(), q.column(
            "item_id").combine_chunks(), _floor(q)
        by_id = np.empty(len(ids), np.int64)
        by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        q_code, c_code = _codes(q.column("group_id"), c.column("group_id"))
        # Groups are numbered in the order of the columns.
        first = np.concatenate([[True], c_code[1:] != c_code[:-1]])
        cell = np.cumsum(first) - 1
        place = np.full(max(q_code.max(), c_code.max()) + 1, -1)
        place[c_code[first]] = np.arange(cell[-1] + 1)
        own = place[q_code]
        products = _Products(_matrix(q, dtype=None), _matrix(c, dtype=None))

        def choose(rows, cols):
            other = own[rows] != cell[cols]
            rows, cols = rows[other], cols[other]
            sims = products.rounded(rows, cols)
            one, _ = _best_per_row(-sims, rows * (cell[-1] + 1) + cell[cols], cols, 1)
            rows, cols, sims = rows[one], cols[one], sims[one]
            good = sims >= floor[rows]
            rows, cols, sims = rows[good], cols[good], sims[good]
            kept, rank = _best_per_row(-sims, rows, by_id[cols], k)
            return rows[kept], cols[kept], sims[kept], rank

        parts = []
        for rows, cols, sims, rank in _chosen(_candidates(products, k, floor, budget, cell, own), choose):
            at = pa.array(cols)
            parts.append(pa.table(
                [names.take(pa.array(rows)), groups.take(at), ids.take(at), pa.array(-sims + 0.0),
                 pa.array(rank + 1, pa.int32())], schema=target))
        return pa.concat_tables(parts) if parts else target.empty_table()

    return best


# -- blocks near pivots -----------------------------------------------------------


def _grid(vectors: np.ndarray) -> np.ndarray:
    """Directions as whole numbers: their products are exact, however the rows are batched.

    The greatest component has as many steps as keep a product's sum exact in single precision.
    """
    steps = 1 << max(0, (EXACT - max(vectors.shape[1] - 1, 0).bit_length()) // 2)
    largest = np.abs(vectors).max(axis=1, initial=0.0, keepdims=True)
    return np.rint(vectors / np.where(largest > 0, largest, 1.0) * steps).astype(np.float32)


class _Cells:
    """Cells around pivots, dealt to blocks, and what may be in each cell.

    A vector's cell depends on its direction alone. A cell larger than a block has
    several units, by hash; any other is one unit. Blocks are runs of units. Of a unit,
    the greatest angle to its pivot, the greatest length and a box of its members are
    kept, so that a query with a floor sees which units may hold something as near.
    """

    def __init__(self, pivots: np.ndarray):
        self.axes = pivots / np.where(_lengths(pivots) > 0, _lengths(pivots), 1.0)[:, None]
        whole = _grid(self.axes)
        # Two steps: the nearest of some pivots, then the nearest of those around it.
        n_tops = max(1, round(len(pivots) ** 0.5))
        self.tops = whole[:n_tops].T
        near = np.concatenate([(whole[a : a + ASKED] @ self.tops).argmax(1) for a in range(0, len(whole), ASKED)])
        inside = [np.flatnonzero(near == top) for top in range(n_tops)]
        self.inside = [x if len(x) else np.array([top]) for top, x in enumerate(inside)]
        self.under = [whole[x].T for x in self.inside]

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        if vectors.shape[1] != self.axes.shape[1]:
            raise ValueError("vectors differ in length")
        whole = _grid(vectors)
        near, found = (whole @ self.tops).argmax(1), np.empty(len(vectors), np.int64)
        order = np.argsort(near, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(near[order])) + 1):
            top = near[rows[0]]
            found[rows] = self.inside[top][(whole[rows] @ self.under[top]).argmax(1)]
        return found

    def deal(self, spans: pa.Table, share: int) -> None:
        """Units for cells of these sizes and extents, and blocks of about ``share`` rows."""
        n, dim = self.axes.shape
        at = spans.column("_cell").to_numpy()
        sizes, angle, longest = np.zeros(n, np.int64), np.zeros(n), np.full(n, -1.0)
        low, high = np.full((n, dim), np.inf, np.float32), np.full((n, dim), -np.inf, np.float32)
        for held, name in ((sizes, "n"), (angle, "angle"), (longest, "longest")):
            held[at] = spans.column(name).to_numpy()
        low[at], high[at] = _matrix_of(spans, "low", dim), _matrix_of(spans, "high", dim)
        self.parts = np.maximum(1, -(-sizes // share)).astype(np.int64)
        self.first, self.block = np.empty(len(sizes), np.int64), []
        block, held = 0, 0
        for cell in np.concatenate(self.inside):
            self.first[cell] = len(self.block)
            for _ in range(self.parts[cell]):
                size = -(-sizes[cell] // self.parts[cell])
                if held and held + size > share:
                    block, held = block + 1, 0
                self.block.append(block)
                held += size
        self.block = np.array(self.block)
        self.of_unit = np.repeat(np.concatenate(self.inside), self.parts[np.concatenate(self.inside)])
        self.low, self.high, self.longest = low[self.of_unit], high[self.of_unit], longest[self.of_unit]
        self._classes(angle[self.of_unit] + 1e-6)

    def units(self, vectors: np.ndarray, bits: np.ndarray) -> np.ndarray:
        cell = self.cell(vectors)
        return self.first[cell] + bits % self.parts[cell]

    def _classes(self, angle: np.ndarray) -> None:
        """Units in classes of similar length, as one matrix each that tells which are reached."""
        self.classes = []
        full = np.flatnonzero(self.longest >= 0)
        order = full[np.argsort(self.longest[full], kind="stable")]
        alike = len(order) == 0 or self.longest[order[-1]] <= 1.01 * self.longest[order[0]]
        for some in [full] if alike else np.array_split(order, 8):
            if len(some):
                bound = np.stack([np.cos(angle[some]), np.sin(angle[some]), np.ones(len(some))])
                axes = np.concatenate([self.axes[self.of_unit[some]].T, bound]).astype(np.float32)
                self.classes.append((some, axes, angle[some].max(), self.longest[some].max()))

    def reached(self, vectors: np.ndarray, floor: np.ndarray):
        """Parts of the rows with the units that may hold a product of at least their floor."""
        lengths = _lengths(vectors)
        units = (vectors / np.where(lengths > 0, lengths, 1.0)[:, None]).astype(np.float32)
        sound = (lengths > 1e-15) & (lengths < 1e15)
        slack = (vectors.shape[1] + 16) * 2.0**-22
        for a, b in _row_chunks(len(vectors), len(self.block), WORK_BYTES):
            marked = np.zeros((b - a, len(self.block)), bool)
            for some, axes, widest, longest in self.classes:
                least = floor[a:b] - STEP - 1e-9 * (1 + lengths[a:b] * longest)
                apart = _apart(least, lengths[a:b], longest) + 1e-6
                every = ~(sound[a:b] & (apart + widest < np.pi) & (1e-15 < longest < 1e15))
                # The cosine of an angle is at least that of the greatest angle plus ``apart``.
                bound = np.stack([-np.cos(apart), np.sin(apart), np.where(every, 4.0, slack)], 1).astype(np.float32)
                inside = np.concatenate([units[a:b], bound], 1) @ axes >= 0
                if len(some) == marked.shape[1]:
                    marked = inside
                else:
                    marked[:, some] = inside
            self._in_box(marked, vectors[a:b].astype(np.float32), lengths[a:b], floor[a:b], sound[a:b])
            yield a, b, marked

    def _in_box(self, marked, vectors, lengths, floor, sound) -> None:
        """Unmark units whose box is too far away: ``2 q . x = q . q + x . x - |q - x|**2``."""
        few = np.flatnonzero(sound & (np.count_nonzero(marked, axis=1) <= BOXES))
        rows, units = np.divmod(np.flatnonzero(marked if len(few) == len(marked) else marked[few]), marked.shape[1])
        rows = few[rows]
        for a in range(0, len(rows), PAIRS):
            r, u = rows[a : a + PAIRS], units[a : a + PAIRS]
            q = vectors[r]
            gap = np.maximum(np.maximum(self.low[u] - q, q - self.high[u]), 0)
            both = lengths[r] ** 2 + self.longest[u] ** 2
            with np.errstate(over="ignore"):
                bound = (both - np.einsum("ij,ij->i", gap, gap)) / 2
            far = bound < floor[r] - STEP - 1e-5 * (both + 1)
            marked[r[far], u[far]] = False


def _matrix_of(table: pa.Table, name: str, dim: int) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks().flatten()).reshape(-1, dim)


def _tables(batches):
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch])


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def _in_cells(corpus: DataFrame, cells: _Cells, wanted: np.ndarray | None = None) -> DataFrame:
    """The corpus with its unit ``_u`` and its block ``_c``; of some units only, if named."""
    def place(batches):
        for table in _tables(batches):
            unit = cells.units(_matrix(table), table.column("_h").to_numpy())
            table = table.drop_columns(["_h"]).append_column("_u", pa.array(unit.astype(np.int32))).append_column(
                "_c", pa.array(cells.block[unit].astype(np.int32)))
            yield from (table if wanted is None else table.filter(pa.array(wanted[unit]))).to_batches()

    bits = F.pmod(F.xxhash64("item_id"), F.lit(1 << 31)).alias("_h")
    return corpus.select("*", bits).mapInArrow(place, f"{_fields(corpus)}_u int, _c int")


def _placed(corpus: DataFrame, n_blocks: int, budget: int, size: tuple[int, int] | None = None) -> tuple[DataFrame, _Cells, list[int]]:
    """The corpus with its block ``_c``, the cells, and the blocks.

    Pivots are the vectors of some items. The driver holds one vector and one box a
    cell, of which there is a bounded number; tasks pass on a row per cell.
    """
    total, dim = size or _size(corpus)
    n_cells = max(n_blocks, min(max(4 * n_blocks, total // CELL_ROWS), CELL_BYTES // (8 * dim)))
    chosen = corpus.orderBy(F.xxhash64("item_id"), "item_id").limit(n_cells).select("item_id", "vec").toArrow()
    cells = _Cells(_matrix(chosen))

    def spans(batches):
        n = len(cells.axes)
        low, high = np.full((n, dim), np.inf), np.full((n, dim), -np.inf)
        sizes, angle, longest = np.zeros(n, np.int64), np.zeros(n), np.full(n, -1.0)
        for table in _tables(batches):
            vectors = _matrix(table)
            cell = cells.cell(vectors)
            order = np.argsort(cell, kind="stable")
            vectors, cell = vectors[order], cell[order]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            at, lengths = cell[starts], _lengths(vectors)
            sizes += np.bincount(cell, minlength=n)
            low[at] = np.minimum(low[at], np.minimum.reduceat(vectors, starts, axis=0))
            high[at] = np.maximum(high[at], np.maximum.reduceat(vectors, starts, axis=0))
            scale = np.where(lengths > 0, lengths, 1.0)
            cosine = np.einsum("ij,ij->i", vectors, cells.axes[cell]) / scale
            angle[at] = np.maximum(angle[at], np.maximum.reduceat(_angles(cosine), starts))
            longest[at] = np.maximum(longest[at], np.maximum.reduceat(lengths, starts))
        at = np.flatnonzero(longest >= 0)
        # Rounded outwards, to single precision.
        with np.errstate(over="ignore"):
            low = np.nextafter(low[at].astype(np.float32), np.float32(-np.inf))
            high = np.nextafter(high[at].astype(np.float32), np.float32(np.inf))
        yield from pa.table({
            "_cell": pa.array(at, pa.int32()), "n": sizes[at], "low": pa.array(list(low), pa.list_(pa.float32())),
            "high": pa.array(list(high), pa.list_(pa.float32())), "angle": angle[at], "longest": longest[at],
        }).to_batches()

    kinds = "_cell int, n long, low array<float>, high array<float>, angle double, longest double"

    def widest(spans: pa.Table) -> pa.Table:
        spans = spans.sort_by("_cell")
        cell = spans.column("_cell").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        lists = lambda f, name: pa.array(list(f.reduceat(_matrix_of(spans, name, dim), starts, axis=0)), pa.list_(pa.float32()))
        most = lambda name: np.maximum.reduceat(spans.column(name).to_numpy(), starts)
        return pa.table({
            "_cell": pa.array(cell[starts], pa.int32()), "n": np.add.reduceat(spans.column("n").to_numpy(), starts), "low": lists(np.minimum, "low"),
            "high": lists(np.maximum, "high"), "angle": most("angle"), "longest": most("longest")})

    found = corpus.select("item_id", "vec").mapInArrow(spans, kinds)
    held = found.groupBy(F.pmod("_cell", F.lit(256)).alias("_b")).applyInArrow(widest, kinds).toArrow()
    cells.deal(held, max(1, -(-total // n_blocks)))
    return _in_cells(corpus, cells), cells, sorted(set(cells.block.tolist()))


def _asked(vectors: np.ndarray, floor: np.ndarray, cells: _Cells):
    """Parts of the rows, the blocks that each visits besides its own, and the units that some row visits."""
    near = cells.block[cells.first[cells.cell(vectors)]]
    firsts = np.flatnonzero(np.diff(cells.block, prepend=-1))  # blocks are runs of units
    for a, b, marked in cells.reached(vectors, floor):
        if np.count_nonzero(marked) > marked.size // MANY:
            visited = np.logical_or.reduceat(marked, firsts, axis=1)
            visited[np.arange(b - a), near[a:b]] = False
            some = marked.any(0)
        else:
            row, unit = np.divmod(np.flatnonzero(marked), marked.shape[1])
            other = cells.block[unit] != near[row + a]
            row, unit = row[other], unit[other]
            visited, some = np.zeros((b - a, len(firsts)), bool), np.zeros(len(cells.block), bool)
            visited[row, cells.block[unit]], some[unit] = True, True
        yield a, b, visited, np.flatnonzero(some)


def _addressed(queries: DataFrame, cells: _Cells) -> DataFrame:
    """Queries with the blocks ``_blocks`` that they visit besides their own, as their ``floor`` allows.

    ``_units`` lists the units that a part of the rows visits, in its first row.
    """
    def rows(batches):
        for table in _tables(batches):
            for a, b, visited, units in _asked(_matrix(table), _floor(table), cells):
                row, block = np.nonzero(visited)
                ends = np.searchsorted(row, np.arange(b - a + 1))
                units_end = np.full(b - a + 1, len(units))
                units_end[0] = 0
                part = table.slice(a, b - a)
                for name, ends_of, values in (("_blocks", ends, block), ("_units", units_end, units)):
                    part = part.append_column(name, pa.ListArray.from_arrays(
                        pa.array(ends_of.astype(np.int32)), pa.array(values.astype(np.int32))))
                yield from part.to_batches()

    return queries.mapInArrow(rows, f"{_fields(queries)}_blocks array<int>, _units array<int>")


def _visits(queries: DataFrame, cells: _Cells, blocks: list[int], first: bool) -> DataFrame:
    """Queries with the block ``_c`` to visit: the nearest, or with a ``floor`` all others that reach it."""
    def rows(batches):
        for table in _tables(batches):
            near = cells.block[cells.first[cells.cell(_matrix(table))]]
            yield from table.append_column("_c", pa.array(near.astype(np.int32))).to_batches()

    if first:
        return queries.mapInArrow(rows, f"{_fields(queries)}_c int")
    asked = queries if "_blocks" in queries.columns else _addressed(queries, cells)
    return asked.withColumn("_c", F.explode("_blocks")).drop("_blocks", "_units")


def _counted(queries: DataFrame, cells: _Cells, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many queries visit each block, and which units they visit there."""
    visits, units = np.zeros(cells.block.max() + 1, np.int64), np.zeros(len(cells.block), bool)
    asked = queries if first or "_blocks" in queries.columns else cut(_addressed(queries, cells))
    for r in _visits(asked, cells, [], first).groupBy("_c").agg(F.count("*").alias("n")).collect():
        visits[r["_c"]] = r["n"]
    if first:
        return visits, (visits > 0)[cells.block]
    units[[r[0] for r in asked.select(F.explode("_units")).distinct().collect()]] = True
    return visits, units


def _search(
    queries: DataFrame, corpus: DataFrame, kernel: Callable, schema: str, k: int, by: list[str],
    budget: int, layout: tuple[int, int] | None,
) -> DataFrame:
    """Kernel results of all queries with all blocks that matter, ranked 1..k by ``neg, nbr``.

    ``by`` names what a query's results are told apart by, as the best of one group.
    """
    size = _size(corpus)
    n_query, n_corpus = layout or _layout(queries, corpus, budget, size)
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    if n_corpus == 1:
        left = fresh(queries).withColumn("_q", F.pmod(F.xxhash64("item_id"), F.lit(n_query)).cast("int"))
        right = fresh(corpus).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
        return left.groupBy("_q").cogroup(right.groupBy("_q")).applyInArrow(kernel, schema)

    def ranked(found: DataFrame) -> DataFrame:
        if by:
            best = found.groupBy("query_id", *by).agg(F.min(F.struct("neg", "nbr")).alias("b"))
            found = best.select("query_id", *by, "b.*")
        # Rows, not lists: cut to k for each query before the shuffle.
        return top_n(found.drop("rank"), ["query_id"], [F.col("neg"), F.col("nbr")], k)

    queries = cut(fresh(queries))  # read for either visit
    dim = max(1, queries.agg(F.max(F.size("vec"))).first()[0] or 1)
    n_few = max(1, FEW_BYTES // (8 * dim))
    few = None if layout else queries.limit(n_few + 1).toArrow()
    if few is not None and few.num_rows <= n_few:
        return ranked(_where_it_lies(few, corpus, kernel, schema, k, max(1, budget // (8 * dim))))
    _, cells, blocks = _placed(corpus, n_corpus, budget, size)
    wanted = queries.sparkSession.sparkContext.defaultParallelism

    def visit(asked: DataFrame, first: bool) -> DataFrame:
        visits, units = _counted(asked, cells, first)
        # As many parts as a task's budget and the cores need, and copies of a block for those alone.
        step = min(max(1, budget // (8 * dim)), max(ASKED, int(visits.sum()) // wanted))
        parts = [(int(at), int(-(-visits[at] // step))) for at in np.flatnonzero(visits)]
        # A block is a task's work whatever its bytes are after compression: tasks are not joined by size.
        n_tasks = sum(n for _, n in parts)
        n_tasks += max(1, min(2 * n_tasks, 1000))
        parts = F.broadcast(queries.sparkSession.createDataFrame(parts, "_c int, _parts int"))
        left = _visits(asked, cells, blocks, first).join(parts, "_c").withColumn(
            "_q", F.pmod(F.xxhash64("item_id"), F.col("_parts")).cast("int")).drop("_parts")
        # Units that no query visits do not travel.
        right = fresh(_in_cells(corpus, cells, units).join(parts, "_c").withColumn(
            "_q", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts", "_u"))
        left, right = (df.repartition(n_tasks, "_c", "_q") for df in (left, right))
        return left.groupBy("_c", "_q").cogroup(right.groupBy("_c", "_q")).applyInArrow(kernel, schema)

    near = cut(ranked(visit(queries, True)))
    floors = near.filter(F.col("rank") == k).select(F.col("query_id").alias("item_id"), (-F.col("neg")).alias("floor"))
    # Which blocks a query visits is found once, and read to count the visits and to make them.
    bounded = cut(_addressed(queries.join(floors, "item_id", "left").na.fill(float("-inf"), ["floor"]), cells))
    more = visit(bounded, False)
    columns = ["query_id", *by, "nbr", "neg"]
    return ranked(near.select(*columns).union(more.select(*columns)))


def _where_it_lies(few: pa.Table, corpus: DataFrame, kernel: Callable, schema: str, k: int, rows: int) -> DataFrame:
    """Kernel results of a few queries with each task's part of the corpus, ``rows`` at a time.

    What a query found ``k`` times in one step is its floor in the task's next steps.
    """
    def run(batches):
        floor, waiting = np.full(few.num_rows, -np.inf), []
        place = {x: i for i, x in enumerate(few.column("item_id").to_pylist())}

        def step():
            found = kernel(few.append_column("floor", pa.array(floor)), pa.Table.from_batches(waiting))
            last = found.filter(pc.equal(found.column("rank"), k))
            at = [place[x] for x in last.column("query_id").to_pylist()]
            floor[at] = np.maximum(floor[at], -last.column("neg").to_numpy())
            return found.to_batches()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= rows:
                yield from step()
                waiting = []
        if waiting:
            yield from step()

    return corpus.mapInArrow(run, schema)


def knn_topk(
    queries: DataFrame, corpus: DataFrame, k: int = 200, budget: int = BLOCK_BYTES,
    layout: tuple[int, int] | None = None, within: str | None = None,
) -> DataFrame:
    """Top ``k`` corpus items per query by dot product, ties by id.

    Inputs have ``item_id`` and ``vec``. An item of both sides counts among its
    own neighbours. ``within`` names a column both sides must agree on. Result:
    ``query_id, nbr_id, rank, sim`` with ``sim`` rounded to 6 places before
    ranking.
    """
    id_type = corpus.schema["item_id"].dataType.simpleString()
    schema = f"query_id {id_type}, nbr {id_type}, neg double, rank int"
    kernel = _best_items(k, budget)
    if within:
        keep = ["item_id", within, "vec"]
        left, right = _spread_within(queries.select(*keep), corpus.select(*keep), within, budget, layout)
        found = left.groupBy("_q", "_c", within).cogroup(right.groupBy("_q", "_c", within)).applyInArrow(kernel, schema)
        best = top_n(found.drop("rank"), ["query_id"], [F.col("neg"), F.col("nbr")], k)
    else:
        best = _search(queries.select("item_id", "vec"), corpus.select("item_id", "vec"), kernel, schema, k, [], budget, layout)
    return best.select(
        "query_id", F.col("nbr").alias("nbr_id"), "rank", (F.lit(0.0) - F.col("neg")).alias("sim")
    )


def nearest_groups(
    queries: DataFrame, corpus: DataFrame, k: int, budget: int = BLOCK_BYTES,
    layout: tuple[int, int] | None = None,
) -> DataFrame:
    """The ``k`` nearest other groups of each query, each with its best item.

    Inputs have ``item_id, group_id, vec``, and an item is in one group. A group is
    as near as its most similar item, ties by that item's id; the query's own group
    takes no part, however many of its items are near. Result: ``query_id,
    nbr_group, nbr_id, sim, group_rank`` with ``sim`` rounded to 6 places first.
    """
    kinds = {c: corpus.schema[c].dataType.simpleString() for c in ("item_id", "group_id")}
    schema = f"query_id {kinds['item_id']}, nbr_group {kinds['group_id']}, nbr {kinds['item_id']}, neg double, rank int"
    keep = ["item_id", "group_id", "vec"]
    best = _search(queries.select(*keep), corpus.select(*keep), _best_groups(k, budget), schema, k, ["nbr_group"], budget, layout)
    return best.select(
        "query_id", "nbr_group", F.col("nbr").alias("nbr_id"), (F.lit(0.0) - F.col("neg")).alias("sim"),
        F.col("rank").alias("group_rank"),
    )


# -- pools --------------------------------------------------------------------------


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """60-bit keys of pairs from both sides' bits, independent from one ``a`` to the next."""
    x = (a.astype(np.uint64) + b.astype(np.uint64)) * np.uint64(PAIR_FACTORS[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(PAIR_FACTORS[1])
    return (x >> np.uint64(4)).astype(np.int64)


def _smallest_keys(near: np.ndarray, q_bits: np.ndarray, c_bits: np.ndarray, m: int):
    """Rows and columns of the pairs marked in ``near`` among which are each row's ``m`` smallest keys."""
    rows, cols = [], []
    for i in range(len(near)):
        here = np.flatnonzero(near[i])
        if len(here) > m:
            keys = pair_keys(q_bits[i : i + 1], c_bits[here])
            here = here[keys <= np.partition(keys, m - 1)[m - 1]]
        rows.append(np.full(len(here), i))
        cols.append(here)
    return np.concatenate(rows), np.concatenate(cols)


def sampled_pool(
    queries: DataFrame, corpus: DataFrame, threshold: float, m: int, strict: bool = False,
    budget: int = POOL_BYTES, layout: tuple[int, int] | None = None,
) -> DataFrame:
    """Per query, the size of its pool of similar items and a uniform sample of ``m``.

    Inputs have ``item_id, owner_id, vec``. The pool holds the corpus items of
    another owner whose similarity reaches ``threshold`` (passes it when
    ``strict``). The sample is the ``m`` smallest by a key mixed from both items'
    bits, so samples of different queries are independent. Result: ``query_id,
    pool_size, rank, item_id, sim``, one row per sampled item; a query with an
    empty pool has no row.
    """
    if m < 1:
        raise ValueError("a sample holds at least one item")
    n_query, n_corpus = layout or _layout(queries, corpus, budget)
    left = _spread(
        queries.select("item_id", "owner_id", "vec", hash_bits("pool_query", "item_id").alias("bits")),
        "item_id", "_q", n_query, "_c", n_corpus,
    )
    right = _spread(
        corpus.select("item_id", "owner_id", "vec", hash_bits("pool_item", "item_id").alias("bits")),
        "item_id", "_c", n_corpus, "_q", n_query,
    )
    id_type = corpus.schema["item_id"].dataType.simpleString()
    schema = f"query_id {id_type}, n long, rank int, key long, item_id {id_type}, sim double"

    def sample(q: pa.Table, c: pa.Table) -> pa.Table:
        id_field = q.schema.field("item_id").type
        target = pa.schema([
            ("query_id", id_field), ("n", pa.int64()), ("rank", pa.int32()), ("key", pa.int64()),
            ("item_id", id_field), ("sim", pa.float64())])
        if q.num_rows == 0 or c.num_rows == 0:
            return target.empty_table()
        c = c.sort_by("item_id")
        ids, names = c.column("item_id").combine_chunks(), q.column("item_id").combine_chunks()
        q_owner, c_owner = _codes(q.column("owner_id"), c.column("owner_id"))
        q_bits, c_bits = (t.column("bits").to_numpy() for t in (q, c))
        products = _Products(_matrix(q, dtype=None), _matrix(c, dtype=None))
        parts = []
        for start, end in _row_chunks(q.num_rows, c.num_rows, budget):
            quick = products.look(slice(start, end))
            margin = products.margin[start:end, None]
            near = quick >= threshold - margin
            near &= q_owner[start:end, None] != c_owner[None, :]
            # Those too close to the threshold for single precision are computed exactly.
            rows, cols = np.nonzero(near & (quick <= threshold + margin))
            sims = products.rounded(rows + start, cols)
            near[rows, cols] = sims > threshold if strict else sims >= threshold
            sizes = near.sum(axis=1)
            rows, cols = _smallest_keys(near, q_bits[start:end], c_bits, m)
            keys = pair_keys(q_bits[start:end][rows], c_bits[cols])
            kept, rank = _best_per_row(keys, rows, cols, m)
            rows, cols, keys = rows[kept], cols[kept], keys[kept]
            parts.append(pa.table(
                [names.take(pa.array(rows + start)), pa.array(sizes[rows], pa.int64()), pa.array(rank + 1, pa.int32()),
                 pa.array(keys), ids.take(pa.array(cols)), pa.array(products.rounded(rows + start, cols))],
                schema=target))
        return pa.concat_tables(parts)

    partial = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(sample, schema)
    if n_corpus == 1:
        return partial.select("query_id", F.col("n").alias("pool_size"), "rank", "item_id", "sim")
    # At most m rows of a query from every block; sizes stand on each block's first.
    stored = cut(partial)
    sizes = stored.filter("rank = 1").groupBy("query_id").agg(F.sum("n").alias("pool_size"))
    best = top_n(stored.select("query_id", "key", "item_id", "sim"), ["query_id"], [F.col("key"), F.col("item_id")], m)
    return best.join(sizes, "query_id").select("query_id", "pool_size", "rank", "item_id", "sim")


def threshold_negatives(pool: DataFrame, k: int) -> DataFrame:
    """``k - 1`` sampled negatives; a query whose pool is too small is skipped."""
    return pool.filter((F.col("pool_size") >= k - 1) & (F.col("rank") <= k - 1)).select("query_id", "item_id", "sim")

def distinct_draws(total: Column, m: int, purpose: str, key: str) -> Column:
    """``min(m, total)`` different whole numbers below ``total``, in the order drawn.

    Draw ``j`` is one of the ``total - j`` numbers not drawn yet: a uniform index,
    moved past the earlier draws in ascending order.
    """
    def draw(drawn: Column, j: Column) -> Column:
        index = hash_int(F.lit(0).cast("long"), total - j - 1, purpose, key, j.cast("string"))
        moved = F.aggregate(F.array_sort(drawn), index, lambda x, taken: x + F.when(x >= taken, 1).otherwise(0).cast("long"))
        return F.concat(drawn, F.array(moved))

    turns = F.sequence(F.lit(0).cast("long"), F.least(total, F.lit(m).cast("long")) - 1)
    return F.when(total > 0, F.aggregate(turns, F.array().cast("array<long>"), draw)).otherwise(F.array().cast("array<long>"))


def _similar(products: _Products, start: int, end: int, threshold: float, q_code, c_code) -> np.ndarray:
    """Which of the block's products pass the threshold for each query product, its own apart."""
    quick = products.look(slice(start, end))
    margin = products.margin[start:end, None]
    near = quick > threshold - margin
    near &= q_code[start:end, None] != c_code[None, :]
    rows, cols = np.nonzero(near & (quick <= threshold + margin))
    near[rows, cols] = products.rounded(rows + start, cols) > threshold
    return near


def product_pool(
    items: DataFrame, threshold: float, m: int, budget: int = BLOCK_BYTES,
    layout: tuple[int, int] | None = None, draws_per_part: int = 2_000_000,
) -> DataFrame:
    """Pool of a query: all items of other products whose first item is similar
    to the first item of the query's product. A uniform sample of ``m`` of it.

    Only products are compared. Products stand in hash order, so a product's pool is a
    sequence of item ranges. One pass over pairs of product blocks adds up each
    product's ranges by block; every query draws ``m`` positions of its pool; a second
    pass finds the product and the place in it that each position names. The
    work is linear in the items. Result as in ``sampled_pool``.
    """
    products = cut(items.groupBy("owner_id").agg(
        F.min_by("vec", "item_id").alias("vec"), F.min("item_id").alias("item_id"), F.count("*").alias("n")
    ).withColumn("bits", hash_bits("product", "owner_id")))
    n_query, n_corpus = layout or _layout(products, products, budget)
    kind = items.schema["owner_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    # Blocks are ranges of the hash order, so positions do not depend on their number.
    block = ((F.shiftright("bits", 30) * F.lit(n_corpus)) / F.lit(1 << 30)).cast("int")
    part = F.pmod(F.xxhash64("owner_id"), F.lit(n_query)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])

    def blocks(c: pa.Table) -> tuple[pa.Table, np.ndarray]:
        c = c.sort_by([("bits", "ascending"), ("owner_id", "ascending")])
        return c, c.column("n").to_numpy()

    def weigh(q: pa.Table, c: pa.Table) -> pa.Table:
        target = pa.schema([("owner_id", q.schema.field("owner_id").type), ("_c", pa.int32()), ("w", pa.int64())])
        if q.num_rows == 0 or c.num_rows == 0:
            return target.empty_table()
        c, n = blocks(c)
        q_code, c_code = _codes(q.column("owner_id"), c.column("owner_id"))
        products = _Products(_matrix(q, dtype=None), _matrix(c, dtype=None))
        weights = np.zeros(q.num_rows, np.int64)
        for start, end in _row_chunks(q.num_rows, c.num_rows, budget):
            near = _similar(products, start, end, threshold, q_code, c_code)
            weights[start:end] = np.where(near, n, 0).sum(1)
        full = pa.array(weights > 0)
        return pa.table([q.column("owner_id"), q.column("_c"), pa.array(weights)], schema=target).filter(full)

    left = fresh(products).withColumn("_q", part).withColumn("_c", every(n_corpus))
    right = fresh(products).withColumn("_c", block).withColumn("_q", every(n_query))
    weights = left.groupBy("_q", "_c").cogroup(right.groupBy("_q", "_c")).applyInArrow(weigh, f"owner_id {kind}, _c int, w long")
    # One entry a block: where the block's part of the pool begins.
    before = W.partitionBy("owner_id").orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    ranges = weights.withColumn("start", F.coalesce(F.sum("w").over(before), F.lit(0))).groupBy("owner_id").agg(
        F.sum("w").alias("pool_size"), F.array_sort(F.collect_list(F.struct("start", "_c"))).alias("ranges"))
    asked = skew_join(items.select("item_id", "owner_id"), ranges, ["owner_id"])
    drawn = asked.select(
        F.col("item_id").alias("query_id"), "owner_id", "pool_size", "ranges",
        F.posexplode(distinct_draws(F.col("pool_size"), m, "product_pool", "item_id")).alias("rank", "at"),
    ).withColumn("range", F.element_at(F.filter("ranges", lambda r: r["start"] <= F.col("at")), -1))
    draws = cut(drawn.select(
        "query_id", "owner_id", "pool_size", (F.col("rank") + 1).alias("rank"), F.col("range._c").alias("_c"),
        (F.col("at") - F.col("range.start")).alias("at")))

    def locate(q: pa.Table, c: pa.Table) -> pa.Table:
        kinds = {f: q.schema.field(f).type for f in ("query_id", "owner_id")}
        target = pa.schema([("query_id", kinds["query_id"]), ("pool_size", pa.int64()), ("rank", pa.int32()),
                            ("owner_id", kinds["owner_id"]), ("place", pa.int64()), ("sim", pa.float64())])
        asked = q.filter(pc.is_null(q.column("vec")))
        if asked.num_rows == 0 or c.num_rows == 0:
            return target.empty_table()
        c, n = blocks(c)
        q = q.filter(pc.is_in(q.column("owner_id"), value_set=asked.column("owner_id").combine_chunks()))
        first = q.filter(pc.is_valid(q.column("vec")))
        q_code, c_code, a_code = _codes(first.column("owner_id"), c.column("owner_id"), asked.column("owner_id"))
        place = np.full(max(q_code.max(), a_code.max()) + 1, -1)
        place[q_code] = np.arange(len(q_code))
        row = place[a_code]
        order = np.argsort(row, kind="stable")
        at, row = asked.column("at").to_numpy()[order], row[order]
        products = _Products(_matrix(first, dtype=None), _matrix(c, dtype=None))
        found, left = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for start, end in _row_chunks(first.num_rows, c.num_rows, budget):
            near = _similar(products, start, end, threshold, q_code, c_code)
            ends = np.cumsum(np.where(near, n, 0), axis=1)
            cuts = np.searchsorted(row, np.arange(start, end + 1))
            for i in range(end - start):
                a, b = cuts[i], cuts[i + 1]
                if a < b:
                    j = np.searchsorted(ends[i], at[a:b], side="right")
                    found[a:b], left[a:b] = j, at[a:b] - (ends[i, j] - n[j])
        asked = asked.take(pa.array(order))
        return pa.table(
            [asked.column("query_id"), asked.column("pool_size"), asked.column("rank"), c.column("owner_id").take(pa.array(found)),
             pa.array(left), pa.array(products.rounded(row, found))], schema=target)

    # Draws of one product may be many: they are spread over parts that each get its vector.
    parts = max(1, -(-draws.count() // (draws_per_part * n_query * n_corpus)))
    whole = products.select(
        F.lit(None).cast(item_kind).alias("query_id"), "owner_id", F.lit(None).cast("long").alias("pool_size"),
        F.lit(None).cast("int").alias("rank"), every(n_corpus).alias("_c"), F.lit(None).cast("long").alias("at"),
        "vec", "item_id").withColumn("_s", every(parts))
    spread = F.pmod(F.xxhash64("query_id", "rank"), F.lit(parts)).cast("int")
    empty = {c: F.lit(None).cast(products.schema[c].dataType) for c in ("vec", "item_id")}
    questions = fresh(draws).withColumns(empty).withColumn("_s", spread).select(*whole.columns)
    left = whole.unionAll(questions).withColumn("_q", part)
    right = fresh(products).withColumn("_c", block).withColumn("_q", every(n_query)).withColumn("_s", every(parts))
    keys = ["_q", "_c", "_s"]
    places = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        locate, f"query_id {item_kind}, pool_size long, rank int, owner_id {kind}, place long, sim double")
    numbered = group_rank(items.select("item_id", "owner_id"), ["owner_id"], order_key("item", "item_id"), "item_id", "place")
    return places.join(numbered, ["owner_id", "place"]).select("query_id", "pool_size", "rank", "item_id", "sim")


def pick_hard_negatives(
    wanted: DataFrame, candidates: DataFrame, pool_size: int = 10,
) -> DataFrame:
    """Choose ``n_pad`` negatives for each case.

    ``wanted`` has ``case_id, query_id, n_pad`` and optionally ``other_group``,
    a second excluded group. The first ``max(n_pad, pool_size)`` candidates form
    the pool; ``n_pad`` of them are taken in hash order.
    """
    joined = wanted.filter(F.col("n_pad") > 0).join(candidates, "query_id")
    if "other_group" in wanted.columns:
        other = F.col("other_group")
        joined = joined.filter(other.isNull() | (F.col("nbr_group") != other))
    # A case has at most top-k candidates.
    by_rank = W.partitionBy("case_id").orderBy("group_rank")
    pooled = joined.withColumn("_place", F.row_number().over(by_rank)).filter(
        F.col("_place") <= F.greatest(F.col("n_pad"), F.lit(pool_size))
    )
    by_hash = W.partitionBy("case_id").orderBy(
        order_key("negative", "case_id", "nbr_id"), "nbr_id"
    )
    return pooled.withColumn("_turn", F.row_number().over(by_hash)).filter(
        F.col("_turn") <= F.col("n_pad")
    ).select("case_id", F.col("nbr_id").alias("item_id"), F.col("sim"))


def most_similar_of_resident(
    requests: DataFrame, residents: DataFrame, on: list[str], n: int,
) -> DataFrame:
    """Up to ``n`` of a resident's items per request, most similar first.

    ``requests`` has ``case_id, query_vec`` and ``on``; ``residents`` has
    ``item_id, vec`` and ``on``. The resident side is salted, and each task
    passes on at most ``n`` rows per case.
    """
    sim: Column = F.round(dot("query_vec", "vec"), DIGITS)
    pairs = skew_join(
        residents.select(*on, "item_id", "vec"),
        requests.select(*on, "case_id", "query_vec"), on,
    ).select("case_id", "item_id", sim.alias("sim"))
    return top_n(pairs, ["case_id"], [F.desc("sim"), F.col("item_id")], n)


def intra_group_similarity(
    items: DataFrame, k: int = 1, budget: int = BLOCK_BYTES,
    layout: tuple[int, int] | None = None,
) -> DataFrame:
    """How alike the items of one owner are, one row per item.

    ``mean_sim`` is the mean similarity to the owner's other items, taken from
    the sum vector in linear time; ``nearest`` and ``nearest_sim`` come from the
    block search inside each owner. A large owner is split into blocks like any
    other corpus and no pair is emitted.
    """
    parts = items.select("owner_id", F.posexplode("vec").alias("i", "x"))
    sums = parts.groupBy("owner_id", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    # One entry per dimension: the array is as long as a vector.
    total = sums.groupBy("owner_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda z: z["s"]).alias("total")
    )
    sizes = items.groupBy("owner_id").agg(F.count("*").alias("n_items"))
    means = skew_join(items, total.join(sizes, "owner_id"), ["owner_id"]).select(
        "item_id", "owner_id", "n_items",
        F.when(
            F.col("n_items") > 1,
            F.round((dot("vec", "total") - dot("vec", "vec")) / (F.col("n_items") - 1), DIGITS),
        ).alias("mean_sim"),
    )
    near = knn_topk(items, items, k + 1, budget, layout, within="owner_id")
    others = near.filter(F.col("nbr_id") != F.col("query_id")).groupBy("query_id").agg(
        F.min_by("nbr_id", "rank").alias("nearest"), F.max("sim").alias("nearest_sim")
    )
    return means.join(others.withColumnRenamed("query_id", "item_id"), "item_id", "left")
