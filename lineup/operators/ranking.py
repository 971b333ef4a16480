"""Ranks, prefix sums and joins that stay whole when one key is hot.

A plain window puts a whole group into one task. These helpers split each large
group into ordered buckets first, so a task holds one bucket of one group; only bucket
totals, at most ``16 ** digits`` per large group, travel together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import _col, order_key

# One bucket per 2 (in a group) or 4 (over everything) leading hex digits.
GROUP_DIGITS = 2
GLOBAL_DIGITS = 4
WHOLE = 50_000  # rows of a group that one task may sort
HOT_KEYS = 1000
SALTS = 32


def fine_buckets(order: Column | str) -> Column:
    """Buckets for a table with few but large groups."""
    return F.substring(_col(order), 1, GLOBAL_DIGITS)


def range_buckets(df: DataFrame, order: str, parts: int = 256) -> Column:
    """Buckets along ``order``, numbers or text, bounded by a sample of its distinct values.

    The sample is the ``parts`` values of smallest hash, so its size is fixed
    and it is the same in every run. Nulls, which sort first, fall in bucket 0.
    """
    values = df.select(order).filter(F.col(order).isNotNull()).distinct()
    sample = values.orderBy(F.xxhash64(order), order).limit(parts).collect()
    bounds = sorted(r[0] for r in sample)

    def search(low: int, high: int) -> Column:
        """Number of bounds up to the value, which lies between ``low`` and ``high``."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(order) < F.lit(bounds[middle]), search(low, middle)).otherwise(
            search(middle + 1, high)
        )

    return F.when(F.col(order).isNull(), 0).otherwise(search(0, len(bounds)))


def prefix_sum(
    df: DataFrame, by: Sequence[str], order: Column | str, tie: str, value: Column | str,
    name: str, bucket: Column | None = None, total: str | None = None,
    attach: DataFrame | None = None,
) -> DataFrame:
    """Sum of ``value`` over the rows before this one, within ``by``.

    ``order`` is a hex key; for another order pass a ``bucket`` that never
    decreases along it. ``total`` names a column for the group's whole sum.
    ``attach`` is a table with one row per group; its columns reach the rows
    through the bucket totals, so a hot group is not joined as one key.
    """
    by = list(by)
    digits = GROUP_DIGITS if by else GLOBAL_DIGITS
    bucket = F.substring(_col(order), 1, digits) if bucket is None else bucket
    keyed = df.withColumns({"_order": _col(order), "_bucket": bucket, "_value": _col(value)})
    if by:
        running, starts = _by_size(keyed, by, total)
    else:
        running, starts = keyed, _starts(keyed, by, total)
    if attach is not None:
        starts = starts.join(attach, by)
    inside = (
        W.partitionBy(*by, "_bucket").orderBy("_order", tie)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    running = running.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        running.join(starts, [*by, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("long"))
        .drop("_order", "_bucket", "_value", "_inside", "_start")
    )


def _starts(keyed: DataFrame, by: list[str], total: str | None) -> DataFrame:
    """Sum of ``_value`` before each bucket of each group."""
    totals = keyed.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_total"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = [F.sum("_total").over(W.partitionBy(*by)).alias(total)] if total else []
    return totals.select(
        *by, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"), *whole
    )


def _by_size(keyed: DataFrame, by: list[str], total: str | None) -> tuple[DataFrame, DataFrame]:
    """The rows and the starts, with buckets for groups of more than ``WHOLE`` rows alone.

    Of those there is at most one in ``WHOLE`` rows, so their list is broadcast. Any
    other group is one bucket, and its rows need no totals.
    """
    sums = [F.sum("_value").alias("_sum")] if total else []
    sizes = keyed.groupBy(*by).agg(F.count("*").alias("_rows"), *sums)
    large = F.broadcast(sizes.filter(F.col("_rows") > WHOLE).select(*by, F.lit(True).alias("_large")))
    starts = _starts(keyed.join(large, by).drop("_large"), by, total)
    whole = [F.col("_sum").alias(total)] if total else []
    small = sizes.filter(F.col("_rows") <= WHOLE).select(
        *by, F.lit("").alias("_bucket"), F.lit(0).alias("_start"), *whole
    )
    text = F.col("_bucket").cast("string")  # in the order of the totals no more
    running = keyed.join(large, by, "left").withColumn(
        "_bucket", F.when(F.col("_large"), text).otherwise("")
    ).select(*keyed.columns)
    return running, small.unionByName(starts.withColumn("_bucket", text))


def group_rank(
    df: DataFrame, by: Sequence[str], order: Column | str, tie: str, name: str = "rank",
    bucket: Column | None = None, total: str | None = None, attach: DataFrame | None = None,
) -> DataFrame:
    """0-based rank by ``(order, tie)`` within ``by``; options as in ``prefix_sum``."""
    return prefix_sum(df, by, order, tie, F.lit(1), name, bucket, total, attach)


def top_n(
    df: DataFrame, by: Sequence[str], orders: Sequence[Column], n: int, name: str = "rank",
) -> DataFrame:
    """First ``n`` rows per group, 1-based rank in ``name``.

    A constant ``n`` lets Spark cut every partition to ``n`` rows per group
    before the shuffle, so a hot group costs ``n`` rows per map task.
    """
    window = W.partitionBy(*by).orderBy(*orders)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= F.lit(n))


def contiguous_positions(
    df: DataFrame, group: Sequence[str], item: str, purpose: str, name: str = "pos",
) -> tuple[DataFrame, DataFrame]:
    """Number all rows 0..n-1 with each group in one contiguous range.

    Returns the numbered rows and one row per group with its ``n`` and
    ``offset``. Groups and items are in hash order.
    """
    group = list(group)
    sizes = (
        df.groupBy(*group).agg(F.count("*").alias("n"))
        .withColumn("_gkey", order_key(purpose, *group))
    )
    extents = prefix_sum(sizes, [], "_gkey", group[-1], "n", "offset").drop("_gkey")
    ranked = group_rank(
        df, group, order_key(purpose, item), item, "_in_group",
        attach=extents.select(*group, "offset"),
    )
    positions = ranked.withColumn(name, F.col("offset") + F.col("_in_group")).drop(
        "offset", "_in_group"
    )
    return positions, extents


def skew_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner",
) -> DataFrame:
    """Equi-join of a skewed ``left`` with a ``right`` that is thin per key.

    The ``HOT_KEYS`` most frequent keys of ``left`` are salted; any other key
    holds less than one row in ``HOT_KEYS``. The list of hot keys is a fixed
    number of rows, so it may be broadcast. ``left`` is read twice: give it a
    stored table or a narrow scan. Rows spread by their ``item_id``, or by all
    columns without one; a salt from the row survives task retries.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"the right side is repeated, so {how!r} is not possible")
    on = list(on)
    hot = (
        left.groupBy(*on).agg(F.count("*").alias("_n"))
        .orderBy(F.desc("_n"), *on).limit(HOT_KEYS)
        .select(*on, F.lit(True).alias("_hot"))
    )
    spread_by = ["item_id"] if "item_id" in left.columns and "item_id" not in on else left.columns
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(SALTS))
    salted = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0).cast("long"))
    ).drop("_hot")
    all_salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
    spread = right.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0).cast("long")))),
    ).drop("_hot")
    columns = left.columns + ([] if how.startswith("left_") else
                              [c for c in right.columns if c not in on])
    return salted.join(spread, [*on, "_salt"], how).select(*columns)


def chunked_lists(
    df: DataFrame, by: Sequence[str], item: str, purpose: str, name: str = "items",
    chunk: int = 10_000,
) -> DataFrame:
    """Lists of at most ``chunk`` items per row; large groups get more rows."""
    by = list(by)
    ranked = group_rank(df, by, order_key(purpose, item), item, "_rank")
    return (
        ranked.withColumn("chunk", F.floor(F.col("_rank") / chunk).cast("int"))
        .groupBy(*by, "chunk")
        .agg(F.sort_array(F.collect_list(item)).alias(name))
    )


def quota(total, n_keys, rank, remainder: str = "first") -> Column:
    """Even share of ``total`` for the key at 0-based ``rank`` of ``n_keys``."""
    total, k, r = (c if isinstance(c, Column) else F.lit(c) for c in (total, n_keys, rank))
    share = F.floor(total / k).cast("long")
    extra = F.pmod(total, k)
    gets_one = r < extra if remainder == "first" else r >= k - extra
    return share + F.when(gets_one, 1).otherwise(0)
