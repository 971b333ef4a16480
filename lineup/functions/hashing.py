"""Reproducible sampling keys.

Every random choice is an ordering by ``order_key`` or an integer from
``hash_int``. Both depend only on the seed, a purpose and the row's own key, so
results do not change with partitioning and plain SQL can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
#: Odd factors that mix the bits of a pair, below 2**62 so that SQL's wide integers hold the products.
PAIR_FACTORS = (0x1E3779B97F4A7C15, 0x2545F4914F6CDD1D)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def order_key(purpose: str, *keys, seed: int = SEED) -> Column:
    """32 hex digits: md5 of ``seed|purpose|key|...``."""
    parts = [F.lit(str(seed)), F.lit(purpose)]
    parts += [_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash_int(lo, hi, purpose: str, *keys, seed: int = SEED) -> Column:
    """Integer in ``[lo, hi]``, both ends included."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return lo + F.pmod(hash_bits(purpose, *keys, seed=seed), hi - lo + 1)


def hash_bits(purpose: str, *keys, seed: int = SEED) -> Column:
    """60-bit integer per row, wide enough to index any table."""
    key = order_key(purpose, *keys, seed=seed)
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
