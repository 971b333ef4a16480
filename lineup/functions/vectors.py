"""Vector and box arithmetic. Sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _col


def dot(a, b) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v) -> Column:
    """Unit vector; null when the norm is zero."""
    length = norm(v)
    return F.when(
        length > 0, F.transform(_col(v), lambda x: x.cast("double") / length)
    )


def cosine(a, b) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def pad_clip_box(x1, y1, x2, y2, pad: int, width, height) -> Column:
    """Grow a box by ``pad``, clip it to the frame; null when nothing is left."""
    w = width if isinstance(width, Column) else F.lit(width)
    h = height if isinstance(height, Column) else F.lit(height)
    box = F.struct(
        F.greatest(F.lit(0), _col(x1) - pad).alias("x1"),
        F.greatest(F.lit(0), _col(y1) - pad).alias("y1"),
        F.least(w, _col(x2) + pad).alias("x2"),
        F.least(h, _col(y2) + pad).alias("y2"),
    )
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)
