"""Importance resampling: documents like a target, by hashed n-gram models.

Words and punctuation runs, and pairs of them, are hashed to a fixed number of
buckets. One model counts the target's documents, the labelled good ones, and
one every raw document. A document's importance is the log ratio of their
probabilities of it. Gumbel noise on the log ratio and a cut at the k-th
greatest sum is a sample without replacement in proportion to importance.

The k-th greatest is found by radix: a few passes count the leading digits of
the keys, so nothing is sorted as a whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import store
from .toxicity import sample_labels

BUCKETS = 10_000


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Hashes of runs of word bytes and of punctuation, and their texts."""
    low = common.LOWER[data]
    n = len(low)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = np.where(common.SPACE[low], 0, 2)
    kind[((low >= ord("a")) & (low <= ord("z"))) | ((low >= ord("0")) & (low <= ord("9"))) | (low >= 128)] = 1
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    keep = kind[start] > 0
    start, end = start[keep], end[keep]
    return common.span_hash(common.prefix_hash(low), start, end), np.searchsorted(offsets, start, side="right") - 1


def grams(data: np.ndarray, offsets: np.ndarray):
    """Buckets of single tokens and of pairs inside a text, and their texts."""
    word, doc = tokens(data, offsets)
    pair = common.gram_hash(word, doc, 2)[:-1] if len(word) > 1 else word[:0]
    inside = doc[1:] == doc[:-1] if len(word) > 1 else np.zeros(0, bool)
    slot = np.concatenate([common.mix(word), pair[inside]]) % np.uint64(BUCKETS)
    return slot.astype(np.int64), np.concatenate([doc, doc[:-1][inside] if len(word) > 1 else doc[:0]])


def _count(target: np.ndarray):
    def rows(batches):
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch, a, b, data, offsets in common.text_slices(batches):
            slot, doc = grams(data, offsets)
            ids = common.column(batch, "doc_id", a, b)
            at = np.minimum(np.searchsorted(target, ids), max(0, len(target) - 1))
            good = target[at] == ids if len(target) else np.zeros(len(ids), bool)
            counts[0] += np.bincount(slot, minlength=BUCKETS)
            counts[1] += np.bincount(slot[good[doc]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(counts[0]), pa.array(counts[1])], ["slot", "raw", "target"])

    return rows


def _weigh(ratio: np.ndarray):
    def rows(batches):
        for batch, a, b, data, offsets in common.text_slices(batches):
            slot, doc = grams(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(common.column(batch, "doc_id", a, b)), pa.array(np.bincount(doc, minlength=b - a).astype(np.int64)),
                 pa.array(np.bincount(doc, weights=ratio[slot], minlength=b - a))], ["doc_id", "n_grams", "log_weight"])

    return rows


def importance(docs: DataFrame, target: np.ndarray) -> DataFrame:
    """``doc_id, n_grams, log_weight`` of every document. The models have a fixed size."""
    counts = docs.mapInArrow(_count(np.sort(target)), "slot int, raw long, target long").groupBy("slot").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    model = np.zeros((2, BUCKETS))
    for i, c in enumerate(("raw", "target")):
        model[i, counts["slot"]] = counts[c]
    share = (model + 1.0) / (model.sum(1, keepdims=True) + BUCKETS)
    ratio = np.log(share[1]) - np.log(share[0]) if model[1].any() else np.zeros(BUCKETS)
    return docs.mapInArrow(_weigh(ratio), "doc_id long, n_grams long, log_weight double")


def kth_greatest(rows: DataFrame, column: str, k: int, bits: int = 12) -> tuple[int, int]:
    """The ``k``-th greatest of a long column without nulls, and how many greater ones there are.

    Passes over digits of ``bits`` bits, from the top; each sends one histogram.
    """
    if k < 1:
        raise ValueError("k must be positive")
    # Shifting the sign bit makes unsigned order out of signed order.
    key = F.expr(f"`{column}` ^ (-9223372036854775807L - 1L)")
    fixed, above, left = 0, 0, 64
    while left > 0:
        width = min(bits, left)
        rest = rows if left == 64 else rows.where(F.shiftrightunsigned(key, left) == F.lit(_signed(fixed)))
        digit = F.shiftrightunsigned(key, left - width).bitwiseAND(F.lit((1 << width) - 1))
        counts = {r["d"]: r["count"] for r in rest.groupBy(digit.alias("d")).count().collect()}
        for d in sorted(counts, reverse=True):
            if above + counts[d] >= k:
                break
            above += counts[d]
        fixed, left = (fixed << width) | int(d), left - width
    return _signed(fixed ^ (1 << 63)), above


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def resample(docs: DataFrame, labels: DataFrame, fraction: float = 0.85, most: int = 12_000, seed: int = 3) -> DataFrame:
    """``doc_id, n_grams, log_weight, key, kept`` of every document; ``kept`` is the sample.

    The target is the labelled documents of good quality, not toxic, at most
    ``most`` of them by hash. The sample has ``fraction`` of the documents, rounded up.
    Equal keys go by the smaller id. A null or empty text has log ratio 0, and
    without labels every ratio is 0: the noise alone decides. Rows without an id
    are left out; of rows that repeat an id the greatest text counts. An empty table gives no rows.
    """
    docs = common.one_row_per_id(docs)
    wanted = labels.select("doc_id", F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0).alias("good"))
    known: pd.DataFrame = sample_labels(wanted, most, "good")
    target = known.loc[known["y"] == 1, "doc_id"].to_numpy(np.int64)
    # A uniform number between 0 and 1, both excluded, from the id.
    chance = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    keyed = importance(docs, target).withColumn("key", F.col("log_weight") - F.log(-F.log(chance)))
    # Whole numbers keep the order of keys; the sample is exact for them.
    keyed = store(keyed.withColumn("rank", F.round(F.col("key") * (1 << 24)).cast("long")), "keyed")
    k = -(-keyed.count() * int(round(fraction * 10_000)) // 10_000)
    if k < 1:
        return keyed.select("doc_id", "n_grams", "log_weight", "key", F.lit(False).alias("kept"))
    edge, above = kth_greatest(keyed, "rank", k)
    ties = keyed.where(F.col("rank") == edge).select((-F.col("doc_id")).alias("order"))
    last, _ = kth_greatest(ties, "order", k - above)
    kept = (F.col("rank") > edge) | ((F.col("rank") == edge) & (-F.col("doc_id") >= last))
    return keyed.select("doc_id", "n_grams", "log_weight", "key", kept.alias("kept"))
