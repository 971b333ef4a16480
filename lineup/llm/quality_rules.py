"""Document rules, and verdicts on whole hosts from the failures of their documents.

The facts of a text come from one vectorised scan. Failures are counted per
host with a combining aggregation. A host's failure rate of a rule is shrunk
towards the rates of all hosts: a beta prior, fitted to them by moments, adds
its pseudo-counts, so a host of few documents is not judged by chance. Verdicts
are joined back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import store

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

FACTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules of a host verdict: a document fails one if the condition holds.
RULES = {
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 12 * n_words)",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "repeat_words": "5 * n_repeat_words > n_words",
}


LEAST = 2.0  # documents that the prior counts for, at least


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_facts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``FACTS`` of each text."""
    n = len(offsets) - 1
    start, end, doc = common.word_spans(data, offsets)
    solid = ~common.SPACE[data]
    prefix = common.prefix_hash(data, 0)
    words = common.span_hash(prefix, start, end)
    count = lambda d: np.bincount(d, minlength=n).astype(np.int64)
    own = lambda keys, d: common.mix(keys + common.mix((d + 1).astype(np.uint64)))  # noqa: E731  different between texts

    # Lines with a word, and those equal to an earlier one.
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    breaks = np.flatnonzero(data == 10)
    cut[breaks + 1] = True
    begin = np.flatnonzero(cut[: len(data)])
    line_doc = np.searchsorted(offsets, begin, side="right") - 1
    stop = np.minimum(np.append(begin[1:], len(data)), offsets[1:][line_doc])
    stop = np.where((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10), stop - 1, stop) if len(begin) else stop
    seen = np.concatenate([[0], np.cumsum(solid)])
    full = seen[stop] > seen[begin]
    begin, stop, line_doc = begin[full], stop[full], line_doc[full]
    second = common.prefix_hash(data, 1)
    line = own(common.span_hash(prefix, begin, stop) ^ common.mix(common.span_hash(second, begin, stop, 1)), line_doc)
    _, first = np.unique(line, return_index=True)
    n_lines = count(line_doc)

    # Words inside three-word windows that occur twice or more.
    whole = np.zeros(len(doc), bool)
    if len(doc) > 2:
        whole[:-2] = doc[2:] == doc[:-2]
    at = np.flatnonzero(whole)
    window = own(common.gram_hash(words, doc, 3)[at], doc[at])
    _, which, times = np.unique(window, return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    covered = np.zeros(len(doc), bool)
    for j in range(3):
        covered[again + j] = True
    return {
        "n_words": count(doc), "word_chars": _per_doc(solid & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_doc(SYMBOL[data], offsets), "n_lines": n_lines,
        "n_dup_lines": n_lines - count(line_doc[first]), "n_repeat_words": count(doc[covered])}


def _scan(batches):
    for batch, a, b, data, offsets in common.text_slices(batches):
        facts = text_facts(data, offsets)
        keys = [batch.column(batch.schema.get_field_index(k)).slice(a, b - a) for k in ("doc_id", "host")]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(facts[k]) for k in FACTS)], ["doc_id", "host", *FACTS])


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """Every row's ``doc_id``, ``host`` and facts, and whether it fails the base rule."""
    common.small_batches(docs.sparkSession)
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                        F.col("text").cast("string").alias("text")).mapInArrow(
        _scan, "doc_id long, host string, " + ", ".join(f"{k} long" for k in FACTS))
    return facts.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def host_rates(facts: DataFrame) -> DataFrame:
    """Per host and rule ``n, failed, rate``, the rate shrunk by the beta prior of all hosts.

    The prior has the mean and variance of the hosts' plain rates. Hosts with
    equal rates give a prior that outweighs any host; it counts as much as
    ``LEAST`` documents at least, so that none is judged by one of its own. Rows
    without a host take no part.
    """
    counts = facts.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count("*").alias("n"), *[F.sum(F.expr(v).cast("long")).alias(k) for k, v in RULES.items()])
    long = counts.select("host", "n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(k).alias("failed")) for k in RULES])).alias("r")).select("host", "n", "r.*")
    plain = long.withColumn("plain", F.col("failed") / F.col("n"))
    prior = plain.groupBy("rule").agg(F.avg("plain").alias("mean"), F.var_pop("plain").alias("var"))
    strength = F.least(F.greatest(F.col("mean") * (1 - F.col("mean")) / F.greatest("var", F.lit(1e-9)) - 1, F.lit(LEAST)), F.lit(1e6))
    # One row a rule, and there are four rules.
    fitted = plain.join(F.broadcast(prior), "rule").withColumn("strength", strength)
    return fitted.select("host", "rule", "n", "failed", (
        (F.col("failed") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))).alias("rate"))


def quality_rules(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """``doc_id``, facts, ``base_failed`` and ``kept`` of every row.

    A host whose shrunk failure rate of any rule exceeds ``most`` is rejected
    with all its documents. A null host gets no verdict, so its rows are kept
    unless the base rule fails. A null or blank text has no words and fails it.
    Every row is judged by itself, repeated rows alike; an empty table gives no rows.
    """
    facts = store(measure(docs, host), "facts")
    bad = store(host_rates(facts).groupBy("host").agg(F.max("rate").alias("worst"))
                .where(F.col("worst") > most).select("host"), "hosts")
    judged = facts.join(bad.withColumn("rejected", F.lit(True)), "host", "left")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rejected").isNull()).alias("kept"), F.col("host"))
