"""Document rates that bring soft domains to target weights.

A classifier learned from the labels table gives each document a probability of
each domain. A document's expected tokens spread over the domains by it.
Projected gradient steps on least squares then fit a rate of each document, zero
or more, so that the expected tokens of every domain match their targets. A
step's gradient needs only the domains' totals, so a pass sends a few numbers to
the driver; the rate of a document follows from its probabilities and the steps.

DataFrame operations only. The classifier is a naive Bayes over a text's distinct
words, hashed to a table of fixed size, and Gaussian shape features. Both are
learned by combining aggregations of a bounded sample of labelled texts. Every text
is then read once: its words meet the table of log odds, whose rows are as many as
the hash has slots, and are summed to one small row a document, which all later
steps read.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Domain of a labelled document.
DOMAIN = "case when toxic = 1 then 'toxic' when quality = 1 then 'good' when quality = 0 then 'low' end"
WEIGHTS = {"good": 0.80, "low": 0.15, "toxic": 0.05}
STEPS = 12
SLOTS = 1 << 15  # hashed words
SURE = 2.0  # standard errors that the log odds of a word are drawn back by
LEARN = 10_000  # labelled texts of each domain that are learned from, at most
MISSED = 1e-3  # share of all wished tokens by which totals may miss their targets without a warning

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = "0123456789#*$%&|<>!@/\\=_"
_SPACES = " \n\t\r"


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it.

    The optimiser may move expressions below filters, where repeats are not shared.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the shape features ``f``, the last being the number of tokens (runs of
    other than blanks), and ``words``, the distinct lower-cased runs of letters."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    left = lambda signs: F.length(F.translate(body, signs, "")).cast("double")
    runs = F.regexp_count(body, F.lit(f"[^{_SPACES}]+")).cast("double")
    counts = F.array(F.length(body).cast("double"), runs, left(_UPPER), left(_SIGNS))

    def shapes(c: Column) -> Column:
        n, tokens = F.get(c, F.lit(0)), F.get(c, F.lit(1))
        share = lambda part: F.sqrt(part / F.greatest(n, F.lit(1.0)))
        return F.array(F.log1p(n), share(n - F.get(c, F.lit(2))), share(n - F.get(c, F.lit(3))), share(tokens), tokens)

    words = F.array_distinct(F.split(F.lower(body), "[^\\p{L}]+"))
    return docs.withColumns({"f": let(counts, shapes), "words": words})


def slot(word: str = "word") -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def sample_labels(labels: DataFrame, most: int = LEARN) -> DataFrame:
    """``doc_id, domain`` of at most ``most`` labelled documents of each domain, by hash of the id.

    Of rows that repeat a label's id, and of contradicting ones, the greatest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.expr(DOMAIN).alias("domain")).where(
        "doc_id is not null and domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    order = Window.partitionBy("domain").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
    return known.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).select("doc_id", "domain")


class Domains:
    """Names in order, and what each domain's texts are like: log odds of word slots
    against all texts, and mean and variance of the shape features."""

    def __init__(self, names: list[str], sizes: list[int], odds: np.ndarray, means: np.ndarray, variances: np.ndarray):
        self.names, self.sizes, self.odds, self.means, self.variances = names, sizes, odds, means, variances

    def shape_odds(self, f: Column) -> list[Column]:
        """Log odds of each domain before any word."""
        out = []
        for size, mean, variance in zip(self.sizes, self.means, self.variances):
            value = F.lit(math.log(size / sum(self.sizes)))
            for i, (m, v) in enumerate(zip(mean, np.maximum(variance, 1e-4))):
                away = F.get(f, F.lit(i)) - F.lit(float(m))
                value = value - F.lit(0.5 * math.log(v)) - away * away / F.lit(2 * float(v))
            out.append(value)
        return out


def fit_domains(docs: DataFrame, labels: DataFrame, most: int = LEARN) -> Domains | None:
    """The labelled domains in name order, or None without labelled texts.

    A word's log odds are drawn towards 0 by their standard error.
    """
    size = 4
    # At most ``most`` ids of each of three domains.
    chosen = F.broadcast(sample_labels(labels, most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    labelled = store(features(texts).select("domain", "f", "words"), "labelled")
    x = [F.get("f", F.lit(i)) for i in range(size)]
    learned = labelled.groupBy("domain").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(x)]).orderBy("domain").collect()
    if not learned:
        return None
    names = [r["domain"] for r in learned]
    # At most SLOTS rows, whatever the number of texts.
    rows = labelled.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy(slot().alias("slot")).agg(
        *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(names)]).collect()
    counts = np.zeros((len(names), SLOTS))
    for r in rows:
        counts[:, r["slot"]] = [r[f"n{i}"] for i in range(len(names))]
    sizes = np.array([r["n"] for r in learned], float)
    expected = counts.sum(0) * (sizes / sizes.sum())[:, None]
    odds = np.log((counts + 0.5) / (expected + 0.5))
    odds = np.sign(odds) * np.maximum(np.abs(odds) - SURE / np.sqrt(counts + 0.5), 0)
    table = lambda kind: np.array([[r[f"{kind}{i}"] for i in range(size)] for r in learned])
    return Domains(names, [r["n"] for r in learned], odds, table("m"), table("v"))


def row_key(text: str = "text") -> Column:
    """What tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def posteriors(docs: DataFrame, domains: Domains | None) -> DataFrame:
    """``doc_id, row_key, n_tokens, copies_of, p``: one row for each id and text, with
    the number of rows that hold it and the probabilities of the domains."""
    read = features(docs.select("doc_id", "text", row_key().alias("row_key"))).drop("text")
    n_tokens = F.get("f", F.lit(4)).cast("long")
    if domains is None:
        return read.groupBy("doc_id", "row_key").agg(
            F.max(n_tokens).alias("n_tokens"), F.count("*").alias("copies_of"), F.array(F.lit(1.0)).alias("p"))
    k = range(len(domains.names))
    telling = np.flatnonzero(domains.odds.any(0))
    table = docs.sparkSession.createDataFrame(
        [(int(s), *[float(domains.odds[d, s]) for d in k]) for s in telling], "slot int, " + ", ".join(f"o{d} double" for d in k))
    shaped = read.select("doc_id", "row_key", n_tokens.alias("n_tokens"), *[c.alias(f"s{d}") for d, c in enumerate(domains.shape_odds(F.col("f")))],
                         F.posexplode("words").alias("at", "word"))
    # Every text splits into one word at least; an empty one has no slot. The table has SLOTS rows at most.
    met = shaped.withColumn("slot", F.when(F.col("word") != "", slot())).join(F.broadcast(table), "slot", "left")
    own = met.groupBy("doc_id", "row_key").agg(
        F.max("n_tokens").alias("n_tokens"), F.count_if(F.col("at") == 0).alias("copies_of"),
        *[F.max(f"s{d}").alias(f"s{d}") for d in k], *[F.coalesce(F.sum(f"o{d}"), F.lit(0.0)).alias(f"o{d}") for d in k])
    # Rows that hold the same text each brought its words.
    score = [F.col(f"s{d}") + F.col(f"o{d}") / F.col("copies_of") for d in k]
    # Probability of each: one over the sum of all odds against it.
    against = lambda c: F.transform(c, lambda mine: 1 / F.aggregate(
        c, F.lit(0.0), lambda total, other: total + F.exp(F.least(other - mine, F.lit(700.0)))))
    return own.select("doc_id", "row_key", "n_tokens", "copies_of", let(F.array(*score), against).alias("p"))


def rate_column(steps: list[list[float]], cap: float | None) -> Column:
    """Rate of a document after the steps, over its ``p``; each is projected on rates from 0 to ``cap``."""
    if not steps:
        return F.lit(1.0)
    top = F.lit(float(cap) if cap is not None else float("inf"))
    moves = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])
    along = lambda p, move: F.aggregate(F.zip_with(p, move, lambda x, y: x * y), F.lit(0.0), lambda a, b: a + b)
    return let(F.col("p"), lambda p: F.aggregate(
        moves, F.lit(1.0), lambda r, move: F.least(F.greatest(r - along(p, move), F.lit(0.0)), top)))


def fit_rates(docs: DataFrame, targets: list[float], cap: float | None = None, most: int = STEPS) -> tuple[list[list[float]], list[float]]:
    """Steps of ``rate_column``, and the totals that the rates reach.

    ``docs`` has ``p`` and ``n_tokens``. Each step follows the gradient of the
    squared errors, scaled by the Gram matrix of the documents not held at a bound.
    The descent ends where the totals meet the targets, or after ``most`` steps.
    """
    k = len(targets)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    wish = np.array(targets)
    steps: list[list[float]] = []
    while True:
        inside = (F.col("r") > 0) & (F.col("r") < cap) if cap is not None and steps else F.col("r") > 0
        row = docs.select("p", "n_tokens", rate_column(steps, cap).alias("r")).agg(
            *[F.coalesce(F.sum(F.col("r") * F.col("n_tokens") * p[i]), F.lit(0.0)).alias(f"s{i}") for i in range(k)],
            *[F.coalesce(F.sum(F.when(inside, F.col("n_tokens") * p[i] * p[j])), F.lit(0.0)).alias(f"g{i}_{j}")
              for i in range(k) for j in range(i, k)]).first()
        reached = [row[f"s{i}"] for i in range(k)]
        error = np.array(reached) - wish
        if len(steps) == most or np.abs(error).max() <= 1e-6 * max(1.0, wish.sum()):
            return steps, reached
        gram = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        steps.append(np.linalg.solve(gram + 1e-4 * np.diag(np.maximum(wish, 1.0)), error).tolist())


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, keep: dict[str, float] | None = None,
        cap: float | None = None) -> DataFrame:
    """``docs`` with ``n_tokens, domains, p, rate, copies``; such columns of its own are replaced.

    ``docs`` has ``doc_id`` and ``text``. ``weights`` are the domains' target shares
    of the present tokens, or ``keep`` is the part of its own expected tokens that
    each domain shall have. A domain without a weight has target 0. ``copies`` is
    the rate's whole part, and one more with the chance of its fraction, by hash of
    the id: repeated rows share it.

    A null text has no tokens; like an empty one it gets a rate from its
    probabilities, as do rows with a null id. An empty table gives no rows. Totals
    that miss their targets are reported by a warning.
    """
    docs = docs.drop(*[c for c in ("n_tokens", "p", "domains", "rate", "copies") if c in docs.columns])
    learned = fit_domains(docs, labels)
    domains = learned.names if learned else ["all"]
    soft = store(posteriors(docs, learned), "soft")
    # Tokens of all rows, copies included.
    weighed = soft.select((F.col("n_tokens") * F.col("copies_of")).alias("n_tokens"), "p")
    present = weighed.agg(*[F.coalesce(F.sum(F.col("n_tokens") * F.get("p", F.lit(i))), F.lit(0.0)).alias(f"s{i}")
                            for i in range(len(domains))]).first()
    if keep is not None:
        targets = [present[i] * keep.get(d, 1.0) for i, d in enumerate(domains)]
    else:
        weights = WEIGHTS if weights is None else weights
        named = {d: weights.get(d, 0.0) for d in domains} if domains != ["all"] else {"all": 1.0}
        scale = sum(present) / (sum(named.values()) or 1.0)
        targets = [named[d] * scale for d in domains]
    steps, reached = fit_rates(weighed, targets, cap)
    missed = max(abs(a - b) for a, b in zip(reached, targets))
    if missed > MISSED * max(1.0, sum(targets)):
        # No rates within the bounds may reach them; the fitted ones come nearest.
        warnings.warn(f"tokens of {domains}: wished {targets}, reached {reached}", stacklevel=2)
    chance = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rated = soft.select(
        F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "n_tokens", F.lit(",".join(domains)).alias("domains"), "p",
        rate_column(steps, cap).alias("rate")).alias("rated")
    mine = docs.withColumn("_row_key", row_key())
    joined = mine.join(rated, mine["doc_id"].eqNullSafe(rated["_id"]) & (mine["_row_key"] == rated["_key"]))
    return joined.drop("_id", "_key", "_row_key").withColumn("copies", F.floor(F.col("rate") + chance).cast("long")).select(
        *docs.columns, "n_tokens", "domains", "p", "rate", "copies")
