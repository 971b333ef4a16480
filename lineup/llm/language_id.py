"""Language of documents from words labelled by a linear-chain conditional random field.

A word's affixes, byte n-grams and lexicon entry give its emission scores, all
sums of hashed weights. Learned transitions tie neighbouring words, so that a
text that switches between languages is labelled span by span. Forward and
backward passes run over all chains of a batch at once, one word of each a
step. A document's score of a language is the mean marginal of its words.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHAIN = 64  # words in a chain; longer texts are several chains
TABLE = 1 << 18  # hashed features
SWITCH = 0.03  # chance of a switch between training words


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 texts belongs to a letter."""
    letters = _letters()
    keep = letters[:256] & (np.arange(256) < 128)
    keep = keep[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return keep
    first = data[lead].astype(np.int64)
    size = 2 + (first >= 0xE0) + (first >= 0xF0)
    code = first & (0x7F >> size)
    more = np.concatenate([data, np.zeros(3, np.uint8)])
    for k in (1, 2, 3):
        code = np.where(size > k, (code << 6) | (more[lead + k] & 0x3F), code)
    lead, size = (x[letters[np.minimum(code, 0x10FFFF)]] for x in (lead, size))
    for k in range(4):
        keep[np.minimum(lead[size > k] + k, len(keep) - 1)] = True
    return keep


def letter_words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased bytes with blanks for all but letters, and the words' spans and texts."""
    keep = letter_bytes(data)
    low = common.LOWER[data]
    # The second bytes of capitals from U+00C0 to U+00DE, behind 0xC3, are lowered too.
    if len(low) > 1:
        after = np.zeros(len(low), bool)
        after[1:] = low[:-1] == 0xC3
        capital = after & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
        low = np.where(capital, low + 32, low).astype(np.uint8)
    soft = np.where(keep, low, 0x20).astype(np.uint8)
    return soft, *common.word_spans(soft, offsets)


def _slot(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(46)).astype(np.int64)


def emission_features(soft: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Feature slots of the words: one array a word (affixes, lexicon), and one a byte with the words' bounds."""
    prefix = common.prefix_hash(soft)
    per_word = []
    for n in (1, 2, 3):
        stop, head = np.minimum(start + n, end), np.maximum(end - n, start)
        per_word.append(_slot(common.mix(common.span_hash(prefix, start, stop) + np.uint64(10 + n))))
        per_word.append(_slot(common.mix(common.span_hash(prefix, head, end) + np.uint64(20 + n))))
    per_word.append(_slot(common.mix(common.span_hash(prefix, start, end) + np.uint64(30))))
    # Trigrams of bytes, from each byte of a word on, its trailing blank included.
    size = end - start
    row = np.repeat(np.arange(len(start)), size)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - start, size)
    del row
    padded = np.concatenate([soft, np.full(2, 0x20, np.uint8)]).astype(np.uint64)
    gram = (padded[:-2] << np.uint64(16)) | (padded[1:-1] << np.uint64(8)) | padded[2:]
    return per_word, _slot(common.mix(gram[at] + np.uint64(1 << 40))), first


def emissions(weights: np.ndarray, soft, start, end) -> np.ndarray:
    """Score of each language for each word."""
    per_word, grams, first = emission_features(soft, start, end)
    out = np.zeros((len(start), weights.shape[1]), np.float32)
    if not len(start):
        return out
    for slots in per_word:
        out += weights[slots]
    summed = np.add.reduceat(weights[grams], first[:-1], axis=0) if len(grams) else 0
    return out + summed / np.sqrt(np.maximum(np.diff(first), 1))[:, None]


def forward_backward(scores: np.ndarray, lengths: np.ndarray, transition: np.ndarray, begin: np.ndarray):
    """Marginals of each word, the chains given one after another with the longest first.

    ``scores`` holds the words' log scores; ``transition`` and ``begin`` are log
    scores too. Returns the marginals and the expected transitions.
    """
    n_words, k = scores.shape
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    emit = np.exp(scores - scores.max(1, keepdims=True))
    step, start = np.exp(transition), np.exp(begin)
    ahead = np.empty_like(emit)
    most = int(lengths[0]) if len(lengths) else 0
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(most)]
    for t in range(most):
        at = first[: active[t]] + t
        value = emit[at] * (start if t == 0 else ahead[at - 1] @ step)
        ahead[at] = value / np.maximum(value.sum(1, keepdims=True), 1e-30)
    back = np.ones_like(emit)
    expected = np.zeros((k, k))
    for t in range(most - 2, -1, -1):
        at = first[: active[t + 1]] + t
        later = emit[at + 1] * back[at + 1]
        value = later @ step.T
        back[at] = value / np.maximum(value.sum(1, keepdims=True), 1e-30)
        weight = 1 / np.maximum(np.einsum("ni,ij,nj->n", ahead[at], step, later), 1e-30)
        expected += step * ((ahead[at] * weight[:, None]).T @ later)
    marginal = ahead * back
    return marginal / np.maximum(marginal.sum(1, keepdims=True), 1e-30), expected


def _chains(words_per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the chains of texts, longest first."""
    pieces = -(-words_per_doc // CHAIN)
    doc = np.repeat(np.arange(len(words_per_doc)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(words_per_doc) - words_per_doc, pieces) + number * CHAIN
    length = np.minimum(words_per_doc[doc] - number * CHAIN, CHAIN)
    order = np.argsort(-length, kind="stable")
    return start[order], length[order]


class Crf:
    """Languages, hashed emission weights, transitions and chain starts."""

    def __init__(self, languages: list[str], weights, transition, begin):
        self.languages, self.weights, self.transition, self.begin = languages, weights, transition, begin

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean marginal of each language in each text; NaN without a word of letters."""
        soft, start, end, doc = letter_words(data, offsets)
        n = len(offsets) - 1
        counts = np.bincount(doc, minlength=n)
        begin, length = _chains(counts)
        order = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        marginal, _ = forward_backward(emissions(self.weights, soft, start, end)[order], length, self.transition, self.begin)
        total = np.zeros((n, len(self.languages)))
        for k in range(len(self.languages)):
            total[:, k] = np.bincount(doc[order], weights=marginal[:, k], minlength=n)
        with np.errstate(invalid="ignore"):
            return total / counts[:, None]


def fit_crf(texts: list[str], languages: list[str], steps: int = 8, rate: float = 0.5, seed: int = 7) -> Crf:
    """Learn from monolingual texts joined to chains that switch.

    The emission weights start from the smoothed log odds of each feature, and
    gradient steps on the chains' likelihood refine them and the transitions.
    """
    names = sorted(set(languages))
    k = len(names)
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    soft, start, end, doc = letter_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    label = np.array([names.index(x) for x in languages])[doc]
    per_word, grams, first = emission_features(soft, start, end)
    row = np.repeat(np.arange(len(start)), np.diff(first))
    counts = np.zeros((TABLE, k))
    for j in range(k):
        for slots in per_word:
            counts[:, j] += np.bincount(slots[label == j], minlength=TABLE)
        counts[:, j] += np.bincount(grams[label[row] == j], minlength=TABLE)
    share = (counts + 0.5) / (counts.sum(0) + 0.5 * TABLE)
    seen = counts.sum(1, keepdims=True) > 0
    odds = np.log(share)
    weights = (np.where(seen, odds - odds.mean(1, keepdims=True), 0) / 4).astype(np.float32)
    if k == 1:
        return Crf(names, weights, np.zeros((1, 1)), np.zeros(1))

    # Chains: label paths with switches, each step the next word of that language.
    rng = np.random.default_rng(seed)
    n_chains = max(1, min(len(start), 400_000) // CHAIN)
    path = np.empty((n_chains, CHAIN), np.int64)
    path[:, 0] = rng.integers(0, k, n_chains)
    for t in range(1, CHAIN):
        path[:, t] = np.where(rng.random(n_chains) < SWITCH, rng.integers(0, k, n_chains), path[:, t - 1])
    flat = path.reshape(-1)
    word = np.empty(len(flat), np.int64)
    for j in range(k):
        stream = np.flatnonzero(label == j)
        at = np.flatnonzero(flat == j)
        word[at] = stream[(np.arange(len(at)) + rng.integers(0, len(stream))) % len(stream)]
    lengths = np.full(n_chains, CHAIN)
    truth = np.eye(k)[flat]
    moves = np.zeros((k, k))
    np.add.at(moves, (path[:, :-1].reshape(-1), path[:, 1:].reshape(-1)), 1)
    transition, begin = np.full((k, k), math.log(1 / k)), np.full(k, math.log(1 / k))
    transition += 1.0 * np.eye(k)
    squares = np.full((TABLE, k), 1e-2)
    scale = (1 / np.sqrt(np.maximum(np.diff(first), 1))).astype(np.float32)
    for _ in range(steps):
        score = emissions(weights, soft, start, end)[word]
        marginal, expected = forward_backward(score, lengths, transition, begin)
        wrong = np.zeros((len(start), k))
        for j in range(k):
            wrong[:, j] = np.bincount(word, weights=truth[:, j] - marginal[:, j], minlength=len(start))
        gradient = np.zeros((TABLE, k))
        for j in range(k):
            for slots in per_word:
                gradient[:, j] += np.bincount(slots, weights=wrong[:, j], minlength=TABLE)
            gradient[:, j] += np.bincount(grams, weights=(wrong[:, j] * scale)[row], minlength=TABLE)
        gradient -= 0.05 * weights
        squares += gradient**2
        weights = (weights + 0.2 * gradient / np.sqrt(squares)).astype(np.float32)
        transition = transition + rate * (moves - expected) / moves.sum(1, keepdims=True) * 2
    return Crf(names, weights, transition, begin)


def sample_documents(docs: DataFrame, most: int) -> pd.DataFrame:
    """Up to ``most`` texts of each language, by hash of the id. ``most`` bounds the sample."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return pd.DataFrame({"doc_id": [], "lang": [], "text": []})
    reach = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int((1 << 30) * min(1.0, 1.5 * most / n)))])
    near = known.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30))).where(
        (F.col("h") < F.element_at(reach, F.col("lang"))) & F.col("text").rlike("\\p{L}"))
    got = near.select("doc_id", "lang", "text", "h").toPandas().sort_values(["lang", "h", "doc_id"])
    return got.groupby("lang").head(most)[["doc_id", "lang", "text"]]


def _predict(model: Crf):
    def rows(batches):
        for batch, a, b, data, offsets in common.text_slices(batches):
            share = model.documents(data, offsets) if model.languages else np.full((b - a, 1), np.nan)
            none = np.isnan(share[:, 0])
            best = np.argmax(np.nan_to_num(share), 1)
            name = np.array([*model.languages, "und"])[np.where(none, len(model.languages), best)]
            value = np.where(none, 0.0, np.nan_to_num(share)[np.arange(b - a), best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(common.column(batch, "doc_id", a, b)), pa.array(name.astype(object), pa.string()),
                 pa.array(np.clip(value, 0, 1))], ["doc_id", "lang_pred", "score"])

    return rows


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def language_id(docs: DataFrame, most: int = 150) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document.

    ``docs`` has ``doc_id``, ``text`` and ``lang``; further columns are ignored.
    Learns from at most ``most`` texts of each language, never from documents
    whose ``crc32(doc_id) mod 3`` is 1. Words are runs of letters. A null text or
    one without letters is ``und`` with score 0, as is all without labelled texts.
    Rows without an id are left out; of rows that repeat an id the greatest text
    is read. An empty table gives no rows.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.col("lang").cast("string").alias("lang")).where(~held_out())
    sample = sample_documents(labelled, most)
    if len(sample):
        model = fit_crf(sample["text"].tolist(), sample["lang"].tolist())
    else:
        model = Crf([], np.zeros((TABLE, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    plain = common.one_row_per_id(docs)
    out = plain.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
