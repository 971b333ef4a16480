"""Toxicity of documents, read through leetspeak, spacing and repetition.

1. Character 4-grams of every text make a language model of characters.
2. Words with a digit, sign or separator, or a letter twice in a row, and characters
   set apart, are lattices: each character stands for itself or for what it
   imitates, repeats and separators may be nothing. Viterbi finds the likeliest
   reading under the model and a channel. Signs at a word's edge may be punctuation,
   so the word is read with and without them.
3. Words and word beginnings of restored texts are weighed by labelled documents
   as log odds, and a logistic curve over a document's strongest weights gives its score.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# What a sign may stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = ".-_*,~/\\'"

KINDS = 32  # symbols of the character model: boundary, 26 letters, other letters, other signs
GRAM = 4
TABLE = 1 << 20  # KINDS ** GRAM, and the number of hashed word features
HIDE = -2.5  # log probability of writing a sign for a letter
REPEAT = -1.5  # of repeating a letter
SPLIT = -1.5  # of a separator

_CODE = np.zeros(256, np.int64)
_CODE[list(range(ord("a"), ord("z") + 1))] = np.arange(1, 27)
_CODE[list(range(ord("A"), ord("Z") + 1))] = np.arange(1, 27)
_CODE[128:] = 27
_CODE[list(b"0123456789@$!|+*")] = 28


# -- character model ------------------------------------------------------------

def _count_grams(batches):
    """Counts of 4-grams over letters and boundaries, as sparse parts of the table."""
    total, held = np.zeros(TABLE, np.int64), 0

    def flush():
        at = np.flatnonzero(total)
        part = at >> 14
        edges = np.searchsorted(part, np.arange(TABLE >> 14) , side="left")
        ends = np.append(edges[1:], len(at))
        full = np.flatnonzero(ends > edges)
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)),
             pa.array([at[edges[j] : ends[j]].astype(np.int32).tobytes() for j in full], pa.binary()),
             pa.array([total[at[edges[j] : ends[j]]].tobytes() for j in full], pa.binary())], ["part", "grams", "counts"])

    for _, _, _, data, offsets in common.text_slices(batches):
        code = np.zeros(len(data) + len(offsets) + GRAM, np.int64)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        code[np.arange(len(data)) + doc + 1] = _CODE[data]  # a boundary between texts
        grams = code[:-3]
        for j in range(1, GRAM):
            grams = grams * KINDS + code[j : len(code) - 3 + j]
        usable = (code[3:] != 0) | (code[2:-1] != 0)
        for j in range(GRAM):
            usable = usable & (code[j : len(code) - 3 + j] != 28)
        total += np.bincount(grams[usable], minlength=TABLE)
        held += len(data)
        if held > 256 << 20:
            yield flush()
            total[:], held = 0, 0
    if held:
        yield flush()


def _add_grams(rows: pd.DataFrame) -> pd.DataFrame:
    grams = np.concatenate([np.frombuffer(x, np.int32) for x in rows["grams"]])
    counts = np.concatenate([np.frombuffer(x, np.int64) for x in rows["counts"]])
    kinds, place = np.unique(grams, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, place, counts)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "grams": [kinds.astype(np.int32).tobytes()], "counts": [total.tobytes()]})


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probability of a character after three others, from every text.

    The table has a fixed size, whatever the number of texts.
    """
    schema = "part int, grams binary, counts binary"
    parts = docs.mapInArrow(_count_grams, schema).groupBy("part").applyInPandas(_add_grams, schema)
    counts = np.zeros(TABLE, np.float64)
    for row in parts.toLocalIterator():
        counts[np.frombuffer(row.grams, np.int32)] = np.frombuffer(row.counts, np.int64)
    counts = counts.reshape((KINDS,) * GRAM)
    prob = (counts.sum((0, 1, 2)) + 0.5) / (counts.sum() + 0.5 * KINDS)
    for axes in ((0, 1), (0,), ()):  # longer contexts lean on shorter ones
        level = counts.sum(axes) if axes else counts
        prob = (level + 5.0 * prob) / (level.sum(-1, keepdims=True) + 5.0)
    return np.log(prob).astype(np.float32).reshape(-1)


# -- decoding --------------------------------------------------------------------

def _readings(chars: np.ndarray):
    """For each distinct sign: its letters, up to two that it may stand for (-1 for none)
    with their cost, and whether it may stand for nothing. Then each place's sign."""
    kinds, place = np.unique(chars, return_inverse=True)
    letters: dict[str, int] = {}
    same, stands = np.zeros(len(kinds), np.int64), np.full((len(kinds), 2), -1)
    cost, gap = np.zeros(len(kinds)), np.zeros(len(kinds), bool)
    for k, ch in enumerate(map(chr, kinds)):
        same[k] = letters.setdefault(ch.lower(), len(letters))
        if ch.lower().isalpha():
            stands[k, 0] = same[k]
        else:
            for j, letter in enumerate(LOOKS_LIKE.get(ch, "")):
                stands[k, j] = letters.setdefault(letter, len(letters))
            cost[k], gap[k] = HIDE, ch in SEPARATORS or ch == " "
    return list(letters), same, stands, cost, gap, place


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def restore_all(words: list[str], model: np.ndarray) -> list[str]:
    """The likeliest letters behind each hidden word, or the word where a sign has no reading.

    Viterbi over all words at once, a character of each a step.
    """
    size = np.array([len(x) for x in words], np.int64)
    begin = np.cumsum(size) - size
    chars = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
    if not len(chars):
        return list(words)
    letters, same, stands, cost, gap, place = _readings(chars)
    symbol = np.array([_symbol(x) for x in letters])
    of_word = np.repeat(np.arange(len(words)), size)
    none = np.bincount(of_word, weights=((stands[place, 0] < 0) & ~gap[place]), minlength=len(words)) > 0
    again = np.zeros(len(chars), bool)
    again[1:] = (same[place[1:]] == same[place[:-1]]) & (of_word[1:] == of_word[:-1])
    left = np.where(none, 0, size)
    mask = KINDS**3 - 1
    word = np.flatnonzero(left)
    state, score, node = np.zeros(len(word), np.int64), np.zeros(len(word)), np.full(len(word), -1)
    parents, said, n_nodes = [], [], 0  # readings as chains of letters
    ended = []
    for t in range(int(left.max()) + 1):
        end = left[word] == t
        if end.any():
            value = score[end] + model[state[end] * KINDS]
            order = np.lexsort((-value, word[end]))
            w, tail = word[end][order], node[end][order]
            top = np.ones(len(w), bool)
            top[1:] = w[1:] != w[:-1]
            ended.append((w[top], tail[top]))
            word, state, score, node = word[~end], state[~end], score[~end], node[~end]
        if not len(word):
            break
        at = begin[word] + t
        sign = place[at]
        nothing = np.flatnonzero(gap[sign] | again[at])
        source, letter = [nothing], [np.full(len(nothing), -1)]
        to, value = [state[nothing]], [score[nothing] + np.where(gap[sign[nothing]], SPLIT, REPEAT)]
        for j in (0, 1):
            some = np.flatnonzero(stands[sign, j] >= 0)
            kind = stands[sign[some], j]
            gram = state[some] * KINDS + symbol[kind]
            source.append(some)
            letter.append(kind)
            to.append(gram & mask)
            value.append(score[some] + cost[sign[some]] + model[gram])
        source, letter, to, value = (np.concatenate(x) for x in (source, letter, to, value))
        key = word[source] * (mask + 1) + to
        order = np.lexsort((-value, key))
        top = np.ones(len(order), bool)
        top[1:] = key[order[1:]] != key[order[:-1]]
        keep = order[top]
        source, letter, state, score = source[keep], letter[keep], to[keep], value[keep]
        word, node = word[source], node[source]
        new = np.flatnonzero(letter >= 0)
        parents.append(node[new])
        said.append(letter[new])
        node[new] = n_nodes + np.arange(len(new))
        n_nodes += len(new)
    out = list(words)
    parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
    spoken = np.concatenate(said) if said else np.zeros(0, np.int64)
    for w, tail in ended:
        rows, row = [], np.arange(len(w))
        texts = [[] for _ in w]
        while len(row := row[tail >= 0]):
            tail = tail[tail >= 0]
            rows.append((row, spoken[tail]))
            tail = parent[tail]
        for row, letter in reversed(rows):
            for r, x in zip(row.tolist(), letter.tolist()):
                texts[r].append(letters[x])
        for r, x in enumerate(w.tolist()):
            out[x] = "".join(texts[r])
    return out


def restore(word: str, model: np.ndarray) -> str:
    """The likeliest letters behind one hidden word."""
    return restore_all([word], model)[0]


_EDGE = "\"'`.,;:?!()[]{}<>&%#*~-_=/\\|$"
_SIGNS = re.escape("".join(LOOKS_LIKE))
_GAPS = re.escape(SEPARATORS)
_READABLE = re.compile(rf"(?:[^\W\d_]|[{_SIGNS}{_GAPS}])+")
_LETTERS = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
_ODD = re.compile(rf"[{_SIGNS}{_GAPS}]|([^\W\d_])\1", re.IGNORECASE)


def _forms(text: str) -> list[str]:
    """What is decoded of a word or of a run of single characters: all of it, and for
    signs that may be punctuation as well, what stays without them."""
    if len(parts := text.split()) > 1:
        run = " ".join(parts)
        return list(dict.fromkeys([run, *_LETTERS.findall(run)]))
    found = []
    for part in _READABLE.findall(text):
        core = part.strip(SEPARATORS)
        found += [core, core.lstrip(_EDGE), core.rstrip(_EDGE), core.strip(_EDGE)]
        found += [x for x in re.split(f"[{_GAPS}]+", core) if x != core]
    return [x for x in dict.fromkeys(found) if len(x) > 2 and _ODD.search(x)]


def _odd_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of what may hide a word: words with a sign that has a
    reading, a separator inside or a letter twice in a row, and three or more single
    characters set apart by white space."""
    start, end, doc = common.word_spans(data, offsets)
    if not len(start):
        return start, end, doc
    n = len(data)
    sign, gap, low = _SIGN[data], _GAP[data], common.LOWER[data]
    solid = ~gap & ~common.SPACE[data]
    letter = (_CODE[data] > 0) & (_CODE[data] < 28)
    pair = np.zeros(n, bool)  # with the byte before
    pair[1:] = (low[1:] == low[:-1]) & letter[1:] & (data[1:] < 128)
    pair[1:-1] |= gap[1:-1] & solid[2:]
    for width, first, last in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
        if n >= 2 * width:
            same = (data[: n - 2 * width + 1] >= first) & (data[: n - 2 * width + 1] <= last)
            for j in range(width):
                same &= data[j : n - 2 * width + 1 + j] == data[j + width : n - width + 1 + j]
            pair[width : n - width + 1] |= same
    signs, pairs = np.concatenate([[0], np.cumsum(sign)]), np.concatenate([[0], np.cumsum(pair)])
    odd = (end - start > 2) & ((signs[end] > signs[start]) | (pairs[end] > pairs[start + 1]))
    # Runs of single characters.
    inner = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    single = (end - start - (inner[end] - inner[start]) == 1) & (sign | gap | letter)[start]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | ~single[1:] | ~single[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    run = single[first] & (last - first >= 2)
    first, last = first[run], last[run]
    odd &= ~single
    return (np.concatenate([start[odd], start[first]]), np.concatenate([end[odd], end[last]]), np.concatenate([doc[odd], doc[first]]))


def hidden_words(text: str) -> list[str]:
    """Parts of a text that may hide a word: every word with a sign, a separator inside or
    a doubled letter, and single characters between blanks. Whether they do, the model decides."""
    raw = text.encode()
    start, end, _ = _odd_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [x for a, b in zip(start, end) for x in _forms(raw[a:b].decode())]


def _may_hide(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts in which ``hidden_words`` can find anything, from their bytes."""
    return np.bincount(_odd_spans(data, offsets)[2], minlength=len(offsets) - 1) > 0


_SIGN = np.zeros(256, bool)
_SIGN[[ord(x) for x in LOOKS_LIKE if x.isascii()]] = True
_SIGN[[0xE2, 0xC2]] = True  # first bytes of the two money signs
_GAP = np.zeros(256, bool)
_GAP[[ord(x) for x in SEPARATORS]] = True


# -- features ----------------------------------------------------------------------

def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (lower-cased word, and its first 4, 5, 6 bytes) with their text."""
    data = common.LOWER[data]
    code = _CODE[data]
    soft = np.where((code > 0) & (code < 28), data, 0x20).astype(np.uint8)
    start, end, doc = common.word_spans(soft, offsets)
    prefix = common.prefix_hash(soft)
    feats, docs = [common.span_hash(prefix, start, end) ^ np.uint64(7)], [doc]
    for n in (4, 5, 6):
        long = end - start > n
        feats.append(common.span_hash(prefix, start[long], start[long] + n))
        docs.append(doc[long])
    return (np.concatenate(feats) >> np.uint64(44)).astype(np.int64), np.concatenate(docs)


def _said(words: list[bytes], model: np.ndarray) -> list[np.ndarray]:
    """Features of the readings of each word or run that may hide a word."""
    forms = [_forms(x.decode("utf-8", "replace")) for x in words]
    owner = np.repeat(np.arange(len(words)), [len(x) for x in forms])
    flat = [x for some in forms for x in some]
    said = [b"" if r == x.lower() else r.encode() for x, r in zip(flat, restore_all(flat, model))]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in said])]).astype(np.int64)
    feats, which = _features(np.frombuffer(b"".join(said), np.uint8), ends)
    held = np.unique(owner[which] * TABLE + feats)
    return np.split(held % TABLE, np.searchsorted(held, np.arange(1, len(words)) * TABLE))


def _with_restored(data, offsets, model, memo):
    """The texts' features and those of what hides in them."""
    feats, doc = _features(data, offsets)
    start, end, owner = _odd_spans(data, offsets)
    if len(start):
        # Each distinct word is read once, and a document counts it once.
        _, first, kind = np.unique(common.span_hash(common.prefix_hash(data), start, end), return_index=True, return_inverse=True)
        words = [data[a:b].tobytes() for a, b in zip(start[first], end[first])]
        fresh = [x for x in words if x not in memo]
        if len(memo) + len(fresh) > 100_000:
            memo.clear()
            fresh = words
        memo.update(zip(fresh, _said(fresh, model) if fresh else ()))
        more = [memo[x] for x in words]
        size = np.array([len(x) for x in more])
        begin = np.cumsum(size) - size
        held = np.unique(owner * len(first) + kind)
        owner, kind = held // len(first), held % len(first)
        n = size[kind]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[kind], n)
        feats, doc = np.concatenate([feats, np.concatenate(more)[at]]), np.concatenate([doc, np.repeat(owner, n)])
    return feats, doc


def _slices(batches, keyed: bool = True):
    for batch, a, b, data, offsets in common.text_slices(batches):
        yield common.column(batch, "doc_id", a, b) if keyed else np.zeros(b - a, np.int64), data, offsets


def _known(doc_id, ids: np.ndarray, data, offsets):
    """Which texts are among the sorted ``ids``, and their bytes and offsets."""
    pick = np.flatnonzero(ids[np.minimum(np.searchsorted(ids, doc_id), len(ids) - 1)] == doc_id)
    size = np.diff(offsets)[pick]
    new = np.concatenate([[0], np.cumsum(size)])
    return pick, data[np.repeat(offsets[:-1][pick] - new[:-1], size) + np.arange(new[-1])], new


def _tally(model, ids: np.ndarray, toxic: np.ndarray):
    """Numbers of the labelled documents, toxic and not, that hold each feature."""

    def rows(batches):
        counts, memo = np.zeros((2, TABLE), np.int32), {}
        for doc_id, data, offsets in _slices(batches):
            pick, data, offsets = _known(doc_id, ids, data, offsets)
            if not len(pick):
                continue
            at = np.searchsorted(ids, doc_id[pick])
            feats, doc = _with_restored(data, offsets, model, memo)
            pairs = np.unique(doc * TABLE + feats)
            for kind in (0, 1):
                counts[kind] += np.bincount(
                    pairs[toxic[at][pairs // TABLE] == kind] % TABLE, minlength=TABLE).astype(np.int32)
        at = np.flatnonzero(counts.any(0))
        if len(at):
            part = at >> 14
            cuts = np.flatnonzero(np.diff(part)) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[np.concatenate([[0], cuts])].astype(np.int32)),
                 pa.array([x.astype(np.int32).tobytes() for x in np.split(at, cuts)], pa.binary()),
                 pa.array([counts[0][x].astype(np.int64).tobytes() for x in np.split(at, cuts)], pa.binary()),
                 pa.array([counts[1][x].astype(np.int64).tobytes() for x in np.split(at, cuts)], pa.binary())],
                ["part", "grams", "clean", "toxic"])

    return rows


def _add_tally(rows: pd.DataFrame) -> pd.DataFrame:
    grams = np.concatenate([np.frombuffer(x, np.int32) for x in rows["grams"]])
    kinds, place = np.unique(grams, return_inverse=True)
    sums = []
    for c in ("clean", "toxic"):
        total = np.zeros(len(kinds), np.int64)
        np.add.at(total, place, np.concatenate([np.frombuffer(x, np.int64) for x in rows[c]]))
        sums.append(total.tobytes())
    return pd.DataFrame({"part": rows["part"].iloc[:1], "grams": [kinds.astype(np.int32).tobytes()], "clean": [sums[0]], "toxic": [sums[1]]})


def _strengths(model, weights: np.ndarray, keyed: bool = True, ids: np.ndarray | None = None):
    """The two strongest weights of distinct features in each text, or in those of ``ids`` alone."""

    def rows(batches):
        memo: dict[bytes, np.ndarray] = {}
        for doc_id, data, offsets in _slices(batches, keyed):
            if ids is not None:
                pick, data, offsets = _known(doc_id, ids, data, offsets)
                doc_id = doc_id[pick]
            feats, doc = _with_restored(data, offsets, model, memo)
            value = weights[feats]
            hit = value > 0
            feats, doc, value = feats[hit], doc[hit], value[hit]
            first, second = np.zeros(len(doc_id)), np.zeros(len(doc_id))
            if len(doc):
                order = np.lexsort((feats, -value, doc))
                feats, doc, value = feats[order], doc[order], value[order]
                new = np.ones(len(doc), bool)
                new[1:] = (feats[1:] != feats[:-1]) | (doc[1:] != doc[:-1])
                doc, value = doc[new], value[new]
                top = np.ones(len(doc), bool)
                top[1:] = doc[1:] != doc[:-1]
                first[doc[top]] = value[top]
                at = np.flatnonzero(top) + 1
                at = at[at < len(doc)]
                at = at[doc[at] == doc[at - 1]]
                second[doc[at]] = value[at]
            yield pa.RecordBatch.from_arrays([pa.array(doc_id), pa.array(first), pa.array(second)], ["doc_id", "first", "second"])

    return rows


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weighted logistic regression with an intercept, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta * (np.arange(len(beta)) > 0)
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def sample_labels(labels: DataFrame, most: int, label: str = "toxic") -> pd.DataFrame:
    """Up to ``most`` labelled documents of either class, by hash of the id, with the share each stands for.

    Rows with a null id or label, or labels other than 0 and 1, are left out; of
    contradicting labels the greater holds.
    """
    clean = labels.where(f"doc_id is not null and {label} in (0, 1)").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    parts = []
    for y, n in sizes.items():
        # The hash cuts to about the bound before the rest is ordered.
        near = clean.where(f"y = {y}").withColumn("h", F.xxhash64("doc_id", F.lit(11)))
        if n > most:
            near = near.where(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * most / n)))
        part = near.orderBy("h", "doc_id").limit(most).select("doc_id", "y").toPandas()
        parts.append(part.assign(weight=n / max(1, len(part))))
    return pd.concat(parts) if parts else pd.DataFrame({"doc_id": [], "y": [], "weight": []})


class ToxicityModel:
    """Character model, feature weights and curve; all of fixed size."""

    def __init__(self, characters: np.ndarray, weights: np.ndarray, curve: np.ndarray):
        self.characters, self.weights, self.curve = characters, weights, curve


def fit(docs: DataFrame, labels: DataFrame, most: int = 12_000, least: int = 5) -> ToxicityModel:
    """Learn from the labelled documents, at most ``most`` of either class.

    A feature needs ``least`` toxic documents. Without toxic or without other
    labels every score is the smoothed share of toxic labels.
    """
    docs = common.one_row_per_id(docs)
    characters = character_model(docs.select("text"))
    known = sample_labels(labels, most).sort_values("doc_id")
    ids, toxic = known["doc_id"].to_numpy(np.int64), known["y"].to_numpy(np.int64)
    weight = known["weight"].to_numpy(float)
    total = [weight[toxic == k].sum() for k in (0, 1)]
    weights = np.zeros(TABLE, np.float32)
    flat = np.array([math.log((total[1] + 0.5) / (total[0] + 0.5)), 0.0, 0.0])
    if not (toxic == 0).any() or not (toxic == 1).any():
        return ToxicityModel(characters, weights, flat)
    schema = "part int, grams binary, clean binary, toxic binary"
    n = [int((toxic == k).sum()) for k in (0, 1)]
    for row in docs.mapInArrow(_tally(characters, ids, toxic), schema).groupBy("part").applyInPandas(
            _add_tally, schema).toLocalIterator():
        at = np.frombuffer(row.grams, np.int32)
        clean, bad = np.frombuffer(row.clean, np.int64), np.frombuffer(row.toxic, np.int64)
        odds = np.log((bad + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))
        weights[at] = np.where(bad >= least, np.maximum(odds - 1.0, 0), 0)
    spark = docs.sparkSession
    picked = spark.createDataFrame(known[["doc_id", "y", "weight"]])
    got = picked.join(docs.mapInArrow(_strengths(characters, weights, ids=ids), "doc_id long, first double, second double"), "doc_id").toPandas()
    if got["y"].nunique() < 2:
        return ToxicityModel(characters, weights, flat)
    curve = _logistic(got[["first", "second"]].to_numpy(), got["y"].to_numpy(float), got["weight"].to_numpy() / got["weight"].mean())
    return ToxicityModel(characters, weights, curve)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` of every row; a null or empty text has the score of no evidence."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    a, b, c = (float(v) for v in model.curve)
    logit = F.lit(a) + F.lit(b) * F.col("first") + F.lit(c) * F.col("second")
    return plain.mapInArrow(_strengths(model.characters, model.weights), "doc_id long, first double, second double").select(
        "doc_id", (1 / (1 + F.exp(-logit))).alias("score"))


def keep_clean(docs: DataFrame, model: ToxicityModel, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``cut``, in one pass without a shuffle."""
    common.small_batches(docs.sparkSession)
    a, b, c = (float(v) for v in model.curve)
    measure = _strengths(model.characters, model.weights, keyed=False)

    def rows(batches):
        for batch in batches:
            found = [x.to_pydict() for x in measure([batch])]
            first = np.concatenate([x["first"] for x in found]) if found else np.zeros(0)
            second = np.concatenate([x["second"] for x in found]) if found else np.zeros(0)
            value = 1 / (1 + np.exp(-(a + b * first + c * second)))
            yield batch.filter(pa.array(value < cut))

    return docs.mapInArrow(rows, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    ``docs`` has ``doc_id`` and ``text``, ``labels`` has ``doc_id`` and ``toxic``;
    further columns are ignored. Labels whose ``crc32(doc_id) mod 4`` is 2 are
    held out. Rows without an id are left out; of rows that repeat an id the
    greatest text counts. Long texts are read whole. An empty table gives no rows.
    """
    docs = common.one_row_per_id(docs)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs, labels.where(F.col("doc_id").isNotNull() & ~held))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
