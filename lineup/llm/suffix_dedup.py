"""Exact substring deduplication by prefix-free parsing.

A rolling hash over a few bytes triggers phrase ends, so equal passages are cut
alike wherever they stand. A phrase reaches ``length - 1`` bytes into the next
ones, as a prefix-free parse overlaps its phrases: every string of ``length``
bytes starts in exactly one phrase and lies inside it.

1. The dictionary holds each distinct phrase once, with its smallest document.
   Every other document drops all strings that start in such a phrase.
2. Left are the suffixes of dictionary phrases, each in one document. Those
   whose first ``length`` bytes hold a minimizer that no other phrases hold are
   unlike any other. The rest are dealt into buckets by their first bytes, and each bucket
   sorts its share of the dictionary's suffixes: equal neighbours are one string.
3. The parse, phrase by phrase, puts both answers back at their places in the
   corpus order of documents and bytes.

Only equality of the first ``length`` bytes matters, so suffixes are sorted by
80-bit keys of those bytes and not by the bytes; phrases by 96-bit keys. Tasks
exchange one entry per key and chunk of documents, so a passage that a third of
all documents hold weighs no more than others. The texts are shuffled once, as
compressed chunks; three steps of one plan read that exchange, and parse anew
rather than store what they found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TRIGGER = 12  # bytes that a trigger looks at
SPACING = 128  # bytes between triggers, on average
CHUNK = 1 << 20  # bytes of text in a row that tasks exchange, or one longer text

_CHUNK = "chunk long, ids binary, offsets binary, data binary, rest array<string>"
_ZSTD = "zstd"
_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, rest string"


def _cut(batches):
    """Whole documents, gathered to rows of about ``CHUNK`` bytes named by their smallest id."""

    def row(parts):
        ids = np.concatenate([x[0] for x in parts])
        size = np.concatenate([x[1] for x in parts])
        data = np.concatenate([x[2] for x in parts])
        rest = pa.concat_arrays([x[3] for x in parts])
        start = np.cumsum(size) - size
        order = np.argsort(ids)  # so that an earlier place means a smaller id
        new = np.concatenate([[0], np.cumsum(size[order])])
        at = np.repeat(start[order] - new[:-1], size[order]) + np.arange(new[-1])
        kept = rest.take(pa.array(order))
        return pa.RecordBatch.from_arrays(
            [pa.array([int(ids[order[0]])]), *(pa.array([x], pa.binary()) for x in (
                ids[order].tobytes(), new.tobytes(), _shrink(data[at]))), pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)],
            ["chunk", "ids", "offsets", "data", "rest"])

    parts, held = [], 0
    for batch, a, b, data, offsets in common.text_slices(batches, size=CHUNK // 4):
        if parts and held + len(data) > CHUNK:
            yield row(parts)
            parts, held = [], 0
        rest = batch.column(batch.schema.get_field_index("rest")).slice(a, b - a).cast(pa.string())
        parts.append((common.column(batch, "doc_id", a, b), np.diff(offsets), data.copy(), rest))
        held += len(data)
    if parts:
        yield row(parts)


def _shrink(data: np.ndarray) -> bytes:
    return pa.compress(data.tobytes(), _ZSTD, asbytes=True) if data.nbytes else b""


def _grow(data, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, _ZSTD, asbytes=True) if size else b"", np.uint8)


class _Parse:
    """Phrases, minimizers and strings of the documents of one chunk."""

    def __init__(self, ids, offsets, data, length: int):
        self.ids, self.offsets, self.length = ids, offsets, length
        n = len(data)
        self.data = data
        self.prefix = [common.prefix_hash(data, 0), common.prefix_hash(data, 1, 1)]
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
        # Strings start at these places.
        self.valid = np.ones(n, bool)
        for a, b in zip(offsets[:-1], offsets[1:]):
            self.valid[max(a, b - length + 1) : b] = False
        cut = np.zeros(n + 1, bool)
        hashed = common.rolling_hash(data, TRIGGER)
        cut[: len(hashed)] = hashed % np.uint64(SPACING) == 0
        del hashed
        cut[offsets] = True
        begin = np.flatnonzero(cut[:n] & self.valid)
        self.begin = begin
        # The reach of a phrase: its own bytes and the next ones up to a whole last string.
        starts = np.flatnonzero(cut)
        core_end = starts[np.searchsorted(starts, begin, side="right")]
        self.core_end = core_end
        reach = np.minimum(core_end + length - 1, offsets[1:][self.doc[begin]])
        size = (reach - begin).astype(np.uint64)
        self.phrase = [common.mix(common.span_hash(p, begin, reach, k) + size) for k, p in enumerate(self.prefix)]
        self.phrase_doc = self.doc[begin]

    def minimizers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct minimizers of the strings, the phrases that each belongs to, and
        for every place which minimizer its string has.

        The phrases are named by five bytes of a hash over those in which strings
        with the minimizer start, for a run of such strings; 0 stands for several names.
        """
        gram = min(24, self.length)
        width = self.length - gram + 1
        hashed = common.rolling_hash(self.data, gram)
        if len(hashed) < width:  # fewer bytes than one string
            nothing = np.zeros(0, np.uint64)
            return nothing, nothing, np.full(len(self.data), -1, np.int32)
        low, reach = hashed, 1
        while 2 * reach <= width:
            low, reach = np.minimum(low[: len(low) - reach], low[reach:]), 2 * reach
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        places = np.flatnonzero(self.valid)
        value = low[places]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (places[1:] != places[:-1] + 1)
        kinds, index = np.unique(value[new], return_inverse=True)
        which = np.full(len(self.data), -1, np.int32)
        which[places] = index[np.cumsum(new) - 1]
        runs = np.flatnonzero(new)
        ends = np.append(runs[1:], len(value)) - 1 if len(runs) else runs
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.phrase[0])])
        a = np.searchsorted(self.begin, places[runs], side="right") - 1
        b = np.searchsorted(self.begin, places[ends], side="right")
        name = (common.mix(total[b] - total[a]) >> np.uint64(24)) | np.uint64(1)
        one = np.zeros(len(kinds), np.uint64)
        one[index] = name
        several = np.zeros(len(kinds), bool)
        several[index[one[index] != name]] = True
        return kinds, np.where(several, np.uint64(0), one), which

    def starts_in(self, chosen: np.ndarray) -> np.ndarray:
        """Which strings start in the chosen phrases."""
        edge = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(edge, self.begin[chosen], 1)
        np.add.at(edge, self.core_end[chosen], -1)
        return (np.cumsum(edge[:-1]) > 0) & self.valid


def _by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = ((keys >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=n_buckets))])


def _phrase_kinds(parse: _Parse):
    """First occurrence of each distinct phrase of the chunk, in order, and which one each phrase is."""
    _, first, index = np.unique(parse.phrase[0] ^ common.mix(parse.phrase[1]), return_index=True, return_inverse=True)
    return _in_order(first, index)


def _in_order(first: np.ndarray, index: np.ndarray):
    """Number kinds by their first occurrence, so that the documents beside them ascend."""
    order = np.argsort(first)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return first[order], back[index]


def _ask(n_buckets: int, length: int):
    """A chunk's phrases with their smallest document, and its minimizers, by bucket."""

    def rows(chunks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, parse in _parses(chunks, length):
            first, _ = _phrase_kinds(parse)
            h1, h2, doc = parse.phrase[0][first], _short(parse.phrase[1][first], 4), parse.ids[parse.phrase_doc[first]]
            o, e = _by_bucket(h1, n_buckets)
            kinds, names, _ = parse.minimizers()
            mo, me = _by_bucket(kinds, n_buckets)
            h1, h2, doc, prints, names = h1[o], h2[o], doc[o], kinds[mo].astype(np.uint32), _short(names[mo], 5)
            full = np.flatnonzero((np.diff(e) > 0) | (np.diff(me) > 0))
            part = lambda x, ends: [x[ends[j] : ends[j + 1]].tobytes() for j in full]
            out.append(pd.DataFrame({
                "bucket": full, "chunk": chunk, "h1": part(h1, e), "h2": part(h2, e), "doc": [_rising(doc[e[j] : e[j + 1]]) for j in full],
                "prints": part(prints, me), "names": part(names, me)}))
        return pd.concat(out)

    return rows


def _short(keys: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of each key."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :size].copy()


def _wide(keys, size: int) -> np.ndarray:
    out = np.zeros((len(keys) // size, 8), np.uint8)
    out[:, :size] = keys.reshape(-1, size)
    return out.view(np.uint64)[:, 0]


def _parses(chunks: pd.DataFrame, length: int):
    # Reused workers give back what earlier groups and stages held.
    pa.default_memory_pool().release_unused()
    for r in chunks.itertuples():
        offsets = np.frombuffer(r.offsets, np.int64)
        yield int(r.chunk), _Parse(np.frombuffer(r.ids, np.int64), offsets, _grow(r.data, int(offsets[-1])), length)


def _joined(rows: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(rows), kind)


def _rising(ids: np.ndarray) -> bytes:
    """Ascending ids as steps, whose zeros the exchange's compression takes out."""
    return np.diff(ids, prepend=np.int64(0)).tobytes()


def _risen(rows: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(np.frombuffer(x, np.int64)) for x in rows)])


def _smallest(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each entry the smallest document among entries with both keys equal."""
    order = np.lexsort((doc, h2, h1))
    a, b = h1[order], h2[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(doc), np.int64)
    out[order] = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


_ANSWER = "chunk long, bucket int, least binary, shared binary, n long, seen binary"


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """The smallest document of each phrase, and whether a minimizer belongs to several phrases."""
    least = _smallest(_joined(rows["h1"], np.uint64), _joined(rows["h2"], np.uint32), _risen(rows["doc"]))
    kinds, index = np.unique(_joined(rows["prints"], np.uint32), return_inverse=True)
    name = _wide(_joined(rows["names"], np.uint8), 5)
    one = np.zeros(len(kinds), np.uint64)
    one[index] = name
    several = np.zeros(len(kinds), bool)
    several[index[(one[index] != name) | (name == 0)]] = True
    shared = several[index]
    at = np.cumsum([len(x) // 8 for x in rows["h1"]])[:-1]
    mt = np.cumsum([len(x) // 4 for x in rows["prints"]])[:-1]
    return pd.DataFrame({
        "chunk": rows["chunk"], "bucket": rows["bucket"],
        "least": [x.tobytes() for x in np.split(least, at)],
        "shared": [np.packbits(x).tobytes() for x in np.split(shared, mt)], "n": [len(x) // 4 for x in rows["prints"]],
        "seen": None})


def _bits(packed, sizes) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint8), *(
        np.unpackbits(np.frombuffer(x, np.uint8), count=int(n)) for x, n in zip(packed, sizes))]).astype(bool)


def _digest(ids, offsets, data, starts, length: int, keep_bytes: bool | str) -> pd.DataFrame:
    """What stays of each document once the strings at ``starts`` are gone; ``"characters"``
    leaves those out that a cut splits."""
    edge = np.zeros(len(data) + 1, np.int32)
    at = np.flatnonzero(starts)
    edge[at] += 1
    np.subtract.at(edge, at + length, 1)
    gone = np.cumsum(edge[:-1]) > 0
    run = gone.copy()
    run[1:] &= ~gone[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    run[inner] = gone[inner]
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
    sound = [x.decode("utf-8", "ignore").encode() for x in kept] if keep_bytes == "characters" else kept
    return pd.DataFrame({
        "doc_id": ids, "n_bytes": np.diff(offsets), "n_removed": total(gone), "n_spans": total(run),
        "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept": sound if keep_bytes else None})


class _Open:
    """What the first answers leave open in a chunk."""

    def __init__(self, parse: _Parse, answers: pd.DataFrame, n_buckets: int):
        answers = answers.sort_values("bucket")
        first, index = _phrase_kinds(parse)
        o, _ = _by_bucket(parse.phrase[0][first], n_buckets)
        least = np.empty(len(first), np.int64)
        least[o] = _joined(answers["least"], np.int64)
        kinds, _, which = parse.minimizers()
        mo, _ = _by_bucket(kinds, n_buckets)
        shared = np.empty(len(kinds), bool)
        shared[mo] = _bits(answers["shared"], answers["n"])
        own = parse.ids[parse.phrase_doc]
        # Strings known to start in a smaller document.
        self.gone = parse.starts_in(least[index] < own)
        places = np.flatnonzero(parse.starts_in(least[index] == own) & ~self.gone)
        places = places[shared[which[places]]]
        h1, h2 = (common.span_hash(p, places, places + parse.length, k) for k, p in enumerate(parse.prefix))
        # Places ascend with the documents, so the first of a key has the smallest.
        _, one, slot = np.unique(h1, return_index=True, return_inverse=True)
        one, slot = _in_order(one, slot)
        order, self.ends = _by_bucket(h1[one], n_buckets)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        one = one[order]
        holder = parse.doc[places]
        self.h1, self.h2, self.doc = h1[one], h2[one], parse.ids[holder[one]]
        # Those of a later document of the chunk are known, the first one's are asked about.
        later = holder != holder[_first_of(slot)]
        self.gone[places[later]] = True
        self.places, self.slots = places[~later], back[slot[~later]]


def _ask_strings(n_buckets: int, length: int):
    """The open strings of a chunk with their smallest document, by bucket."""

    def rows(key, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for chunk, parse in _parses(chunks, length):
            left = _Open(parse, answers, n_buckets)
            full, h2 = np.flatnonzero(np.diff(left.ends)), _short(left.h2, 2)
            part = lambda x: [x[left.ends[j] : left.ends[j + 1]].tobytes() for j in full]
            doc = [_rising(left.doc[left.ends[j] : left.ends[j + 1]]) for j in full]
            out.append(pd.DataFrame({"chunk": chunk, "bucket": full, "h1": part(left.h1), "h2": part(h2), "doc": doc}))
        return pd.concat(out)

    return rows


def _first_of(slot: np.ndarray) -> np.ndarray:
    """Where each entry's kind stands first."""
    first = np.full(slot.max(initial=-1) + 1, len(slot), np.int64)
    first[slot[::-1]] = np.arange(len(slot))[::-1]
    return first[slot]


def _sorted_suffixes(rows: pd.DataFrame) -> pd.DataFrame:
    """Whether each string of a bucket also starts in a smaller document than the asking one."""
    doc = _risen(rows["doc"])
    seen = _smallest(_joined(rows["h1"], np.uint64), _joined(rows["h2"], np.uint16), doc) < doc
    sizes = [len(x) // 8 for x in rows["h1"]]
    return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "least": None, "shared": None, "n": sizes,
                         "seen": [np.packbits(x).tobytes() for x in np.split(seen, np.cumsum(sizes)[:-1])]})


def _finish(n_buckets: int, length: int, keep_bytes: bool | str):
    def rows(key, chunks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        late = answers["seen"].notna()
        strings = answers[late].sort_values("bucket")
        seen = _bits(strings["seen"], strings["n"])
        out = []
        for (_, parse), rest in zip(_parses(chunks, length), chunks["rest"]):
            left = _Open(parse, answers[~late], n_buckets)
            left.gone[left.places] |= seen[left.slots]
            digest = _digest(parse.ids, parse.offsets, parse.data, left.gone, length, keep_bytes)
            out.append(digest.assign(rest=list(rest)))
        return pd.concat(out)

    return rows


def suffix_dedup(docs: DataFrame, length: int = 50, keep_bytes: bool = False) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts in a smaller document.

    ``docs`` has ``doc_id`` and ``text``; further columns are ignored. Returns
    ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` per document:
    sizes in UTF-8 bytes, the number of maximal removed runs, the digest of the
    bytes that stay, and with ``keep_bytes`` those bytes (null without). A cut
    may fall inside a character.

    A null text is empty; texts shorter than ``length`` keep all. Rows without an
    id are left out; of rows that repeat an id the greatest text counts. Long
    texts are taken whole. An empty table gives no rows.
    """
    if length < 16:
        raise ValueError("length must be at least 16")
    return _deduplicated(common.one_row_per_id(docs).withColumn("rest", F.lit(None).cast("string")), length, keep_bytes).drop("rest")


def _deduplicated(docs: DataFrame, length: int, keep_bytes: bool | str) -> DataFrame:
    """``suffix_dedup`` of rows with different ids, with their text ``rest`` beside the result."""
    n_buckets = common.buckets_for(common.text_bytes(docs) / 12)
    chunks = docs.mapInArrow(_cut, _CHUNK)
    asked = chunks.groupBy("chunk").applyInPandas(_ask(n_buckets, length), (
        "bucket int, chunk long, h1 binary, h2 binary, doc binary, prints binary, names binary"))
    answers = asked.groupBy("bucket").applyInPandas(_answer, _ANSWER)
    strings = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(
        _ask_strings(n_buckets, length), "chunk long, bucket int, h1 binary, h2 binary, doc binary").groupBy(
        "bucket").applyInPandas(_sorted_suffixes, _ANSWER)
    return chunks.groupBy("chunk").cogroup(answers.union(strings).groupBy("chunk")).applyInPandas(
        _finish(n_buckets, length, keep_bytes), _RESULT)


def without_repeats(docs: DataFrame, length: int = 50, flag: str | None = None) -> DataFrame:
    """``docs`` with only what ``suffix_dedup`` keeps of each text; a text that is cut down to white space goes.

    All columns return as they are, whatever their names; they travel with the texts, so
    nothing is joined. Of rows that repeat an id, the one with the greatest text stays.
    Rows without an id stay whole. Characters that a cut splits go as well. ``flag`` names a
    further column that tells whether the text was cut.
    """
    names = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(F.col("text").isNull().alias("none"), *[F.col(c).alias(n) for c, n in names.items()]).alias("rest"))
    common.small_batches(docs.sparkSession)
    known = whole.where("doc_id is not null")
    # JSON carries every type; the formats keep all digits of a time.
    formats = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    known = known.withColumn("rest", F.to_json("rest", formats))
    if common.repeats(docs):
        known = common.store(known.groupBy("doc_id").agg(F.max(F.struct("text", "rest")).alias("r")).select("doc_id", "r.*"), "single")
    done = _deduplicated(known, length, "characters").withColumn("rest", F.from_json("rest", whole.schema["rest"].dataType, formats))
    text = F.when(F.col("rest.none"), F.lit(None)).otherwise(F.col("kept").cast("string"))
    blank = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\r\x0b\x0c", "     ")) == ""
    some = done.where((F.col("n_removed") == 0) | ~blank)
    kinds = {c: docs.schema[c].dataType for c in ("doc_id", "text")}

    def back(df: DataFrame, text: Column, was_cut: Column) -> DataFrame:
        own = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"rest.{n}") for c, n in names.items()}
        columns = [own[c].cast(kinds[c]).alias(c) if c in kinds else own[c].alias(c) for c in docs.columns]
        return df.select(*columns, *([was_cut.alias(flag)] if flag else []))

    whole_rows = whole.where("doc_id is null")
    return back(some, text, F.col("n_removed") > 0).union(back(whole_rows, F.col("text"), F.lit(False)))
