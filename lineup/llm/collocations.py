"""Phrases whose words occur together, counted by vertical partitioning.

A phrase is a path in the suffix tree of the pieces' words, cut off at four
words. The tree is never built whole:

1. Words are counted. A rare word is part of no phrase, so suffixes end before it.
2. Prefixes of two words are counted. They are the unit of partitioning: prefixes
   that follow each other in hash order form a group until their counts reach the
   budget. A prefix that exceeds the budget on its own is extended to whole
   suffixes, dealt over all groups.
3. A last scan sends every suffix to the group of its prefix. A task sorts the
   suffixes of its group, which gives the group's subtree; a node's count is the
   total of the leaves below it. Counts of nodes of extended prefixes are added up
   over groups.

Which words and prefixes are frequent reaches the scans as bit tables of fixed
size; a wrong bit lets a suffix through that is then counted and dropped.
"""

from __future__ import annotations

from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, small_batches, store, text_slices

STEP = 4 << 20  # bytes of text that are split into words at once
WORD_BITS, PAIR_BITS = 24, 26  # logarithms of the bit tables' sizes
BLOCK_BITS = 16  # a bit table is collected in blocks of this many bits
HELD = 1 << 21  # suffixes that a scan combines before it passes them on
FINE = 16  # prefixes are grouped by this many leading bits of their hash
BREAK = b"A"  # no word holds a capital
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(0x0A if b in _BREAKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_H = ["h1", "h2", "h3", "h4"]


def words_of(texts: list[bytes]) -> list[bytes]:
    """Words of all texts in order, with ``BREAK`` between pieces and texts."""
    return b"\n".join(texts).translate(_TABLE).replace(b"\n", b" A ").split()


def _steps(batches):
    """(lang, words) for the texts of each language in bounded steps."""
    for batch, a, b, data, offsets in text_slices(batches, size=STEP):
        langs = batch.column(batch.schema.get_field_index("lang")).slice(a, b - a).to_pylist()
        of: dict[str, list[bytes]] = {}
        for i, lang in enumerate(langs):
            of.setdefault(lang, []).append(data[offsets[i] : offsets[i + 1]].tobytes())
        for lang, texts in of.items():
            yield lang, words_of(texts)


class Hashes(dict):
    """64-bit hashes of one language's words; the break is 0."""

    def __init__(self, lang: str, seed: int):
        super().__init__({BREAK: 0})
        self.of = blake2b(lang.encode() + b" ", digest_size=8, salt=str(seed).encode())

    def __missing__(self, word: bytes) -> int:
        h = self.of.copy()
        h.update(word)
        value = self[word] = int.from_bytes(h.digest(), "little") or 1
        return value

    def list(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 1_000_000:
            self.clear()
            self[BREAK] = 0
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _count_words(seed: int):
    def rows(batches):
        schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
        held: dict[str, Counter] = {}

        def flush():
            for lang, counts in held.items():
                counts.pop(BREAK, None)
                hashes = Hashes(lang, seed)
                words = list(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(words), pa.string()), pa.array([w.decode() for w in words], pa.string()),
                    pa.array(hashes.list(words).view(np.int64)), pa.array(list(counts.values()), pa.int64())], schema=schema)
            held.clear()

        for lang, words in _steps(batches):
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > 500_000:
                yield from flush()
        yield from flush()

    return rows


def bit_table(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """One bit for each value of the leading ``bits`` bits of the keys: 2**bits bits, whatever the input."""
    slot = F.shiftrightunsigned(F.col(key), 64 - bits)
    low = (1 << BLOCK_BITS) - 1

    def pack(group: pa.Table) -> pa.Table:
        table = np.zeros(1 << BLOCK_BITS, bool)
        table[group.column("slot").to_numpy() & low] = True
        return pa.table({"block": group.column("block").slice(0, 1), "packed": pa.array([np.packbits(table).tobytes()], pa.binary())})

    blocks = keys.select(slot.alias("slot")).distinct().withColumn("block", F.shiftrightunsigned("slot", BLOCK_BITS))
    out = np.zeros((1 << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), np.uint8)
    for block, packed in blocks.groupBy("block").applyInArrow(pack, "block long, packed binary").collect():
        out[block] = np.frombuffer(packed, np.uint8)
    return out.reshape(-1)


def _has(table: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    slot = keys >> np.uint64(64 - bits)
    return (table[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1


def _pair_keys(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix(mix(h) * np.uint64(0x9E3779B97F4A7C15) + g)


def _frequent(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The hashes with 0, the break, in place of rare words."""
    return np.where(_has(table, hashes, WORD_BITS), hashes, np.uint64(0))


def _hashed_steps(batches, seed: int):
    memo: dict[str, Hashes] = {}
    for lang, words in _steps(batches):
        if lang not in memo:
            if len(memo) >= 64:
                memo.clear()
            memo[lang] = Hashes(lang, seed)
        yield memo[lang].list(words)


def _count_pairs(seed: int, words):
    def rows(batches):
        held, size = [], 0

        def flush():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=["k", "n"])

        for hashes in _hashed_steps(batches, seed):
            h = _frequent(hashes, words.value)
            at = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0))
            held.append(_pair_keys(h[at], h[at + 1]))
            size += len(at)
            if size > HELD:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return rows


def combine(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows as one, in sorted order, with their ``n`` added up."""
    order = np.lexsort(columns[::-1])
    columns, n = [c[order] for c in columns], n[order]
    new = np.zeros(len(n), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n, at) if len(at) else n


def _suffixes(seed: int, words, pairs, groups):
    """Suffixes of two to four words with the group of their prefix."""

    def rows(batches):
        held, size = [], 0

        def flush():
            columns, n = combine([np.concatenate(c) for c in zip(*held)], np.ones(size, np.int64))
            held.clear()
            key, h = columns[0], columns[1:]
            part = part_of(key, h, groups.value)
            order = np.argsort(part, kind="stable")
            for a in range(0, len(order), 100_000):
                o = order[a : a + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[o]), *[pa.array(x[o].view(np.int64)) for x in h], pa.array(n[o])], names=["part", *_H, "n"])

        for hashes in _hashed_steps(batches, seed):
            h = np.concatenate([_frequent(hashes, words.value), np.zeros(3, np.uint64)])
            key = _pair_keys(h[:-1], h[1:])
            good = (h[:-1] != 0) & (h[1:] != 0) & _has(pairs.value, key, PAIR_BITS)
            at = np.flatnonzero(good)
            third = good[at + 1]
            fourth = third & good[np.minimum(at + 2, len(good) - 1)]
            nothing = np.uint64(0)
            held.append((key[at], h[at], h[at + 1], np.where(third, h[np.minimum(at + 2, len(h) - 1)], nothing),
                         np.where(fourth, h[np.minimum(at + 3, len(h) - 1)], nothing)))
            size += len(at)
            if size > HELD:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    return rows


def part_of(key: np.ndarray, h: list[np.ndarray], groups: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Group of each suffix: that of its prefix, or any by the whole suffix where the prefix is extended."""
    bounds, hot = groups
    part = np.searchsorted(bounds, key >> np.uint64(64 - FINE), side="right").astype(np.int32)
    extended = np.isin(key, hot)
    if extended.any():
        whole = key[extended]
        for x in h[2:]:
            whole = _pair_keys(whole, x[extended])
        part[extended] = (whole % np.uint64(len(bounds) + 1)).astype(np.int32)
    return part


def vertical_groups(pairs: DataFrame, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Where groups of prefixes begin, and the prefixes that exceed ``budget``.

    The driver gets 2**FINE sums and one key for each ``budget`` occurrences.
    """
    hot = np.array([r[0] for r in pairs.where(F.col("n") > budget).select("k").collect()], np.int64).view(np.uint64)
    fine = pairs.groupBy(F.shiftrightunsigned("k", 64 - FINE).alias("b")).agg(
        F.sum(F.when(F.col("n") <= budget, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("every")).collect()
    total, bounds, filled = sum(r["every"] for r in fine), [], 0
    for r in sorted(fine, key=lambda r: r["b"]):
        if filled and filled + r["n"] > budget:
            bounds.append(r["b"])
            filled = 0
        filled += r["n"]
    # Extended prefixes need as many groups as their suffixes fill.
    while len(bounds) + 1 < min(total // budget, 1 << FINE):
        bounds.append(1 << FINE)
    return np.array(bounds, np.uint64), np.sort(hot)


def subtree(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Nodes of two words and more of the tree of these suffixes, with their leaves' totals."""
    columns, n = combine(columns, n)
    nodes, counts = [], []
    new = np.zeros(len(n), bool)
    new[:1] = True
    for depth, c in enumerate(columns, 1):
        new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        if depth == 1 or not len(at):
            continue
        total = np.add.reduceat(n, at)
        real = columns[depth - 1][at] != 0
        at, total = at[real], total[real]
        nodes.append([x[at] if i < depth else np.zeros(len(at), np.uint64) for i, x in enumerate(columns)])
        counts.append(total)
    if not nodes:
        return [np.zeros(0, np.uint64) for _ in columns], np.zeros(0, np.int64)
    return [np.concatenate(x) for x in zip(*nodes)], np.concatenate(counts)


def _group_nodes(least: int, groups):
    def rows(group: pa.Table) -> pa.Table:
        nodes, n = subtree([group.column(c).to_numpy().view(np.uint64) for c in _H], group.column("n").to_numpy())
        keep = (n >= least) | np.isin(_pair_keys(nodes[0], nodes[1]), groups.value[1])
        return pa.table([*[pa.array(x[keep].view(np.int64)) for x in nodes], pa.array(n[keep])], names=[*_H, "n"])

    return rows


def phrase_counts(docs: DataFrame, least: int = 30, budget: int = 1 << 19) -> tuple[DataFrame, DataFrame]:
    """``lang, word, n`` of every word, and ``lang, words, n`` of every phrase of two to
    four words that occurs ``least`` times. ``docs`` has ``lang`` and ``text``."""
    spark = docs.sparkSession
    for seed in range(10):
        counted = docs.mapInArrow(_count_words(seed), "lang string, word string, h long, n long")
        words = store(counted.groupBy("lang", "word", "h").agg(F.sum("n").alias("n")), "words")
        shared = words.groupBy("h").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        if not shared.where((F.col("c") > 1) & (F.col("n") >= least)).limit(1).count():
            break
    else:
        raise RuntimeError("words share hashes under every seed")
    share = spark.sparkContext.broadcast
    frequent = words.where(F.col("n") >= least)
    word_bits = share(bit_table(frequent, "h", WORD_BITS))
    pairs = docs.mapInArrow(_count_pairs(seed, word_bits), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    pairs = store(pairs.where(F.col("n") >= least), "prefixes")
    pair_bits, groups = share(bit_table(pairs, "k", PAIR_BITS)), share(vertical_groups(pairs, budget))
    kinds = ", ".join(f"{c} long" for c in _H) + ", n long"
    suffixes = docs.mapInArrow(_suffixes(seed, word_bits, pair_bits, groups), f"part int, {kinds}")
    nodes = suffixes.groupBy("part").applyInArrow(_group_nodes(least, groups), kinds)
    phrases = nodes.groupBy(*_H).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    listed = phrases.withColumn("node", F.struct(*_H)).select(
        "node", "n", F.posexplode(F.array(*_H)).alias("pos", "h")).where("h <> 0")
    named = listed.join(frequent.select("h", "lang", "word"), "h").groupBy("node").agg(
        F.first("n").alias("n"), F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("at"))
    named = named.select("lang", F.transform("at", lambda x: x["word"]).alias("words"), "n")
    return words.select("lang", "word", "n"), store(named, "phrases")


def _part(words: Column | str, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(
    docs: DataFrame, least: int = 30, inside: int = 80, top: int = 2000, budget: int = 1 << 19,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``top`` phrases.

    ``docs`` has ``lang`` (null: ``und``) and ``text`` (null: empty); every row counts,
    repeated ones as often as they stand there, and further columns are ignored.
    Words are runs other than blanks and tabs inside pieces between punctuation marks
    and line breaks, with A-Z lower-cased. A phrase of two to four words with at
    least ``least`` occurrences ``a`` scores ``2000000 * a div (l + r)`` at the cut
    that scores lowest, the first of equal ones; ``l`` and ``r`` are the occurrences
    of its parts. A phrase inside a longer one that has ``inside`` per cent of its
    occurrences is left out. ``n`` counts the language's words. Equal scores are
    ordered by ``a`` descending, then by the phrase's bytes. An empty table, or one
    without frequent phrases, gives no rows. A group of prefixes holds at most
    ``budget`` occurrences, or the 2**-16 of all prefixes that share their hash's start.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words, phrases = phrase_counts(docs, least, budget)
    long = phrases.select("lang", F.array_join("words", " ").alias("phrase"), "words", F.col("n").alias("a"), F.size("words").alias("len"))
    counts = words.where(F.col("n") >= least).select("lang", F.col("word").alias("part"), F.col("n").alias("f")).union(
        long.select("lang", "phrase", "a"))
    # The parts of every cut, looked up by their text.
    cuts = long.select("lang", "phrase", "words", "a", "len", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.posexplode(F.array(
        _part("words", F.lit(1), F.col("k")), _part("words", F.col("k") + 1, F.col("len") - F.col("k")))).alias("side", "part"))
    sums = sides.join(counts, ["lang", "part"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    scored = sums.withColumn("score", F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # What lies inside a longer phrase: every run of two words and more of it.
    spans = F.expr("""flatten(transform(sequence(2, len - 1), s -> transform(sequence(1, len - s + 1), i -> array_join(slice(words, i, s), ' '))))""")
    inner = long.where("len > 2").select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = F.col("longer").isNotNull() & F.expr(f"cast(longer as decimal(20, 0)) * 100 >= cast(a as decimal(20, 0)) * {int(inside)}")
    left = lowest.join(inner, ["lang", "phrase"], "left").where(~held)
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"),
        "n", F.col("cut.score").cast("long").alias("score"))
