"""Packing tokenised documents into windows by best-fit decreasing.

Each text is tokenised where it is read; only the lengths of its pieces travel.
A document longer than a window is first cut into full windows. The rest is
dealt into blocks of a few thousand pieces, and each block packs its pieces,
longest first, into the tightest open window, which a segment tree indexed by
remaining capacity finds. Blocks make the work parallel and bounded; each leaves
a few windows unfilled, whatever the size of the table.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import store

BLOCK = 4096  # pieces that are packed together
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_ranks() -> str:
    """The vocabulary of ``byte_bpe_50k.json`` as ranks, which gives the same ids five times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_specials() -> dict[str, int]:
    """The added tokens of ``byte_bpe_50k.json``, which stand for whole strings of a text."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    import base64

    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


def _tokenise(path: str, pattern: str, specials: dict[str, int], window: int, end_id: int):
    """The pieces of each text: full windows and a rest."""

    def rows(batches):
        tool = encoding(path, pattern, tuple(sorted(specials.items())))
        encode = lambda text: tool.encode(text, allowed_special="all")
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            texts = batch.column(batch.schema.get_field_index("text"))
            for doc, text in zip(ids, texts):
                tokens = encode(text.as_py() or "")
                tokens.append(end_id)
                data = np.array(tokens, "<u4").tobytes()
                total = len(tokens)
                for start in range(0, total, window):
                    part = data[4 * start : 4 * (start + window)]
                    for k, v in zip(out, (doc.as_py(), start, len(part) // 4, zlib.crc32(part), total)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out))

    return rows


class Capacities:
    """Open windows by remaining capacity, in a segment tree that counts them."""

    def __init__(self, window: int):
        self.size = 1 << max(1, window).bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window with the least capacity that holds ``length``, removed."""
        at = length + self.size
        if not self.count[at]:
            # Up to the first right sibling with windows, then down to its left end.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        capacity = at - self.size
        self._add(capacity, -1)
        return capacity, self.open[capacity].pop()


def best_fit(lengths, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length, given longest first."""
    places, offsets, free, n = [], [], Capacities(window), 0
    for length in lengths:
        found = free.take(length)
        capacity, number = found if found else (window, n)
        n += found is None
        places.append(number)
        offsets.append(window - capacity)
        if capacity > length:
            free.put(capacity - length, number)
    return np.array(places, np.int64), np.array(offsets, np.int64)


def _pack(window: int, blocks: int):
    def rows(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True])
        number, offset = best_fit(pieces["length"].tolist(), window)
        return pieces.assign(sequence_id=number * blocks + pieces["block"], offset=offset).drop(columns=["block", "row"])

    return rows


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, ranks: str | None = None,
         specials: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.

    ``docs`` has ``doc_id`` and ``text``; further columns are ignored. A text's
    ids are those of its bytes, with one id for each string of ``specials`` (the
    vocabulary's added tokens), and then ``end_id``; a null text has ``end_id`` only. The end of a sequence's last
    piece is its length, the rest up to ``window`` is padding. Every row is
    packed by itself, so repeated rows, ids and null ids keep their own pieces.
    An empty table gives no rows.
    """
    import public_tokenizers

    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = store(docs.mapInArrow(
        _tokenise(ranks or default_ranks(), public_tokenizers.PATTERN, default_specials() if specials is None else specials,
                  window, end_id), _PIECES), "pieces")
    blocks = max(1, math.ceil(pieces.count() / BLOCK))
    dealt = pieces.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(
        _pack(window, blocks), _PIECES + ", sequence_id long, offset long")


def padding(packed: DataFrame, window: int = 2048) -> DataFrame:
    """Tokens, sequences, and slots that pad them; a sequence of a power of two needs none."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    whole = F.expr("bit_count(filled) = 1")
    return filled.agg(
        F.sum("filled").alias("n_tokens"), F.count("*").alias("n_sequences"),
        F.sum(F.when(whole, 0).otherwise(window - F.col("filled"))).alias("n_padding"))
