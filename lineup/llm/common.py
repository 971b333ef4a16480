"""Shared folder tables, text buffers and vectorised hashing."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = 1 << 20  # bytes of text that one vectorised step takes, or one longer text


_LOCAL_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. A local session without that setting
    gets one temporary folder; on a cluster its absence is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        if context.applicationId not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        folder = _LOCAL_FOLDERS[context.applicationId]
    return folder.rstrip("/")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to workers at most ``rows`` at a time.

    The session keeps the setting, as its plans run later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def one_row_per_id(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``text`` only, without null keys; of rows that repeat a key
    the greatest text stays. Without repeats the texts are not shuffled."""
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    docs = docs.where(F.col(key).isNotNull())
    small_batches(docs.sparkSession)
    if not repeats(docs, key):
        return docs
    return store(docs.groupBy(key).agg(F.max(text).alias(text)), "single")


def repeats(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether any key other than null stands in several rows."""
    return bool(docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").limit(1).count())


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def buckets_for(entries: float, most: int = 3_000_000, least: int = 256) -> int:
    """Number of hash buckets, none above ``most`` entries on average."""
    return max(least, math.ceil(entries / most))


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    where = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[where[0] : where[-1]], where - where[0]


def slices(data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together, at least one text each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def text_slices(batches, text: str = "text", size: int = SLICE):
    """(batch, first row, end row, bytes, offsets) in bounded steps."""
    for batch in batches:
        data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
        for a, b in slices(data, offsets, size):
            yield batch, a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def column(batch: pa.RecordBatch, name: str, a: int, b: int, kind=np.int64) -> np.ndarray:
    return np.asarray(batch.column(batch.schema.get_field_index(name)).slice(a, b - a).to_numpy(zero_copy_only=False), kind)


# -- hashing -------------------------------------------------------------------

# Strings are polynomials over the prime field of P at two random points at once. In a
# field, two strings of n bytes agree at n of the P points at most; modulo a power of
# two, some strings agree at all of them.

P = np.uint64((1 << 31) - 1)
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _RNG.integers(1, int(P), size=(2, 2, 256), dtype=np.uint64)
BASES = _RNG.integers(1 << 20, int(P), size=(2, 2), dtype=np.uint64)
ROLLING_CODES = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}


def _halve(x: np.ndarray) -> np.ndarray:
    """``x`` below 2**62 as an equal value modulo P below 2**32; works in place."""
    high = x >> np.uint64(31)
    x &= P
    x += high
    return x


def _fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo P, for ``x`` below 2**62; works in place."""
    x = _halve(_halve(x))
    return np.subtract(x, P, out=x, where=x >= P)


def _series(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint32)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, int(P)))
        more = min(have, n - have)
        out[have : have + more] = _fold(out[:more].astype(np.uint64) * step)
        have += more
    return out


def _powers(which: int, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both points and of their inverses modulo P."""
    have = _POWERS.get(which)
    if have is None or len(have[0][0]) < n:
        size = max(n, SLICE + 1024)
        have = _POWERS[which] = [
            (_series(int(b), size), _series(pow(int(b), -1, int(P)), size)) for b in BASES[which]]
    return have


def prefix_hash(data: np.ndarray, which: int = 0, lanes: int = 2) -> np.ndarray:
    """Running polynomial hashes, one entry more than there are bytes; for ``span_hash``.

    One lane gives 31 bits, two give 62.
    """
    n = len(data)
    out = np.zeros((lanes, n + 1), np.uint32)
    for lane, (up, _) in enumerate(_powers(which, n + 1)[:lanes]):
        terms = BYTE_CODES[which][lane][data]
        terms *= up[:n]
        # The sum of fewer than 2**30 terms below 2**32.
        out[lane, 1:] = _halve(np.cumsum(_halve(terms), out=terms))
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the bytes from ``start`` to ``end``, wherever they stand."""
    whole = None
    for row, (_, down) in zip(prefix, _powers(which, prefix.shape[1])):
        gap = row[end].astype(np.uint64)
        gap += np.uint64(3) * P  # more than any entry
        gap -= row[start]
        part = _halve(gap)
        part = _fold(np.multiply(_fold(part), down[start], out=part))
        whole = part if whole is None else (whole << np.uint64(31)) | part
    return mix(whole)


def rolling_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` bytes, by its start, modulo 2**64.

    Equal windows have equal hashes; different ones may share them, some always do.
    """
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # Windows of powers of two, put together for the size's binary digits.
    part, width, out, have, base = ROLLING_CODES[data], 1, None, 0, 0x9E3779B97F4A7C15
    while size:
        scale = np.uint64(pow(base, width, 1 << 64))
        if size & 1:
            out = part if out is None else out[: len(part) - have] * scale + part[have:]
            have += width
        size >>= 1
        if size:
            part = part[:-width] * scale + part[width:]
            width *= 2
    return mix(out[:n])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


# -- words ---------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of bytes other than white space."""
    if not len(data):
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def gram_hash(words: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; those past its text count as absent."""
    n = len(words)
    out = np.zeros(n, np.uint64)
    factor = 1
    for j in range(size):
        term = np.zeros(n, np.uint64)
        if n > j:
            same = doc[j:] == doc[: n - j]
            term[: n - j] = np.where(same, words[j:] * np.uint64(factor), np.uint64(0))
        out += term
        factor = factor * 0x2545F4914F6CDD1D % (1 << 64)
    return mix(out)
