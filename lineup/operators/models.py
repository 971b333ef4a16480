"""Batch steps that call a user's model. The library ships no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import parse_verdict_lines
from ..functions.hashing import order_key
from .ranking import group_rank

#: Errors of a remote model that say nothing about the items it was asked about.
TRANSIENT = (ConnectionError, TimeoutError)


class Encoder(Protocol):
    """Paths of one batch -> a matrix with one row per path."""

    def __call__(self, paths: list[str]) -> np.ndarray: ...


class Verdict(Protocol):
    """Paths of one batch -> reply text with a YES or NO line per path."""

    def __call__(self, paths: list[str]) -> str: ...


class Matcher(Protocol):
    """Vector and the representatives' matrix -> 0-based match, or None."""

    def __call__(self, vec: np.ndarray, representatives: np.ndarray) -> int | None: ...


def _batches(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), size):
            yield frame.iloc[start : start + size]


def embed_items(paths: DataFrame, encoder: Encoder, batch: int = 128) -> DataFrame:
    """``path, vec`` with unit vectors, encoding each distinct path once."""

    def run(frames):
        for part in _batches(frames, batch):
            matrix = np.asarray(encoder(part["path"].tolist()), dtype=np.float64)
            length = np.linalg.norm(matrix, axis=1, keepdims=True)
            unit = matrix / np.where(length > 0, length, 1.0)
            yield pd.DataFrame({"path": part["path"], "vec": list(unit.astype(np.float32))})

    return paths.select("path").distinct().mapInPandas(run, "path string, vec array<float>")


def cache_misses(paths: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Paths without a stored vector of this model."""
    stored = cache.filter(F.col("model") == model).select("path")
    return paths.select("path").distinct().join(stored, "path", "left_anti")


def embed_incremental(
    paths: DataFrame, encoder: Encoder, model: str, folder: str, batch: int = 128,
) -> DataFrame:
    """Encode what the store lacks, append it, and return the whole store."""
    from ..sources.writers import read_or_empty

    spark = paths.sparkSession
    schema = "path string, vec array<float>, model string"
    cache = read_or_empty(spark, folder, schema)
    new = embed_items(cache_misses(paths, cache, model), encoder, batch)
    new.select("path", "vec", F.lit(model).alias("model")).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def filter_by_verdict(
    items: DataFrame, verdict: Verdict, batch: int = 8, attempts: int = 3,
    wait: Callable[[int], None] | None = None, errors: tuple[type[BaseException], ...] = TRANSIENT,
    report: bool = False,
) -> DataFrame:
    """Add ``keep``. Query items are kept; a gallery item is kept unless the
    model says NO, so an unreadable or failed batch keeps its items.

    ``items`` has ``item_id, path, role``. Batches are fixed by item order in a
    cell, not by partitioning. Only ``errors`` are tried again and count as a failed
    batch; any other is a mistake in the function and ends the job. ``report`` adds
    ``failure``, the error's type where all attempts failed, and ``attempts``.
    """
    cell = [c for c in ("corpus", "group_id", "entity_id", "source_id") if c in items.columns]
    gallery = group_rank(
        items.filter(F.col("role") == "gallery").select("item_id", "path", *cell),
        cell, order_key("verdict", "item_id"), "item_id", "_rank",
    ).withColumn("_batch", F.floor(F.col("_rank") / batch))
    packed = gallery.groupBy(*cell, "_batch").agg(
        F.array_sort(F.collect_list(F.struct("item_id", "path"))).alias("rows")
    )

    def ask(paths: list[str]) -> tuple[str, str | None, int]:
        failure = None
        for attempt in range(attempts):
            try:
                return verdict(paths), None, attempt + 1
            except errors as error:
                failure = type(error).__name__
                if wait is not None and attempt + 1 < attempts:
                    wait(attempt)
        return "", failure, attempts

    def run(frames):
        for frame in frames:
            replies = [ask([r["path"] for r in rows]) for rows in frame["rows"]]
            yield frame.assign(
                reply=[r for r, _, _ in replies], failure=pd.Series([f for _, f, _ in replies], frame.index, object),
                attempts=[n for _, _, n in replies])

    id_type = items.schema["item_id"].dataType.simpleString()
    kinds = "".join(f", {c} {packed.schema[c].dataType.simpleString()}" for c in cell)
    replied = packed.select("rows", *cell).mapInPandas(
        run, f"rows array<struct<item_id:{id_type},path:string>>{kinds}, reply string, failure string, attempts int"
    )
    flags = replied.select(
        *cell, "failure", "attempts", F.inline(F.arrays_zip(
            F.col("rows.item_id").alias("item_id"),
            parse_verdict_lines("reply", F.size("rows")).alias("keep"),
        ))
    )
    # An item may stand in several cells; each has its own verdict.
    named = flags.withColumn("role", F.lit("gallery")).distinct()
    same = [items[c].eqNullSafe(named[c]) for c in (*cell, "item_id", "role")]
    condition = same[0]
    for one in same[1:]:
        condition &= one
    more = [named["failure"], named["attempts"]] if report else []
    return items.join(named, condition, "left").select(
        *[items[c] for c in items.columns], F.coalesce(named["keep"], F.lit(True)).alias("keep"), *more
    )


def clean_items(
    items: DataFrame, verdict: Verdict, folder: str, key: str = "group_id", retry: bool = False,
    buckets: int = 64, **options,
) -> DataFrame:
    """``filter_by_verdict`` in steps that are stored as they finish; see ``ledger``.

    A restart asks about the unfinished buckets of keys only. ``retry`` asks again
    about the items of failed batches, alone. Result: ``items`` with ``keep, failure,
    attempts`` of the last time each item was asked about.
    """
    from ..sources.ledger import run_steps

    def step(part: DataFrame) -> DataFrame:
        return filter_by_verdict(part, verdict, report=True, **options).withColumn("asked", F.current_timestamp())

    def last(asked: DataFrame) -> DataFrame:
        newest = asked.groupBy(*items.columns).agg(F.max(F.struct("asked", "keep", "failure", "attempts")).alias("n"))
        return newest.select(*items.columns, "n.keep", "n.failure", "n.attempts")

    done = last(run_steps(items, key, step, folder, buckets))
    if not retry:
        return done
    failed = failed_items(done).select(items.columns)
    return last(run_steps(failed, key, step, folder, buckets, again=failed))


def failed_items(cleaned: DataFrame) -> DataFrame:
    """The items of failed batches, with the type of error and the attempts made."""
    return cleaned.filter(F.col("failure").isNotNull())
