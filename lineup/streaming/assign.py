"""Online identity assignment: an ordered fold over detections per key.

Each detection meets the representatives (first item) of the identities opened
so far and either joins one or opens the next. The fold of one key is sequential
by definition; keys run in parallel, and a key's rows stream through its task in
Arrow batches.

Detections have ``group_id, item_id, ts, vec``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.models import Matcher

_VERDICT = "gallery_size_before int, answer int, verdict string, assigned_to string, late boolean"
STATE = "reps array<double>, size int, last_ts timestamp"


def decision_schema(detections: DataFrame) -> str:
    """Keys and time as the detections have them, then the decision."""
    kinds = {c: detections.schema[c].dataType.simpleString() for c in ("group_id", "item_id", "ts")}
    return ", ".join([*(f"{c} {kind}" for c, kind in kinds.items()), _VERDICT])


def cosine_matcher(threshold: float = 0.5) -> Matcher:
    """Most similar representative, or the stranger below the threshold."""

    def match(vec: np.ndarray, reps: np.ndarray) -> int:
        sims = np.round(reps @ vec, 6)
        best = int(np.argmax(sims))
        return best if sims[best] >= threshold else len(reps)

    return match


class Gallery:
    """Representatives of one key. The matrix doubles when it is full."""

    def __init__(self, reps: np.ndarray | None = None):
        self.size = 0 if reps is None else len(reps)
        self._rows = reps

    @property
    def reps(self) -> np.ndarray:
        return self._rows[: self.size]

    def open(self, vec: np.ndarray) -> str:
        if self._rows is None:
            self._rows = np.empty((4, len(vec)))
        elif self.size == len(self._rows):
            self._rows = np.concatenate([self._rows, np.empty_like(self._rows)])
        self._rows[self.size] = vec
        self.size += 1
        return f"person_{self.size:03d}"

    def decide(self, vec: np.ndarray, matcher: Matcher) -> tuple[int, int | None, str, str]:
        """(size before, answer, verdict, assigned identity)."""
        before = self.size
        if before == 0:
            return before, None, "new (gallery_empty)", self.open(vec)
        answer = matcher(vec, self.reps)
        if answer is None:
            return before, None, "new (unparsable)", self.open(vec)
        if answer == before:
            return before, answer, "new (stranger)", self.open(vec)
        if not 0 <= answer < before:
            return before, answer, "new (out_of_range)", self.open(vec)
        return before, answer, "matched", f"person_{answer + 1:03d}"


def assign_entities(detections: DataFrame, matcher: Matcher | None = None) -> DataFrame:
    """Fold a table of detections, each key in ``(ts, item_id)`` order."""
    match = matcher or cosine_matcher()
    ordered = (
        detections.select("group_id", "item_id", "ts", "vec")
        .repartition("group_id").sortWithinPartitions("group_id", "ts", "item_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gallery = object(), Gallery()
        for batch in batches:
            vecs = [np.asarray(v.values, dtype=np.float64) for v in batch.column("vec")]
            groups = batch.column("group_id").to_pylist()
            out = []
            for group, vec in zip(groups, vecs):
                if group != key:
                    key, gallery = group, Gallery()
                out.append(gallery.decide(vec, match))
            before, answer, verdict, assigned = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("group_id"), batch.column("item_id"), batch.column("ts"),
                 pa.array(before, pa.int32()), pa.array(answer, pa.int32()),
                 pa.array(verdict, pa.string()), pa.array(assigned, pa.string()),
                 pa.array([False] * len(out), pa.bool_())],
                names=["group_id", "item_id", "ts", "gallery_size_before", "answer",
                       "verdict", "assigned_to", "late"],
            )

    return ordered.mapInArrow(run, decision_schema(detections))


def assign_stream(detections: DataFrame, matcher: Matcher | None = None) -> DataFrame:
    """The same fold over a stream.

    Rows of a micro-batch are folded in time order. A row older than its key's
    last folded row is still assigned, against the gallery as it now is, and
    marked ``late``.
    """
    match = matcher or cosine_matcher()

    def run(key, frames, state) -> Iterator[pd.DataFrame]:
        last = None
        gallery = Gallery()
        if state.exists:
            reps, size, last = state.get
            gallery = Gallery(np.asarray(reps, dtype=np.float64).reshape(size, -1))
        # The rows of one key in one micro-batch, bounded by the trigger.
        rows = pd.concat(list(frames)).sort_values(["ts", "item_id"], kind="stable")
        out = []
        for item, ts, vec in zip(rows["item_id"], rows["ts"], rows["vec"]):
            late = last is not None and ts < last
            out.append((key[0], item, ts, *gallery.decide(np.asarray(vec, np.float64), match), late))
            last = ts if last is None else max(last, ts)
        state.update((gallery.reps.ravel().tolist(), gallery.size, last))
        frame = pd.DataFrame(out, columns=[
            "group_id", "item_id", "ts", "gallery_size_before", "answer", "verdict",
            "assigned_to", "late"])
        frame["answer"] = frame["answer"].astype("Int32")
        yield frame

    return detections.select("group_id", "item_id", "ts", "vec").groupBy(
        "group_id"
    ).applyInPandasWithState(run, decision_schema(detections), STATE, "append", "NoTimeout")


def gallery_state(decisions: DataFrame) -> DataFrame:
    """Identities found so far: representative and size."""
    return decisions.groupBy("group_id", "assigned_to").agg(
        F.min_by("item_id", F.struct("gallery_size_before", "ts", "item_id")).alias("representative"),
        F.count("*").alias("n_items"),
    )


def live_summary(decisions: DataFrame) -> DataFrame:
    """Running totals per key; use with output mode ``update`` or ``complete``."""
    from ..operators.reports import summary_by_key

    return summary_by_key(decisions)
