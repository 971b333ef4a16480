"""Detections taken in and totals kept up to date while a stream runs.

Late policy: event time carries a watermark, ``delay`` behind the newest row seen. A row
in time counts once, however often it arrives. A row behind the watermark is dropped, and
``late_rows`` tells how many were. Totals are kept for windows of event time and written
when the watermark has passed a window, so a written total never changes. The file sink
records each micro-batch by its number: a batch that runs again after a failure
writes nothing twice, and readers skip files of batches that did not end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.frames import detection_intake
from ..sources.writers import read_or_empty

DELAY = "10 minutes"
WINDOW = "1 minute"


def intake_stream(
    detections: DataFrame, min_confidence: float, pad: int, width: int, height: int,
    time: str = "ts", delay: str = DELAY,
) -> DataFrame:
    """``detection_intake`` of a stream, each crop once.

    The id of a crop follows from its video, frame and box, so a detection that is
    delivered again has the same. Ids are kept until the watermark has passed them.
    """
    taken = detection_intake(detections.withWatermark(time, delay), min_confidence, pad, width, height)
    return taken.dropDuplicatesWithinWatermark(["crop_id"])


def window_totals(
    decisions: DataFrame, key: str = "group_id", time: str = "ts", delay: str = DELAY, window: str = WINDOW,
) -> DataFrame:
    """Items, new and matched ones of each key by window of event time, of a stream in append mode."""
    verdict = F.col("verdict")
    totals = decisions.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), key).agg(
        F.count("*").alias("n_items"),
        F.count_if(verdict.startswith("new")).alias("n_new"),
        F.count_if(verdict == "matched").alias("n_matched"),
    )
    return totals.select(key, F.col("window.start").alias("since"), "n_items", "n_new", "n_matched")


def write_live_summary(
    decisions: DataFrame, folder: str, checkpoint: str, key: str = "group_id", time: str = "ts",
    delay: str = DELAY, window: str = WINDOW, once: bool = False,
) -> StreamingQuery:
    """Start keeping the totals of ``decisions`` in ``folder``; ``once`` ends with the rows at hand."""
    writer = window_totals(decisions, key, time, delay, window).writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(folder)


def read_live_summary(spark: SparkSession, folder: str, key: str = "group_id long") -> DataFrame:
    """Totals of each key over all windows written so far; empty before the first one."""
    name = key.split(" ")[0]
    rows = read_or_empty(spark, folder, f"{key}, since timestamp, n_items long, n_new long, n_matched long")
    return rows.groupBy(name).agg(*[F.sum(c).alias(c) for c in ("n_items", "n_new", "n_matched")], F.max("since").alias("since"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's recent micro-batches dropped as too late."""
    return sum(state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"])
