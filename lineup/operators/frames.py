"""Planning which frames to read, and detections made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import pad_clip_box
from .cases import numbered
from .ranking import group_rank, range_buckets, skew_join


def frame_step(fps, target_fps: float) -> Column:
    """Frames between two samples; an unknown rate counts as 25."""
    rate = F.coalesce(F.nullif(F.col(fps).cast("double"), F.lit(0.0)), F.lit(25.0))
    return F.greatest(F.bround(rate / target_fps, 0).cast("long"), F.lit(1).cast("long"))


def frame_schedule(videos: DataFrame, target_fps: float = 1.0) -> DataFrame:
    """Frame numbers to sample: 0, step, 2 step ... below the frame count.

    ``videos`` has ``video, fps, n_frames``. Long videos are spread over tasks
    before their frames are listed.
    """
    rate = F.coalesce(F.nullif(F.col("fps").cast("double"), F.lit(0.0)), F.lit(25.0))
    stepped = videos.filter("n_frames > 0").select(
        "video", rate.alias("rate"), frame_step("fps", target_fps).alias("step"), "n_frames"
    ).withColumn("n", F.ceil(F.col("n_frames") / F.col("step")).cast("long"))
    return numbered(stepped, "n", "turn").select(
        "video", ((F.col("turn") - 1) * F.col("step")).alias("frame_idx"),
        F.round((F.col("turn") - 1) * F.col("step") / F.col("rate"), 3).alias("timestamp_s"),
    )


def group_frames(requests: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Requested frames per event in ascending order, at most ``chunk`` per row."""
    bucket = range_buckets(requests, "frame_no")
    ranked = group_rank(requests, ["event_id"], "frame_no", "item_id", "_rank", bucket)
    return (
        ranked.withColumn("chunk", F.floor(F.col("_rank") / chunk).cast("int"))
        .groupBy("event_id", "chunk")
        .agg(F.sort_array(F.collect_list("frame_no")).alias("frames"))
    )


def valid_frames(requests: DataFrame, videos: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Requests below the video's frame count, grouped per event."""
    inside = skew_join(requests, videos.select("event_id", "n_frames"), ["event_id"]).filter(
        (F.col("frame_no") >= 0) & (F.col("frame_no") < F.col("n_frames"))
    )
    return group_frames(inside.drop("n_frames"), chunk)


def match_events(requests: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with their video file, and the requests without one."""
    return (
        skew_join(requests, mapping, ["event_id"]),
        skew_join(requests, mapping.select("event_id"), ["event_id"], "left_anti"),
    )


def detection_intake(
    detections: DataFrame, min_confidence: float, pad: int, width: int, height: int,
) -> DataFrame:
    """Confident detections with a padded box and an id from their own key.

    Works on batch and streaming frames: the id needs no running counter.
    """
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("video", "frame_idx", "x1", "y1", "x2", "y2")])
    return detections.filter(F.col("det_conf") >= min_confidence).select(
        "*", F.md5(key).alias("crop_id"),
        pad_clip_box("x1", "y1", "x2", "y2", pad, width, height).alias("box"),
    ).filter(F.col("box").isNotNull())
