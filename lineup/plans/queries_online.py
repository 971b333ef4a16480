"""Detections and online assignment."""

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import frames
from ..operators import reports as R
from ..streaming import assign
from . import views
from .oracle import TABLES, okey
from .registry import register

THRESHOLD = 0.25


def detections(spark, folder):
    items = views.items(spark, folder).select("group_id", "item_id", "ts", "vec_id")
    return items.join(views.vectors(spark, folder), "vec_id").drop("vec_id")


def decisions(spark, folder):
    return assign.assign_entities(detections(spark, folder), assign.cosine_matcher(THRESHOLD))


@register("detection_intake", """
SELECT event_id, md5(concat_ws('|', video, frame_idx, x1, y1, x2, y2)) AS crop_id,
       greatest(0, x1 - 4) AS box_x1, greatest(0, y1 - 4) AS box_y1, least(640, x2 + 4) AS box_x2, least(480, y2 + 4) AS box_y2
FROM (SELECT event_id, event_type AS video, event_id AS frame_idx, user_id * 5 % 660 AS x1, user_id * 3 % 500 AS y1,
             user_id * 5 % 660 + 40 AS x2, user_id * 3 % 500 + 90 AS y2, value / 100 AS det_conf FROM events)
WHERE det_conf >= 0.05 AND least(640, x2 + 4) > greatest(0, x1 - 4) AND least(480, y2 + 4) > greatest(0, y1 - 4)""")
def detection_intake(spark, folder):
    user = F.col("user_id")
    found = views.table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("video"), F.col("event_id").alias("frame_idx"),
        (user * 5 % 660).alias("x1"), (user * 3 % 500).alias("y1"),
        (user * 5 % 660 + 40).alias("x2"), (user * 3 % 500 + 90).alias("y2"),
        (F.col("value") / 100).alias("det_conf"),
    )
    kept = frames.detection_intake(found, 0.05, 4, 640, 480)
    return kept.select("event_id", "crop_id", *[
        F.col(f"box.{c}").alias(f"box_{c}") for c in ("x1", "y1", "x2", "y2")
    ])


# The fold row by row: each step meets the list of representatives so far.
TABLES["v_fold"] = f"""
WITH RECURSIVE ordered AS (
  SELECT group_id, item_id, ts, vec, row_number() OVER (PARTITION BY group_id ORDER BY ts, item_id) AS n
  FROM v_items JOIN (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings) USING (vec_id)),
fold AS (
  SELECT group_id, n, item_id, ts, 0 AS size_before, 'new (gallery_empty)' AS verdict, 1::BIGINT AS number, [vec] AS reps FROM ordered WHERE n = 1
  UNION ALL
  SELECT group_id, n, item_id, ts, len(reps)::INT, CASE WHEN best >= {THRESHOLD} THEN 'matched' ELSE 'new (stranger)' END,
         CASE WHEN best >= {THRESHOLD} THEN list_position(sims, best) ELSE len(reps) + 1 END,
         CASE WHEN best >= {THRESHOLD} THEN reps ELSE list_append(reps, vec) END
  FROM (SELECT *, list_max(sims) AS best FROM (
    SELECT o.*, f.reps, [round(list_dot_product(r, o.vec), 6) for r in f.reps] AS sims
    FROM fold f JOIN ordered o ON o.group_id = f.group_id AND o.n = f.n + 1)))
SELECT group_id, item_id, ts, size_before AS gallery_size_before, verdict, printf('person_%03d', number) AS assigned_to FROM fold"""


@register("assign_entities", "SELECT group_id, item_id, gallery_size_before, verdict, assigned_to FROM v_fold")
def assign_entities(spark, folder):
    return decisions(spark, folder).select(
        "group_id", "item_id", "gallery_size_before", "verdict", "assigned_to"
    )


_COUNTS = "count(*) AS n_items, count(*) FILTER (verdict LIKE 'new%') AS n_new, count(*) FILTER (verdict = 'matched') AS n_matched"


@register("decision_summary", f"SELECT {_COUNTS} FROM v_fold")
def decision_summary(spark, folder):
    return R.decision_summary(decisions(spark, folder))


@register("decision_summary_by_group", f"SELECT group_id, {_COUNTS} FROM v_fold GROUP BY 1")
def decision_summary_by_group(spark, folder):
    return assign.live_summary(decisions(spark, folder))


@register("items_per_entity", f"""
SELECT group_id, assigned_to, chunk, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items, count(*)::INT AS n_items FROM (
  SELECT *, ((row_number() OVER (PARTITION BY group_id, assigned_to ORDER BY {okey('assigned', 'item_id')}, item_id) - 1) // 3)::INT AS chunk FROM v_fold)
GROUP BY ALL""")
def items_per_entity(spark, folder):
    lists = R.items_per_entity(decisions(spark, folder), chunk=3)
    return lists.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@register("representatives", """
SELECT group_id, assigned_to, arg_min(item_id, (ts, item_id)) AS representative, count(*) AS n_items FROM v_fold GROUP BY ALL""")
def representatives(spark, folder):
    return R.representative(decisions(spark, folder))


@register("gallery_state", """
SELECT group_id, assigned_to, min(item_id) FILTER (verdict LIKE 'new%') AS representative, count(*) AS n_items FROM v_fold GROUP BY ALL""")
def gallery_state(spark, folder):
    return assign.gallery_state(decisions(spark, folder))


@register("verdict_classes", """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'matched' WHEN event_type = 'view' THEN 'unparsable' WHEN event_type = 'purchase' THEN 'unparsable' ELSE 'new' END AS class
FROM events""")
def verdict_classes(spark, folder):
    verdict = (
        F.when(F.col("event_type") == "click", "matched")
        .when(F.col("event_type") == "purchase", "new (unparsable)")
        .when(F.col("event_type") != "view", "new (stranger)")
    )
    return views.table(spark, folder, "events").select("event_id", A.verdict_class(verdict).alias("class"))
