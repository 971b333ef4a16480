"""File formats, read back from text that Spark derives from the tables."""

from pyspark.sql import functions as F

from ..sources import readers, schema, writers
from . import views
from .oracle import TABLES
from .registry import register

TABLES["v_full_paths"] = "SELECT p.*, group_id, entity_id, source_id, vec_id FROM v_paths p JOIN v_items USING (item_id)"


def _full_paths(spark, folder):
    items = views.items(spark, folder).select("item_id", "group_id", "entity_id", "source_id", "vec_id")
    return views.paths(spark, folder).join(items, "item_id")


@register("group_index_round_trip", "SELECT group_id::VARCHAR AS group_id, entity_id::VARCHAR AS entity_id, source_id::VARCHAR AS source_id, role, path FROM v_full_paths")
def group_index_round_trip(spark, folder):
    """Items -> nested documents of at most 50 items -> items."""
    documents = writers.group_index_json(_full_paths(spark, folder), chunk=50)
    return readers.parse_group_index(documents, "document")


@register("flat_index", """
SELECT source_id::VARCHAR AS group_id, entity_id::VARCHAR AS entity_id, item_id::VARCHAR AS source_id, r.role, path FROM v_full_paths, (VALUES ('query'), ('gallery')) r(role)""")
def flat_index(spark, folder):
    """One flat document per item; each path serves both roles."""
    text = F.concat(
        F.lit('{"'), F.col("source_id").cast("string"), F.lit('": {"'), F.col("entity_id").cast("string"),
        F.lit('": {"'), F.col("item_id").cast("string"), F.lit('": ["'), "path", F.lit('"]}}}'),
    )
    return readers.parse_group_index(_full_paths(spark, folder).select(text.alias("t")), "t", flat=True)


@register("manifest_rows", """
SELECT path, role, CASE WHEN role = 'query' THEN source_id ELSE 0 END AS pos FROM v_full_paths""")
def manifest_rows(spark, folder):
    """One manifest per item, in the two-key form."""
    query = F.col("role") == "query"
    manifest = F.to_json(F.struct(
        F.when(query, F.array()).otherwise(F.array("path")).alias("gallery"),
        F.when(query, F.create_map("path", F.col("source_id").cast("int"))).alias("queries"),
    ))
    return readers.parse_manifest(_full_paths(spark, folder).select(manifest.alias("t")), "t")


@register("caption_lines", """
SELECT CASE WHEN contains(line, ': ') THEN split_part(line, ': ', 1) END AS caption_key,
       CASE WHEN contains(line, ': ') THEN substr(line, strpos(line, ': ') + 2) END AS caption
FROM (SELECT concat(CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('img_', doc_id, ': ') END, caption) AS line FROM v_captions)""")
def caption_lines(spark, folder):
    prefix = F.when(F.col("doc_id") % 4 == 0, "").otherwise(
        F.concat(F.lit("img_"), F.col("doc_id").cast("string"), F.lit(": "))
    )
    lines = views.captions(spark, folder).select(F.concat(prefix, "caption").alias("line"))
    return lines.select(*readers.parse_caption_line("line"))


@register("event_mapping", """
SELECT trim(event_type) AS event_id, arg_max(concat('f', event_id, '.mp4'), event_id) AS video_file FROM (
  SELECT concat(event_type, '_', user_id) AS event_type, event_id FROM events) GROUP BY 1""")
def event_mapping(spark, folder):
    rows = views.table(spark, folder, "events").select(
        F.concat(F.lit(" "), "event_type", F.lit("_"), F.col("user_id").cast("string"), F.lit(" ")).alias("EVENT_ID"),
        F.concat(F.lit("/videos/x/f"), F.col("event_id").cast("string"), F.lit(".mp4 ")).alias("FILE_PATH"),
        F.col("event_id").alias("order"),
    )
    return readers.latest_mapping(rows, F.col("order"))


@register("prediction_headers", """
SELECT (conv_id * 100 + turn)::INT AS idx, 'B' AS label, role AS prediction, text AS response,
       CASE WHEN role = 'user' THEN NULL ELSE 'q' || conv_id END AS query FROM conversations WHERE role <> 'system'
UNION ALL SELECT (conv_id * 100 + turn)::INT, 'B', role, text, 'q' || conv_id FROM conversations WHERE role = 'system'""")
def prediction_headers(spark, folder):
    """The same rows under the three headers, by role."""
    rows = views.table(spark, folder, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    query = F.concat(F.lit("q"), F.col("conv_id").cast("string"))
    label = F.lit("B").alias("label")
    one = rows.filter("role = 'assistant'").select(
        key.alias("idx"), label, F.col("role").alias("prediction"), F.col("text").alias("response"), query.alias("query"))
    two = rows.filter("role = 'system'").select(
        key.alias("idx"), label, F.col("role").alias("prediction"), F.col("text").alias("model_output"), query.alias("query_img"))
    three = rows.filter("role = 'user'").select(
        key.alias("query_id"), label, F.col("role").alias("answer"), F.col("text").alias("model_output"))
    parts = [readers.canonical_predictions(p) for p in (one, two, three)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("detection_lines", """
SELECT event_id AS crop_id, concat('crops/', event_id, '.jpg') AS crop_path, event_type AS video, user_id AS frame_idx, round(value, 3) AS timestamp_s FROM events""")
def detection_lines(spark, folder):
    line = F.to_json(F.struct(
        F.col("event_id").alias("crop_id"),
        F.concat(F.lit("crops/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("crop_path"),
        F.col("event_type").alias("video"), F.col("user_id").alias("frame_idx"),
        F.round("value", 3).alias("timestamp_s"),
    ))
    lines = views.table(spark, folder, "events").select(line.alias("t"))
    return lines.select(F.from_json("t", schema.DETECTION).alias("d")).select(
        "d.crop_id", "d.crop_path", "d.video", "d.frame_idx", "d.timestamp_s"
    )
