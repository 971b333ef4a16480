"""Names, letters, numbers and vectors."""

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import names as N
from ..functions import text as X
from ..functions import vectors as V
from ..operators import frames, pools
from ..operators.cases import scenario_name
from ..sources import readers
from . import views
from .registry import register

_RIGHT = "string_split(parse_filename(path), '_')"


@register("names_parse", f"""
SELECT item_id, array_to_string(t[1:len(t) - 4], '_') AS entity_id, array_to_string(t[1:len(t) - 5], '_') AS group_id,
       t[len(t) - 4] AS cluster_id, t[len(t) - 3] AS source_id, t[len(t) - 2] AS event_id,
       TRY_CAST(t[len(t) - 1] AS INT) AS frame_no, replace(t[len(t)], '.jpg', '') AS clothes_id
FROM (SELECT item_id, {_RIGHT} AS t FROM v_paths)""")
def names_parse(spark, folder):
    return views.paths(spark, folder).select("item_id", *N.parse_path("path"))


@register("path_keys", """
SELECT item_id, concat('/mnt', replace(path, '/data/', '/archive/')) AS moved,
       array_to_string(string_split(path, '/')[-2:], '/') AS caption_key,
       string_split(parse_filename(path), '_')[1] AS category,
       string_split(path, '/')[-2] = 'same' AS in_listed_dir
FROM v_paths""")
def path_keys(spark, folder):
    return views.paths(spark, folder).select(
        "item_id",
        N.add_prefix(N.rewrite_path("path", "/data/", "/archive/"), "/mnt").alias("moved"),
        N.path_suffix_key("path", 2).alias("caption_key"),
        N.path_category("path").alias("category"),
        N.is_person_path("path", ("same",)).alias("in_listed_dir"),
    )


@register("result_names", """
SELECT DISTINCT file, prefix, group_kind, clothes, camera,
       concat_ws('_', 'cropped', clothes, group_kind, camera) AS scenario
FROM (SELECT concat('m', source_id, '_result_', group_kind, '_', corpus, 'clothes_', camera, 'camera.csv') AS file,
             concat('m', source_id) AS prefix, group_kind, concat(corpus, 'clothes') AS clothes,
             concat(camera, 'camera') AS camera FROM v_triples)""")
def result_names(spark, folder):
    triples = pools.valid_triples(views.items(spark, folder))
    file = F.concat(
        F.lit("m"), F.col("source_id").cast("string"), F.lit("_result_"), "group_kind",
        F.lit("_"), "corpus", F.lit("clothes_"), "camera", F.lit("camera.csv"),
    )
    files = triples.select(file.alias("file")).distinct()
    return files.select("file", *N.scenario_parts("file"))


@register("normalized_results", """
WITH found AS (
  SELECT DISTINCT corpus AS folder, concat('m', source_id % 3, '_result_', group_kind, '_', corpus, 'clothes_', camera, 'camera.csv') AS file FROM v_triples
  UNION SELECT DISTINCT corpus, concat('predictions_m0_cropped_', corpus, 'clothes_', group_kind, '_', camera, 'camera.csv') FROM v_triples WHERE source_id % 2 = 0
  UNION SELECT DISTINCT corpus, concat('m', source_id, '_result_', camera, '.csv') FROM v_triples
  UNION SELECT DISTINCT corpus, concat('m', source_id, '_', camera, '.csv') FROM v_triples),
parts AS (SELECT *, regexp_extract(file, '^(.*?)_result_(family|singleton)_(crossclothes|sameclothes)_(crosscamera|samecamera)[.]csv$', ['p', 'g', 'c', 's']) AS x FROM found),
wanted AS (SELECT folder, file, CASE WHEN x.g <> '' THEN concat('predictions_', x.p, '_cropped_', x.c, '_', x.g, '_', x.s, '.csv') END AS target FROM parts)
SELECT w.folder, w.file, w.target,
       CASE WHEN NOT contains(w.file, '_result_') THEN 'no result in its name' WHEN w.target IS NULL THEN 'unexpected suffix'
            WHEN h.file IS NOT NULL OR EXISTS (FROM wanted o WHERE o.folder = w.folder AND o.target = w.target AND o.file < w.file) THEN 'taken' ELSE 'renamed' END AS status,
       CASE WHEN w.target IS NOT NULL THEN coalesce(h.file, (SELECT min(o.file) FROM wanted o WHERE o.folder = w.folder AND o.target = w.target AND o.file < w.file)) END AS rival
FROM wanted w LEFT JOIN found h ON h.folder = w.folder AND h.file = w.target""")
def normalized_results(spark, folder):
    """Result files of every scenario, some already under their new name, some misnamed."""
    t = pools.valid_triples(views.items(spark, folder))
    source = lambda c: F.col(c).cast("string")
    m, one = F.concat(F.lit("m"), source("source_id")), F.concat(F.lit("m"), (F.col("source_id") % 3).cast("string"))
    clothes, camera = F.concat("corpus", F.lit("clothes")), F.concat("camera", F.lit("camera"))
    names = [
        (F.concat(F.concat_ws("_", F.concat(one, F.lit("_result")), "group_kind", clothes, camera), F.lit(".csv")), F.lit(True)),
        (F.concat(F.concat_ws("_", F.lit("predictions_m0_cropped"), clothes, "group_kind", camera), F.lit(".csv")), F.col("source_id") % 2 == 0),
        (F.concat(m, F.lit("_result_"), "camera", F.lit(".csv")), F.lit(True)),
        (F.concat(m, F.lit("_"), "camera", F.lit(".csv")), F.lit(True)),
    ]
    found = None
    for name, which in names:
        part = t.filter(which).select(F.col("corpus").alias("folder"), name.alias("file"))
        found = part if found is None else found.union(part)
    return readers.normalize_results(found.distinct())


_MODES = "[" + ", ".join(f"'{m}'" for m in N.INPUT_MODES) + "]"


@register("run_names", f"""
SELECT c_custkey, run,
       CASE WHEN c_custkey % 2 = 0 THEN concat(prefix, '_epoch', c_nationkey) ELSE prefix END AS prefix,
       'Qwen2.5-VL-3B-Instruct' AS model, lower(c_mktsegment) AS object_type, 'expert' AS feature_mode,
       expert_feature, input_mode, 'False' AS captions,
       CASE WHEN c_custkey % 2 = 0 THEN concat('epoch', c_nationkey) END AS checkpoint_tag
FROM (SELECT *, concat_ws('_', '20260401_120000', prefix, 'Qwen2.5-VL-3B-Instruct', lower(c_mktsegment), 'expert',
                          expert_feature, input_mode, 'lr', '1e-05', 'bs', '4', 'captions', 'False') AS run
      FROM (SELECT *, concat('p_', c_custkey) AS prefix, concat('emb_', c_nationkey) AS expert_feature,
                   ({_MODES})[(c_custkey % 8 + 1)::INT] AS input_mode FROM customer))""")
def run_names(spark, folder):
    key = F.col("c_custkey")
    modes = F.array(*[F.lit(m) for m in N.INPUT_MODES])
    run = N.run_name(
        F.lit("20260401_120000"), F.concat(F.lit("p_"), key.cast("string")),
        F.lit("Qwen/Qwen2.5-VL-3B-Instruct"), F.lower("c_mktsegment"), F.lit("expert"),
        F.concat(F.lit("emb_"), F.col("c_nationkey").cast("string")),
        F.get(modes, (key % 8).cast("int")), F.lit("1e-05"), F.lit("4"), F.lit("False"),
    )
    epoch = F.concat(F.lit("/ckpts/connector_epoch_"), F.col("c_nationkey").cast("string"), F.lit(".pt"))
    file = F.when(key % 2 == 0, epoch).otherwise("/connector.pt")
    checkpoints = views.table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("runs/"), run, file).alias("checkpoint")
    )
    return checkpoints.select("c_custkey", *N.run_name_parts("checkpoint"))


@register("letter_round_trip", """
SELECT event_id, n, s, label, chr((65 + CASE WHEN label = -1 THEN s WHEN label - 1 < s THEN label - 1 ELSE label END)::INT) AS letter,
       label AS back
FROM (SELECT event_id, 1 + user_id % 9 AS n, event_id % (2 + user_id % 9) AS s,
             CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 + (event_id // 7) % (1 + user_id % 9) END AS label FROM events)""")
def letter_round_trip(spark, folder):
    rows = views.table(spark, folder, "events").select(
        "event_id", (1 + F.col("user_id") % 9).alias("n"),
        (F.col("event_id") % (2 + F.col("user_id") % 9)).alias("s"),
        F.when(F.col("event_id") % 7 == 0, F.lit(-1).cast("long"))
        .otherwise(1 + F.expr("event_id div 7") % (1 + F.col("user_id") % 9)).alias("label"),
    )
    letter = A.answer_letter("label", "s")
    return rows.withColumn("letter", letter).withColumn("back", A.letter_to_index("letter", "s"))


_CELL = """CASE event_type WHEN 'click' THEN value::VARCHAR WHEN 'view' THEN concat(' ', user_id, ' ')
    WHEN 'purchase' THEN concat('-', user_id) WHEN 'signup' THEN props ELSE '' END"""


@register("parse_cells", f"""
SELECT event_id, coalesce(CASE WHEN trim(cell) SIMILAR TO '[+-]?[0-9]+' THEN TRY_CAST(trim(cell) AS INT) END,
                          CAST(trunc(TRY_CAST(trim(cell) AS DOUBLE)) AS INT))::VARCHAR AS parsed,
       lower(trim(flag)) = 'true' AS truthy
FROM (SELECT event_id, {_CELL} AS cell, CASE WHEN user_id % 2 = 0 THEN ' TRUE ' ELSE event_type END AS flag FROM events)""")
def parse_cells(spark, folder):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    cell = (
        F.when(kind == "click", F.col("value").cast("string"))
        .when(kind == "view", F.concat(F.lit(" "), user, F.lit(" ")))
        .when(kind == "purchase", F.concat(F.lit("-"), user))
        .when(kind == "signup", F.col("props")).otherwise("")
    )
    flag = F.when(F.col("user_id") % 2 == 0, " TRUE ").otherwise(kind)
    return views.table(spark, folder, "events").select(
        "event_id", A.parse_int(cell).cast("string").alias("parsed"), A.truthy(flag).alias("truthy")
    )


@register("vector_norms", """
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS length,
       round(list_dot_product(v, [x * 3 for x in v]) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product([x * 3 for x in v], [x * 3 for x in v])), 6) AS self_cosine,
       round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first
FROM (SELECT vec_id, [x::DOUBLE * (vec_id % 5 + 1) for x in embedding] AS v FROM embeddings)""")
def vector_norms(spark, folder):
    scaled = views.vectors(spark, folder).withColumn(
        "v", F.transform("vec", lambda x: x.cast("double") * (F.col("vec_id") % 5 + 1))
    )
    tripled = F.transform("v", lambda x: x * 3)
    return scaled.select(
        "vec_id", F.round(V.norm("v"), 6).alias("length"),
        F.round(V.cosine("v", tripled), 6).alias("self_cosine"),
        F.round(F.get(V.l2_normalize("v"), F.lit(0)), 6).alias("first"),
    )


@register("padded_boxes", """
SELECT event_id, x1, y1, x2, y2 FROM (
  SELECT event_id, greatest(0, a - 8) AS x1, greatest(0, b - 8) AS y1, least(640, a + w + 8) AS x2, least(480, b + h + 8) AS y2
  FROM (SELECT event_id, (user_id * 13 % 700) - 20 AS a, (event_id * 7 % 520) - 20 AS b, user_id % 60 AS w, event_id % 90 AS h FROM events))
WHERE x2 > x1 AND y2 > y1""")
def padded_boxes(spark, folder):
    boxes = views.table(spark, folder, "events").select(
        "event_id", (F.col("user_id") * 13 % 700 - 20).alias("a"),
        (F.col("event_id") * 7 % 520 - 20).alias("b"),
        (F.col("user_id") % 60).alias("w"), (F.col("event_id") % 90).alias("h"),
    )
    box = V.pad_clip_box("a", "b", F.col("a") + F.col("w"), F.col("b") + F.col("h"), 8, 640, 480)
    return boxes.select("event_id", box.alias("box")).filter("box IS NOT NULL").select("event_id", "box.*")


_VIDEO = """SELECT c_custkey AS video, CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE c_nationkey * 1.5 END::DOUBLE AS fps,
   greatest(0, round(c_acctbal)::BIGINT // 10)::BIGINT AS n_frames FROM customer"""


@register("frame_schedule", f"""
SELECT video, frame_idx, round(frame_idx / rate, 3) AS timestamp_s FROM (
  SELECT video, rate, unnest(range(0, n_frames, step)) AS frame_idx FROM (
    SELECT *, greatest(round_even(rate / 2.0, 0)::BIGINT, 1) AS step FROM (
      SELECT *, CASE WHEN fps = 0 THEN 25.0 ELSE fps END::DOUBLE AS rate FROM ({_VIDEO}) WHERE n_frames > 0)))""")
def frame_schedule(spark, folder):
    videos = views.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("video"),
        F.when(F.col("c_nationkey") % 5 == 0, 0.0).otherwise(F.col("c_nationkey") * 1.5).alias("fps"),
        F.greatest(F.lit(0), F.expr("cast(round(c_acctbal) as bigint) div 10")).cast("long").alias("n_frames"),
    )
    return frames.frame_schedule(videos, 2.0)


def _frame_requests(spark, folder):
    """Each item asks for a frame of the recording of its entity and source."""
    return views.items(spark, folder).select(
        "item_id", F.concat_ws("_", F.col("entity_id").cast("string"), F.col("source_id").cast("string")).alias("event_id"),
        (F.col("item_id") % 1000).alias("frame_no"), "role",
    )


_REQUESTS = "SELECT item_id, concat_ws('_', entity_id, source_id) AS event_id, item_id % 1000 AS frame_no, role FROM v_items"


@register("grouped_frames", f"""
SELECT event_id, chunk, string_agg(frame_no::VARCHAR, ',' ORDER BY frame_no) AS frames FROM (
  SELECT *, ((row_number() OVER (PARTITION BY event_id ORDER BY frame_no, item_id) - 1) // 20)::INT AS chunk FROM ({_REQUESTS}))
GROUP BY ALL""")
def grouped_frames(spark, folder):
    grouped = frames.group_frames(_frame_requests(spark, folder).drop("role"), chunk=20)
    return grouped.withColumn("frames", F.array_join(F.transform("frames", lambda x: x.cast("string")), ","))


_MAPPING = "SELECT event_id, min(item_id) % 700 + 200 AS n_frames, concat('v', min(item_id), '.mp4') AS video_file FROM (" + _REQUESTS + ") WHERE role = 'query' GROUP BY 1"


def _videos(requests):
    return requests.filter("role = 'query'").groupBy("event_id").agg(
        (F.min("item_id") % 700 + 200).alias("n_frames"),
        F.concat(F.lit("v"), F.min("item_id").cast("string"), F.lit(".mp4")).alias("video_file"),
    )


@register("valid_frames", f"""
SELECT event_id, string_agg(frame_no::VARCHAR, ',' ORDER BY frame_no) AS frames
FROM ({_REQUESTS}) r JOIN ({_MAPPING}) m USING (event_id) WHERE frame_no < n_frames GROUP BY 1""")
def valid_frames(spark, folder):
    requests = _frame_requests(spark, folder)
    grouped = frames.valid_frames(requests.drop("role"), _videos(requests))
    return grouped.select("event_id", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@register("match_events", f"""
SELECT item_id, event_id, coalesce(video_file, 'unmatched') AS video_file
FROM ({_REQUESTS}) r LEFT JOIN ({_MAPPING}) m USING (event_id)""")
def match_events(spark, folder):
    requests = _frame_requests(spark, folder)
    found, missing = frames.match_events(
        requests.select("item_id", "event_id"), _videos(requests).select("event_id", "video_file")
    )
    return found.unionByName(missing.withColumn("video_file", F.lit("unmatched"))).select(
        "item_id", "event_id", "video_file"
    )


@register("question_parts", """
SELECT item_id, t[1] AS before, t[2] AS between, t[3] AS after, item_id % 2 = 0 AS query_first
FROM (SELECT item_id, string_split_regex(q, '<[^>]+>') AS t FROM (
  SELECT item_id, concat('Does ', CASE WHEN item_id % 2 = 0 THEN '<Query>' ELSE '<gallery>' END, ' show ', text,
                         CASE WHEN item_id % 2 = 0 THEN '<gallery>' ELSE '<query>' END, '?') AS q FROM benchmark))""")
def question_parts(spark, folder):
    even = F.col("item_id") % 2 == 0
    question = F.concat(
        F.lit("Does "), F.when(even, "<Query>").otherwise("<gallery>"), F.lit(" show "), "text",
        F.when(even, "<gallery>").otherwise("<query>"), F.lit("?"),
    )
    return views.table(spark, folder, "benchmark").select("item_id", *X.split_placeholders(question))


@register("scenario_names", """SELECT scenario, count(*) AS n_triples FROM v_named GROUP BY 1""")
def scenario_names(spark, folder):
    triples = pools.valid_triples(views.items(spark, folder))
    name = scenario_name(F.col("corpus"), F.col("group_kind"), F.col("camera"))
    return triples.groupBy(name.alias("scenario")).agg(F.count("*").alias("n_triples"))
