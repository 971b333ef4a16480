"""Readers. Every reader has a fixed schema; parsing helpers take columns, so
they serve files, streams and tables alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import _col
from ..functions.names import base_name, scenario_parts
from . import schema


#: A document that cannot be read fails the job instead of vanishing.
STRICT = {"mode": "FAILFAST"}


def parse_manifest(rows: DataFrame, text: str) -> DataFrame:
    """Manifest JSON -> one row per listed item with its role and position."""
    m = rows.select(F.from_json(F.col(text), schema.MANIFEST, STRICT).alias("m"))
    gallery = m.select(F.posexplode("m.gallery").alias("pos", "path")).select(
        "path", F.lit("gallery").alias("role"), "pos"
    )
    query = m.select(F.explode("m.queries").alias("path", "pos")).select(
        "path", F.lit("query").alias("role"), "pos"
    )
    return gallery.unionByName(query)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files; ``wholetext`` because one JSON document fills a file."""
    return parse_manifest(spark.read.text(path, wholetext=True), "value")


def read_item_listing(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Paths of a folder: the ``.jpg`` files, and everything else."""
    listed = spark.read.format("binaryFile").load(folder).select("path")
    image = F.col("path").endswith(".jpg")
    return listed.filter(image), listed.filter(~image)


def parse_group_index(rows: DataFrame, text: str, flat: bool = False) -> DataFrame:
    """Nested index JSON -> one row per (group, entity, source, role, path).

    The flat form lists paths without roles; each then serves both roles.
    """
    leaf = schema.INDEX_FLAT if flat else schema.INDEX_SPLIT
    index = rows.select(
        F.explode(F.from_json(F.col(text), leaf, STRICT)).alias("group_id", "entities")
    )
    entities = index.select("group_id", F.explode("entities").alias("entity_id", "sources"))
    sources = entities.select(
        "group_id", "entity_id", F.explode("sources").alias("source_id", "held")
    )
    roles = ("query", "gallery")
    lists = F.array(*[
        F.struct(F.lit(r).alias("role"),
                 (F.col("held") if flat else F.col("held")[r]).alias("paths"))
        for r in roles
    ])
    by_role = sources.select("group_id", "entity_id", "source_id", F.inline(lists))
    return by_role.select("group_id", "entity_id", "source_id", "role", F.explode("paths").alias("path"))


def read_group_index(
    spark: SparkSession, path: str, flat: bool = False, shape: str = "document",
) -> DataFrame:
    """Index files: one JSON document per file, indented or not, or with
    ``shape="lines"`` one per line, which reads large indexes in parallel."""
    if shape not in ("document", "lines"):
        raise ValueError(f"unknown index shape {shape!r}: expected document or lines")
    rows = spark.read.text(path, wholetext=shape == "document")
    return parse_group_index(rows.filter(F.trim("value") != ""), "value", flat)


def read_cases(spark: SparkSession, path: str, shape: str = "lines") -> DataFrame:
    """Cases from JSON lines, a JSON list, or an envelope with ``eval_cases``.

    Missing columns are null.
    """
    if shape == "lines":
        return spark.read.schema(schema.CASE).json(path)
    if shape == "list":
        return spark.read.schema(schema.CASE).json(path, multiLine=True)
    if shape == "envelope":
        whole = spark.read.schema(schema.ENVELOPE).json(path, multiLine=True)
        return whole.select("scenario", F.inline("eval_cases"))
    raise ValueError(f"unknown case shape {shape!r}: expected lines, list or envelope")


def read_tuples(
    spark: SparkSession, paths: str | list[str], source: str | None = None,
    rewrite: tuple[str, str] | None = None,
) -> DataFrame:
    """(query, gallery, answer) tuples of other object types.

    The query is a path or an object with ``img_path``; both become ``path``.
    """
    lines = spark.read.text(paths)
    raw = F.from_json("value", "query string, gallery array<string>, answer int", STRICT)
    plain = lines.select(raw.alias("t")).select("t.*")

    def item(column: Column) -> Column:
        as_object = F.from_json(column, schema.TUPLE_ITEM)
        is_object = column.startswith("{")
        path = F.when(is_object, as_object["img_path"]).otherwise(column)
        if rewrite:
            path = F.replace(path, F.lit(rewrite[0]), F.lit(rewrite[1]))
        return F.struct(
            path.alias("path"),
            F.when(is_object, as_object["source"]).alias("source"),
            F.when(is_object, as_object["person_id"]).alias("entity_id"),
        )

    rows = plain.select(
        item(F.col("query")).alias("query"),
        F.transform("gallery", item).alias("gallery"), "answer",
    )
    return rows.filter(F.col("query.source") == source) if source else rows


# The column of each header variant that holds the value.
_PREDICTION_COLUMNS = {
    "idx": ("idx", "query_id"),
    "label": ("label",),
    "prediction": ("prediction", "answer"),
    "response": ("response", "model_output"),
    "query": ("query", "query_img"),
}


def canonical_predictions(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """Any of the three headers -> ``idx, label, prediction, response, query``."""
    columns = []
    for name, options in _PREDICTION_COLUMNS.items():
        kind = "int" if name == "idx" else "string"
        held = next((o for o in options if o in rows.columns), None)
        value = F.col(held).try_cast(kind) if held else F.lit(None).cast(kind)
        columns.append(value.alias(name))
    return rows.select(*columns, *keep)


def csv_headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, header``: the first line of every file that has one."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("_at"),
        F.col("_metadata.file_block_start").alias("_block"),
    )
    # The first line of a file is the first of its first block.
    return lines.filter("_block = 0").groupBy("file").agg(
        F.regexp_replace(F.min_by("value", "_at"), "^\ufeff|\r$", "").alias("header"))


def read_csv_by_header(spark: SparkSession, path: str | list[str]) -> list[tuple[list[str], DataFrame]]:
    """Files of each header as one table, in text columns with ``file``, the files' whole path.

    Each variant is one scan of the CSV reader, so quoted commas and line breaks are
    read. Names of files reach the driver, as those of any scan do.
    """
    by_header: dict[str, list[str]] = {}
    for r in csv_headers(spark, path).orderBy("file").collect():
        by_header.setdefault(r["header"], []).append(r["file"])
    tables = []
    for header, files in sorted(by_header.items()):
        rows = spark.read.csv(
            files, header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST", enforceSchema=False)
        names = list(rows.columns)
        # The file's name goes first, under a name no header has.
        tables.append((names, rows.select(F.col("_metadata.file_path").alias("_file"), *[F.col(f"`{c}`") for c in names])))
    return tables


def read_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Prediction files of any of the three headers, side by side in one folder.

    ``idx, label, prediction, response, query``, the ``file``'s name, the scenario in
    it, and ``header``, the header's columns. A file without an index or a
    prediction column is an error that names it. A folder without files gives no rows.
    """
    parts = []
    for names, rows in read_csv_by_header(spark, path):
        missing = [c for c in ("idx", "prediction") if not set(_PREDICTION_COLUMNS[c]) & set(names)]
        if missing:
            raise ValueError(f"no column for {missing} in {rows.first()['_file'] if rows.count() else names}")
        tagged = rows.withColumn("_name", base_name("_file"))
        parts.append(canonical_predictions(
            tagged, F.col("_name").alias("file"), *scenario_parts("_name"), F.lit(",".join(names)).alias("header")))
    if not parts:
        kinds = ["idx int", *[f"{c} string" for c in (*list(_PREDICTION_COLUMNS)[1:], "file", "prefix", "group_kind", "clothes", "camera", "scenario", "header")]]
        return spark.createDataFrame([], ", ".join(kinds))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


#: How a result file is renamed: to the name of its scenario, or with a prefix.
def _scenario_target(name: Column) -> tuple[Column, Column]:
    prefix, group, clothes, camera, scenario = scenario_parts(name)
    whole = F.when(group.isNotNull(), F.concat(
        F.lit("predictions_"), F.coalesce(prefix, F.lit("")), F.lit("_"), scenario, F.lit(".csv")))
    why = F.when(~F.contains(name, F.lit("_result_")), "no result in its name").when(group.isNull(), "unexpected suffix")
    return whole, why


def _prefix_target(name: Column) -> tuple[Column, Column]:
    has = F.startswith(name, F.lit("predictions_"))
    return F.when(~has, F.concat(F.lit("predictions_"), name)), F.when(has, "has the prefix")


_TARGETS = {"scenario": _scenario_target, "prefix": _prefix_target}


def normalize_results(files: DataFrame, rule: str = "scenario") -> DataFrame:
    """What each result file of a folder is to be called, and what stands against it.

    ``files`` has ``folder, file``. Result: ``folder, file, target, status, rival``.
    ``status`` is ``renamed``, or why not: the file's name gives no target, or the
    target is ``taken`` by ``rival``, a file of that name or the first, in name order, of
    those that want it. Each (folder, file) counts once; files other than ``.csv`` are left out.
    """
    if rule not in _TARGETS:
        raise ValueError(f"unknown rule {rule!r}: expected one of {sorted(_TARGETS)}")
    once = files.select("folder", "file").filter(F.endswith(F.col("file"), F.lit(".csv"))).distinct()
    target, why = _TARGETS[rule](F.col("file"))
    wanted = once.select("folder", "file", target.alias("target"), why.alias("_why"))
    holder = once.select("folder", F.col("file").alias("target"), F.col("file").alias("_holder"))
    first = wanted.filter("target is not null").groupBy("folder", "target").agg(F.min("file").alias("_first"))
    placed = wanted.join(holder, ["folder", "target"], "left").join(first, ["folder", "target"], "left")
    rival = F.coalesce("_holder", F.when(F.col("_first") != F.col("file"), F.col("_first")))
    status = F.coalesce("_why", F.when(rival.isNotNull(), "taken").otherwise("renamed"))
    return placed.select("folder", "file", "target", status.alias("status"), F.when(F.col("_why").isNull(), rival).alias("rival"))


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Predictions of a result folder under repaired headers and names, and the files left out.

    A file whose repaired name another one holds, or wants first, is left out with its
    rival; one without a scenario in its name keeps its name.
    """
    rows = read_predictions(spark, path)
    names = normalize_results(rows.select(F.lit(path).alias("folder"), "file").distinct())
    rejects = names.filter("status = 'taken'")
    kept = names.filter("status <> 'taken'").select("file", F.coalesce("target", "file").alias("result"))
    return rows.join(kept, "file"), rejects


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """Similarity run files -> one row per case with the run's settings."""
    whole = spark.read.schema(schema.SIDECAR).json(path, multiLine=True)
    return whole.select("test_file", "model", "stranger_threshold", F.inline("cases"))


def latest_mapping(rows: DataFrame, order: Column) -> DataFrame:
    """Event -> file base name; the last row of an event wins."""
    event = F.trim(F.col("EVENT_ID"))
    return rows.groupBy(event.alias("event_id")).agg(
        F.max_by(base_name(F.trim(F.col("FILE_PATH"))), order).alias("video_file")
    )


def read_event_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Event mapping CSV; rows are ordered by file, block and position."""
    rows = spark.read.schema("EVENT_ID string, FILE_PATH string").csv(
        path, header=True, enforceSchema=False
    )
    order = F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )
    return latest_mapping(rows.withColumn("_order", order), F.col("_order"))


def read_file_lists(spark: SparkSession, files: str | list[str]) -> DataFrame:
    """The ``FILE_PATH`` column of the CSV files that have one; their headers may differ.

    A line with other than its header's number of fields is an error.
    """
    parts = [rows.select("FILE_PATH") for names, rows in read_csv_by_header(spark, files) if "FILE_PATH" in names]
    out = spark.createDataFrame([], "FILE_PATH string")
    for part in parts:
        out = out.unionAll(part)
    return out


def parse_caption_line(line) -> list[Column]:
    """``key: caption``; the caption keeps any later ``: ``."""
    pattern = r"^(.*?): (.*)$"
    return [
        F.nullif(F.regexp_extract(_col(line), pattern, 1), F.lit("")).alias("caption_key"),
        F.when(_col(line).rlike(pattern), F.regexp_extract(_col(line), pattern, 2)).alias("caption"),
    ]


def read_captions(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    return lines.select(*parse_caption_line("value")).filter("caption_key IS NOT NULL")


def read_caption_json(spark: SparkSession, path: str) -> DataFrame:
    """Caption JSON list; the first caption of each image."""
    rows = spark.read.schema("img_path string, captions array<string>").json(path, multiLine=True)
    return rows.select(F.col("img_path").alias("caption_key"), F.get("captions", F.lit(0)).alias("caption"))


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.DETECTION).json(path)


def stream_detections(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    return (
        spark.readStream.schema(schema.DETECTION)
        .option("maxFilesPerTrigger", files_per_batch).json(folder)
    )


def read_video_listing(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Video files of a folder in name order, optionally the first ``limit``."""
    listed = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.{mp4,mov,avi,mkv,MP4,MOV,AVI,MKV}")
        .load(folder).select("path").orderBy("path")
    )
    return listed if limit is None else listed.limit(limit)
