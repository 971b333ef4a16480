"""Parsing item paths and run names.

An item is named ``<account>_<cluster>_<device>_<event>_<frame>_<clothes>.jpg``.
The account may itself contain ``_``, so names are read from the right. Names
that do not fit give null instead of an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _col


def base_name(path) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def _tokens(path) -> Column:
    return F.split(base_name(path), "_")


def _token(path, index: int) -> Column:
    return F.try_element_at(_tokens(path), F.lit(index))


def _drop_right(tokens: Column, n: int) -> Column:
    kept = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - n, F.lit(0)))
    return F.when(F.size(tokens) > n, F.array_join(kept, "_"))


def entity_of_path(path) -> Column:
    return _drop_right(_tokens(path), 4)


def group_of_entity(entity) -> Column:
    return _drop_right(F.split(_col(entity), "_"), 1)


def group_of_path(path) -> Column:
    return group_of_entity(entity_of_path(path))


def source_of_path(path) -> Column:
    return _token(path, -4)


def event_of_path(path) -> Column:
    return _token(path, -3)


def frame_of_path(path) -> Column:
    return _token(path, -2).try_cast("int")


def cluster_of_entity(entity) -> Column:
    return F.element_at(F.split(_col(entity), "_"), -1)


def clothes_of_path(path) -> Column:
    return F.regexp_replace(_token(path, -1), r"\.jpg$", "")


def parse_path(path) -> list[Column]:
    """All facts held by an item path, as named columns."""
    entity = entity_of_path(path)
    return [
        entity.alias("entity_id"),
        group_of_entity(entity).alias("group_id"),
        cluster_of_entity(entity).alias("cluster_id"),
        source_of_path(path).alias("source_id"),
        event_of_path(path).alias("event_id"),
        frame_of_path(path).alias("frame_no"),
        clothes_of_path(path).alias("clothes_id"),
    ]


def rewrite_path(path, old: str, new: str) -> Column:
    return F.replace(_col(path), F.lit(old), F.lit(new))


def add_prefix(path, prefix: str) -> Column:
    return F.concat(F.lit(prefix), _col(path))


def path_suffix_key(path, k: int) -> Column:
    """Last ``k`` components, the key captions are filed under."""
    parts = F.split(_col(path), "/")
    n = F.least(F.size(parts), F.lit(k))
    return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/")


def path_category(path) -> Column:
    """Product id: the base name up to its first ``_``."""
    return F.substring_index(base_name(path), "_", 1)


def parent_dir(path) -> Column:
    return F.try_element_at(F.split(_col(path), "/"), F.lit(-2))


def is_person_path(path, person_dirs) -> Column:
    return F.coalesce(parent_dir(path).isin(*person_dirs), F.lit(False))


# Words of a result file's name.
GROUP_KINDS = ("family", "singleton")
CLOTHES_KINDS = ("crossclothes", "sameclothes")
CAMERA_KINDS = ("crosscamera", "samecamera")

_RESULT_NAME = "^(.*?)_result_({g})_({c})_({s})$".format(
    g="|".join(GROUP_KINDS), c="|".join(CLOTHES_KINDS), s="|".join(CAMERA_KINDS)
)


def scenario_parts(file_name) -> list[Column]:
    """``<prefix>_result_<group>_<clothes>_<camera>.csv`` -> its parts.

    A name with any other suffix gives nulls. ``scenario`` is the name under
    which benchmarks are filed.
    """
    stem = F.regexp_replace(base_name(file_name), r"\.csv$", "")

    def part(i):
        return F.nullif(F.regexp_extract(stem, _RESULT_NAME, i), F.lit(""))

    prefix, group, clothes, camera = (part(i) for i in range(1, 5))
    scenario = F.when(
        group.isNotNull(),
        F.concat_ws("_", F.lit("cropped"), clothes, group, camera),
    )
    return [
        prefix.alias("prefix"),
        group.alias("group_kind"),
        clothes.alias("clothes"),
        camera.alias("camera"),
        scenario.alias("scenario"),
    ]


# Input modes of a run name.
INPUT_MODES = (
    "image_only", "expert_only", "expert_qformer", "expert_and_image_attn",
    "expert_and_image_attn_adapter", "expert_and_image_concat", "expert_and_image_add",
    "expert_cross_attn",
)
_RUN = (
    r"^[^_]+_[^_]+_(?:(.*?)_)?(Qwen[^_]*)_([^_]+)_([^_]+)(?:_(.+?))?_("
    + "|".join(INPUT_MODES)
    + r")_lr_.*_captions_([^_]+)$"
)
_EPOCH = r"connector_epoch_([0-9]+)\.pt$"
_BEST = r"connector_best_step_([0-9]+)\.pt$"


def run_name_parts(checkpoint) -> list[Column]:
    """Checkpoint path -> run settings. The input mode is what stands before ``_lr_``."""
    path = _col(checkpoint)
    parts = F.split(path, "/")
    epoch = F.nullif(F.regexp_extract(path, _EPOCH, 1), F.lit(""))
    best = F.nullif(F.regexp_extract(path, _BEST, 1), F.lit(""))
    tag = F.coalesce(F.concat(F.lit("epoch"), epoch), F.concat(F.lit("best_step"), best))
    run = F.try_element_at(parts, F.when(tag.isNull(), F.lit(-2)).otherwise(F.lit(-3)))

    def part(i):
        return F.nullif(F.regexp_extract(run, _RUN, i), F.lit(""))

    return [
        run.alias("run"),
        F.concat_ws("_", part(1), tag).alias("prefix"),
        part(2).alias("model"),
        part(3).alias("object_type"),
        part(4).alias("feature_mode"),
        F.coalesce(part(5), F.lit("None")).alias("expert_feature"),
        part(6).alias("input_mode"),
        part(7).alias("captions"),
        tag.alias("checkpoint_tag"),
    ]


def run_name(started, prefix, model, object_type, feature_mode, expert_feature,
             input_mode, lr, batch_size, captions) -> Column:
    """Inverse of ``run_name_parts`` for the run folder."""
    text = [_col(c).cast("string") for c in (
        started, prefix, F.element_at(F.split(_col(model), "/"), -1), object_type,
        feature_mode, expert_feature, input_mode)]
    return F.concat_ws(
        "_", *text, F.lit("lr"), _col(lr).cast("string"), F.lit("bs"),
        _col(batch_size).cast("string"), F.lit("captions"), _col(captions).cast("string"),
    )
