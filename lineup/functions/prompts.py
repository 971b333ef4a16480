"""Chat messages for a case.

A message is ``array<struct<role, content: array<struct<type, text, image>>>>``.
A case is one row with ``query`` (path) and ``gallery`` (paths in order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import index_to_letter
from .hashing import _col

# Fixed value: the text shown in the stranger's slot.
STRANGER_OPTION = "(stranger / not in the gallery)"


def _null() -> Column:
    return F.lit(None).cast("string")


def text_part(text) -> Column:
    text = text if isinstance(text, Column) else F.lit(text)
    return F.struct(F.lit("text").alias("type"), text.alias("text"), _null().alias("image"))


def image_part(path) -> Column:
    return F.struct(F.lit("image").alias("type"), _null().alias("text"), _col(path).alias("image"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _query_parts(query) -> Column:
    return F.array(text_part("Query: "), image_part(query))


def lettered_options(gallery, stranger_slot) -> Column:
    """N images and one text-only stranger slot, lettered in order."""
    g, s = _col(gallery), _col(stranger_slot)

    def option(i):
        letter = F.char(F.lit(65) + i)
        image = F.get(g, F.when(i < s, i).otherwise(i - 1))
        return F.when(
            i == s,
            F.array(text_part(F.concat(letter, F.lit(": " + STRANGER_OPTION)))),
        ).otherwise(F.array(text_part(F.concat(letter, F.lit(": "))), image_part(image)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(g)), option))


def numbered_options(gallery) -> Column:
    g = _col(gallery)
    return F.flatten(
        F.transform(
            g,
            lambda path, i: F.array(
                text_part(F.concat(F.lit("Gallery "), (i + 1).cast("string"), F.lit(":"))),
                image_part(path),
            ),
        )
    )


def build_prompt(system, query, gallery, stranger_slot, answer) -> Column:
    """System text, lettered options, and the answer letter as the reply."""
    reply = F.concat(F.lit("Answer: "), _col(answer), F.lit("."))
    return F.array(
        message("system", F.array(text_part(system))),
        message("user", F.concat(_query_parts(query), lettered_options(gallery, stranger_slot))),
        message("assistant", F.array(text_part(reply))),
    )


def sentence_answer(label) -> Column:
    n = _col(label).cast("string")
    return F.when(
        _col(label) == -1,
        "The person in the query image does not match any person in the gallery. Answer: -1.",
    ).otherwise(
        F.concat(
            F.lit("The person in the query image matches the person in gallery image "),
            n, F.lit(". Answer: "), n,
        )
    )


def build_prompt_legacy(system, query, gallery, label, caption=None) -> Column:
    """Numbered gallery; the reply is a sentence, or a caption when given."""
    reply = sentence_answer(label) if caption is None else _col(caption)
    return F.array(
        message("system", F.array(text_part(system))),
        message("user", F.concat(_query_parts(query), numbered_options(gallery))),
        message("assistant", F.array(text_part(reply))),
    )


def ranking_text(similarity, stranger_slot, title: str = "Expert similarity scores") -> Column:
    """Similarities by option letter, highest first; ties keep gallery order.

    Four places, halves away from zero.
    """
    scored = F.transform(
        _col(similarity),
        lambda s, i: F.struct(
            (-s).alias("minus"), i.alias("i"),
            index_to_letter(i, stranger_slot).alias("letter"),
        ),
    )

    def line(x, rank):
        note = F.when(rank == 0, "  ← rank 1, highest similarity").otherwise(
            F.concat(F.lit("  ← rank "), (rank + 1).cast("string"))
        )
        return F.concat(
            F.lit("  "), x["letter"], F.lit(": "), F.format_string("%.4f", -x["minus"]), note
        )

    lines = F.transform(F.sort_array(scored), line)
    head = F.lit(f"{title} (cosine, higher = more similar to query):")
    return F.array_join(F.concat(F.array(head), lines), "\n")


def build_prompt_with_ranking(system, query, gallery, stranger_slot, similarity) -> Column:
    """Lettered options followed by the ranking text; no reply."""
    return F.array(
        message("system", F.array(text_part(system))),
        message(
            "user",
            F.concat(
                _query_parts(query),
                lettered_options(gallery, stranger_slot),
                F.array(text_part(ranking_text(similarity, stranger_slot))),
            ),
        ),
    )


def build_prompt_qa(system, image, question, labels) -> Column:
    """One image and a question; the first label is the reply."""
    return F.array(
        message("system", F.array(text_part(system))),
        message("user", F.array(image_part(image), text_part(_col(question)))),
        message("assistant", F.array(text_part(F.get(_col(labels), F.lit(0))))),
    )


def message_images(messages) -> Column:
    """Every image reference of a message, in order."""
    parts = F.flatten(F.transform(_col(messages), lambda m: m["content"]))
    return F.transform(F.filter(parts, lambda p: p["image"].isNotNull()), lambda p: p["image"])


def system_message(kind, variant, messages: dict[str, dict[str, str]]) -> Column:
    """Text of (kind, variant), else of (kind, default); an unknown kind raises.

    ``messages`` is the caller's own table of system texts.
    """
    flat = [
        part for k, variants in messages.items() for v, text in variants.items()
        for part in (F.lit(f"{k}/{v}"), F.lit(text))
    ]
    table = F.create_map(*flat)
    found = F.coalesce(
        F.try_element_at(table, F.concat_ws("/", _col(kind), _col(variant))),
        F.try_element_at(table, F.concat_ws("/", _col(kind), F.lit("default"))),
    )
    unknown = F.raise_error(F.concat(F.lit("unknown message kind: "), _col(kind)))
    return F.coalesce(found, unknown.cast("string"))
