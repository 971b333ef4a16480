"""Caption rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _col
from .names import parent_dir

# Words that open and close a noun phrase naming a person.
ARTICLES = ("A", "The", "a", "the")
DEMONSTRATIVES = ("this", "that", "This", "That")
NOUNS = ("man", "woman", "child", "boy", "girl", "lady", "male", "female", "person")
# The words between them, one character a step: Java's matcher calls itself for every
# round of a group of changing length, and a line of some thousand words ended the executor.
_PLAIN = r"[\w\s]*?"
# A hyphen joins two words, once, and white space follows them.
_HYPHENATED = r"(?:(?!-(?:(?<=\s-)|(?!\w++\s)))[\w\s-])*?"


def tag_caption(text) -> Column:
    """Bracket phrases such as ``a tall man``.

    One rewrite per (opening word, noun), articles before demonstratives; only
    demonstratives accept hyphenated adjectives. A caption that ends up with
    anything but one bracket is introduced by ``[Person]. ``.
    """
    source = _col(text)
    # Rewrites only add brackets, so a word that the source lacks never comes up.
    openers = F.array(*[
        F.struct(F.lit(word).alias("word"), F.lit(adjectives).alias("adjectives"))
        for words, adjectives in ((ARTICLES, _PLAIN), (DEMONSTRATIVES, _HYPHENATED)) for word in words
    ])
    opening = F.filter(openers, lambda o: F.contains(source, F.concat(o["word"], F.lit(" "))))
    nouns = F.filter(F.array(*[F.lit(n) for n in NOUNS]), lambda n: F.contains(source, n))

    def bracket(x: Column, o: Column, noun: Column) -> Column:
        # The literals come first, and what stands before them is looked at afterwards.
        phrase = F.concat(
            F.lit("(?U)"), o["word"], F.lit(r" (?<=\b"), o["word"], F.lit(r" )((?!\s)"), o["adjectives"], F.lit(")"),
            noun, F.lit(r"(?<=\s"), noun, F.lit(r")\b"),
        )
        return F.regexp_replace(x, phrase, F.concat(F.lit("["), o["word"], F.lit(" $1"), noun, F.lit("]")))

    out = F.aggregate(opening, source, lambda x, o: F.aggregate(nouns, x, lambda y, n: bracket(y, o, n)))

    def introduce(x: Column) -> Column:
        opened = F.length(x) - F.length(F.replace(x, F.lit("["), F.lit("")))
        return F.when(opened == 1, x).otherwise(F.concat(F.lit("[Person]. "), x))

    # A one-element transform names the text, so it is not worked out twice.
    return F.get(F.transform(F.array(out), introduce), F.lit(0))


def retag_caption(text, word, number) -> Column:
    """Every ``[...]`` becomes ``[word n]``; a caption without one is the tag alone."""
    tag = F.concat(F.lit("["), _col(word), F.lit(" "), _col(number).cast("string"), F.lit("]"))
    pattern = F.lit(r"\[[^\[\]]*?\]")
    return F.when(
        _col(text).rlike(r"\[[^\[\]]*?\]"), F.regexp_replace(_col(text), pattern, tag)
    ).otherwise(tag)


def product_name(path) -> Column:
    """Readable product: the ``<name>_final`` folder, else the parent folder."""
    final = F.nullif(F.regexp_extract(_col(path), "/([^/]+)_final/", 1), F.lit(""))
    plain = F.substring_index(_col(path), ".", 1)
    name = F.coalesce(final, parent_dir(path), plain)
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def fill_product(text, name) -> Column:
    return F.regexp_replace(_col(text), F.lit(r"\[Product \d+\]"), _col(name))


def split_placeholders(question) -> list[Column]:
    """Cut a question at its two ``<...>`` marks and say which comes first."""
    q = _col(question)
    parts = F.split(q, "<[^>]+>", 3)
    first = F.nullif(F.regexp_extract(q, "<([^>]+)>", 1), F.lit(""))
    return [
        F.try_element_at(parts, F.lit(1)).alias("before"),
        F.try_element_at(parts, F.lit(2)).alias("between"),
        F.try_element_at(parts, F.lit(3)).alias("after"),
        (F.lower(first) == "query").alias("query_first"),
    ]
