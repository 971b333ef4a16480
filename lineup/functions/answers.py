"""Option letters and answers read from model text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _col


def index_to_letter(index, stranger_slot) -> Column:
    """0-based gallery index -> option letter, leaving room for the stranger."""
    g, s = _col(index), _col(stranger_slot)
    return _letter(g + F.when(g >= s, 1).otherwise(0))


def _letter(place: Column) -> Column:
    """A to Z. There is no further letter, and a second A would count wrong answers as right."""
    return F.when(
        place >= 26, F.raise_error(F.lit("a gallery of more than 25 items has no option letters"))
    ).otherwise(F.char(F.lit(65) + place))


def letter_to_index(letter, stranger_slot) -> Column:
    """Option letter -> 1-based gallery position, or -1 for the stranger."""
    a, s = F.ascii(_col(letter)) - 65, _col(stranger_slot)
    return F.when(a == s, F.lit(-1)).when(a < s, a + 1).otherwise(a)


def answer_letter(label, stranger_slot) -> Column:
    label, s = _col(label), _col(stranger_slot)
    return F.when(label == -1, _letter(s)).otherwise(
        index_to_letter(label - 1, s)
    )


# Answer patterns, tried in order. (?U) makes \b and \d follow
# Unicode on every Java version.
_LETTER = r"(?U)Answer:\s*([A-Z])\b"
_NUMBER = r"(?iU)Answer:\s*(-?\d+)"
_NO_MATCH = r"(?i)does not match any"
_IN_GALLERY = r"(?iU)gallery image\s+(-?\d+)"
_LONE_CAPITAL = r"(?U)\b([A-Z])\b"
_FIRST_INT = r"(?U)(-?\d+)"

# letter: as used when comparing sources; api: as used on remote models;
# full: every step; strict: only steps that name an answer.
_PROFILES = {
    "letter": ("letter", "capital"),
    "api": ("letter", "number", "none", "capital", "int"),
    "full": ("letter", "number", "none", "gallery", "capital", "int"),
    "strict": ("letter", "number", "none", "gallery"),
}


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _as_int(text: Column) -> Column:
    """Canonical integer text: ``007`` and ``7`` are one answer."""
    return text.try_cast("decimal(38,0)").cast("string")


def extract_answer(text, profile: str = "full") -> Column:
    """First answer found in ``text``: a letter, an integer as text, or null."""
    t = _col(text)
    steps = {
        "letter": _first(t, _LETTER),
        "number": _as_int(_first(t, _NUMBER)),
        "none": F.when(t.rlike(_NO_MATCH), F.lit("-1")),
        "gallery": _as_int(_first(t, _IN_GALLERY)),
        "capital": _first(t, _LONE_CAPITAL),
        "int": _as_int(_first(t, _FIRST_INT)),
    }
    return F.coalesce(*[steps[name] for name in _PROFILES[profile]])


def answer_kind(answer) -> Column:
    a = _col(answer)
    return (
        F.when(a.isNull(), "none").when(a.rlike("^[A-Z]$"), "letter").otherwise("number")
    )


def extract_answer_caption(text) -> Column:
    """Number of the first ``[word n]`` tag."""
    return _first(_col(text), r"\[(?:[^\[\]\d]* )?(\d+)\]").try_cast("int")


def extract_answer_tail(text) -> Column:
    """Text after the last ``in gallery image ``, up to the next full stop."""
    tail = F.element_at(F.split(_col(text), "in gallery image "), -1)
    return F.substring_index(tail, ".", 1)


def parse_int(cell) -> Column:
    """Integer, or the integer part of a decimal, or null."""
    c = F.trim(_col(cell))
    number = F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("int"))
    decimal = c.try_cast("double")
    finite = ~F.isnan(decimal) & (F.abs(decimal) < 2**31)
    return F.coalesce(number, F.when(finite, decimal).cast("int"))


def sanitize_text(text) -> Column:
    return F.translate(_col(text), ",\n", "; ")


def query_status(label) -> Column:
    return F.when(_col(label) > 0, "known").otherwise("unknown")


def is_correct(prediction, label) -> Column:
    return F.coalesce(
        _col(prediction).cast("string") == _col(label).cast("string"), F.lit(False)
    )


def truthy(cell) -> Column:
    return F.lower(F.trim(_col(cell).cast("string"))) == "true"


def parse_verdict_lines(text, n) -> Column:
    """YES/NO lines -> ``n`` booleans. Missing answers keep the item."""
    n = n if isinstance(n, Column) else F.lit(n)
    lines = F.transform(F.split(F.coalesce(_col(text), F.lit("")), "\n"),
                        lambda x: F.upper(F.trim(x)))
    answers = F.filter(lines, lambda x: x.isin("YES", "NO"))
    padded = F.concat(answers, F.array_repeat(F.lit("YES"), n))
    return F.transform(F.slice(padded, F.lit(1), n), lambda x: x == "YES")


def verdict_class(verdict) -> Column:
    v = _col(verdict)
    return (
        F.when(v.isNull(), "unparsable")
        .when(v.startswith("matched"), "matched")
        .when(v.contains("unparsable"), "unparsable")
        .otherwise("new")
    )
