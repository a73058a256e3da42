"""Column functions on text and numbers, all inside the JVM."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "
_FLOAT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
_INT = r"^\s*[+-]?\d+\s*$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; an aggregate's end, as a transform would copy all of what ``use`` gives."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def is_float(x: Column) -> Column:
    """Whether a text reads as a number: digits, exponent, nan and inf; no grouping, suffix or hex."""
    return F.coalesce(x.rlike(_FLOAT), F.lit(False))


def is_int(x: Column) -> Column:
    """Whether a text reads as a whole number."""
    return F.coalesce(x.rlike(_INT), F.lit(False))


def to_float(x: Column) -> Column:
    """The number that a text reads as, else null."""
    return F.when(is_float(x), F.trim(x).try_cast("double"))


def strip_punctuation(x: Column) -> Column:
    return F.regexp_replace(x, r"\p{Punct}", "")


def strip_nbsp(x: Column) -> Column:
    return F.replace(x, F.lit(NBSP), F.lit(""))


def strip_citations(x: Column) -> Column:
    """Text without marks such as [12]."""
    return F.regexp_replace(x, r"\[\d+\]", "")


def ascii_dots(x: Column) -> Column:
    """Each character beyond ASCII, and each question mark, as a point."""
    return F.regexp_replace(x, r"[^\x00-\x7F]|\?", ".")


def underscored(x: Column) -> Column:
    return F.replace(x, F.lit(" "), F.lit("_"))


def resource_key(x: Column) -> Column:
    """A text as the last part of an address: one space off either end, the others as underscores."""
    return underscored(F.regexp_replace(F.regexp_replace(x, "^ ", ""), " $", ""))


def last_segment(x: Column) -> Column:
    return F.substring_index(x, "/", -1)


def segment_after(x: Column, word: str = "resource") -> Column:
    """The path segment that follows ``word``; null without it."""
    parts = F.split(x, "/")
    return F.get(parts, F.nullif(F.array_position(parts, F.lit(word)), F.lit(0)).cast("int"))


def query_plus(x: Column) -> Column:
    """A text as a value in an address's query, blank as plus, all but letters, digits and ``_.-`` encoded."""
    return F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A"))


def date_time_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy_MM_dd-HH_mm")


def date_stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy_MM_dd")


def letter_distance(a: Column, b: Column) -> Column:
    """How many letters one text has and the other lacks, spaces and case apart.

    A letter counts once, but in upper case each time. The letters of each text are
    found once, and not again for each letter of the other.
    """
    letters = lambda x: F.split(F.replace(x, F.lit(" "), F.lit("")), "")
    met = lambda found, c: F.when(F.array_contains(found, c), found).otherwise(F.concat(found, F.array(F.lower(c))))
    unique = lambda x: F.aggregate(F.filter(letters(x), lambda c: c != ""), F.array().cast("array<string>"), met)
    lacking = lambda x, y: F.size(F.filter(x, lambda c: ~F.array_contains(y, c)))
    return once(F.struct(unique(a).alias("a"), unique(b).alias("b")), lambda both: lacking(both["a"], both["b"]) + lacking(both["b"], both["a"]))


@functools.cache
def _accented() -> tuple[str, str]:
    """Characters beyond ASCII whose canonical decomposition holds an ASCII one, and these."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i)).encode("ascii", "ignore").decode()) for i in range(0x80, 0x10000) if not 0xD800 <= i < 0xE000]
    kept = [(c, a) for c, a in pairs if len(a) == 1]
    return "".join(c for c, _ in kept), "".join(a for _, a in kept)


def plain_accents(x: Column) -> Column:
    """Text in ASCII: canonically decomposed, all but ASCII dropped."""
    accented, plain = _accented()
    return F.regexp_replace(F.translate(x, accented, plain), r"[^\x00-\x7F]", "")
