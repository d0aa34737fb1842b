"""Character functions; positions are 1-based."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textscan import strip


def substr(c: Column, start: int, n: int | None = None) -> Column:
    return F.substring(c, start, n) if n is not None else F.substr(c, F.lit(start))


def length(c: Column) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(c)).cast("bigint")


def upcase(c: Column) -> Column:
    return F.upper(c)


def overwrite(c: Column, start: int, text: str, n: int = 1) -> Column:
    """Replace ``n`` characters from ``start``; the text never gets longer."""
    piece = text[:n].ljust(n)
    inside = F.least(F.lit(n), F.greatest(F.length(c) - F.lit(start - 1), F.lit(0)))
    return F.when(
        F.length(c) >= start, F.overlay(c, F.substr(F.lit(piece), F.lit(1), inside), F.lit(start), inside)
    ).otherwise(c)


def overwrite_all(c: Column, text: str) -> Column:
    """Every character replaced by the first one of ``text``, blanks inside included."""
    return F.repeat(F.lit(text[:1]), F.length(F.rtrim(c)))


def chars(c: Column, n: int) -> Column:
    """The first ``n`` characters as an array of exactly ``n`` entries, missing beyond the end."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.nullif(F.substr(c, i, F.lit(1)), F.lit("")))


def scan(c: Column, i: int, delims: str = " ") -> Column:
    """The i-th word (from the right when negative); repeated delimiters count once."""
    if i == 0:
        raise ValueError("word numbers start at 1")
    words = F.filter(F.split(c, f"[{re.escape(delims)}]"), lambda w: w != "")
    return F.try_element_at(words, F.lit(i))


def _strip(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def cats(*cols: Column) -> Column:
    """Trimmed values side by side; missing values add nothing."""
    return F.concat(*[_strip(c) for c in cols])


def catx(sep: str, *cols: Column) -> Column:
    """Trimmed values with a separator between those that are not empty."""
    return F.array_join(F.filter(F.array(*[_strip(c) for c in cols]), lambda x: x != ""), sep)


def join_parts(*cols: Column) -> Column:
    """Non-empty parts joined by a blank, without white space at the ends."""
    parts = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return strip(F.array_join(F.filter(parts, lambda x: x != ""), " "))
