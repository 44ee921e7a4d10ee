"""Scalars of field values as SQL expressions of one row. Each builder takes the dialect and the names of the columns."""

from __future__ import annotations

from . import rules as R
from .dialect import Spark


def trimmed(d: Spark, x: str) -> str:
    return d.replace(x, r"^\s+|\s+$")


def blank(d: Spark, x: str) -> str:
    return f"({x} IS NULL OR NOT {d.like(x, r'[^ \t\n\r\f\v]')})"


def any_of(d: Spark, x: str, words: list[str]) -> str:
    """Whether x holds one of the words, in one pass over x."""
    return d.like(x, "|".join(w.replace(".", r"\.") for w in words))


def pdf_day(d: Spark, x: str) -> str:
    """Date text (YYYY-MM-DD) of an embedded date; four to seven characters give the first of January. Free text gives null."""
    cleaned = d.replace(d.replace(trimmed(d, x), r"^D:"), r"(?s)[+\-Z].*$")
    full = d.date(f"left({cleaned}, 8)", "basic")
    year = d.date(f"left({cleaned}, 4) || '0101'", "basic")
    digits = f"{d.like(f'left({cleaned}, 8)', '^[0-9]{8}$')}"
    return f"CASE WHEN length({cleaned}) >= 8 AND {digits} THEN {d.day(full)} WHEN length({cleaned}) BETWEEN 4 AND 7 AND {d.like(f'left({cleaned}, 4)', '^[0-9]{4}$')} THEN {d.day(year)} END"


def year_of(d: Spark, x: str) -> str:
    return f"nullif({d.extract(x, r'\b((?:19|20)\d{2})\b')}, '')"


def normal_author(d: Spark, x: str) -> str:
    return d.replace(d.replace(trimmed(d, x), r"\s+", " "), r"[.,;:]+$")


def garbage_author(d: Spark, x: str) -> str:
    low = f"lower({trimmed(d, x)})"
    letters = f"length({d.replace(low, r'[^\p{L}\s]')})"
    words = any_of(d, low, R.AUTHOR_BLACKLIST + R.AUTHOR_SOFTWARE)
    return f"(length({low}) < 3 OR length({low}) > 100 OR CAST({letters} AS DOUBLE) / greatest(length({low}), 1) < 0.7 OR {words})"


def author_last(d: Spark, x: str) -> str:
    plain = d.replace(trimmed(d, x), r"(?i)\s+et\s+al\.?$")
    return f"CASE WHEN {d.contains(plain, ',')} THEN {trimmed(d, d.first(d.split(plain, ',')))} ELSE {d.last(d.split(d.replace(plain, r'\s+', ' '), ' '))} END"


def garbage_title(d: Spark, x: str, patterns: list[str] | None = None) -> str:
    low = f"lower({trimmed(d, x)})"
    return d.like(low, "|".join(patterns or R.GARBAGE_TITLE))


def boilerplate(d: Spark, x: str) -> str:
    low = f"lower({trimmed(d, x)})"
    return f"({any_of(d, low, R.BOILERPLATE)} OR length({low}) < 5)"
