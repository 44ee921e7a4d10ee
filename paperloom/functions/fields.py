"""Field extraction from one text and its embedded metadata, as Arrow functions: one pass gives every field of both stages.

A text is worked on once for all fields: windows are cut once, and the type patterns run only where one of the literals
that every match of them must hold has been seen by a single automaton. Candidates come in a fixed order; the most confident
wins, the first of equals. Null or empty texts give the values that the rules name for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import date, datetime
from typing import NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R

try:
    import ahocorasick
except ImportError:  # the literals are then looked for one by one
    ahocorasick = None


class Found(NamedTuple):
    value: str | None
    confidence: float
    source: str
    method: str


def best(candidates: Iterable[Found], nothing: str) -> Found:
    top = Found(None, 0.0, "heuristic", nothing)
    for c in candidates:
        if top.value is None or c.confidence > top.confidence:
            top = c
    return top


# --- dates ------------------------------------------------------------------------------------------------------------
_MONTH = {m.lower(): i % 12 + 1 for i, m in enumerate(R.MONTHS_FULL.split("|") + R.MONTHS_SHORT.split("|"))}
_FORMS = [(name, confidence, re.compile(pattern, re.I)) for name, confidence, pattern in R.DATE_FORMS]
#: Which part of a form's match is the year, the month and the day; 1 stands for what the form does not write.
_ORDER = {"iso": (0, 1, 2), "us": (2, 0, 1), "eu": (2, 1, 0), "written_full": (2, 0, 1), "month_year": (1, 0, None), "abbrev_my": (1, 0, None), "abbrev_dmy": (2, 1, 0), "year_only": (0, None, None)}


def day_of(form: str, match: str) -> date | None:
    """The day that a match of a form names; None if there is no such day."""
    parts = re.findall(r"[A-Za-z]+|\d+", match)
    year, month, day = (1 if at is None else _MONTH.get(parts[at].lower()) or int(parts[at]) for at in _ORDER[form])
    try:
        return date(year, month, day)
    except ValueError:
        return None


def text_dates(text: str | None, context: bool = True) -> Iterator[Found]:
    """EX-2, EX-2b: the dates of a text's start; words near a date raise its confidence, to 1 at most."""
    window = (text or "")[: R.DATE_CHARS]
    for form, base, pattern in _FORMS:
        for m in pattern.finditer(window):
            day = day_of(form, m.group())
            if day is None or not R.DATE_YEARS[0] <= day.year <= R.DATE_YEARS[1]:
                continue
            confidence = base
            if context:
                near = window[max(0, m.start() - R.DATE_WINDOW) : m.end() + R.DATE_WINDOW].lower()
                confidence = min(1.0, base + sum(boost for word, boost in R.DATE_CONTEXT.items() if word in near))
            yield Found(str(day.year) if form == "year_only" else day.isoformat(), confidence, "heuristic", f"regex:{form}")


def free_text_day(value: str | None) -> str | None:
    """EX-3's last resort: a date somewhere in free text; parts that it does not name are those of 1 January 1900."""
    from dateutil import parser

    if not value:
        return None
    try:
        return parser.parse(value, fuzzy=True, default=datetime(1900, 1, 1)).strftime("%Y-%m-%d")
    except (ValueError, OverflowError, TypeError):
        return None


def embedded_day(value: str, fuzzy: bool = True) -> str | None:
    """EX-3: the day of an embedded date; four to seven characters are a year."""
    bare = re.sub(r"(?s)[+\-Z].*", "", value.strip().removeprefix("D:"))
    form = "%Y%m%d" if len(bare) >= 8 else "%Y" if len(bare) >= 4 else None
    if form:
        try:
            return datetime.strptime(bare[: 8 if len(bare) >= 8 else 4], form).strftime("%Y-%m-%d")
        except ValueError:
            pass
    return free_text_day(value) if fuzzy else None


def embedded_dates(meta: dict, fuzzy: bool = True) -> Iterator[Found]:
    """EX-1."""
    for key in R.DATE_KEYS:
        if meta.get(key) and (day := embedded_day(meta[key], fuzzy)):
            yield Found(day, 0.60, "metadata", f"pdf_{key}")


def find_date(text: str | None, meta: dict, context: bool = True, fuzzy: bool = True) -> Found:
    return best([*embedded_dates(meta, fuzzy), *text_dates(text, context)], "no_date_found")


def year_in(value: str | None) -> str | None:
    """EX-4."""
    m = re.search(r"\b((?:19|20)\d{2})\b", value or "")
    return m.group(1) if m else None


# --- authors, identifiers, organisations, titles ------------------------------------------------------------------------
_AUTHORS = [(confidence, re.compile(pattern, re.M)) for confidence, pattern in R.AUTHOR_FORMS]
_AUTHOR_WORDS = re.compile("|".join(map(re.escape, R.AUTHOR_BLACKLIST + R.AUTHOR_SOFTWARE)))


def normal_author(name: str) -> str:
    return " ".join(name.split()).rstrip(".,;:")


def no_author(name: str) -> bool:
    """EX-7."""
    low = name.lower().strip()
    if not 3 <= len(low) <= 100 or _AUTHOR_WORDS.search(low):
        return True
    return sum(c.isalpha() or c.isspace() for c in low) / len(low) < 0.7


def find_author(text: str | None, meta: dict) -> Found:
    """EX-5 to EX-8."""

    def candidates() -> Iterator[Found]:
        for key in ("author", "Author"):
            name = (meta.get(key) or "").strip()
            if len(name) > 2 and not no_author(name):
                yield Found(normal_author(name), 0.70, "metadata", "pdf_info_author")
        for confidence, pattern in _AUTHORS:
            for m in pattern.finditer((text or "")[: R.AUTHOR_CHARS]):
                name = m.group(1).strip()
                if 3 < len(name) < 100 and not no_author(name):
                    yield Found(normal_author(name), confidence, "heuristic", "regex:author_pattern")
                    break  # later matches of a form are no more confident than its first

    return best(candidates(), "no_author_found")


_IDENTIFIERS = [(name, confidence, re.compile(pattern, re.I)) for name, confidence, pattern in R.IDENTIFIER_FORMS]
_IDENTIFIER_META = re.compile(R.IDENTIFIER_META)


def find_identifier(text: str | None, meta: dict) -> Found:
    """EX-10 to EX-12."""

    def candidates() -> Iterator[Found]:
        for key in ("subject", "Subject", "keywords", "Keywords"):
            value = (meta.get(key) or "").strip()
            if _IDENTIFIER_META.match(value):
                yield Found(value, R.IDENTIFIER_META_CONFIDENCE, "metadata", f"pdf_{key}_as_id")
        window = (text or "")[: R.IDENTIFIER_CHARS]
        for name, confidence, pattern in _IDENTIFIERS:
            if m := pattern.search(window):
                yield Found(m.group(1).strip(), confidence, "heuristic", f"regex:{name}")

    return best(candidates(), "no_id_found")


_SHORT = {name: re.compile(rf"\b{re.escape(name)}\b") for name, _ in R.ORGANISATIONS if len(name) <= 3}


def find_organisation(text: str | None, meta: dict) -> Found:
    """EX-13: the first of the most confident names; names of up to three letters must stand alone and count for less."""

    def candidates() -> Iterator[Found]:
        sources = [(meta[key], R.ORG_META, "metadata") for key in R.ORG_KEYS if meta.get(key)]
        if text:
            sources.append((text[: R.ORG_CHARS], R.ORG_TEXT, "heuristic"))
        for words, confidence, source in sources:
            low = words.lower()
            for name, short in R.ORGANISATIONS:
                if name in low and (name not in _SHORT or _SHORT[name].search(low)):
                    yield Found(short, confidence * R.ORG_SHORT if name in _SHORT else confidence, source, f"org_match:{name}")

    return best(candidates(), "no_org_found")


_GARBAGE, _GARBAGE_META = (re.compile("|".join(p)) for p in (R.GARBAGE_TITLE, R.GARBAGE_TITLE_META))
_BOILERPLATE = re.compile("|".join(R.BOILERPLATE))
_TITLES = [(confidence, re.compile(pattern, re.M)) for confidence, pattern in R.TITLE_LABELS]


def boilerplate(text: str) -> bool:
    """EX-18."""
    low = text.lower().strip()
    return len(low) < 5 or bool(_BOILERPLATE.search(low))


def largest_font_title(spans: Iterable[tuple[float, str]] | None) -> str | None:
    """EX-14: text of the largest font of a first page, first of equals; over 14 points, over five characters, no boilerplate."""
    size, title = 0.0, None
    for points, text in spans or []:
        if points > size and len(text.strip()) > 5:
            size, title = points, text.strip()
    return None if title is None or size <= 14 or boilerplate(title) else title


def find_title(text: str | None, meta: dict, spans: Iterable[tuple[float, str]] | None = None) -> Found:
    """EX-14 to EX-18."""

    def candidates() -> Iterator[Found]:
        if large := largest_font_title(spans):
            yield Found(large, 0.80, "heuristic", "largest_font_page1")
        embedded = meta.get("title") or ""
        if len(embedded) > 5 and not _GARBAGE.search(embedded.lower().strip()):
            yield Found(embedded.strip(), 0.65, "metadata", "pdf_info_title")
        for confidence, pattern in _TITLES:
            m = pattern.search((text or "")[:3000])
            if m and not boilerplate(m.group(1)):
                yield Found(m.group(1).strip(), confidence, "heuristic", "regex:title_label")
        for line in map(str.strip, (text or "").strip().split("\n")[:20]):
            if 10 < len(line) < 200 and not boilerplate(line):
                yield Found(line, 0.35, "heuristic", "first_significant_line")
                break

    return best((c for c in candidates() if c.value), "no_title_found")


# --- types ------------------------------------------------------------------------------------------------------------
def literals(pattern: str) -> list[str] | None:
    r"""For each alternative of \b(?:...)\b the longest text that any match of it holds, in lower case; None if one has none of two letters."""
    body = pattern.removeprefix(r"\b(?:").removesuffix(r"\b").removesuffix(")")
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "|" and not depth:
            parts.append(body[start:i])
            start = i + 1
    out = []
    for plain in [*parts, body[start:]]:
        while re.search(r"\([^()]*\)", plain):
            plain = re.sub(r"\([^()]*\)[?*+]?", "\n", plain)  # groups say nothing certain
        plain = re.sub(r"\[[^\]]*\][?*+]?|\\[a-zA-Z][?*+]?|\.[?*+]|\\\.\??", "\n", plain)
        longest = max(re.sub(r".[?*]", "\n", plain).split("\n"), key=len)
        if len(longest) < 2:
            return None
        out.append(longest.lower())
    return out


class Signals:
    """Weighted patterns of several types, in order; a pattern is tried only where one of its literals was seen."""

    def __init__(self, table: dict[str, list[tuple[str, int]]]):
        self.rows = [(kind, re.compile(pattern, re.I), weight) for kind, signals in table.items() for pattern, weight in signals]
        self.most = {kind: sum(w for _, w in signals) for kind, signals in table.items()}
        self.always: list[int] = []
        self.by_literal: dict[str, list[int]] = {}
        for k, pattern in enumerate(p for signals in table.values() for p, _ in signals):
            found = literals(pattern)
            for word in found or ():
                self.by_literal.setdefault(word, []).append(k)
            if found is None:
                self.always.append(k)
        self.automaton = None

    def seen(self, low: str) -> set[int]:
        """Patterns that could match."""
        if ahocorasick is None:
            words: Iterable[str] = (w for w in self.by_literal if w in low)
            return {k for w in words for k in self.by_literal[w]}.union(self.always)
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for word, rows in self.by_literal.items():
                self.automaton.add_word(word, rows)
            self.automaton.make_automaton()
        out = set(self.always)
        for _, rows in self.automaton.iter(low):
            out.update(rows)
        return out

    def score(self, low: str, every: bool = False) -> tuple[str, float] | None:
        """(type, confidence) of the highest score, the first of equals; None if nothing matches. every: without the automaton."""
        totals: dict[str, int] = {}
        for k in range(len(self.rows)) if every else sorted(self.seen(low)):
            kind, pattern, weight = self.rows[k]
            if pattern.search(low):
                totals[kind] = totals.get(kind, 0) + weight
        if not totals:
            return None
        kind = max(self.most, key=lambda t: totals.get(t, 0))
        return kind, min(totals[kind] / self.most[kind] * 0.85, 0.90)


GENERIC, DOMAIN = Signals(R.GENERIC), Signals(R.DOMAIN)


def find_generic_type(text: str | None, low: str | None = None) -> Found:
    """EX-19."""
    if not text:
        return Found("other", 0.1, "heuristic", "no_text")
    got = GENERIC.score(low if low is not None else text[: R.SIGNAL_CHARS].lower())
    return Found(*got, "heuristic", "doctype_signals") if got else Found("other", 0.1, "heuristic", "doctype_no_match")


def find_domain_type(text: str | None, organisation: Found, low: str | None = None) -> tuple[Found, Found, Found]:
    """EX-20: the type, its domain, and the subdomain (the organisation, else the first word of the type)."""
    if not text:
        return tuple(Found(v, c, "heuristic", "no_text") for v, c in (("other", 0.1), ("general", 0.1), ("", 0.0)))
    got = DOMAIN.score(low if low is not None else text[: R.SIGNAL_CHARS].lower())
    if not got:
        return tuple(Found(v, c, "heuristic", "maritime_fallback") for v, c in (("other", 0.15), ("general", 0.15), ("", 0.0)))
    sub = (organisation.value, organisation.confidence) if organisation.value else (got[0].split("_")[0], 0.3)
    return Found(*got, "heuristic", "maritime_signals"), Found(R.TYPE_DOMAIN.get(got[0], "general"), got[1], "heuristic", "maritime_domain"), Found(*sub, "heuristic", "maritime_subdomain")


# --- stages -----------------------------------------------------------------------------------------------------------
HEURISTIC_FIELDS = ["title", "author", "organization", "date", "year", "report_id", "document_type", "maritime_document_type", "maritime_domain", "maritime_subdomain"]
METADATA_FIELDS = ["title", "author", "summary", "date", "year"]
_NONE = Found(None, 0.0, "none", "none")


def heuristic_stage(text: str | None, meta: dict) -> list[Found]:
    """EX-22: HEURISTIC_FIELDS in order."""
    low = (text or "")[: R.SIGNAL_CHARS].lower()
    organisation, day = find_organisation(text, meta), find_date(text, meta)
    year = year_in(day.value)
    dated = Found(year, day.confidence, day.source, "year_from_date") if year else _NONE
    return [find_title(text, meta), find_author(text, meta), organisation, day, dated, find_identifier(text, meta), find_generic_type(text, low), *find_domain_type(text, organisation, low)]


def metadata_stage(meta: dict) -> list[Found]:
    """EX-21: METADATA_FIELDS in order."""
    title, author, subject = ((meta.get(k) or "").strip() for k in ("title", "author", "subject"))
    day = best(embedded_dates(meta), "no_date_found")
    year = year_in(day.value)
    return [
        Found(title, 0.60, "metadata", "pdf_info_title") if title and not _GARBAGE_META.search(title.lower()) else _NONE,
        Found(author, 0.55, "metadata", "pdf_info_author") if len(author) > 2 else _NONE,
        Found(subject, 0.40, "metadata", "pdf_info_subject") if subject else _NONE,
        day if day.value else _NONE,
        Found(year, day.confidence, "metadata", "pdf_date_year") if year else _NONE,
    ]


def _meta(value) -> dict:
    return {} if value is None else dict(value)


_PARTS = [("value", T.StringType()), ("confidence", T.DoubleType()), ("source", T.StringType()), ("method", T.StringType())]


def _flat_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f"{n}_{part}", kind) for n in names for part, kind in _PARTS])


def _frame(rows: list[list[Found]], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([[x for f in row for x in f] for row in rows], columns=[f"{n}_{part}" for n in names for part, _ in _PARTS])


_STAGES = [f"h_{n}" for n in HEURISTIC_FIELDS] + [f"m_{n}" for n in METADATA_FIELDS]


@F.pandas_udf(_flat_schema(_STAGES))
def both_stages(texts: pd.Series, metas: pd.Series) -> pd.DataFrame:
    """Heuristic (h_) and metadata (m_) fields, flat: value, confidence, source and method of each."""
    return _frame([heuristic_stage(t, _meta(m)) + metadata_stage(_meta(m)) for t, m in zip(texts, metas)], _STAGES)


def single(name: str, find) -> object:
    """An Arrow function of (text, metadata) that gives the four parts of one field."""

    @F.pandas_udf(_flat_schema([name]))
    def one(texts: pd.Series, metas: pd.Series) -> pd.DataFrame:
        return _frame([[find(t, _meta(m))] for t, m in zip(texts, metas)], [name])

    return one


@F.pandas_udf(_flat_schema(["type", "domain", "subdomain"]))
def domain_types(texts: pd.Series, metas: pd.Series) -> pd.DataFrame:
    return _frame([list(find_domain_type(t, find_organisation(t, _meta(m)))) for t, m in zip(texts, metas)], ["type", "domain", "subdomain"])


def field_struct(prefix: str, name: str):
    """A field of both_stages' result, in column s, as one struct."""
    return F.struct(*[F.col(f"s.{prefix}_{name}_{part}").alias(part) for part, _ in _PARTS])
