"""File names, folders and their rules, as SQL expressions."""

from __future__ import annotations

import re

from . import rules as R
from .dialect import Spark
from .extract import author_last, trimmed


# Letters of other scripts that are written with several Latin letters, and with one.
LETTERS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th", "–": "-", "—": "--", "’": "'", "‘": "'", "“": '"', "”": '"', "…": "...",
    "ё": "io", "ж": "zh", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ь": "'", "ю": "iu", "я": "ia", "Ё": "Io", "Ж": "Zh", "Х": "Kh", "Ц": "Ts", "Ч": "Ch", "Ш": "Sh", "Щ": "Shch", "Ю": "Iu", "Я": "Ia",
    "θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "Θ": "Th", "Φ": "Ph", "Χ": "Kh", "Ψ": "Ps",
}
SINGLE = {
    "øØłŁđĐðÐıİ": "oOlLdDdDiI", "абвгдезийклмнопрстуфыэіґ": "abvgdeziiklmnoprstufyeig", "АБВГДЕЗИЙКЛМНОПРСТУФЫЭІҐ": "ABVGDEZIIKLMNOPRSTUFYEIG",
    "αβγδεζηικλμνξοπρσςτυωάέήίόύώϊϋ": "abgdezeiklmnxoprsstuoaeeiouoiu", "ΑΒΓΔΕΖΗΙΚΛΜΝΞΟΠΡΣΤΥΩΆΈΉΊΌΎΏ": "ABGDEZEIKLMNXOPRSTUOAEEIOUO",
}


def ascii_text(d: Spark, x: str) -> str:
    """Latin letters for Latin, Cyrillic and Greek ones; other scripts stay. Letters are replaced only in texts that hold some."""
    plain = f"translate({x}, {d.text(''.join(SINGLE))}, {d.text(''.join(SINGLE.values()))})"
    for old, new in LETTERS.items():
        plain = d.swap(plain, old, new)
    return f"CASE WHEN {d.like(x, '[^ -~]')} THEN {d.unaccent(plain)} ELSE {x} END"


def sanitised(d: Spark, x: str, length: int = R.NAME_LENGTH, lower: bool = True, separator: str = "_", accents: bool = False) -> str:
    """NM-5: a safe file name without ending; accents: letters beyond ASCII stay."""
    text = f"coalesce({x}, '')" if accents else ascii_text(d, f"coalesce({x}, '')")
    text = f"lower({text})" if lower else text
    text = d.replace(text, r'[<>:"/\\|?*\x00-\x1f]')
    text = d.replace(text, R.SEPARATORS, separator)
    end = re.escape(separator)
    if separator != "_":
        text = d.replace(text, f"(?:{end})+", separator)
    text = d.replace(text, f"^(?:{end})+|(?:{end})+$")
    text = d.replace(f"left({text}, {length})", f"(?:{end})+$")
    reserved = ", ".join(f"'{w}'" for w in R.RESERVED)
    return f"CASE WHEN lower({text}) IN ({reserved}) THEN {text} || '{separator}file' ELSE {text} END"


def value(field: str) -> str:
    return f"coalesce(merged.{field}.value, '')"


def variables(d: Spark, separator: str = "_") -> dict[str, str]:
    """NM-2: template variables of a merged record; empty text where there is no value."""
    words = d.filter(d.split(d.replace(trimmed(d, value("title")), r"\s+", " "), " "), "length(x) > 2")

    def filled(field: str) -> str:
        return f"CASE WHEN {trimmed(d, value(field))} <> '' THEN {value(field)} ELSE '' END"

    kind = f"CASE WHEN {trimmed(d, value('maritime_document_type'))} <> '' THEN {d.swap(value('maritime_document_type'), '_', ' ')} ELSE {filled('document_type')} END"
    return {
        "year": filled("year"), "date": d.swap(d.swap(filled("date"), "-", "_"), "/", "_"), "author_last": f"CASE WHEN {trimmed(d, value('author'))} <> '' THEN {author_last(d, value('author'))} ELSE '' END", "author_full": filled("author"),
        "title_short": d.join(d.slice(words, 4), separator), "title_full": filled("title"), "org": filled("organization"), "type": kind, "report_id": filled("report_id"),
        "vessel": filled("vessel_name"), "equipment": filled("equipment_name"),
    }


def filled_template(d: Spark, template: str, separator: str) -> str:
    """NM-3: the parts of a template that are not empty, joined: texts as they stand, variables from columns v_...; unknown ones are empty."""
    known = variables(d, separator)
    parts = [f"v_{p[1:-1]}" if p[1:-1] in known else "''" if p.startswith("{") and p.endswith("}") else d.text(p) for p in re.split(r"(\{[^}]+\})", template) if p]
    return d.join(d.filter(d.array(*parts), "x <> ''"), separator)


def raw_name(d: Spark, template: str = R.CONFIG_TEMPLATE, separator: str = "_") -> str:
    """NM-1: the filled template of the record's domain type, or of the configuration if it has none, before sanitising."""
    types: dict[str, list[str]] = {}
    for kind, own in R.TEMPLATES.items():
        types.setdefault(own, []).append(kind)
    branches = " ".join(f"WHEN dtype IN ({', '.join(map(repr, kinds))}) THEN {filled_template(d, own, separator)}" for own, kinds in types.items())
    return f"CASE WHEN coalesce(dtype, '') = '' THEN {filled_template(d, template, separator)} {branches} ELSE {filled_template(d, R.DEFAULT_TEMPLATE, separator)} END"


def folder(d: Spark, strategy: str) -> str:
    """Relative folder with a slash at its end."""
    if strategy not in R.FOLDER_STRATEGIES:
        raise ValueError(f"unknown folder strategy {strategy}; there are {', '.join(R.FOLDER_STRATEGIES)}")
    year = f"CASE WHEN {trimmed(d, value('year'))} <> '' THEN {value('year')} ELSE 'unknown_year' END"
    kind = f"CASE WHEN {trimmed(d, value('document_type'))} <> '' THEN {sanitised(d, value('document_type'), 200, lower=False)} ELSE 'uncategorised' END"
    low = f"lower(CASE WHEN {trimmed(d, value('document_type'))} <> '' THEN {value('document_type')} ELSE '' END)"
    domain = f"{broad_domain(d, low)} || '/' || CASE WHEN {low} <> '' THEN {sanitised(d, low, 200, lower=False)} ELSE 'other' END || '/'"
    return {"year": f"{year} || '/'", "type": f"{kind} || '/'", "year_type": f"{year} || '/' || {kind} || '/'", "domain_type": domain, "domain_year": f"{domain} || {year} || '/'"}[strategy]


def broad_domain(d: Spark, x: str) -> str:
    """First domain one of whose words holds the type or is held by it; an empty type is held by every word."""
    t = f"lower({trimmed(d, x)})"
    branches = []
    for domain, words in R.BROAD_DOMAINS.items():
        tests = " OR ".join(f"contains({t}, '{w}') OR contains('{w}', {t})" for w in words.split())
        branches.append(f"WHEN {tests} THEN '{domain}'")
    return "CASE " + " ".join(branches) + " ELSE 'general' END"
