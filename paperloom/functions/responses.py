"""Model responses: their JSON in the shapes that models write it, and the file name that a response suggests."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import once
from . import rules as R
from .fields import year_in

_BLOCK = re.compile(r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", re.S)


def _load(text: str):
    """The JSON value of a text, commas before a closing bracket forgiven; None if it is none."""
    for attempt in (text, re.sub(r",\s*]", "]", re.sub(r",\s*}", "}", text))):
        try:
            return json.loads(attempt)
        except ValueError:
            continue
    return None


def response_object(raw: str | None) -> dict:
    """ML-1: the object in a response: the whole of it, what stands in a fence, or the first brace block; empty if there is none."""
    raw = raw or ""
    bare = raw.strip()
    shapes = [lambda: raw]
    if bare.startswith("```"):
        shapes.append(lambda: re.sub(r"\n?```\s*$", "", re.sub(r"^```\w*\n?", "", bare)))
    if block := _BLOCK.search(raw):
        shapes.append(block.group)
    for shape in shapes:
        value = _load(shape())
        if value is not None:
            return value if isinstance(value, dict) else {}
    return {}


RESPONSE_FIELDS = list(R.RESPONSE_CONFIDENCE)


def response_values(raw: str | None) -> tuple[list[str | None], str | None, list[str]]:
    """ML-2: (values of RESPONSE_FIELDS, year of the date, at most ten keywords, given as a list or parted by commas)."""
    data = response_object(raw)
    values = [str(v).strip() or None if (v := data.get(k)) is not None else None for k in RESPONSE_FIELDS]
    given = data.get("keywords", "")
    words = [str(k).strip() for k in given if k] if isinstance(given, list) else [k.strip() for k in given.split(",") if k.strip()] if isinstance(given, str) else []
    return values, year_in(str(data["date"])) if data.get("date") else None, words[:10]


@F.pandas_udf(T.StructType([*[T.StructField(k, T.StringType()) for k in RESPONSE_FIELDS], T.StructField("year", T.StringType()), T.StructField("keywords", T.ArrayType(T.StringType()))]))
def response_fields(raws: pd.Series) -> pd.DataFrame:
    rows = [(*values, year, words) for values, year, words in map(response_values, raws)]
    return pd.DataFrame(rows, columns=[*RESPONSE_FIELDS, "year", "keywords"])


def with_suggested_name(df: DataFrame, raw: str, out: str = "suggested_name") -> DataFrame:
    """ML-3 in built-in expressions: add the file name that a response suggests.

    The first line inside a fence, without label, quotes, ending and signs that names cannot hold; words parted at blanks,
    hyphens and inner capitals, and, in a name of over 25 characters without any break, around known words; an acronym of
    the words that follow it and filler words are left out; at most 60 characters, cut at a break. Null gives an empty name.
    """
    rep = F.regexp_replace
    x = rep(rep(F.coalesce(raw, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)^```\w*\n?|\n?```\s*$", "")
    x = rep(F.split_part(x, F.lit("\n"), F.lit(1)), r"(?U)^\s+|\s+$", "")
    x = rep(rep(x, r"(?U)^(?:FILENAME|filename)[:\s]*|\s+$", ""), "^[\"'`]+|[\"'`]+$", "")
    x = rep(rep(rep(x, r"(?i)\.pdf$", ""), r'[<>:"/\\|?*]', ""), r"(?U)[\s\-]+", "_")
    step = df.withColumn("__x", once(rep(x, "([a-z])([A-Z])", "$1_$2")))
    mashed = (F.instr("__x", "_") == 0) & (F.length("__x") > 25)
    x = F.when(mashed, rep("__x", f"(?i)({R.FILE_WORDS})", "_$1_")).otherwise(F.col("__x"))
    step = step.withColumn("__parts", once(F.split(rep(F.lower(rep(x, "_+", "_")), "^_+|_+$", ""), "_")))
    step = step.withColumn("__name", once(_without_fillers(_without_acronyms(F.col("__parts")))))
    short = F.when(F.length("__name") <= 60, F.col("__name")).otherwise(rep(F.left("__name", F.lit(60)), "_[^_]*$", ""))
    return step.withColumn(out, short).drop("__x", "__parts", "__name")


def _without_acronyms(parts: Column) -> Column:
    def initials(i: Column, n: Column) -> Column:
        return F.array_join(F.transform(F.slice(parts, i + 2, n), lambda w: F.left(w, F.lit(1))), "")

    def kept(p: Column, i: Column) -> Column:
        n = F.length(p)
        named = n.between(2, 5) & F.regexp_like(p, F.lit(r"(?U)^\p{L}+$")) & (i + n < F.size(parts)) & (initials(i, n) == p)
        return ~named

    return F.when(F.size(parts) > 3, F.filter(parts, kept)).otherwise(parts)


def _without_fillers(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda p: ~p.isin(*R.FILLER_WORDS)), "_")
