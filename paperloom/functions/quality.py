"""Text quality: the mean of the signals present (entropy, common words, white space, line lengths) as an Arrow function."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R

_WORDS = re.compile("[a-z]{3,}")
_COMMON = frozenset(R.COMMON_WORDS)


def signals(text: str | None) -> tuple[float, float | None, float | None, float | None, float | None]:
    """(score, entropy, common words, white space, line lengths); a signal that a text cannot give is None and not counted."""
    if not text or len(text.strip()) < 10:
        return 0.0, None, None, None, None
    n = len(text)
    entropy = min(-sum(c / n * math.log2(c / n) for c in Counter(text).values()) / 4.5, 1.0)
    words = _WORDS.findall(text.lower())
    common = min(sum(w in _COMMON for w in words) / len(words) * 2.5, 1.0) if words else None
    white = max(1 - 5 * abs((text.count(" ") + text.count("\n")) / n - 0.15), 0.0)
    lines = [len(x) for x in text.split("\n") if len(x.strip()) > 5]
    lengths = None
    if len(lines) >= 3:
        lines = lines[:50]
        mean = sum(lines) / len(lines)
        if mean > 10:
            lengths = max(0.0, 1 - math.sqrt(sum((x - mean) ** 2 for x in lines) / (len(lines) - 1)) / mean)
    present = [s for s in (entropy, common, white, lengths) if s is not None]
    return sum(present) / len(present), entropy, common, white, lengths


_SIGNALS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "entropy", "common", "white", "lengths")])


@F.pandas_udf(_SIGNALS)
def quality_signals(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([signals(t) for t in texts], columns=["score", "entropy", "common", "white", "lengths"], dtype="float64")


def with_quality(df: DataFrame, text: str, out: str = "text_quality") -> DataFrame:
    """TQ-0 to TQ-5: add the score of the column text; null and texts under ten characters score 0."""
    return df.withColumn(out, quality_signals(F.col(text)).getField("score"))


def oracle_sql() -> str:
    """The same score in DuckDB SQL over documents."""
    common = ", ".join(f"'{w}'" for w in R.COMMON_WORDS)
    return f"""
WITH t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10),
ch AS (SELECT doc_id, n, unnest(regexp_extract_all(text, '(?s).')) AS c FROM t),
cc AS (SELECT doc_id, n, c, count(*) AS k FROM ch GROUP BY doc_id, n, c),
en AS (SELECT doc_id, least(-sum(k / n * log2(k / n)) / 4.5, 1) AS entropy FROM cc GROUP BY doc_id),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM t),
wc AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN least(len(list_filter(w, lambda x: x IN ({common}))) / len(w) * 2.5, 1) END AS common FROM w),
ws AS (SELECT doc_id, greatest(1 - 5 * abs(length(regexp_replace(text, '[^ \\n]', '', 'g')) / n - 0.15), 0) AS white FROM t),
li AS (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) > 5), lambda x: length(x)) AS l FROM t),
ls AS (SELECT doc_id, CASE WHEN len(l) >= 3 AND list_avg(l[1:50]) > 10 THEN greatest(0, 1 - list_stddev_samp(l[1:50]) / list_avg(l[1:50])) END AS lengths FROM li)
SELECT d.doc_id, round(coalesce((entropy + white + coalesce(common, 0) + coalesce(lengths, 0)) / (2 + CASE WHEN common IS NULL THEN 0 ELSE 1 END + CASE WHEN lengths IS NULL THEN 0 ELSE 1 END), 0), 6) AS text_quality
FROM documents d LEFT JOIN en ON d.doc_id = en.doc_id LEFT JOIN wc ON d.doc_id = wc.doc_id LEFT JOIN ws ON d.doc_id = ws.doc_id LEFT JOIN ls ON d.doc_id = ls.doc_id
"""
