"""Queries of problem 1: mixed timestamp formats and time zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timestamps as T
from ..operators.timestamps import with_normal_form
from ..session import table


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct (file, date value) with its normal form; the zone and locale come from the file's job."""
    state = table(spark, sf_dir, "documents_state").select("file_id", "job_id", F.col("merged.date.value").alias("value"))
    jobs = table(spark, sf_dir, "jobs").select("job_id", "site_zone", "site_locale").dropDuplicates(["job_id"])
    joined = state.where(F.col("value").isNotNull()).join(jobs, "job_id", "left")
    return with_normal_form(joined, "value", "site_zone", "site_locale")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated(spark, sf_dir).where(F.col("normal_form").isNotNull()).select("file_id", "normal_form").distinct()


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values each form of the cascade reads, and how many stay unread."""
    out = dated(spark, sf_dir).groupBy(F.coalesce("normal_form_form", F.lit("unread")).alias("form"))
    return out.agg(F.count("*").alias("n_values"), F.countDistinct("value").alias("n_distinct"))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}

def _sql(select: str) -> str:
    """DuckDB SQL over dated values: each form's matches are rows, the first form of a value counts, its parts are read by arithmetic."""
    names = "y mo mon d h mi s ap off abb a b ep ems".split()
    forms = []
    for k, form in enumerate(T.FORMS):
        at = {part: i for i, part in enumerate(form.parts.split(), 1)}
        pattern = form.pattern.replace("'", "''")
        parts = ", ".join(f"regexp_extract(v, '{pattern}', {at[n]}) AS {n}" if n in at else f"'' AS {n}" for n in names)
        forms.append(f"SELECT rid, {k} AS ord, '{form.name}' AS form, {parts} FROM v WHERE regexp_matches(v, '{pattern}')")
    months = " ".join(f"WHEN lower(mon) IN ({', '.join(repr(w) for w in words.split())}) THEN {n}" for n, words in T.MONTHS.items())
    homonyms = " ".join(f"WHEN upper(abb) = '{a}' AND starts_with(zone, '{start}') THEN {m}" for (a, start), m in T.HOMONYMS.items())
    zones = " ".join(f"WHEN upper(abb) = '{a}' THEN {m}" for a, m in T.ABBREVIATIONS.items())
    digits = "regexp_replace(off, '[^0-9]', '', 'g')"
    hours, minutes = f"TRY_CAST(substring({digits}, 1, 2) AS INT)", f"TRY_CAST(substring({digits}, 3, 2) AS INT)"
    us = f"coalesce(locale IN ({', '.join(map(repr, T.MONTH_FIRST))}), false)"
    earlier = " ".join(f"WHEN (site - INTERVAL {m} MINUTE) AT TIME ZONE zone = wall THEN site - INTERVAL {m} MINUTE" for m in (60, 30))
    return f"""WITH j AS (SELECT job_id, any_value(site_zone) AS zone, any_value(site_locale) AS locale FROM jobs GROUP BY job_id),
v AS MATERIALIZED (SELECT row_number() OVER () AS rid, file_id, s.merged.date.value AS value, regexp_replace(s.merged.date.value, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g') AS v, coalesce(zone, 'UTC') AS zone, locale FROM documents_state s LEFT JOIN j ON s.job_id = j.job_id WHERE s.merged.date.value IS NOT NULL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY ord) AS rn FROM ({' UNION ALL '.join(forms)}) m) n WHERE rn = 1),
p AS (SELECT v.file_id, v.value, v.zone, form, TRY_CAST(y AS INT) AS y, CASE WHEN mon <> '' THEN (CASE {months} ELSE 0 END) WHEN a <> '' THEN TRY_CAST(CASE WHEN {us} THEN a ELSE b END AS INT) ELSE TRY_CAST(mo AS INT) END AS mo,
CASE WHEN a <> '' THEN TRY_CAST(CASE WHEN {us} THEN b ELSE a END AS INT) ELSE TRY_CAST(d AS INT) END AS d,
CASE WHEN ap <> '' THEN (CASE WHEN TRY_CAST(h AS INT) BETWEEN 1 AND 12 THEN TRY_CAST(h AS INT) % 12 + CASE WHEN lower(ap) = 'p' THEN 12 ELSE 0 END ELSE 99 END) ELSE TRY_CAST(h AS INT) END AS h, TRY_CAST(mi AS INT) AS mi, coalesce(TRY_CAST(s AS INT), 0) AS s,
CASE WHEN off <> '' THEN (CASE WHEN upper(off) = 'Z' THEN 0 WHEN {hours} <= 18 AND {minutes} < 60 THEN (CASE WHEN starts_with(off, '-') THEN -1 ELSE 1 END) * ({hours} * 60 + {minutes}) END) WHEN abb <> '' THEN (CASE {homonyms} {zones} END) END AS off, (off <> '' OR abb <> '') AS zoned,
coalesce(TRY_CAST(ep AS BIGINT), TRY_CAST(ems AS BIGINT) // 1000) AS ep FROM v LEFT JOIN f ON v.rid = f.rid),
t AS (SELECT *, TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}}', y, coalesce(mo, 1), coalesce(d, 1)) AS DATE) AS day, CASE WHEN h < 24 AND mi < 60 AND s < 60 THEN TRY_CAST(format('{{:04d}}-{{:02d}}-{{:02d}} {{:02d}}:{{:02d}}:{{:02d}}', y, mo, d, h, mi, s) AS TIMESTAMP) END AS wall FROM p),
u AS (SELECT *, wall AT TIME ZONE zone AS site FROM t),
i AS (SELECT *, CASE WHEN ep IS NOT NULL THEN to_timestamp(ep) WHEN day IS NULL OR y < 1 OR wall IS NULL THEN NULL WHEN zoned THEN (wall - to_minutes(off)) AT TIME ZONE 'UTC' WHEN site IS NULL THEN NULL ELSE (CASE {earlier} ELSE site END) END AS instant FROM u),
r AS (SELECT file_id, value, form, CASE WHEN ep IS NOT NULL OR h IS NOT NULL THEN strftime(instant AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') WHEN day IS NOT NULL AND y >= 1 THEN (CASE WHEN d IS NOT NULL THEN strftime(day, '%Y-%m-%d') WHEN mo IS NOT NULL THEN strftime(day, '%Y-%m') ELSE strftime(day, '%Y') END) END AS normal_form FROM i)
{select}"""


SQL = {
    "p1_found": _sql("SELECT DISTINCT file_id, normal_form FROM r WHERE normal_form IS NOT NULL"),
    "p1_forms": _sql("SELECT coalesce(CASE WHEN normal_form IS NOT NULL THEN form END, 'unread') AS form, count(*) AS n_values, count(DISTINCT value) AS n_distinct FROM r GROUP BY 1"),
}
