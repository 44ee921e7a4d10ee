"""DuckDB SQL that says in relational form what the Arrow functions of field extraction compute: candidates are rows, and ranked.

Nothing here is shared with the Spark side but the fixed values. RE2 knows word edges and blanks of ASCII only; where the rules
mean those of Unicode, letters beyond ASCII are written as underscores first, and other signs as semicolons.
"""

from __future__ import annotations

from ..functions import rules as R


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d(x: float) -> str:
    return f"{x!r}e0" if "e" not in repr(x) else repr(x)


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def _matches_any(x: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {q(p)})" for p in patterns) + ")"


def _pick(cands: str, nothing: str) -> str:
    """rid, value, confidence, source, method: the most confident candidate of each rid, the first of equals."""
    return f"""SELECT c.rid, c.file_id, b.value, coalesce(b.confidence, 0) AS confidence, coalesce(b.source, 'heuristic') AS source, coalesce(b.method, '{nothing}') AS method
FROM c LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY confidence DESC, ord) AS rn FROM ({cands}) k WHERE value IS NOT NULL AND value <> '') r WHERE rn = 1) b ON c.rid = b.rid"""


def _embedded_day(x: str) -> str:
    bare = f"regexp_replace(regexp_replace({trim(x)}, '^D:', ''), '(?s)[+\\-Z].*$', '')"
    full = f"CASE WHEN regexp_matches(left({bare}, 8), '^[0-9]{{8}}$') THEN try_strptime(left({bare}, 8), '%Y%m%d') END"
    year = f"CASE WHEN regexp_matches(left({bare}, 4), '^[0-9]{{4}}$') THEN try_strptime(left({bare}, 4) || '0101', '%Y%m%d') END"
    return f"strftime(CASE WHEN length({bare}) >= 8 THEN {full} WHEN length({bare}) >= 4 THEN {year} END, '%Y-%m-%d')"


def _meta_dates() -> str:
    rows = [f"SELECT rid, {i} AS ord, 0.6e0 AS confidence, {_embedded_day(f'pdf_metadata[{q(k)}]')} AS value, 'metadata' AS source, 'pdf_{k}' AS method FROM c" for i, k in enumerate(R.DATE_KEYS)]
    return " UNION ALL ".join(rows)


_STRPTIME = {"iso": "%Y-%m-%d", "us": "%m/%d/%Y", "eu": "%d.%m.%Y", "written_full": "%B %d %Y", "month_year": "%d %B %Y", "abbrev_dmy": "%d %b %Y", "abbrev_my": "%d %b %Y", "year_only": "%Y"}


def _text_dates(context: bool) -> str:
    """Matches in order with their places: the parts between matches give where each begins."""
    out = []
    for f, (name, base, pattern) in enumerate(R.DATE_FORMS):
        p = q("(?i)" + pattern)
        tidy = "lower(regexp_replace(m, '[-,\\s]+', ' ', 'g'))"
        read = {"iso": "m", "us": "m", "eu": "m", "written_full": tidy, "abbrev_dmy": tidy, "year_only": "m"}.get(name, f"'1 ' || {tidy}")
        boost = " + ".join(["0e0", *(f"CASE WHEN contains(near, {q(w)}) THEN {d(b)} ELSE 0e0 END" for w, b in R.DATE_CONTEXT.items())])
        confidence = f"least({d(base)} + ({boost}), 1e0)" if context else d(base)
        found = f"""SELECT rid, i, m, lower(substring(w, greatest(s - {R.DATE_WINDOW}, 0) + 1, least(s, {R.DATE_WINDOW}) + length(m) + {R.DATE_WINDOW})) AS near FROM
(SELECT rid, w, i, ms[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM
(SELECT rid, w, ms, gaps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT rid, w, regexp_extract_all(w, {p}, 0) AS ms, regexp_split_to_array(w, {p}) AS gaps FROM (SELECT rid, left(coalesce(raw_text, ''), {R.DATE_CHARS}) AS w FROM c) a) b) e) g"""
        day = f"try_strptime({read}, '{_STRPTIME[name]}')"
        value = f"strftime({day}, '{'%Y' if name == 'year_only' else '%Y-%m-%d'}')"
        out.append(f"SELECT rid, {(f + 1) * 100000} + i AS ord, {confidence} AS confidence, {value} AS value, 'heuristic' AS source, 'regex:{name}' AS method FROM ({found}) z WHERE year({day}) BETWEEN {R.DATE_YEARS[0]} AND {R.DATE_YEARS[1]}")
    return " UNION ALL ".join(out)


def _no_author(x: str) -> str:
    low = f"lower({trim(x)})"
    return f"(length({low}) < 3 OR length({low}) > 100 OR {_contains_any(low, R.AUTHOR_BLACKLIST + R.AUTHOR_SOFTWARE)} OR length(regexp_replace({low}, '[^\\p{{L}}\\s]', '', 'g')) / length({low}) < 0.7)"


def _normal_author(x: str) -> str:
    return f"regexp_replace(regexp_replace({trim(x)}, '\\s+', ' ', 'g'), '[.,;:]+$', '')"


def _authors() -> str:
    rows = []
    for i, key in enumerate(("author", "Author")):
        v = trim(f"pdf_metadata['{key}']")
        rows.append(f"SELECT rid, {i} AS ord, 0.7e0 AS confidence, {_normal_author(v)} AS value, 'metadata' AS source, 'pdf_info_author' AS method FROM c WHERE length({v}) > 2 AND NOT {_no_author(v)}")
    for i, (confidence, pattern) in enumerate(R.AUTHOR_FORMS, 1):
        if not pattern.startswith("(?m)"):
            pattern = "(?m)" + pattern
        names = f"SELECT rid, i, {trim('n[i]')} AS name FROM (SELECT rid, n, unnest(range(1, len(n) + 1)) AS i FROM (SELECT rid, regexp_extract_all(left(coalesce(raw_text, ''), {R.AUTHOR_CHARS}), {q(pattern)}, 1) AS n FROM c) a) b"
        rows.append(f"SELECT rid, {i * 10000} + i AS ord, {d(confidence)} AS confidence, {_normal_author('name')} AS value, 'heuristic' AS source, 'regex:author_pattern' AS method FROM ({names}) t WHERE length(name) > 3 AND length(name) < 100 AND NOT {_no_author('name')}")
    return " UNION ALL ".join(rows)


def _identifiers() -> str:
    rows = []
    for i, key in enumerate(("subject", "Subject", "keywords", "Keywords")):
        v = trim(f"pdf_metadata['{key}']")
        rows.append(f"SELECT rid, {i} AS ord, {d(R.IDENTIFIER_META_CONFIDENCE)} AS confidence, {v} AS value, 'metadata' AS source, 'pdf_{key}_as_id' AS method FROM c WHERE regexp_matches({v}, {q(R.IDENTIFIER_META)})")
    for i, (name, confidence, pattern) in enumerate(R.IDENTIFIER_FORMS, 10):
        rows.append(f"SELECT rid, {i} AS ord, {d(confidence)} AS confidence, {trim(f'regexp_extract(left(raw_text, {R.IDENTIFIER_CHARS}), {q(chr(40) + chr(63) + chr(105) + chr(41) + pattern)}, 1)')} AS value, 'heuristic' AS source, 'regex:{name}' AS method FROM c")
    return " UNION ALL ".join(rows)


def _organisations() -> str:
    """A join of texts and the table of names."""
    names = ", ".join(f"({i}, {q(n)}, {q(s)})" for i, (n, s) in enumerate(R.ORGANISATIONS))
    sources = [f"SELECT rid, {i} AS src, lower(pdf_metadata['{k}']) AS low, {d(R.ORG_META)} AS base, 'metadata' AS source FROM c" for i, k in enumerate(R.ORG_KEYS)]
    sources.append(f"SELECT rid, 9 AS src, lower(left(raw_text, {R.ORG_CHARS})) AS low, {d(R.ORG_TEXT)} AS base, 'heuristic' AS source FROM c")
    edge = "regexp_replace(low, '[^\\p{L}\\p{N}_]', ' ', 'g')"
    return f"""SELECT rid, src * 1000 + no AS ord, CASE WHEN length(name) <= 3 THEN base * {d(R.ORG_SHORT)} ELSE base END AS confidence, short AS value, source, 'org_match:' || name AS method
FROM (SELECT *, ' ' || {edge} || ' ' AS words FROM ({' UNION ALL '.join(sources)}) s WHERE low IS NOT NULL) t JOIN (VALUES {names}) AS o(no, name, short) ON contains(low, name) AND (length(name) > 3 OR contains(words, ' ' || name || ' '))"""


def _boilerplate(x: str) -> str:
    low = f"lower({trim(x)})"
    return f"(length({low}) < 5 OR {_contains_any(low, R.BOILERPLATE)})"


def _titles() -> str:
    t = "pdf_metadata['title']"
    rows = [f"SELECT rid, 0 AS ord, 0.65e0 AS confidence, {trim(t)} AS value, 'metadata' AS source, 'pdf_info_title' AS method FROM c WHERE length({t}) > 5 AND NOT {_matches_any(f'lower({trim(t)})', R.GARBAGE_TITLE)}"]
    for i, (confidence, pattern) in enumerate(R.TITLE_LABELS, 1):
        if not pattern.startswith("(?m)"):
            pattern = "(?m)" + pattern
        x = trim(f"regexp_extract(left(raw_text, 3000), {q(pattern)}, 1)")
        rows.append(f"SELECT rid, {i} AS ord, {d(confidence)} AS confidence, {x} AS value, 'heuristic' AS source, 'regex:title_label' AS method FROM c WHERE NOT {_boilerplate(x)}")
    lines = f"SELECT rid, i, {trim('l[i]')} AS line FROM (SELECT rid, l, unnest(range(1, least(len(l), 20) + 1)) AS i FROM (SELECT rid, string_split({trim('raw_text')}, chr(10)) AS l FROM c) a) b"
    rows.append(f"SELECT rid, 100 + i AS ord, 0.35e0 AS confidence, line AS value, 'heuristic' AS source, 'first_significant_line' AS method FROM ({lines}) t WHERE length(line) > 10 AND length(line) < 200 AND NOT {_boilerplate('line')}")
    return " UNION ALL ".join(rows)


def _types(table: dict) -> str:
    """rid, value, confidence of the highest score, the first of equals; a row for each text and type with a score."""
    plain = "regexp_replace(regexp_replace(low, '[\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g'), '[^\\p{L}\\p{N}\\x00-\\x7F]', ';', 'g')"
    plain = f"regexp_replace({plain}, '[^\\x00-\\x7F]', '_', 'g')"
    rows = []
    for i, (kind, signals) in enumerate(table.items()):
        score = " + ".join(f"CASE WHEN regexp_matches(p, {q('(?i)' + pattern)}) THEN {w} ELSE 0 END" for pattern, w in signals)
        rows.append(f"SELECT rid, {i} AS ord, {q(kind)} AS value, {score} AS score, {sum(w for _, w in signals)} AS most FROM t")
    return f"""SELECT rid, value, least(score / most * 0.85e0, 0.9e0) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, ord) AS rn FROM
(WITH t AS MATERIALIZED (SELECT rid, {plain} AS p FROM (SELECT rid, lower(left(raw_text, {R.SIGNAL_CHARS})) AS low FROM c WHERE coalesce(raw_text, '') <> '') l) {' UNION ALL '.join(rows)}) s WHERE score > 0) r WHERE rn = 1"""


def _typed(picked: str, fallback: float, method: str, none: str) -> str:
    return f"""SELECT c.rid, c.file_id, coalesce(b.value, 'other') AS value, CASE WHEN b.value IS NOT NULL THEN b.confidence WHEN coalesce(c.raw_text, '') <> '' THEN {d(fallback)} ELSE 0.1e0 END AS confidence, 'heuristic' AS source,
CASE WHEN b.value IS NOT NULL THEN '{method}' WHEN coalesce(c.raw_text, '') <> '' THEN '{none}' ELSE 'no_text' END AS method FROM c LEFT JOIN ({picked}) b ON c.rid = b.rid"""


_DOMAINS = ", ".join(f"({q(t)}, {q(dom)})" for t, dom in R.TYPE_DOMAIN.items())
_YEAR = "nullif(regexp_extract(value, '\\b((?:19|20)\\d{2})\\b', 1), '')"

C = "c AS MATERIALIZED (SELECT row_number() OVER () AS rid, file_id, raw_text, pdf_metadata FROM corpus)"
TITLE = f"title AS ({_pick(_titles(), 'no_title_found')})"
AUTHOR = f"author AS ({_pick(_authors(), 'no_author_found')})"
ORGANISATION = f"organization AS MATERIALIZED ({_pick(_organisations(), 'no_org_found')})"
DATE = f"day AS MATERIALIZED ({_pick(_meta_dates() + ' UNION ALL ' + _text_dates(True), 'no_date_found')})"
META_DATE = f"m_day AS MATERIALIZED ({_pick(_meta_dates(), 'no_date_found')})"
IDENTIFIER = f"report_id AS ({_pick(_identifiers(), 'no_id_found')})"
KIND = f"document_type AS ({_typed(_types(R.GENERIC), 0.1, 'doctype_signals', 'doctype_no_match')})"
DOMAIN = f"kind AS MATERIALIZED ({_typed(_types(R.DOMAIN), 0.15, 'maritime_signals', 'maritime_fallback')})"
DOMAIN_OF = f"kind_domain AS (SELECT k.rid, k.file_id, CASE WHEN k.method = 'maritime_signals' THEN coalesce(t.dom, 'general') ELSE 'general' END AS value, k.confidence, k.source, replace(k.method, 'maritime_signals', 'maritime_domain') AS method FROM kind k LEFT JOIN (VALUES {_DOMAINS}) AS t(name, dom) ON k.value = t.name)"
SUB = """kind_sub AS (SELECT k.rid, k.file_id, CASE WHEN k.method <> 'maritime_signals' THEN '' WHEN o.value IS NOT NULL THEN o.value ELSE string_split(k.value, '_')[1] END AS value,
CASE WHEN k.method <> 'maritime_signals' THEN 0e0 WHEN o.value IS NOT NULL THEN o.confidence ELSE 0.3e0 END AS confidence, k.source, replace(k.method, 'maritime_signals', 'maritime_subdomain') AS method FROM kind k JOIN organization o ON k.rid = o.rid)"""

_COLUMNS = "file_id, value, round(confidence, 6) AS confidence, source, method"


def _year_rows(day: str, source: str, method: str) -> str:
    return f"SELECT file_id, {_YEAR} AS value, CASE WHEN {_YEAR} IS NOT NULL THEN confidence ELSE 0e0 END AS confidence, CASE WHEN {_YEAR} IS NOT NULL THEN {source} ELSE 'none' END AS source, CASE WHEN {_YEAR} IS NOT NULL THEN '{method}' ELSE 'none' END AS method FROM {day}"


_H = {
    "title": "SELECT * EXCLUDE rid FROM title", "author": "SELECT * EXCLUDE rid FROM author", "organization": "SELECT * EXCLUDE rid FROM organization", "date": "SELECT * EXCLUDE rid FROM day", "year": _year_rows("day", "source", "year_from_date"),
    "report_id": "SELECT * EXCLUDE rid FROM report_id", "document_type": "SELECT * EXCLUDE rid FROM document_type", "maritime_document_type": "SELECT * EXCLUDE rid FROM kind", "maritime_domain": "SELECT * EXCLUDE rid FROM kind_domain", "maritime_subdomain": "SELECT * EXCLUDE rid FROM kind_sub",
}
_H_WITH = [C, TITLE, AUTHOR, ORGANISATION, DATE, IDENTIFIER, KIND, DOMAIN, DOMAIN_OF, SUB]


def _given(value: str, test: str, confidence: str, method: str) -> str:
    return f"SELECT file_id, CASE WHEN {test} THEN {value} END AS value, CASE WHEN {test} THEN {confidence} ELSE 0e0 END AS confidence, CASE WHEN {test} THEN 'metadata' ELSE 'none' END AS source, CASE WHEN {test} THEN '{method}' ELSE 'none' END AS method FROM c"


_MT, _MA, _MS = (trim(f"coalesce(pdf_metadata['{k}'], '')") for k in ("title", "author", "subject"))
_MK = "list_filter(list_transform(string_split(coalesce(pdf_metadata['keywords'], ''), ','), lambda x: trim(x)), lambda x: x <> '')[1:10]"
_M = {
    "title": _given(_MT, f"({_MT} <> '' AND NOT {_matches_any(f'lower({_MT})', R.GARBAGE_TITLE_META)})", "0.6e0", "pdf_info_title"),
    "author": _given(_MA, f"length({_MA}) > 2", "0.55e0", "pdf_info_author"),
    "summary": _given(_MS, f"{_MS} <> ''", "0.4e0", "pdf_info_subject"),
    "date": "SELECT file_id, value, confidence, CASE WHEN value IS NOT NULL THEN source ELSE 'none' END AS source, CASE WHEN value IS NOT NULL THEN method ELSE 'none' END AS method FROM m_day",
    "year": _year_rows("m_day", "'metadata'", "pdf_date_year"),
}
_M_WITH = [C, META_DATE]

# --- model responses
_FIX = "regexp_replace(regexp_replace({x}, ',\\s*}}', '}}', 'g'), ',\\s*\\]', ']', 'g')"
_FENCED = f"regexp_replace(regexp_replace({trim('raw')}, '^```\\w*\\n?', ''), '\\n?```\\s*$', '')"
_BLOCK = "regexp_extract(raw, '(?s)\\{[^{}]*(?:\\{[^{}]*\\}[^{}]*)*\\}', 0)"


def _body() -> str:
    shapes = [("true", "raw"), (f"starts_with({trim('raw')}, '```')", _FENCED), ("true", _BLOCK)]
    tries = [(test, y) for test, x in shapes for y in (x, _FIX.format(x=x))]
    return "CASE " + " ".join(f"WHEN {test} AND json_valid({x}) THEN {x}" for test, x in tries) + " END"


def _text(key: str) -> str:
    return f"nullif({trim(f'json_extract_string(body, {q(chr(36) + chr(46) + key)})')}, '')"


_LISTED = "CASE WHEN json_type(body, '$.keywords') = 'ARRAY' THEN list_transform(CAST(json_extract(body, '$.keywords') AS VARCHAR[]), lambda x: trim(x)) ELSE list_filter(list_transform(string_split(coalesce(json_extract_string(body, '$.keywords'), ''), ','), lambda x: trim(x)), lambda x: x <> '') END"
RESPONSES = f"r AS MATERIALIZED (SELECT file_id, vlm_model, {', '.join(f'{_text(k)} AS {k}' for k in R.RESPONSE_CONFIDENCE)}, {_LISTED}[1:10] AS keywords FROM (SELECT file_id, vlm_model, {_body()} AS body FROM (SELECT file_id, vlm_model, vlm_raw_response AS raw FROM documents_state WHERE vlm_raw_response IS NOT NULL) a) b)"
_R_YEAR = _YEAR.replace("value", "date")
_V = {k: f"SELECT file_id, {k} AS value, {d(c)} AS confidence, 'vlm' AS source, 'vlm:' || coalesce(vlm_model, 'none') AS method FROM r" for k, c in R.RESPONSE_CONFIDENCE.items()}
_V["year"] = f"SELECT file_id, {_R_YEAR} AS value, {d(R.RESPONSE_YEAR)} AS confidence, 'vlm' AS source, 'vlm:' || coalesce(vlm_model, 'none') AS method FROM r"

_COMPARED = "regexp_replace(regexp_replace(lower(" + trim("{x}") + "), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')"


def _merged() -> str:
    rows = []
    for field in R.ALL_FIELDS:
        for place, source in enumerate((_M, _V, _H)):
            if field in source:
                rows.append(f"SELECT DISTINCT file_id, '{field}' AS field, {place} AS place, value, confidence, source, method FROM ({source[field]}) x{place} WHERE value IS NOT NULL AND regexp_matches(value, '\\S')")
    fields = ", ".join(f"('{f}')" for f in R.ALL_FIELDS)
    same = f"({_COMPARED.format(x='one.value')} = {_COMPARED.format(x='two.value')} AND {_COMPARED.format(x='one.value')} <> '')"
    return f"""k AS ({' UNION ALL '.join(rows)}), n AS (SELECT *, row_number() OVER (PARTITION BY file_id, field ORDER BY confidence DESC, place) AS rn FROM k)
SELECT f.file_id, f.field, one.value, CASE WHEN one.value IS NULL THEN 0e0 WHEN coalesce({same}, false) THEN round(least(one.confidence + {d(R.AGREEMENT_BOOST)}, {d(R.AGREEMENT_CAP)}), 6) ELSE round(one.confidence, 6) END AS confidence,
CASE WHEN one.value IS NULL THEN 'none' WHEN coalesce({same}, false) THEN one.source || '+cross_validated' ELSE one.source END AS source, coalesce(one.method, 'no_candidates') AS method
FROM (SELECT file_id, field FROM (SELECT DISTINCT file_id FROM corpus) a, (VALUES {fields}) AS b(field)) f
LEFT JOIN n one ON f.file_id = one.file_id AND f.field = one.field AND one.rn = 1 LEFT JOIN n two ON f.file_id = two.file_id AND f.field = two.field AND two.rn = 2"""


def _with(parts: list[str], body: str) -> str:
    return "WITH " + ", ".join(parts) + " " + body


def _long(table: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT file_id, '{f}' AS field, value, round(confidence, 6) AS confidence, source, method FROM ({sql}) t_{f}" for f, sql in table.items())


_KEYWORDS = f"""k AS (SELECT DISTINCT file_id, 0 AS o, {d(R.RESPONSE_KEYWORD)} AS confidence, i, keywords[i] AS keyword FROM (SELECT file_id, keywords, unnest(range(1, len(keywords) + 1)) AS i FROM r) a
UNION ALL SELECT DISTINCT file_id, 2 AS o, 0.5e0 AS confidence, i, kw[i] AS keyword FROM (SELECT file_id, kw, unnest(range(1, len(kw) + 1)) AS i FROM (SELECT file_id, {_MK} AS kw FROM corpus) b) c),
f AS (SELECT *, row_number() OVER (PARTITION BY file_id, lower(keyword) ORDER BY o, i) AS seen FROM k)
SELECT file_id, CAST(place AS INT) AS place, keyword, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, o, i) AS place FROM f WHERE seen = 1) t WHERE place <= 10"""

_PAGES = f"""p AS (SELECT DISTINCT file_id, nullif(trim(pdf_metadata['title']), '') AS second FROM corpus)
SELECT one.file_id, coalesce(title, second) AS title, CASE WHEN title IS NOT NULL THEN 0.85e0 WHEN second IS NOT NULL THEN round(0.85e0 * {d(R.PAGE_TWO_FACTOR)}, 6) ELSE 0e0 END AS confidence,
CASE WHEN title IS NULL AND second IS NOT NULL THEN 'vlm:page2' ELSE 'vlm' END AS method, author FROM (SELECT DISTINCT file_id, title, author FROM r) one LEFT JOIN p ON one.file_id = p.file_id"""

_RESPONSE_COLUMNS = ", ".join(f"{k}, CASE WHEN {k} IS NOT NULL THEN {d(c)} ELSE 0e0 END AS {k}_confidence" for k, c in R.RESPONSE_CONFIDENCE.items())

SQL: dict[str, str] = {
    "date_best": _with([C], f"SELECT {_COLUMNS} FROM ({_pick(_meta_dates() + ' UNION ALL ' + _text_dates(False), 'no_date_found')}) t"),
    "date_context": _with([C], f"SELECT file_id, value, round(confidence, 6) AS confidence, method FROM ({_pick(_text_dates(True), 'none_found')}) t"),
    "author_best": _with([C, AUTHOR], f"SELECT {_COLUMNS} FROM author"),
    "report_id_best": _with([C, IDENTIFIER], f"SELECT {_COLUMNS} FROM report_id"),
    "org_detect": _with([C, ORGANISATION], f"SELECT {_COLUMNS} FROM organization"),
    "title_best": _with([C, TITLE], f"SELECT {_COLUMNS} FROM title"),
    "doctype_generic": _with([C, KIND], f"SELECT {_COLUMNS} FROM document_type"),
    "doctype_domain": _with([C, ORGANISATION, DOMAIN, DOMAIN_OF, SUB], "SELECT k.file_id, k.value, round(k.confidence, 6) AS confidence, m.value AS domain, s.value AS subdomain, round(s.confidence, 6) AS subdomain_confidence, k.method FROM kind k JOIN kind_domain m ON k.rid = m.rid JOIN kind_sub s ON k.rid = s.rid"),
    "heuristic_fields": _with(_H_WITH, _long(_H)),
    "metadata_fields": _with(_M_WITH, _long(_M) + f" UNION ALL SELECT file_id, 'keywords' AS field, CASE WHEN len(kw) > 0 THEN array_to_string(kw, '|') ELSE '' END AS value, CASE WHEN len(kw) > 0 THEN 0.5e0 ELSE 0e0 END, CASE WHEN len(kw) > 0 THEN 'metadata' ELSE 'none' END, CASE WHEN len(kw) > 0 THEN 'pdf_info_keywords' ELSE 'none' END FROM (SELECT file_id, {_MK} AS kw FROM c) t"),
    "vlm_parse": _with([RESPONSES], f"SELECT file_id, {_RESPONSE_COLUMNS}, {_R_YEAR} AS year, coalesce(array_to_string(keywords, '|'), '') AS keywords FROM r"),
    "merge_fields": _with([*_H_WITH, META_DATE, RESPONSES], ", " + _merged()).replace(") , k AS", "), k AS"),
    "keyword_merge": _with([RESPONSES], ", " + _KEYWORDS).replace(") , k AS", "), k AS"),
    "vlm_page_merge": _with([RESPONSES], ", " + _PAGES).replace(") , p AS", "), p AS"),
}
