"""DuckDB SQL for the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["p8_found"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
     b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
     wg AS (SELECT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
     bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM wg JOIN bg USING (g)
"""

SQL["p10_word_counts"] = r"""
SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+')) AS BIGINT) AS word_count,
       CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f\v]'))) AS BIGINT) AS line_count
FROM documents
"""

# Runs of equal diagonals of shared 12-word stretches: a run of k stretches is k + 11 words long.
SQL["p8_items"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
     b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark WHERE text IS NOT NULL),
     wg AS (SELECT doc_id, i, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
     bg AS (SELECT item_id, i AS j, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM b WHERE len(w) >= 12)),
     p AS (SELECT DISTINCT doc_id, item_id, i, i - j AS shift FROM wg JOIN bg USING (g)),
     r AS (SELECT doc_id, item_id, count(*) + 11 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS run FROM p) t GROUP BY doc_id, item_id, shift, run)
SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(n) AS longest_run FROM r GROUP BY item_id
"""
