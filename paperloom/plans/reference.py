"""The catalogue of SQL-checked queries: extraction, routing, merging, naming, statistics, reports, operation log."""

from __future__ import annotations

from ..functions import extract as X
from ..functions import naming as N
from ..functions import rules as R
from ..functions.dialect import Spark

BUILD: dict = {}


#: Queries whose expressions are worth spreading texts that come in few splits.
HEAVY = {"summary_quality_words", "dpi_decision", "file_identity"}


def register(f):
    BUILD[f.__name__] = f
    return f


# --- extraction: scalars of embedded metadata and of merged fields ---------------------------------------------------
@register
def title_boilerplate(d):
    """EX-18, EX-15: which embedded titles are boilerplate or made by software."""
    t = d.key("pdf_metadata", "title")
    return f"SELECT file_id, {t} AS title, {X.boilerplate(d, t)} AS is_boilerplate, {X.garbage_title(d, t)} AS is_garbage FROM @corpus WHERE {t} IS NOT NULL"


@register
def pdf_date_parse(d):
    """EX-3."""
    keys = [f"SELECT file_id, '{k}' AS date_key, {d.key('pdf_metadata', k)} AS raw FROM @corpus" for k in R.DATE_KEYS]
    return f"SELECT file_id, date_key, raw, {X.pdf_day(d, 'raw')} AS day FROM ({' UNION ALL '.join(keys)}) t WHERE raw IS NOT NULL"


@register
def year_from_date(d):
    """EX-4."""
    return f"SELECT file_id, merged.date.value AS date_value, {X.year_of(d, 'merged.date.value')} AS year FROM @documents_state"


@register
def author_last_name(d):
    """EX-8, EX-9 and EX-7."""
    a = "merged.author.value"
    return f"SELECT file_id, {a} AS author, {X.normal_author(d, a)} AS normal, {X.author_last(d, a)} AS last_name, {X.garbage_author(d, a)} AS is_garbage FROM @documents_state WHERE {a} IS NOT NULL"


@register
def summary_quality_words(d):
    """TQ-2: words of three letters and how many of them are common words."""
    words = d.extract_all("lower(coalesce(text, ''))", "[a-z]{3,}", 0)
    common = ", ".join(f"'{w}'" for w in R.COMMON_WORDS)
    return f"SELECT doc_id, {d.size('w')} AS n_words, {d.size(d.filter('w', f'x IN ({common})'))} AS n_common FROM (SELECT doc_id, {words} AS w FROM @documents) t"


# --- scans and identity ------------------------------------------------------------------------------------------------
@register
def file_identity(d):
    """SRC-4 over texts: hash of the first 65 536 characters and the size."""
    h = "sha2({}, 256)" if d.name == "spark" else "sha256({})"
    return f"SELECT doc_id, {h.format('concat(left(text, 65536), CAST(length(text) AS VARCHAR(20)))')} AS identity FROM @documents WHERE text IS NOT NULL"


@register
def size_filter_scan(d):
    """SRC-6: inclusive size bounds."""
    return f"SELECT file_id, original_path, file_size_bytes FROM @corpus WHERE file_size_bytes BETWEEN {R.SIZE_BOUNDS[0]} AND {R.SIZE_BOUNDS[1]}"


@register
def path_filter_scan(d):
    """SRC-3, SRC-5: the pattern *.pdf, and no part of the path that starts with a dot."""
    return f"SELECT file_id, original_path FROM @corpus WHERE {d.like('original_path', r'\.pdf$')} AND NOT {d.like('original_path', r'(^|/)\.[^/]')}"


@register
def dpi_decision(d):
    """SRC-9: resolution and pages to render by text density (base 200)."""
    return f"""SELECT file_id, n_words, CASE WHEN n_words > 100 THEN 150 WHEN n_words > 20 THEN 200 ELSE 250 END AS dpi, CASE WHEN n_words > 20 THEN least(1, p) ELSE least(2, p) END AS pages
FROM (SELECT file_id, {d.size(d.extract_all("coalesce(raw_text, '')", r'[^ \t\n\r\f\v]+', 0))} AS n_words, coalesce(page_count, 1) AS p FROM @corpus) t"""


@register
def exact_dedup(d):
    """DD-1: of files with the same identity the first path in order; counted as they are grouped, so copies of one file are no group in one task."""
    return "SELECT file_id, min(original_path) AS original_path, count(*) AS n_copies FROM @corpus GROUP BY file_id"


@register
def exact_text_dedup(d):
    """DD-1 over texts: one row per distinct text with its first document and its number of copies; grouped on a hash, so hot texts pre-aggregate."""
    h = "sha2(text, 256)" if d.name == "spark" else "sha256(text)"
    return f"SELECT {h} AS identity, min(doc_id) AS first_doc, count(*) AS n_copies FROM @documents WHERE text IS NOT NULL GROUP BY {h}"


# --- routing and claims --------------------------------------------------------------------------------------------------
def _route(q: str, model: bool, ocr: bool) -> str:
    low = "'vlm_only'" if model else "'ocr_heuristic'" if ocr else "'metadata_only'"
    middle = "'vlm_plus_heuristic'" if model else "'text_heuristic'"
    return f"CASE WHEN {q} >= {R.QUALITY_HIGH} THEN 'text_heuristic' WHEN {q} >= {R.QUALITY_LOW} THEN {middle} ELSE {low} END"


@register
def route_strategy(d):
    """RT-1: the decision table for each availability of model and text recognition."""
    cols = [f"{_route('coalesce(text_quality, 0)', m, o)} AS model_{int(m)}_ocr_{int(o)}" for m in (True, False) for o in (True, False)]
    return f"SELECT file_id, {', '.join(cols)} FROM @documents_state"


@register
def route_strategy_counts(d):
    """RT-1, AG-2."""
    s = _route("coalesce(text_quality, 0)", True, True)
    return f"SELECT {s} AS strategy, count(*) AS n, round(avg(text_quality), 6) AS mean_quality FROM @documents_state GROUP BY {s}"


@register
def claim_fast_top(d):
    """RT-2: the first document of the fast path (a top-k, not a sort)."""
    return f"SELECT file_id, text_quality FROM @documents_state WHERE status = 'pending' AND text_quality >= {R.QUALITY_LOW} ORDER BY text_quality DESC, file_id LIMIT 1"


@register
def dispatch_by_strategy(d):
    """RT-6: one branch of columns per strategy in one pass."""
    return """SELECT file_id, extraction_strategy, CASE WHEN extraction_strategy LIKE 'vlm%' THEN 'model' WHEN extraction_strategy LIKE 'ocr%' THEN 'scan' WHEN extraction_strategy = 'metadata_only' THEN 'metadata' ELSE 'text' END AS branch,
CASE WHEN extraction_strategy IN ('vlm_only', 'metadata_only') THEN 0 ELSE 1 END AS uses_text FROM @documents_state"""


@register
def batch_config(d):
    """SCH-1, SCH-4: of every job and each of a few machines (literals), workers, batch, memory and the model that fits."""
    cols = ["cores", "ram_gb", "fast_workers", "max_workers", "memory_mb", "model_workers"]
    machines = [(4, 8, 0, 0, 0, 1), (8, 16, 0, 4, 0, 1), (2, 4, 0, 0, 2048, 0), (1, 2, 0, 0, 0, 1), (16, 64, 6, 0, 0, 1)]
    grid = d.array(*(d.struct(**dict(zip(cols, map(str, m)))) for m in machines))
    each = f"explode({grid})" if d.name == "spark" else f"unnest({grid})"
    g = {c: f"g.{c}" for c in cols}
    workers = f"CASE WHEN {g['fast_workers']} > 0 THEN {g['fast_workers']} WHEN {g['max_workers']} > 0 THEN greatest(1, {g['max_workers']} - {g['model_workers']}) ELSE greatest(1, greatest(1, {g['cores']} - 1) - {g['model_workers']}) END"
    memory = f"CASE WHEN {g['memory_mb']} > 0 THEN {g['memory_mb']} ELSE CAST(floor({g['ram_gb']} * 1024 * 0.7) AS INT) END"
    model = f"CASE WHEN {g['ram_gb']} >= 10 THEN 'large' WHEN {g['ram_gb']} >= 6 THEN 'medium' WHEN {g['ram_gb']} >= 4 THEN 'small' ELSE 'none' END"
    return f"SELECT job_id, {g['cores']} AS cores, {g['ram_gb']} AS ram_gb, {workers} AS fast_workers, {workers} + {g['model_workers']} AS workers, least(100, coalesce(total_files, 0)) AS batch_size, {memory} AS memory_mb, {model} AS model FROM (SELECT job_id, total_files, {each} AS g FROM @jobs) t"


# --- merging ------------------------------------------------------------------------------------------------------------
@register
def filled_fields(d):
    """MG-6: filled fields of each record."""
    total = " + ".join(f"CASE WHEN {X.blank(d, f'merged.{f}.value')} THEN 0 ELSE 1 END" for f in R.ALL_FIELDS)
    return f"SELECT file_id, {total} AS n_filled FROM @documents_state"


@register
def prompt_hints(d):
    """ML-6: the known metadata that a prompt carries, and the original file name."""
    lines = [f"CASE WHEN {X.trimmed(d, f'merged.{f}.value')} <> '' THEN 'PDF metadata {f}: ' || merged.{f}.value END" for f in ("title", "author", "date")]
    return f"SELECT file_id, concat_ws(' | ', {', '.join(lines)}) AS hints, {d.last(d.split('original_path', '/'))} AS original_name FROM @documents_state"


@register
def ocr_clean(d):
    """OCR-1: character fixes, blanks, broken words, line ends."""
    x = "coalesce(ocr_text, '')"
    for old, new in R.OCR_FIXES:
        x = d.swap(x, old, new)
    x = d.replace(x, r"[ \t]+", " ")
    x = d.replace(x, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    x = d.replace(d.replace(x, r"\r\n", "\n"), r"\n{3,}", "\n\n")
    x = d.replace(d.replace(x, r"(?m)^[ \t]+", ""), r"(?m)[ \t]+$", "")
    return f"SELECT DISTINCT file_id, {X.trimmed(d, x)} AS text FROM @documents_state WHERE ocr_text IS NOT NULL"


@register
def ocr_confidence(d):
    """OCR-2: mean over pages of the mean of the known word confidences."""
    return "SELECT file_id, round(avg(page_conf) / 100, 6) AS confidence, count(*) AS n_pages FROM (SELECT file_id, page, avg(CASE WHEN conf > 0 THEN CAST(conf AS DOUBLE) END) AS page_conf FROM @ocr_word GROUP BY file_id, page) t GROUP BY file_id"


# --- names and folders --------------------------------------------------------------------------------------------------
def _names(d: Spark, template: str = R.CONFIG_TEMPLATE, separator: str = "_", length: int = R.NAME_LENGTH, lower: bool = True, accents: bool = False) -> str:
    v = ", ".join(f"{e} AS v_{k}" for k, e in N.variables(d, separator).items())
    return f"""v AS (SELECT DISTINCT file_id, original_path, target_dir, merged.maritime_document_type.value AS dtype, {v} FROM @documents_state),
f AS (SELECT file_id, original_path, target_dir, {N.raw_name(d, template, separator)} AS filled, {d.replace(d.last(d.split('original_path', '/')), r'(?i)\.pdf$')} AS stem FROM v),
g AS (SELECT *, CASE WHEN {X.trimmed(d, d.swap('filled', separator, ''))} <> '' THEN filled WHEN coalesce(stem, '') <> '' THEN stem ELSE left(file_id, 12) END AS raw FROM f),
n AS (SELECT file_id, original_path, target_dir, {N.sanitised(d, 'raw', length, lower, separator, accents)} || '.pdf' AS canonical FROM g)"""


def names_with(template: str, separator: str = "_", max_length: int = 80, lowercase: bool = True, strip_accents: bool = True):
    """NM-3, NM-6: the builder of canonical names by another template, separator, length or letters."""
    return lambda d: f"WITH {_names(d, template, separator, max_length - 4, lowercase, not strip_accents)} SELECT file_id, canonical FROM n"


@register
def custom_names(d):
    """NM-3, NM-6: names by a template of one's own, hyphens and at most forty characters."""
    return names_with("{year} {org} no {report_id} - {title_full}{nothing}", "-", 40)(d)


@register
def canonical_name(d):
    """NM-1 to NM-6."""
    return f"WITH {_names(d)} SELECT file_id, canonical FROM n"


@register
def suggested_name(d):
    """NM-7: a model's suggestion goes before the template's name."""
    return f"WITH {_names(d)}, s AS (SELECT DISTINCT file_id, {X.trimmed(d, 'vlm_raw_response')} AS r FROM @documents_state) SELECT n.file_id, CASE WHEN {d.like('r', '^[a-z0-9_]{5,60}$')} THEN r || '.pdf' ELSE canonical END AS canonical FROM n JOIN s ON n.file_id = s.file_id"


def _collision(d: Spark, strategy: str) -> str:
    stem = d.replace("canonical", r"\.pdf$")
    mark = "lpad(CAST(k AS VARCHAR(12)), greatest(2, CAST(length(CAST(k AS VARCHAR(12))) AS INT)), '0')" if strategy == "suffix" else "left(file_id, 8)"
    return f"SELECT *, CASE WHEN k = 1 THEN canonical ELSE {stem} || '_' || {mark} || '.pdf' END AS final FROM (SELECT *, row_number() OVER (PARTITION BY lower(canonical) ORDER BY canonical, file_id) AS k FROM n) t"


def collision_suffix(d):
    """NM-8 by number."""
    return f"WITH {_names(d)} SELECT file_id, final FROM ({_collision(d, 'suffix')}) t"


def collision_hash(d):
    """NM-8 by identity."""
    return f"WITH {_names(d)} SELECT file_id, final FROM ({_collision(d, 'hash')}) t"


@register
def sanitise_titles(d):
    """NM-5 over titles, whole."""
    return f"SELECT DISTINCT file_id, {N.sanitised(d, 'merged.title.value')} AS clean FROM @documents_state WHERE merged.title.value IS NOT NULL"


def _folder(strategy: str):
    def build(d):
        return f"SELECT file_id, {N.folder(d, strategy)} AS folder FROM @documents_state"

    build.__name__, build.__doc__ = f"folder_{strategy}", f"OR-1..5: folders by {strategy}."
    return register(build)


for _s in R.FOLDER_STRATEGIES:
    _folder(_s)


@register
def broad_domain(d):
    """OR-6."""
    t = "coalesce(merged.document_type.value, '')"
    return f"SELECT file_id, {t} AS document_type, {N.broad_domain(d, t)} AS broad_domain FROM @documents_state"


@register
def target_path(d):
    """OR-7."""
    return f"WITH {_names(d)}, p AS (SELECT DISTINCT file_id, {N.folder(d, 'year_type')} AS folder FROM @documents_state) SELECT n.file_id, '/library/' || p.folder || n.canonical AS target FROM n JOIN p ON n.file_id = p.file_id"


@register
def folder_tree_counts(d):
    """Extension: the folder tree's counts by rollup."""
    return f"SELECT year, kind, count(*) AS n FROM (SELECT {N.value('year')} AS year, {N.value('document_type')} AS kind FROM @documents_state) t GROUP BY ROLLUP (year, kind)"


# --- state, statistics, reports -----------------------------------------------------------------------------------------
@register
def state_pending(d):
    """SRC-11."""
    return "SELECT file_id, original_path, file_size FROM @documents_state WHERE status = 'pending'"


@register
def state_completed(d):
    """SRC-11, SO-1."""
    return "SELECT file_id, canonical_name, original_path FROM @documents_state WHERE status = 'complete' ORDER BY canonical_name, file_id"


@register
def state_latest(d):
    """SNK-6: of several versions of a record the latest wins."""
    if d.name == "spark":
        return "SELECT file_id, max_by(struct(status, current_stage), updated_at).status AS status, max_by(struct(status, current_stage), updated_at).current_stage AS current_stage FROM @documents_state GROUP BY file_id"
    return "SELECT file_id, arg_max({'status': status, 'current_stage': current_stage}, updated_at).status AS status, arg_max({'status': status, 'current_stage': current_stage}, updated_at).current_stage AS current_stage FROM documents_state GROUP BY file_id"


@register
def progress_stats(d):
    """AG-1; sums of an empty table are null."""
    sums = ", ".join(f"CAST(sum(CASE WHEN status = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{s}" for s in ("pending", "processing", "complete", "error", "skipped"))
    return f"SELECT count(*) AS total, {sums} FROM @documents_state"


@register
def strategy_breakdown(d):
    """AG-2."""
    return "SELECT extraction_strategy, count(*) AS n FROM @documents_state WHERE status = 'complete' GROUP BY extraction_strategy"


@register
def timing_stats(d):
    """AG-3."""
    return "SELECT round(coalesce(avg(CAST(processing_ms AS DOUBLE)), 0), 6) AS mean_ms, coalesce(max(processing_ms), 0) AS max_ms FROM @documents_state WHERE status = 'complete'"


@register
def total_count(d):
    """AG-4."""
    return "SELECT count(*) AS total FROM @documents_state"


@register
def method_summary(d):
    """AG-5: documents and mean of positive quality by method."""
    return "SELECT extraction_strategy AS method, count(*) AS n, round(coalesce(avg(CASE WHEN text_quality > 0 THEN text_quality END), 0), 3) AS mean_confidence FROM @documents_state GROUP BY extraction_strategy"


def _mean_confidence(d: Spark) -> str:
    parts = [f"coalesce(merged.{f}.confidence, 0)" for f in R.ALL_FIELDS]
    total, n = " + ".join(parts), " + ".join(f"CASE WHEN {p} > 0 THEN 1 ELSE 0 END" for p in parts)
    return f"CASE WHEN ({n}) > 0 THEN round(({total}) / ({n}), 6) ELSE CAST(0 AS DOUBLE) END"


@register
def mean_confidence(d):
    """AG-6."""
    return f"SELECT file_id, {_mean_confidence(d)} AS mean_confidence FROM @documents_state"


def _label() -> str:
    return "CASE " + " ".join(f"WHEN extraction_strategy = '{k}' THEN '{v}'" for k, v in R.STRATEGY_LABELS.items()) + " WHEN coalesce(extraction_strategy, '') = '' THEN '?' ELSE left(extraction_strategy, 6) END"


@register
def preview_tally(d):
    """AG-7, RP-2."""
    return f"SELECT {_label()} AS label, count(*) AS n FROM @documents_state WHERE status = 'complete' GROUP BY {_label()}"


def _preview(d: Spark) -> str:
    kind = f"CASE WHEN {N.value('maritime_document_type')} <> '' THEN {d.swap(N.value('maritime_document_type'), '_', ' ')} WHEN {N.value('document_type')} <> '' THEN {N.value('document_type')} ELSE 'other' END"
    return f"""SELECT DISTINCT {d.last(d.split('original_path', '/'))} AS original_name, original_path, canonical_name, target_dir, {kind} AS document_type, {N.value('organization')} AS organization, {N.value('author')} AS author,
{N.value('date')} AS date_value, {_mean_confidence(d)} AS confidence, {_label()} AS strategy, status FROM @documents_state WHERE status = 'complete'"""


@register
def preview_report(d):
    """RP-1, RP-3."""
    return _preview(d)


def _export(d: Spark) -> str:
    """RP-1: the eleven columns that are exported."""
    return f"""SELECT DISTINCT {d.last(d.split('original_path', '/'))} AS original_file, original_path AS original_location, coalesce(canonical_name, '') AS renamed_file, coalesce(target_dir, '') AS moved_to_location, {N.value('maritime_document_type')} AS document_type,
{N.value('organization')} AS organization, {N.value('author')} AS author, {N.value('date')} AS date, {_mean_confidence(d)} AS confidence, {_label()} AS extraction_method, status FROM @documents_state WHERE status = 'complete'"""


def export_label(d: Spark, x: str) -> str:
    """RP-3, export variant: the type with blanks and capitals; empty ones are Other."""
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'Other' ELSE {d.words_capital(d.swap(x, '_', ' '))} END"


@register
def export_csv_rows(d):
    """SNK-1: the relation that the CSV sink writes."""
    return f"SELECT * FROM ({_export(d)}) t ORDER BY renamed_file, original_location"


@register
def export_label_rows(d):
    """RP-3, SNK-3: the relation with type labels that the sheet shows."""
    return f"SELECT original_file, original_location, renamed_file, moved_to_location, {export_label(d, 'document_type')} AS document_type, organization, author, date, confidence, extraction_method, status FROM ({_export(d)}) t"


@register
def export_summary(d):
    """AG-5, SNK-3: the sheet's summary: documents and mean of positive confidences by method, and of all (method null)."""
    return f"SELECT extraction_method AS method, count(*) AS n, round(coalesce(avg(CASE WHEN confidence > 0 THEN confidence END), 0), 3) AS mean_confidence FROM ({_export(d)}) t GROUP BY ROLLUP (extraction_method)"


@register
def markdown_top20(d):
    """SNK-4, LM-1: the report's first twenty rows, cut to its column widths (the top-k is the feature)."""
    return f"SELECT left(original_file, 30) AS original_file, left(renamed_file, 35) AS renamed_file, left({export_label(d, 'document_type')}, 20) AS document_type FROM ({_export(d)}) t ORDER BY t.renamed_file, t.original_location LIMIT 20"


def rename_plan(d):
    """OP-1, OP-4: operations of the completed documents; identical names are skipped, clashing ones numbered."""
    folder = d.replace("original_path", r"/[^/]*$")
    return f"""WITH n AS (SELECT DISTINCT file_id, original_path, target_dir, canonical_name AS canonical FROM @documents_state WHERE status = 'complete' AND coalesce(canonical_name, '') <> '' AND coalesce(original_path, '') <> ''),
c AS ({_collision(d, 'suffix')}),
t AS (SELECT file_id, original_path AS source_path, {folder} AS source_dir, {d.replace("coalesce(nullif(target_dir, ''), " + folder + ")", '/+$')} AS dir, final FROM c)
SELECT file_id, CASE WHEN dir = source_dir THEN 'rename' ELSE 'move' END AS operation, source_path, dir || '/' || final AS target_path FROM t WHERE source_path <> dir || '/' || final"""


def rename_folders(d):
    """OP-1: folders to make, once each."""
    return f"SELECT {d.replace('target_path', r'/[^/]*$')} AS folder, count(*) AS n FROM ({rename_plan(d)}) p WHERE operation = 'move' GROUP BY {d.replace('target_path', r'/[^/]*$')}"


def rename_operations(d):
    """OP-1: all operations in order of kind: folders to make, once each, where no file lies in them yet, then the moves."""
    target = d.replace("target_path", r"/[^/]*$")
    held = f"SELECT DISTINCT {d.replace('original_path', r'/[^/]*$')} AS folder FROM @documents_state WHERE original_path IS NOT NULL"
    return f"""WITH p AS ({rename_plan(d)}), m AS (SELECT DISTINCT {target} AS folder FROM p)
SELECT 0 AS step, '' AS file_id, 'mkdir' AS operation, '' AS source_path, m.folder AS target_path FROM m {'LEFT ANTI' if d.name == 'spark' else 'ANTI'} JOIN ({held}) h ON m.folder = h.folder
UNION ALL SELECT 1 AS step, file_id, operation, source_path, target_path FROM p"""


def plan_summary(d):
    """OP-2: a dry run: completed files, operations, files left as they are, errors."""
    return f"SELECT (SELECT count(DISTINCT file_id) FROM @documents_state WHERE status = 'complete') AS total, count(*) AS operations, (SELECT count(DISTINCT file_id) FROM @documents_state WHERE status = 'complete') - sum(step) AS skipped, 0 AS errors, true AS dry_run FROM ({rename_operations(d)}) p"


@register
def latest_op_state(d):
    """OP-6: latest state of each operation of the append-only log."""
    f = "max_by(executed, version)" if d.name == "spark" else "arg_max(executed, version)"
    return f"SELECT op_id, {f} AS executed, max(version) AS version FROM @operations GROUP BY op_id"


@register
def executed_documents(d):
    """J-6: documents with executed operations."""
    return "SELECT DISTINCT s.file_id, s.canonical_name FROM @documents_state s {} JOIN (SELECT file_id FROM @operations WHERE executed = 1 AND file_id IS NOT NULL) o ON s.file_id = o.file_id".format("LEFT SEMI" if d.name == "spark" else "SEMI")


@register
def job_latest(d):
    """JB-1."""
    return "SELECT job_id, source_path, status FROM @jobs ORDER BY started_seq DESC, job_id LIMIT 1"


@register
def job_progress(d):
    """JB-1: jobs with the counts of their documents (pre-aggregated before the join)."""
    return """SELECT j.job_id, j.status, j.total_files, coalesce(s.n, 0) AS n_documents, coalesce(s.n_complete, 0) AS n_complete, coalesce(s.n_error, 0) AS n_error FROM @jobs j LEFT JOIN
(SELECT job_id, count(*) AS n, CAST(sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END) AS BIGINT) AS n_complete, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error FROM @documents_state GROUP BY job_id) s ON j.job_id = s.job_id"""


@register
def stage_metrics(d):
    """MT-1: durations by stage and method."""
    return "SELECT current_stage AS stage, extraction_strategy AS method, count(*) AS n, round(avg(CAST(processing_ms AS DOUBLE)), 6) AS mean_ms, max(processing_ms) AS max_ms FROM @documents_state GROUP BY current_stage, extraction_strategy"


@register
def metrics_log(d):
    """MT-1: the rows that stages write to the log of metrics."""
    return "SELECT DISTINCT file_id, current_stage AS stage, processing_ms AS duration_ms, coalesce(extraction_strategy, 'none') AS method FROM @documents_state WHERE processing_ms IS NOT NULL"


@register
def type_domain_join(d):
    """J-2: type to domain by a small dimension, as a join (45 fixed rows)."""
    rows = ", ".join(f"('{t}', '{dom}')" for t, dom in R.TYPE_DOMAIN.items())
    return f"SELECT coalesce(t.domain, 'general') AS domain, count(*) AS n FROM @documents_state s LEFT JOIN (VALUES {rows}) AS t(kind, domain) ON s.merged.maritime_document_type.value = t.kind GROUP BY coalesce(t.domain, 'general')"


@register
def event_windows(d):
    """ST-3 as a batch: events in five-minute windows."""
    start = "CAST(floor(unix_timestamp(CAST(ts AS TIMESTAMP)) / 300) * 300 AS BIGINT)" if d.name == "spark" else "CAST(floor(epoch(ts) / 300) * 300 AS BIGINT)"
    return f"SELECT {start} AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM @events GROUP BY {start}, event_type"
