"""Queries of the work queue, jobs, registration and numbering, as DataFrame programs; their DuckDB SQL is written apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality
from ..functions import rules as R
from ..operators import claims, jobs
from ..operators.numbering import numbered, numbered_within
from ..session import ship, spread, table


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents_state")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of documents as a state: all pending, with their quality."""
    ship(spark)
    docs = quality.with_quality(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")), "text")
    return docs.select(F.col("doc_id").alias("file_id"), F.lit("pending").alias("status"), F.round("text_quality", 6).alias("text_quality"), F.col("n_chars").alias("file_size"))


def claim_fast_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-2: the first file of the fast track (a top-k, not a sort)."""
    return claims.claim(_state(spark, sf_dir), "fast")[0].select("file_id", "text_quality")


def claim_fast_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-2: the state after ten files were claimed, counted by status."""
    return claims.claim(_state(spark, sf_dir), "fast", 10)[1].groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("n_files"))


def claim_model_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-3, over the texts of documents: the smallest of low quality."""
    return claims.claim(_scored(spark, sf_dir), "model", 5)[0].select("file_id", "text_quality", "file_size")


def fallback_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-4, SNK-6: the queue after the files on which a model failed were put back."""
    return claims.fallback_queue(claims.requeue_failed(_state(spark, sf_dir))).select("file_id", "original_path", "current_stage")


def register_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DD-2, J-4: of the corpus's files and of the documents' texts taken as files, those that the state does not hold."""
    corpus = table(spark, sf_dir, "corpus").select("file_id", "original_path", "file_size_bytes")
    text = F.col("text")
    identity = F.sha2(F.concat(F.left(text, F.lit(65536)), F.length(text).cast("string")), 256)
    docs = table(spark, sf_dir, "documents").where(text.isNotNull()).select(identity.alias("file_id"), F.concat(F.lit("/documents/"), F.col("doc_id").cast("string")).alias("original_path"), F.length(text).cast("bigint").alias("file_size_bytes"))
    return claims.register(_state(spark, sf_dir), corpus.unionByName(docs))


def work_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT-5: all pending files in one order: the fast track by falling quality, then the others by size."""
    state = _scored(spark, sf_dir).unionByName(_state(spark, sf_dir).select(F.xxhash64("file_id").alias("file_id"), "status", "text_quality", "file_size"))
    pending = state.where((F.col("status") == "pending") & F.col("text_quality").isNotNull()).select("file_id", "text_quality", "file_size").distinct()
    fast = F.col("text_quality") >= R.QUALITY_LOW
    rows = pending.withColumn("track", F.when(fast, 0).otherwise(1)).withColumn("key", F.when(fast, -F.col("text_quality")).otherwise(F.col("file_size")))
    return numbered(rows, [F.col("track"), F.col("key"), F.col("file_size"), F.col("file_id")]).select("track", "text_quality", "file_size", "place")


def rollback_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-5: executed operations undone in reverse, numbered within each job; a job of any size is spread."""
    ops = table(spark, sf_dir, "operations").where("executed = 1").select("job_id", "op_id", F.col("target_path").alias("source_path"), F.col("source_path").alias("target_path")).distinct()
    return numbered_within(ops, ["job_id"], [F.desc("op_id")])


def excel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3, W-2: the sheet's rows with their serial number."""
    from .reference import BUILD
    from .runner import run

    rows = run(spark, sf_dir, BUILD["export_label_rows"])
    return numbered(rows, [F.col("renamed_file"), F.col("original_location")], "serial").select("serial", "original_file", "renamed_file", "document_type", "confidence")


def job_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB-1: the jobs after a new one."""
    return jobs.create_job(table(spark, sf_dir, "jobs"), _state(spark, sf_dir), "job_new", "/intake").select("job_id", "source_path", "started_seq", "total_files", "processed_files", "error_count", "status")


def job_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JB-1: the jobs after the latest was completed."""
    all_jobs = table(spark, sf_dir, "jobs")
    return jobs.complete_job(all_jobs, _state(spark, sf_dir), jobs.latest_job(all_jobs) or "").select("job_id", "total_files", "processed_files", "error_count", "status")


def first_pages_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-8 over the recognised words: the first five pages joined, blank ones left out. Words of one page are one row, pages of one file five at most."""
    words = table(spark, sf_dir, "ocr_word").where(F.col("page") <= 5).distinct()
    pages = words.groupBy("file_id", "page").agg(F.array_sort(F.collect_list(F.struct("word_ord", "text"))).alias("w"))
    pages = pages.select("file_id", "page", F.array_join(F.transform("w", lambda x: F.coalesce(x["text"], F.lit(""))), " ").alias("text")).where(F.trim("text") != "")
    files = pages.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return files.select("file_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("head"), F.size("p").cast("bigint").alias("n_pages"))


QUERIES = {
    "claim_fast_top": claim_fast_top, "claim_fast_state": claim_fast_state, "claim_model_top": claim_model_top, "fallback_queue": fallback_queue, "register_new": register_new, "work_order": work_order, "rollback_plan": rollback_plan,
    "excel_rows": excel_rows, "job_create": job_create, "job_complete": job_complete, "first_pages_text": first_pages_text,
}

_LOW = R.QUALITY_LOW
_QUALITY = quality.oracle_sql()
_DOCS = f"SELECT d.doc_id AS file_id, q.text_quality, d.n_chars AS file_size FROM ({_QUALITY}) q JOIN documents d ON d.doc_id = q.doc_id"

SQL = {
    "claim_fast_top": f"SELECT file_id, text_quality FROM documents_state WHERE status = 'pending' AND text_quality >= {_LOW} ORDER BY text_quality DESC, file_id LIMIT 1",
    "claim_fast_state": f"""WITH t AS (SELECT file_id FROM (SELECT file_id, max(text_quality) AS q FROM documents_state WHERE status = 'pending' AND text_quality >= {_LOW} GROUP BY file_id) a ORDER BY q DESC, file_id LIMIT 10)
SELECT status, count(*) AS n, count(DISTINCT file_id) AS n_files FROM (SELECT file_id, CASE WHEN file_id IN (SELECT file_id FROM t) THEN 'processing' ELSE status END AS status FROM documents_state) s GROUP BY status""",
    "claim_model_top": f"SELECT file_id, text_quality, file_size FROM ({_DOCS}) s WHERE text_quality < {_LOW} ORDER BY file_size, file_id LIMIT 5",
    "fallback_queue": """SELECT file_id, original_path, CASE WHEN failed THEN 2 ELSE current_stage END AS current_stage FROM (SELECT *, status = 'error' AND extraction_strategy IN ('vlm_only', 'vlm_plus_heuristic') AS failed FROM documents_state) s
WHERE failed OR (extraction_strategy = 'fallback_pending' AND status = 'pending')""",
    "register_new": """SELECT file_id, min(original_path) AS original_path, arg_min(file_size_bytes, original_path) AS file_size_bytes FROM (SELECT file_id, original_path, file_size_bytes FROM corpus
UNION ALL SELECT sha256(left(text, 65536) || CAST(length(text) AS VARCHAR)), '/documents/' || CAST(doc_id AS VARCHAR), length(text) FROM documents WHERE text IS NOT NULL) f WHERE file_id NOT IN (SELECT file_id FROM documents_state) GROUP BY file_id""",
    "work_order": f"""SELECT track, text_quality, file_size, row_number() OVER (ORDER BY track, key, file_size) AS place FROM (SELECT CASE WHEN text_quality >= {_LOW} THEN 0 ELSE 1 END AS track, text_quality, file_size, CASE WHEN text_quality >= {_LOW} THEN -text_quality ELSE file_size END AS key
FROM (SELECT DISTINCT * FROM (SELECT CAST(file_id AS VARCHAR) AS file_id, text_quality, file_size FROM ({_DOCS}) a UNION ALL SELECT file_id, text_quality, file_size FROM documents_state WHERE status = 'pending' AND text_quality IS NOT NULL) u) v) w""",
    "rollback_plan": "SELECT job_id, op_id, target_path AS source_path, source_path AS target_path, row_number() OVER (PARTITION BY job_id ORDER BY op_id DESC) AS place FROM (SELECT DISTINCT job_id, op_id, source_path, target_path FROM operations WHERE executed = 1) t",
    "job_create": "SELECT job_id, source_path, started_seq, total_files, processed_files, error_count, status FROM jobs UNION ALL SELECT 'job_new', '/intake', (SELECT max(started_seq) + 1 FROM jobs), (SELECT count(*) FROM documents_state), 0, 0, 'running'",
    "job_complete": """WITH l AS (SELECT job_id FROM jobs ORDER BY started_seq DESC, job_id LIMIT 1), s AS (SELECT sum(CASE WHEN status = 'complete' THEN 1 ELSE 0 END) AS done, sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS failed FROM documents_state)
SELECT j.job_id, total_files, CASE WHEN l.job_id IS NOT NULL THEN s.done ELSE processed_files END AS processed_files, CASE WHEN l.job_id IS NOT NULL THEN s.failed ELSE error_count END AS error_count, CASE WHEN l.job_id IS NOT NULL THEN 'complete' ELSE status END AS status FROM jobs j LEFT JOIN l ON j.job_id = l.job_id, s""",
    "first_pages_text": """SELECT file_id, string_agg(text, chr(10) ORDER BY page) AS head, count(*) AS n_pages FROM (SELECT file_id, page, string_agg(coalesce(text, ''), ' ' ORDER BY word_ord, text) AS text FROM (SELECT DISTINCT file_id, page, word_ord, text, conf FROM ocr_word WHERE page <= 5) w GROUP BY file_id, page) p WHERE trim(text) <> '' GROUP BY file_id""",
}


def _excel() -> str:
    from ..functions.dialect import DUCK
    from .reference import BUILD

    rows = BUILD["export_label_rows"](DUCK).replace("@", "")
    return f"SELECT row_number() OVER (ORDER BY renamed_file, original_location) AS serial, original_file, renamed_file, document_type, confidence FROM ({rows}) t"


SQL["excel_rows"] = _excel()
