"""Rows written by hand for the SQL queries, small tables with nulls, ties and repeated rows; and every query on empty tables."""

import datetime as dt

import pytest

from paperloom import catalogue
from paperloom.functions import rules as R

_FIELD = "struct<value:string,confidence:double,source:string,extraction_method:string>"
_MERGED = "struct<" + ",".join(f"{f}:{_FIELD}" for f in R.ALL_FIELDS) + f",keywords:array<{_FIELD}>>"
_STATE = f"file_id string, job_id string, original_path string, file_size bigint, status string, current_stage int, text_quality double, extraction_strategy string, vlm_model string, vlm_raw_response string, ocr_text string, ocr_confidence double, merged {_MERGED}, canonical_name string, target_dir string, processing_ms bigint, error_message string, updated_at timestamp"


def merged(**values):
    out = {f: None for f in R.ALL_FIELDS}
    out.update({k: {"value": v, "confidence": c, "source": "s", "extraction_method": "m"} for k, (v, c) in values.items()})
    return {**out, "keywords": None}


def state_row(file_id, status="complete", path=None, quality=0.9, strategy="text_heuristic", fields=None, name=None, target=None, ms=10, stage=5, size=10, ocr=None, response=None, day=1):
    path = f"/in/{file_id}.pdf" if path is None else path
    return (file_id, "j1", path, size, status, stage, quality, strategy, "model", response, ocr, None, fields, name, target, ms, None, dt.datetime(2024, 1, day, tzinfo=dt.timezone.utc))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    state = [
        state_row("a", fields=merged(title=("Hull of the ship", 0.8), year=("2019", 0.6), document_type=("invoice", 0.7), author=("Smith, John et al.", 0.5)), name="same.pdf", target="/lib/x/", ms=10),
        state_row("b", fields=merged(document_type=("  ", 0.4), maritime_document_type=("class_rules", 0.5)), name="SAME.pdf", target="", strategy="vlm_only", quality=0.1, ms=30),
        state_row("b", fields=merged(document_type=("  ", 0.4), maritime_document_type=("class_rules", 0.5)), name="SAME.pdf", target="", strategy="vlm_only", quality=0.1, ms=30),
        state_row("c", fields=None, name=None, strategy=None, quality=None, ms=None),
        state_row("d", fields=merged(organization=("DNV", 0.7)), name="d.pdf", target="/in", strategy="something_else", quality=0.3, ms=20),
        state_row("e", status="pending", quality=0.7, strategy="ocr_heuristic", stage=2, ocr="ﬁrst line \t here\r\nbro-\nken\n\n\n\nend • "),
        state_row("f", status="error", strategy="vlm_plus_heuristic", quality=0.29, path="/in/.hidden/f.PDF"),
        state_row("g", status="processing", path="", quality=0.0, strategy="metadata_only", ocr=""),
    ]
    spark.createDataFrame(state, _STATE).write.parquet(f"{folder}/documents_state.parquet")
    corpus = [
        ("a", "/in/a.pdf", 1024, "one two\n\nthree " + "word " * 30, {"title": "untitled", "creationDate": "D:20190315120000+05'30'", "modDate": "2019"}, 3),
        ("a", "/in/a2.pdf", 1024, "x", {"title": "Confidential plan", "creationDate": "D:20191345"}, 3),
        ("b", "/in/.x/b.pdf", 1023, None, None, None),
        ("c", "/in/c.txt", 2_147_483_648, "", {}, 1),
    ]
    spark.createDataFrame(corpus, "file_id string, original_path string, file_size_bytes bigint, raw_text string, pdf_metadata map<string,string>, page_count int").write.parquet(f"{folder}/corpus.parquet")
    ops = [(1, "j1", "a", "move", "/in/a", "/out/a", 1, 1), (1, "j1", "a", "move", "/in/a", "/out/a", -1, 2), (2, "j1", "b", "move", "/in/b", "/out/b", 1, 1), (2, "j1", "b", "move", "/in/b", "/out/b", 1, 1), (3, "j1", None, "mkdir", None, "/out", 1, 1), (4, "j2", "z", "move", "/q", "/r", 0, 1)]
    spark.createDataFrame(ops, "op_id bigint, job_id string, file_id string, operation string, source_path string, target_path string, executed int, version bigint").write.parquet(f"{folder}/operations.parquet")
    spark.createDataFrame([("j1", "/s", 1, 9, 1, None, "running", "UTC", "en-US"), ("j2", "/t", 2, None, None, None, "complete", None, None)], "job_id string, source_path string, started_seq bigint, total_files bigint, processed_files bigint, error_count bigint, status string, site_zone string, site_locale string").write.parquet(f"{folder}/jobs.parquet")
    words = [("a", 1, 1, "Second", 90), ("a", 1, 0, "First", -1), ("a", 2, 0, "", 50), ("a", 6, 0, "late", 10), ("b", 1, 0, None, 0), ("a", 1, 1, "Second", 90)]
    spark.createDataFrame(words, "file_id string, page int, word_ord int, text string, conf int").write.parquet(f"{folder}/ocr_word.parquet")
    return str(folder)


def rows(spark, tables, name, *columns, distinct=False):
    df = catalogue.queries()[name](spark, tables).select(*columns)
    return sorted((tuple(r) for r in (df.distinct() if distinct else df).collect()), key=repr)


def test_routing(spark, tables):
    got = {r[0]: r[1:] for r in rows(spark, tables, "route_strategy", "file_id", "model_1_ocr_1", "model_0_ocr_1", "model_0_ocr_0", distinct=True)}
    assert got["a"] == ("text_heuristic",) * 3 and got["e"] == ("text_heuristic",) * 3  # 0.7 is high
    assert got["d"] == ("vlm_plus_heuristic", "text_heuristic", "text_heuristic") and got["f"] == ("vlm_only", "ocr_heuristic", "metadata_only") == got["c"]  # no quality is none
    assert rows(spark, tables, "claim_fast_top", "file_id", "text_quality") == [("e", 0.7)]
    assert rows(spark, tables, "claim_fast_state", "status", "n") == [("complete", 5), ("error", 1), ("processing", 2)]
    assert rows(spark, tables, "fallback_queue", "file_id", "current_stage") == [("f", 2)]
    assert dict(rows(spark, tables, "dispatch_by_strategy", "file_id", "branch", distinct=True)) == {"a": "text", "b": "model", "c": "text", "d": "text", "e": "scan", "f": "model", "g": "metadata"}


def test_folders_and_domains(spark, tables):
    year = dict(rows(spark, tables, "folder_year_type", "file_id", "folder", distinct=True))
    assert year["a"] == "2019/invoice/" and year["b"] == "unknown_year/uncategorised/" == year["c"]
    assert dict(rows(spark, tables, "folder_domain_type", "file_id", "folder", distinct=True))["a"] == "financial/invoice/" and dict(rows(spark, tables, "folder_domain_year", "file_id", "folder", distinct=True))["a"].endswith("2019/")
    assert dict(rows(spark, tables, "broad_domain", "file_id", "broad_domain", distinct=True)) == {"a": "financial", **dict.fromkeys("bcdefg", "academic")}


def test_statistics(spark, tables):
    assert rows(spark, tables, "progress_stats", "total", "n_pending", "n_processing", "n_complete", "n_error", "n_skipped") == [(8, 1, 1, 5, 1, 0)]
    assert rows(spark, tables, "timing_stats", "mean_ms", "max_ms") == [(22.5, 30)]
    assert dict(rows(spark, tables, "preview_tally", "label", "n")) == {"Heur": 1, "VLM": 2, "?": 1, "someth": 1}
    confidence = dict(rows(spark, tables, "mean_confidence", "file_id", "mean_confidence", distinct=True))
    assert confidence["a"] == 0.65 and confidence["b"] == 0.45 and confidence["c"] == 0.0
    assert dict(rows(spark, tables, "filled_fields", "file_id", "n_filled", distinct=True)) == {"a": 4, "b": 1, "c": 0, "d": 1, "e": 0, "f": 0, "g": 0}
    assert rows(spark, tables, "state_latest", "file_id", "status")[0] == ("a", "complete")


def test_names_and_plans(spark, tables):
    assert rows(spark, tables, "rename_plan", "file_id", "operation", "target_path") == [("a", "move", "/lib/x/same_02.pdf"), ("b", "rename", "/in/SAME.pdf")]  # d keeps its name, c has none
    assert rows(spark, tables, "rename_operations", "step", "operation", "target_path") == [(0, "mkdir", "/lib/x"), (1, "move", "/lib/x/same_02.pdf"), (1, "rename", "/in/SAME.pdf")]
    assert rows(spark, tables, "plan_summary", "total", "operations", "skipped", "errors", "dry_run") == [(4, 3, 2, 0, True)]
    assert rows(spark, tables, "export_label_rows", "original_file", "document_type") == [("a.pdf", "Other"), ("b.pdf", "Class Rules"), ("c.pdf", "Other"), ("d.pdf", "Other")]
    assert [r[0] for r in rows(spark, tables, "excel_rows", "serial")] == [1, 2, 3, 4]
    assert rows(spark, tables, "author_last_name", "last_name", "normal", "is_garbage") == [("Smith", "Smith, John et al", False)]


def test_operation_log(spark, tables):
    assert rows(spark, tables, "latest_op_state", "op_id", "executed", "version") == [(1, -1, 2), (2, 1, 1), (3, 1, 1), (4, 0, 1)]
    assert rows(spark, tables, "rollback_plan", "job_id", "op_id", "source_path", "place") == [("j1", 1, "/out/a", 3), ("j1", 2, "/out/b", 2), ("j1", 3, "/out", 1)]
    assert rows(spark, tables, "executed_documents", "file_id") == [("a",), ("b",)]
    assert rows(spark, tables, "job_progress", "job_id", "n_documents", "n_complete", "n_error") == [("j1", 8, 5, 1), ("j2", 0, 0, 0)]
    assert rows(spark, tables, "job_latest", "job_id") == [("j2",)]


def test_scans_and_recognition(spark, tables):
    assert rows(spark, tables, "size_filter_scan", "original_path") == [("/in/a.pdf",), ("/in/a2.pdf",), ("/in/c.txt",)]  # both bounds belong to the range
    assert rows(spark, tables, "path_filter_scan", "original_path") == [("/in/a.pdf",), ("/in/a2.pdf",)]
    assert rows(spark, tables, "exact_dedup", "file_id", "original_path", "n_copies") == [("a", "/in/a.pdf", 2), ("b", "/in/.x/b.pdf", 1), ("c", "/in/c.txt", 1)]
    assert dict(rows(spark, tables, "dpi_decision", "file_id", "dpi"))["b"] == 250 and sorted(r[1:] for r in rows(spark, tables, "dpi_decision", "file_id", "n_words", "dpi", "pages") if r[0] == "a") == [(1, 250, 2), (33, 200, 1)]
    assert rows(spark, tables, "first_pages_text", "file_id", "head", "n_pages") == [("a", "First Second", 1)]
    assert rows(spark, tables, "ocr_clean", "file_id", "text") == [("e", "first line here\nbroken\n\nend *"), ("g", "")]
    assert rows(spark, tables, "ocr_confidence", "file_id", "confidence", "n_pages") == [("a", 0.5, 3), ("b", None, 1)]
    assert rows(spark, tables, "pdf_date_parse", "date_key", "day") == [("creationDate", "2019-03-15"), ("creationDate", None), ("modDate", "2019-01-01")]
    assert rows(spark, tables, "title_boilerplate", "title", "is_boilerplate", "is_garbage") == [("Confidential plan", True, False), ("untitled", False, True)]


def emptied(spark, sf, folder):
    import os

    for name in os.listdir(sf):
        spark.read.parquet(f"{sf}/{name}").limit(0).coalesce(1).write.parquet(f"{folder}/{name}")
    return str(folder)


def test_every_query_on_empty_tables(spark, sf, tmp_path_factory):
    """Empty tables give empty results, or single rows of totals; nothing fails."""
    folder = emptied(spark, sf, tmp_path_factory.mktemp("empty"))
    totals = {"progress_stats", "timing_stats", "total_count", "plan_summary", "job_create", "export_summary", "folder_tree_counts"}
    for name, call in catalogue.queries().items():
        if name not in ("scan_one_file", "scan_files", "file_checksums"):  # these read files, not rows
            got = call(spark, folder).collect()
            assert not got or name in totals, (name, got[:2])
