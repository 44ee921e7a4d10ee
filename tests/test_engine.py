"""Scans, sinks, operation log, streaming, entry points."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.engine import Engine
from paperloom.functions.register import register_functions
from paperloom.operators import backends, oplog, scheduling
from paperloom.sources import config, exports
from paperloom.sources.scan import scan
from paperloom.streaming import streams


@pytest.fixture()
def folder(tmp_path):
    for name, body in {"b.pdf": b"x" * 2000, "a.pdf": b"x" * 2000, "c.pdf": b"y" * 3000, "small.pdf": b"z", "d.txt": b"w" * 2000, ".h.pdf": b"h" * 2000}.items():
        (tmp_path / name).write_bytes(body)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "e.pdf").write_bytes(b"e" * 2000)
    return tmp_path


def test_scan(spark, folder):
    got = sorted(r.original_path.rsplit("/", 1)[1] for r in scan(spark, str(folder)).collect())
    assert got == ["a.pdf", "c.pdf", "e.pdf"]
    assert scan(spark, str(folder), recursive=False).count() == 2
    assert scan(spark, str(folder / "small.pdf")).count() == 1 and scan(spark, str(folder / "d.txt")).count() == 0
    assert scan(spark, str(folder / "missing")).count() == 0
    assert all(len(r.file_id) == 64 for r in scan(spark, str(folder)).collect())


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[scanner]\nrecursive = false\nunknown = 1\n[nothing]\nx = 2\n')
    c = config.load(path)
    assert c.scanner.recursive is False and c.naming.max_length == 80
    path.write_text(config.dump(c))
    assert config.load(path) == c and config.load(None) == config.Config()


def test_exports(spark, sf, tmp_path):
    engine = Engine(spark, sf)
    made = engine.export("all", str(tmp_path / "out"))
    n = engine._run("export_csv_rows").count()
    assert spark.read.option("header", True).csv(made[0]).count() >= n > 0
    assert spark.read.json(made[1]).count() == n
    assert "| total |" in (tmp_path / "out.md").read_text()
    import zipfile

    assert zipfile.ZipFile(made[3]).read("xl/worksheets/sheet1.xml").count(b"<row") == n + 1
    sheet = zipfile.ZipFile(made[3]).read("xl/worksheets/sheet1.xml").decode()
    assert "Sr. No." in sheet and ">Other<" in sheet
    envelope = json.loads(open(exports.write_envelope(engine._run("export_csv_rows"), str(tmp_path / "all.json"))).read())
    assert envelope["total_documents"] == len(envelope["documents"]) == n and set(envelope["documents"][0]) == set(config.Export().excel_columns)
    with pytest.raises(ValueError):
        engine.export("odf", "x")


def test_apply_and_rollback(spark, tmp_path):
    (tmp_path / "a.pdf").write_text("a")
    (tmp_path / "b.pdf").write_text("b")
    rows = [("move", str(tmp_path / "a.pdf"), str(tmp_path / "new/x.pdf")), ("rename", str(tmp_path / "b.pdf"), str(tmp_path / "y.pdf"))]
    plan = spark.createDataFrame(rows, "operation string, source_path string, target_path string")
    log = tmp_path / "log.jsonl"
    assert oplog.apply_plan(plan, log)["executed"] == 0 and (tmp_path / "a.pdf").exists()
    assert oplog.apply_plan(plan, log, "j", dry_run=False) == {"total": 2, "executed": 2, "errors": 0, "dry_run": False}
    assert (tmp_path / "new/x.pdf").exists()
    assert oplog.rollback(log, "j") == 2 and (tmp_path / "a.pdf").exists() and not (tmp_path / "new").exists()
    bad = spark.createDataFrame([rows[0], ("move", str(tmp_path / "none.pdf"), str(tmp_path / "z.pdf"))], plan.schema).coalesce(1)
    assert oplog.apply_plan(bad, log, "k", dry_run=False)["errors"] == 1 and (tmp_path / "a.pdf").exists()
    assert len(oplog.file_checksum(tmp_path / "a.pdf")) == 64


def test_a_plan_of_any_size_is_undone_whole(spark, tmp_path):
    n = 1100
    for i in range(n):
        (tmp_path / f"{i}.pdf").write_text(str(i))
    rows = [("mkdir", "", str(tmp_path / "to"))] + [("move", str(tmp_path / f"{i}.pdf"), str(tmp_path / f"to/{i}.pdf")) for i in range(n)]
    rows.insert(1050, ("move", str(tmp_path / "missing.pdf"), str(tmp_path / "to/missing.pdf")))
    plan = spark.createDataFrame(rows, "operation string, source_path string, target_path string").coalesce(1)
    log = tmp_path / "log.jsonl"
    assert oplog.apply_plan(plan, log, "j", dry_run=False) == {"total": n + 2, "executed": 0, "errors": 1, "dry_run": False}
    assert len(list(tmp_path.glob("*.pdf"))) == n and not (tmp_path / "to").exists() and oplog.rollback(log, "j") == 0
    good = plan.where("source_path not like '%missing%'")
    assert oplog.apply_plan(good, log, "j", dry_run=False)["executed"] == n + 1
    (tmp_path / "5.pdf").mkdir()
    (tmp_path / "5.pdf" / "5.pdf").write_text("in the way")
    with pytest.raises(oplog.RollbackError):
        oplog.rollback(log, "j")
    left = len(list((tmp_path / "to").iterdir()))
    assert 0 < left < n  # what was undone is logged
    (tmp_path / "5.pdf" / "5.pdf").unlink()
    (tmp_path / "5.pdf").rmdir()
    assert oplog.rollback(log, "j") == left + 1 and not (tmp_path / "to").exists()


def test_remote_file_systems_and_heads(spark, folder):
    import hashlib

    (folder / "big.pdf").write_bytes(b"q" * 70_000 + b"tail")
    got = {r.original_path.rsplit("/", 1)[1]: r for r in scan(spark, f"file://{folder}").collect()}
    assert set(got) == {"a.pdf", "c.pdf", "e.pdf", "big.pdf"} and got["big.pdf"].file_id == hashlib.sha256(b"q" * 65_536 + b"70004").hexdigest()
    with pytest.raises(Exception, match="nosuchfs"):
        scan(spark, "nosuchfs://host/folder")  # never an empty answer for a file system that is not there


def test_claims_and_jobs(spark):
    from paperloom.operators import claims, jobs

    rows = [("a", "pending", 0.9, 5, "x", 1), ("b", "pending", 0.9, 3, "x", 1), ("c", "pending", 0.1, 9, "x", 1), ("d", "pending", 0.2, 2, "x", 1), ("e", "complete", 0.95, 1, "x", 5), ("f", "error", 0.1, 1, "vlm_only", 3), ("g", "pending", None, 1, "x", 1), ("a", "pending", 0.9, 5, "x", 1)]
    state = spark.createDataFrame(rows, "file_id string, status string, text_quality double, file_size bigint, extraction_strategy string, current_stage int")
    taken, after = claims.claim(state, "fast")
    assert [r.file_id for r in taken.collect()] == ["a"] and after.where("file_id = 'a' AND status = 'processing'").count() == 2 and after.where("status = 'processing'").count() == 2
    assert [r.file_id for r in claims.claim(after, "fast")[0].collect()] == ["b"] and [r.file_id for r in claims.claim(state, "model", 9)[0].collect()] == ["d", "c"]
    assert claims.claim(state.limit(0), "model")[0].count() == 0
    back = claims.requeue_failed(state)
    assert [(r.file_id, r.current_stage) for r in claims.fallback_queue(back).collect()] == [("f", 2)]
    found = spark.createDataFrame([("a", "/1", 1), ("z", "/3", 1), ("z", "/2", 2)], "file_id string, original_path string, file_size_bytes bigint")
    assert [tuple(r) for r in claims.register(state, found).collect()] == [("z", "/2", 2)]
    before = spark.createDataFrame([("j1", "/s", 1, 3, 0, 0, "running", "UTC")], "job_id string, source_path string, started_seq bigint, total_files bigint, processed_files bigint, error_count bigint, status string, site_zone string")
    now = jobs.create_job(before, state, "j2", "/t")
    assert jobs.latest_job(now) == "j2" and now.where("job_id = 'j2'").first().total_files == 8
    done = {r.job_id: r for r in jobs.complete_job(now, state, "j2").collect()}
    assert (done["j2"].status, done["j2"].processed_files, done["j2"].error_count, done["j1"].status) == ("complete", 1, 1, "running")


def test_numbering_is_total(spark):
    from paperloom.operators.numbering import numbered, numbered_within

    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("k")).repartition(7)
    rows = numbered(df, [F.desc("k"), F.col("id")]).collect()
    assert [r.place for r in sorted(rows, key=lambda r: (-r.k, r.id))] == list(range(1, 1001))
    within = numbered_within(df, ["g"], [F.desc("id")]).collect()
    for g in range(3):
        own = sorted((r for r in within if r.g == g), key=lambda r: -r.id)
        assert [r.place for r in own] == list(range(1, len(own) + 1))
    assert numbered(df.limit(0), [F.col("id")]).count() == 0


def test_logging_rotates(tmp_path):
    from paperloom import logs

    log = logs.set_up(tmp_path, "debug", console=False)
    logs.get("part").debug("a line")
    assert "a line" in (tmp_path / "paperloom.log").read_text() and log.handlers[0].maxBytes == 10 * 1024 * 1024
    assert len(logs.set_up(None, "info").handlers) == 1


def test_models_over_http(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            good = asked.get("model") != "broken"
            body = json.dumps({"response": "R " + asked["prompt"], "content": "C " + asked["prompt"]}).encode()
            self.send_response(200 if good else 500)
            self.end_headers()
            self.wfile.write(body if good else b"")

        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_port
    try:
        vlm = config.Vlm(model="broken", fallback_model="light", ollama_port=port, llamacpp_port=port)
        df = backends.with_prompt(spark.createDataFrame([("1", "A title", "x.pdf"), ("2", " ", None)], "id string, title string, name string"), {"title": "title"}, "name", "Q")
        out = {r.id: r for r in backends.completed(df, "id", "prompt", backends.factories(vlm)).collect()}
        assert out["1"].response == "R Q\ntitle: A title\nOriginal file name: x.pdf" and out["2"].response == "R Q" and out["1"].duration_ms >= 0
        vlm.runtime = "llamacpp"
        assert backends.factories(vlm)[0]().complete("p", b"png") == "C p" and backends.HttpModel("m", f"http://127.0.0.1:{port}").healthy()
        assert not backends.HttpModel("m", "http://127.0.0.1:9").healthy() and backends.factories(config.Vlm(enabled=False)) == []
    finally:
        server.shutdown()


def test_entry_without_the_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as entry
    from paperloom import catalogue

    monkeypatch.setitem(sys.modules, "paperloom.llm", None)
    assert set(entry.queries()) == set(catalogue.queries()) and set(entry.oracle_sql()) == set(catalogue.oracle_sql())


def test_rename_plan_targets_are_unique(spark, sf):
    plan = Engine(spark, sf).plan_renames()
    assert plan.first().operation == "mkdir"
    names = plan.where("operation <> 'mkdir'").withColumn("f", F.lower(F.element_at(F.split("target_path", "/"), -1)))
    assert names.groupBy("f").count().where("count > 1").count() == 0


def test_scheduling():
    assert scheduling.batch_config(4, 8, 100).workers == 3
    assert scheduling.batch_config(8, 16, 10, max_workers=4, model=True) == scheduling.BatchConfig(3, 10, int(16 * 1024 * 0.7))
    assert [scheduling.recommended_model(g) for g in (2, 4, 6, 12)] == ["none", "small", "medium", "large"]


def test_backends(spark):
    class Broken:
        def __init__(self):
            raise OSError("no model")

    df = spark.createDataFrame([("1", "hello"), ("2", "there")], "id string, prompt string")
    out = backends.completed(df, "id", "prompt", [Broken, backends.Echo]).collect()
    assert all(json.loads(r.response)["title"] and r.error is None for r in out)
    assert all(r.error for r in backends.completed(df, "id", "prompt", [Broken]).collect())


def test_functions_from_sql(spark):
    assert "date_candidates" in register_functions(spark)
    assert spark.sql("SELECT text_quality_signals('The vessel shall be built to the rules.').score").first()[0] > 0.5
    assert [r.value for r in spark.sql("SELECT * FROM date_candidates('2019-03-15 and 16.03.2019')").collect()][:2] == ["2019-03-15", "2019-03-16"]


def test_streams(spark, sf, tmp_path, folder):
    seen = streams.watch(spark, str(folder))
    q = streams.first_seen(seen, "file_id").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 4  # two equal files are one; the small one is one
    events = spark.read.parquet(f"{sf}/events.parquet")
    source = tmp_path / "events"
    events.write.parquet(str(source))
    live = streams.event_counts(spark.readStream.schema(events.schema).parquet(str(source)))
    q = live.writeStream.format("memory").outputMode("complete").queryName("windows").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == events.count()


def test_names_across_batches(spark, tmp_path):
    source, registry = tmp_path / "in", str(tmp_path / "registry")
    for k, rows in enumerate([[("f1", "a.pdf"), ("f2", "A.pdf")], [("f3", "a.pdf")]]):
        spark.createDataFrame(rows, "file_id string, canonical string").coalesce(1).write.mode("append").parquet(str(source))
        streams.name_batches(spark.readStream.schema("file_id string, canonical string").parquet(str(source)), registry, str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.final for r in spark.read.parquet(f"{registry}/names").collect()) == ["A.pdf", "a_02.pdf", "a_03.pdf"]


def test_names_past_ninety_nine_stay_apart(spark):
    rows = spark.createDataFrame([(f"f{i:03d}", "a.pdf") for i in range(120)], "file_id string, canonical string")
    named, counters = streams.numbered_names(rows, spark.createDataFrame([("a.pdf", 5), ("b.pdf", 7)], streams.COUNTERS))
    finals = [r.final for r in named.collect()]
    assert len(set(finals)) == 120 and {"a_06.pdf", "a_99.pdf", "a_100.pdf", "a_125.pdf"} <= set(finals)
    assert {(r.name_key, r.used) for r in counters.collect()} == {("a.pdf", 125), ("b.pdf", 7)}


def test_every_query_runs_on_the_smallest_tables(spark, sf):
    import __spark_entry__ as entry
    from paperloom import catalogue

    empty = {"date_context", "fuzzy_dates"}
    for name, call in catalogue.queries().items():
        rows = call(spark, sf).collect()
        assert rows or name in empty, name
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert entry.entry(spark).count() > 0
