"""The engine's entry points, and a small command line: scan, process, rename, organize, export, status, rollback, config."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logs
from .functions import quality
from .functions import rules as R
from .operators import claims, oplog
from .plans import fields, renames, state
from .plans.reference import BUILD, names_with
from .plans.runner import run
from .session import build_session, ship, spread, table
from .sources import config as settings
from .sources import exports
from .sources.scan import scan


class Engine:
    """Queries over a folder of tables (corpus, documents_state, operations, jobs) named as in the test data."""

    def __init__(self, spark: SparkSession, tables: str, config: settings.Config | None = None):
        self.spark, self.tables, self.config = spark, tables, config or settings.Config()

    def _run(self, name: str) -> DataFrame:
        return run(self.spark, self.tables, BUILD[name])

    def scan(self, folder: str) -> DataFrame:
        c = self.config.scanner
        return scan(self.spark, folder, tuple(c.file_patterns), c.recursive, c.skip_hidden, (c.min_file_size, c.max_file_size))

    def register(self, found: DataFrame | None = None) -> DataFrame:
        """Files of a scan (or of the corpus) that the state does not hold yet."""
        if found is None:
            found = table(self.spark, self.tables, "corpus").select("file_id", "original_path", "file_size_bytes")
        return claims.register(table(self.spark, self.tables, "documents_state"), found)

    def process(self) -> DataFrame:
        """file_id, quality, strategy and the merged fields as a map of structs: one scan of the corpus for quality, one for fields, a shuffle of narrow rows."""
        ship(self.spark)
        corpus = spread(table(self.spark, self.tables, "corpus").select("file_id", "raw_text"))
        scored = quality.with_quality(corpus, "raw_text").select("file_id", "text_quality").dropDuplicates(["file_id"])
        route = F.when(F.col("text_quality") >= R.QUALITY_HIGH, "text_heuristic").when(F.col("text_quality") >= R.QUALITY_LOW, "vlm_plus_heuristic" if self.config.vlm.enabled else "text_heuristic")
        low = "vlm_only" if self.config.vlm.enabled else "ocr_heuristic" if self.config.ocr.enabled else "metadata_only"
        merged = fields.merge_fields(self.spark, self.tables).groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("value", "confidence", "source", "method").alias("found")))).alias("merged"))  # fourteen fields
        return scored.withColumn("strategy", route.otherwise(low)).join(merged, "file_id")

    def names(self) -> DataFrame:
        """Canonical names by the configured template, separator, length and letters."""
        n = self.config.naming
        return run(self.spark, self.tables, names_with(n.default_template or R.DEFAULT_TEMPLATE, n.separator, n.max_length, n.lowercase, n.strip_accents))

    def claim(self, track: str, n: int = 1) -> tuple[DataFrame, DataFrame]:
        return claims.claim(table(self.spark, self.tables, "documents_state"), track, n)

    def plan_renames(self) -> DataFrame:
        """Operations in the order in which they are applied: folders first."""
        return renames.operations(table(self.spark, self.tables, "documents_state"), self.config.naming.collision_strategy).select("step", "operation", "source_path", "target_path").orderBy("step", "target_path")

    def plan_folders(self, strategy: str | None = None) -> DataFrame:
        name = f"folder_{strategy or self.config.organizer.strategy}"
        if name not in BUILD:
            raise ValueError(f"unknown folder strategy; there are {', '.join(R.FOLDER_STRATEGIES)}")
        return self._run(name)

    def preview(self) -> DataFrame:
        return self._run("preview_report")

    def status(self) -> dict[str, DataFrame]:
        return {n: self._run(n) for n in ("progress_stats", "strategy_breakdown", "timing_stats")}

    def rollback_plan(self, job_id: str | None = None) -> DataFrame:
        plan = state.rollback_plan(self.spark, self.tables)
        return plan.where(F.col("job_id") == job_id) if job_id else plan

    def export(self, fmt: str, path: str) -> list[str]:
        return exports.export(self._run("export_csv_rows"), fmt, path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="paperloom")
    p.add_argument("command", choices=["scan", "process", "rename", "organize", "export", "status", "rollback", "config"])
    p.add_argument("source", help="folder of files (scan) or of tables; for config the file to write")
    p.add_argument("--config")
    p.add_argument("--strategy")
    p.add_argument("--format", default="csv")
    p.add_argument("--output", default="export")
    p.add_argument("--job")
    p.add_argument("--log", default="operations.jsonl")
    p.add_argument("--execute", action="store_true")
    a = p.parse_args(argv)
    config = settings.load(a.config)
    log = logs.set_up(config.expanded().general.log_path if a.config else None, config.general.log_level)
    if a.command == "config":
        settings.save(config, a.source)
        return 0
    engine = Engine(build_session(), a.source, config)
    log.info("%s %s", a.command, a.source)
    if a.command == "scan":
        engine.scan(a.source).show(20, False)
    elif a.command == "process":
        engine.process().show(20)
    elif a.command == "rename":
        print(oplog.apply_plan(engine.plan_renames(), a.log, a.job or "manual", dry_run=not a.execute))
    elif a.command == "organize":
        engine.plan_folders(a.strategy).groupBy("folder").count().orderBy("folder").show(50, False)
    elif a.command == "export":
        print(*engine.export(a.format, a.output), sep="\n")
    elif a.command == "status":
        for name, df in engine.status().items():
            print(name)
            df.show()
    elif a.execute:
        print(oplog.rollback(a.log, a.job or "manual"))
    else:
        engine.rollback_plan(a.job).show(20, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
