"""Jobs and stage metrics (JB-1, MT-1) over tables: each step gives the table after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def create_job(jobs: DataFrame, state: DataFrame, job_id: str, source: str) -> DataFrame:
    """jobs with one more, running, that has all files of the state before it."""
    total, number = state.count(), jobs.agg(F.coalesce(F.max("started_seq"), F.lit(0)).alias("n")).first().n + 1
    row = jobs.sparkSession.createDataFrame([(job_id, source, number, total, 0, 0, "running")], "job_id string, source_path string, started_seq bigint, total_files bigint, processed_files bigint, error_count bigint, status string")
    return jobs.unionByName(row, allowMissingColumns=True)


def complete_job(jobs: DataFrame, state: DataFrame, job_id: str) -> DataFrame:
    """jobs with one complete: its counts are those of the state."""
    done = state.agg(F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "error").alias("failed")).first()
    here = F.col("job_id") == job_id
    return jobs.withColumns({"processed_files": F.when(here, F.lit(done.complete)).otherwise(F.col("processed_files")), "error_count": F.when(here, F.lit(done.failed)).otherwise(F.col("error_count")), "status": F.when(here, "complete").otherwise(F.col("status"))})


def latest_job(jobs: DataFrame) -> str | None:
    row = jobs.orderBy(F.desc("started_seq"), "job_id").select("job_id").first()
    return row.job_id if row else None


def log_metrics(path: str, metrics: DataFrame) -> None:
    """Append metrics(file_id, stage, duration_ms, memory_mb, method) to the table at path."""
    metrics.select("file_id", "stage", "duration_ms", "memory_mb", "method").write.mode("append").parquet(path)
