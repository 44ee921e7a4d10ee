"""The work queue over a state table (file_id, status, text_quality, file_size, extraction_strategy, current_stage): claims and their effect.

A claim gives the claimed rows and the state after it; states are new snapshots, as tables of files have no update in place.
Empty queues claim nothing; rows without quality are in no queue; repeated rows of a file are claimed together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

#: Claims are small batches; more at once is a query of its own.
MOST = 10_000


def queue(state: DataFrame, track: str) -> DataFrame:
    """RT-2, RT-3: pending files of the fast track (best quality first) or of the model track (smallest first): file_id and the two orders."""
    if track not in ("fast", "model"):
        raise ValueError("a track is fast or model")
    pending = state.where(F.col("status") == "pending")
    part = pending.where(F.col("text_quality") >= R.QUALITY_LOW) if track == "fast" else pending.where(F.col("text_quality") < R.QUALITY_LOW)
    return part.groupBy("file_id").agg(F.max("text_quality").alias("text_quality"), F.min("file_size").alias("file_size"))


def claim(state: DataFrame, track: str, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """(claimed files, state with them processing)."""
    if n > MOST:
        raise ValueError(f"at most {MOST} files are claimed at once")
    first = F.desc("text_quality") if track == "fast" else F.asc("file_size")
    taken = queue(state, track).orderBy(first, "file_id").limit(n)
    marked = state.join(F.broadcast(taken.select("file_id").withColumn("__taken", F.lit(True))), "file_id", "left")
    return taken, marked.withColumn("status", F.when(F.col("__taken"), "processing").otherwise(F.col("status"))).drop("__taken")


def requeue_failed(state: DataFrame) -> DataFrame:
    """SNK-6: files on which a model failed go back to the queue, for heuristics alone."""
    failed = (F.col("status") == "error") & F.col("extraction_strategy").isin("vlm_only", "vlm_plus_heuristic")
    new = {"status": F.lit("pending"), "extraction_strategy": F.lit("fallback_pending"), "current_stage": F.lit(2)}
    return state.withColumns({c: F.when(failed, v).otherwise(F.col(c)) for c, v in new.items()})


def fallback_queue(state: DataFrame) -> DataFrame:
    """RT-4."""
    return state.where((F.col("extraction_strategy") == "fallback_pending") & (F.col("status") == "pending"))


def register(state_ids: DataFrame, found: DataFrame) -> DataFrame:
    """DD-2, J-4: of found(file_id, ...) the files that no row of the state has, once each (the first path of a file)."""
    fresh = found.join(state_ids.select("file_id").distinct(), "file_id", "left_anti")
    columns = [c for c in found.columns if c != "file_id"]
    return fresh.groupBy("file_id").agg(F.min(F.struct(*columns)).alias("s")).select("file_id", "s.*")
