"""Names without collisions and the plan of renames. Equal names are numbered by one sort of all rows, so a name that a third of
all files share is no group in one task. The DuckDB SQL is that of plans.reference, where windows number each name's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCK
from ..operators.numbering import numbered_within
from ..session import cut, table
from . import reference
from .runner import run


def without_collisions(names: DataFrame, strategy: str = "suffix") -> DataFrame:
    """NM-8: names(file_id, canonical, ...) with final: the first of equal names (ignoring case) keeps it, the others get their number or the start of their identity."""
    if strategy not in ("suffix", "hash"):
        raise ValueError("a strategy is suffix or hash")
    rows = numbered_within(names.withColumn("__key", F.lower("canonical")), ["__key"], [F.col("canonical"), F.col("file_id")], "__k").drop("__key")
    number = F.col("__k").cast("string")
    mark = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number) if strategy == "suffix" else F.left("file_id", F.lit(8))
    stem = F.regexp_replace("canonical", r"\.pdf$", "")
    return rows.withColumn("final", F.when(F.col("__k") == 1, F.col("canonical")).otherwise(F.concat(stem, F.lit("_"), mark, F.lit(".pdf")))).drop("__k")


def collision_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM-8 by number."""
    return without_collisions(run(spark, sf_dir, reference.canonical_name)).select("file_id", "final")


def collision_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NM-8 by identity."""
    return without_collisions(run(spark, sf_dir, reference.canonical_name), "hash").select("file_id", "final")


def moves(state: DataFrame, strategy: str = "suffix") -> DataFrame:
    """OP-1, OP-4: file_id, operation, source_path, target_path of completed files; identical names are skipped, clashing ones numbered."""
    done = state.where((F.col("status") == "complete") & (F.col("canonical_name") != "") & (F.col("original_path") != ""))
    named = without_collisions(done.select("file_id", "original_path", "target_dir", F.col("canonical_name").alias("canonical")).distinct(), strategy)
    source_dir = F.regexp_replace("original_path", "/[^/]*$", "")
    folder = F.regexp_replace(F.coalesce(F.nullif("target_dir", F.lit("")), source_dir), "/+$", "")
    rows = named.select("file_id", F.when(folder == source_dir, "rename").otherwise("move").alias("operation"), F.col("original_path").alias("source_path"), F.concat(folder, F.lit("/"), "final").alias("target_path"))
    return rows.where(F.col("source_path") != F.col("target_path"))


def operations(state: DataFrame, strategy: str = "suffix") -> DataFrame:
    """OP-1: all operations: step 0 the folders to make, once each, where no file lies in them yet; step 1 the moves."""
    plan = cut(moves(state, strategy))
    folders = plan.select(F.regexp_replace("target_path", "/[^/]*$", "").alias("folder")).distinct()
    held = state.where(F.col("original_path").isNotNull()).select(F.regexp_replace("original_path", "/[^/]*$", "").alias("folder")).distinct()
    made = folders.join(held, "folder", "left_anti").select(F.lit(0).alias("step"), F.lit("").alias("file_id"), F.lit("mkdir").alias("operation"), F.lit("").alias("source_path"), F.col("folder").alias("target_path"))
    return made.unionByName(plan.withColumn("step", F.lit(1)))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents_state").select("file_id", "status", "original_path", "target_dir", "canonical_name")


def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moves(_state(spark, sf_dir))


def rename_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-1: folders that files move to, with their counts."""
    moved = moves(_state(spark, sf_dir)).where(F.col("operation") == "move")
    return moved.groupBy(F.regexp_replace("target_path", "/[^/]*$", "").alias("folder")).agg(F.count("*").alias("n"))


def rename_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return operations(_state(spark, sf_dir))


def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-2: a dry run: completed files, operations, files left as they are, errors."""
    state = _state(spark, sf_dir)
    done = state.where(F.col("status") == "complete").agg(F.countDistinct("file_id").alias("total"), F.lit(0).cast("bigint").alias("operations"), F.lit(0).cast("bigint").alias("moved"))
    planned = operations(state).agg(F.lit(0).cast("bigint").alias("total"), F.count("*").alias("operations"), F.coalesce(F.sum("step"), F.lit(0)).alias("moved"))
    both = done.unionByName(planned).agg(*[F.sum(c).alias(c) for c in ("total", "operations", "moved")])
    return both.select("total", "operations", (F.col("total") - F.col("moved")).alias("skipped"), F.lit(0).alias("errors"), F.lit(True).alias("dry_run"))


QUERIES = {f.__name__: f for f in (collision_suffix, collision_hash, rename_plan, rename_folders, rename_operations, plan_summary)}
SQL = {name: getattr(reference, name)(DUCK).replace("@", "") for name in QUERIES}
