"""Numbering rows in a total order without sending them to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def numbered(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Add out: the place of each row (from 1) in the order, which should have no ties.

    One range exchange sorts the rows; each part then counts on from the rows of the parts before it (one number a part)."""
    parts = cut(df.orderBy(*order)).withColumn("__part", F.spark_partition_id())
    parts = parts.withColumn("__row", F.monotonically_increasing_id())
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a part
    out_rows = parts.join(F.broadcast(offsets.drop("__n")), "__part")
    return out_rows.withColumn(out, F.col("__before") + F.col("__row") - F.col("__first") + 1).drop("__part", "__row", "__first", "__before")


def numbered_within(df: DataFrame, group: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """Add out: the place of each row within its group; a group of any size is spread like all others."""
    rows = cut(numbered(df, [*map(F.col, group), *order], "__place"))
    first = rows.groupBy(*group).agg(F.min("__place").alias("__from"))
    joined = rows.join(first, [rows[g].eqNullSafe(first[g]) for g in group] if len(group) > 1 else rows[group[0]].eqNullSafe(first[group[0]]))
    for g in group:
        joined = joined.drop(first[g])
    return joined.withColumn(out, F.col("__place") - F.col("__from") + 1).drop("__place", "__from")
