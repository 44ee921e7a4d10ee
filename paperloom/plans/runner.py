"""Runs one SQL text on Spark (tables as temporary views) and gives the same text, in its own dialect, for DuckDB."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK, Spark
from ..session import spread, table

Build = Callable[[Spark], str]


#: Tables whose texts are worked on row by row: spread over the cores if they come in fewer splits than there are cores.
SPREAD = {"corpus", "documents"}


def run(spark: SparkSession, sf_dir: str, build: Build, heavy: bool = False) -> DataFrame:
    """heavy: the query does much work on each text."""
    text = build(SPARK)
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:8]
    for name in set(re.findall(r"@(\w+)", text)):
        df = table(spark, sf_dir, name)
        (spread(df) if heavy and name in SPREAD else df).createOrReplaceTempView(f"{name}_{tag}")
    return spark.sql(re.sub(r"@(\w+)", rf"\1_{tag}", text))


def query(build: Build, heavy: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, sf_dir, build, heavy)

    call.__doc__ = build.__doc__
    return call


def oracle(build: Build) -> str:
    return re.sub(r"@(\w+)", r"\1", build(DUCK))
