"""Functions callable from SQL by name (the engine's user-function surface)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..session import ship
from . import fields, pythonic, quality


@udtf(returnType=T.StructType([T.StructField("form", T.StringType()), T.StructField("value", T.StringType()), T.StructField("confidence", T.DoubleType())]))
class DateCandidates:
    """One row per date form found in a text."""

    def eval(self, text: str):
        for name, base, pattern in fields._FORMS:
            for m in pattern.finditer((text or "")[:5000]):
                day = fields.day_of(name, m.group())
                if day:
                    yield name, day.isoformat(), base


def register_functions(spark: SparkSession) -> list[str]:
    """Register the scalar functions and the table function date_candidates; returns their names."""
    ship(spark)
    table = {"text_quality_signals": quality.quality_signals, "date_context": pythonic.date_context, "fuzzy_day": pythonic.fuzzy_day, "otsu": pythonic.otsu, "font_title": pythonic.font_title}
    for name, f in table.items():
        spark.udf.register(name, f)
    spark.udtf.register("date_candidates", DateCandidates)
    return [*table, "date_candidates"]
