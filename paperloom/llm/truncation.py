"""Problem 4: values cut off by field limits or in transfer.

A hashed logistic regression is trained on intact values of the same table and on artificial cuts of them, with features of
the closing characters, the open quotes and brackets, the last words and the distance to the length limits of the source
(lengths at which values without a natural end pile up). It then scores every response and every text field within one.

Which fields hold running text follows from the data: those whose values mostly have a natural end.

Defined results: null and blank responses are no cuts; repeated rows give one row; a response without any text field is
scored as a whole only; where a table holds no intact value to learn from, nothing is found.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, once, spread, table

#: The classifier is fitted on about so many intact values at most (a hashed sample by rate) and CUTS cuts of each.
TRAIN_VALUES = 20_000
CUTS = 2
DIMENSIONS = 1 << 15
THRESHOLD = 0.5
#: A length is a limit if at least so many values of the source have it, so many times as often as its neighbours.
LIMIT_COUNT, LIMIT_LIFT = 5, 4.0

#: A kind of value is running text, and scored, if so large a share of its values has a natural end.
RUNNING_SHARE = 0.5
#: Limits are broadcast up to so many rows (about forty bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000

_NATURAL = r"[.!?…}`\"”)\]]\s*$|^\S*\d\s*$"
_FIELD = r'"(\w+)"\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def values_of(df: DataFrame) -> DataFrame:
    """One row per value: file_id, source, kind (response or the field's name), text. df: file_id, source, response.

    A field whose text also stands whole in another field of its response is left out: it is not cut."""
    alive = df.where(F.regexp_like("response", F.lit(r"(?U)\S")))
    names, texts = (F.regexp_extract_all("response", F.lit(_FIELD), F.lit(g)) for g in (1, 2))
    fields = alive.select("file_id", "source", "response", once(F.arrays_zip(names.alias("kind"), texts.alias("text"))).alias("fields"))
    own = F.expr("filter(fields, x -> x.text <> '' AND size(filter(fields, y -> y.text = x.text)) = 1)")
    whole = F.array(F.struct(F.lit("response").alias("kind"), F.col("response").alias("text")))
    return fields.select("file_id", "source", F.explode(F.concat(whole, own)).alias("v")).select("file_id", "source", "v.kind", "v.text")


def size_counts(values: DataFrame) -> DataFrame:
    """source, kind, unit (chars or bytes), size, n (different files), open (those without a natural end): one narrow pass, pre-aggregated.

    Files are counted by a sketch, which is exact but for rounding at the counts that decide; so repeated rows count once."""
    sized = values.select(
        "source", "kind", F.xxhash64("file_id").alias("file"), F.regexp_like("text", F.lit(_NATURAL)).alias("ended"),
        F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("text").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("size")))).alias("s"),
    )
    return sized.groupBy("source", "kind", "s.unit", "s.size").agg(F.approx_count_distinct("file", 0.02).alias("n"), F.approx_count_distinct(F.when(~F.col("ended"), F.col("file")), 0.02).alias("open"))


def running_kinds(counts: DataFrame) -> DataFrame:
    """kind: the kinds whose values mostly have a natural end."""
    by = counts.where(F.col("unit") == "chars").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("open").alias("open"))
    return by.where((F.col("open") <= (1 - RUNNING_SHARE) * F.col("n")) | (F.col("kind") == "response")).select("kind")


def limits_of(counts: DataFrame) -> DataFrame:
    """source, kind, unit, size: lengths at which values without a natural end pile up."""
    beside = Window.partitionBy("source", "kind", "unit").orderBy("size").rangeBetween(-8, 8)
    mean = (F.sum("n").over(beside) - F.col("n")) / 16
    spikes = counts.withColumn("lift", F.col("n") / F.greatest(mean, F.lit(0.5)))
    return spikes.where((F.col("n") >= LIMIT_COUNT) & (F.col("lift") >= LIMIT_LIFT) & (F.col("open") >= 0.5 * F.col("n"))).select("source", "kind", "unit", "size")


def _held(df: DataFrame) -> DataFrame:
    """A materialised table for a join: as a broadcast if its rows are few enough."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def with_gap(values: DataFrame, limits: DataFrame) -> DataFrame:
    """Add gap: characters or bytes to the nearest limit of the source and kind, null if there is none within three."""
    out = values
    for unit, length in (("chars", F.length), ("bytes", F.octet_length)):
        near = limits.where(F.col("unit") == unit).select("source", "kind", "size", F.explode(F.sequence(F.col("size") - 3, F.col("size"))).alias(f"at_{unit}"))
        near = near.groupBy("source", "kind", f"at_{unit}").agg(F.min(F.col("size") - F.col(f"at_{unit}")).alias(f"gap_{unit}"))
        out = out.withColumn(f"at_{unit}", length("text")).join(_held(near), ["source", "kind", f"at_{unit}"], "left").drop(f"at_{unit}")
    return out.withColumn("gap", F.least("gap_chars", "gap_bytes")).drop("gap_chars", "gap_bytes")


def with_features(df: DataFrame) -> DataFrame:
    """Add features (array<string>) to source, kind, text, gap."""
    c = F.col
    count = lambda x, part: F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))
    # Each step is a projection of its own, so that no expression is repeated inside another.
    step = df.withColumns({"f_text": once(_bare(c("text")))})
    step = step.withColumns({"f_tail": F.regexp_replace(F.right("f_text", F.lit(100)), r"\d+", "0"), "f_json": F.instr("f_text", "{") > 0, "f_plain": F.replace("f_text", F.lit('\\"'), F.lit(""))})
    step = step.withColumns({
        "f_words": F.split(F.lower(F.regexp_replace("f_tail", r"(?U)[^\w']+$", "")), r"(?U)[\s\"{}:,]+"),
        "f_near": F.when(c("gap") <= 0, "at").when(c("gap") <= 3, "near").otherwise("far"),
        "f_end": F.regexp_replace(F.regexp_replace(F.right("f_tail", F.lit(3)), r"\p{L}", "a"), r"(?U)\s", "_"),
        "f_quotes": (count(c("f_plain"), '"') % 2).cast("string"),
        "f_depth": count(c("f_text"), "{") - count(c("f_text"), "}"),
        "f_fences": count(c("f_text"), "```") / 3,
        "f_stop": F.when(F.regexp_like("f_tail", F.lit(r"[.!?…][\"”')]*$")), "stop").when(F.regexp_like("f_tail", F.lit(r"(?U)\w$")), "word").otherwise("other"),
        "f_inner": F.when(c("f_json") & (c("kind") == "response"), F.lit("json")).otherwise(F.lit("text")),
        "f_token": F.concat_ws("/", (F.instr("f_text", " ") == 0).cast("string"), F.length(F.regexp_extract(F.right("f_text", F.lit(12)), r"\d*$", 0)).cast("string")),  # digits at the end
    })
    step = step.withColumns({
        "f_last": F.coalesce(F.try_element_at("f_words", F.lit(-1)), F.lit("")),
        "f_before": F.coalesce(F.try_element_at("f_words", F.lit(-2)), F.lit("")),
        "f_shape": F.concat_ws("/", "kind", F.when(c("f_json"), "json").when(c("f_fences") > 0, "fence").when(F.instr("f_text", " ") > 0, "prose").otherwise("word"),
                               F.when(c("f_depth") > 0, "open").otherwise("even"), "f_quotes", (c("f_fences").cast("int") % 2).cast("string")),
    })
    join = lambda name, *parts: F.concat_ws("/", F.lit(name), *parts)
    features = F.array(
        join("shape", "f_shape"), join("end", "f_inner", "f_end"), join("stop", "f_inner", "f_stop"), join("near", "f_near"), join("nearstop", "f_inner", "f_near", "f_stop"),
        join("last", "f_inner", "f_last"), join("two", "f_inner", "f_before", "f_last"), join("suffix", "f_inner", F.right("f_last", F.lit(3))),
        join("laststop", "f_inner", "f_stop", "f_last"), join("size", "f_inner", F.least(F.floor(F.log2(F.length("f_text") + 1)), F.lit(9)).cast("string")), join("token", "f_token"),
    )
    return step.withColumn("features", once(features)).drop(*[n for n in step.columns if n.startswith("f_")])


def training_rows(values: DataFrame, limits: DataFrame, ended: int) -> DataFrame:
    """label, features: intact values, intact values without their full stop, and cuts of intact values.

    ended: about how many values have a natural end; it sets the rate of the hashed sample, which is taken while scanning."""
    share = min(1.0, TRAIN_VALUES / max(ended, 1))
    sampled = values.withColumn("h", F.xxhash64(F.lit(11), "file_id", "kind", "text")).where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))
    even = F.length(F.replace("text", F.lit("{"), F.lit(""))) == F.length(F.replace("text", F.lit("}"), F.lit("")))
    whole = F.regexp_like("text", F.lit(_NATURAL)) | F.regexp_like("text", F.lit(r"\}\s*\n[A-Z][^\n{]*[.!]\s*$"))
    intact = cut(with_gap(sampled.where(even & whole), limits).where(F.col("gap").isNull()).dropDuplicates(["h"]))
    base = intact.select("source", "kind", "text", "h", F.lit(0.0).alias("label"))
    unstopped = intact.where(F.regexp_like("text", F.lit(r"\.\s*$")) & (F.col("h") % 2 == 0)).select("source", "kind", F.regexp_replace("text", r"\.\s*$", "").alias("text"), "h", F.lit(0.0).alias("label"))
    out = base.unionByName(unstopped)
    least = _held(cut(limits.where(F.col("unit") == "chars").groupBy("source", "kind").agg(F.min("size").alias("limit"))))
    long = intact.where(F.length("text") > 12).join(least, ["source", "kind"], "left")
    for k in range(CUTS):
        spot = F.pmod(F.xxhash64(F.lit(100 + k), "h"), F.greatest(F.length("text") - 6, F.lit(1))) + 4
        place = F.when(F.col("limit").isNotNull() & (F.length("text") > F.col("limit")) & (F.lit(k) == 0), F.col("limit")).otherwise(spot).cast("int")
        cuts = long.select("source", "kind", F.left("text", place).alias("text"), "h", F.lit(1.0).alias("label"))
        out = out.unionByName(cuts.where(~F.regexp_like("text", F.lit(r"[.!?…}]\s*$"))))
    return with_features(with_gap(out, limits)).select("label", "features")


def scored(df: DataFrame) -> DataFrame:
    """file_id, source, kind, text, score of every value of df(file_id, source, response) that is running text.

    Three narrow passes over df: lengths, training sample, scores."""
    values = values_of(df)
    counts = cut(size_counts(values))
    kinds = cut(running_kinds(counts))
    counts = counts.join(_held(kinds), "kind", "left_semi")
    limits = cut(limits_of(counts))
    ended = counts.where(F.col("unit") == "chars").agg(F.sum(F.col("n") - F.col("open"))).first()[0] or 0
    values = values.join(_held(kinds), "kind", "left_semi")
    hashing = HashingTF(inputCol="features", outputCol="vector", numFeatures=DIMENSIONS, binary=True)
    rows = cut(training_rows(values, limits, ended))
    if rows.select("label").distinct().count() < 2:
        return values.withColumn("score", F.lit(0.0)).select("file_id", "source", "kind", "text", "score")
    model = LogisticRegression(featuresCol="vector", labelCol="label", maxIter=40, regParam=2e-4).fit(hashing.transform(rows).select("label", "vector").repartition(max(2, df.sparkSession.sparkContext.defaultParallelism)))
    out = model.transform(hashing.transform(with_features(with_gap(values, limits))))
    return out.withColumn("score", once(F.get(vector_to_array("probability"), F.lit(1)))).select("file_id", "source", "kind", "text", "score")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "documents_state").select("file_id", F.coalesce("vlm_model", F.lit("none")).alias("source"), F.col("vlm_raw_response").alias("response"))
    return spread(state)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_responses(spark, sf_dir)).where(F.col("score") > THRESHOLD).select("file_id").distinct()


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses, cut ones and the rate of cuts of every model."""
    per_file = scored(_responses(spark, sf_dir)).groupBy("source", "file_id").agg(F.max("score").alias("score"))
    out = per_file.groupBy(F.col("source").alias("vlm_model")).agg(F.count("*").alias("n_responses"), F.sum((F.col("score") > THRESHOLD).cast("int")).alias("n_cut"))
    return out.withColumn("cut_rate", F.col("n_cut") / F.col("n_responses"))


QUERIES = {"p4_found": p4_found, "p4_rates": p4_rates}
