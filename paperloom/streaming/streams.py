"""Structured Streaming: watching folders, incremental deduplication, windows of events, names across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.scan import identity


def watch(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """ST-1: new files of a folder as they come: file_id, original_path, file_size_bytes, seen_at."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select(identity(F.col("content"), F.col("length")).alias("file_id"), F.col("path").alias("original_path"), F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("seen_at"))


def first_seen(stream: DataFrame, key: str, time: str | None = None, delay: str | None = None) -> DataFrame:
    """ST-2: rows whose key never came before: the state holds every key. With a delay keys are forgotten after it, which bounds the state."""
    if delay is None:
        return stream.dropDuplicates([key])
    if time is None:
        raise ValueError("a delay needs a time column")
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def event_counts(stream: DataFrame, size: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """ST-3: events by type and window; ts without zone is taken as UTC."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


COUNTERS = "name_key string, used bigint"


def numbered_names(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows(file_id, canonical) with final names, counters after them): names are numbered on from known(name_key, used), ignoring case."""
    w = Window.partitionBy("name_key").orderBy("canonical", "file_id")
    named = rows.withColumn("name_key", F.lower("canonical")).withColumn("k", F.row_number().over(w)).join(known, "name_key", "left").withColumn("k", F.col("k") + F.coalesce("used", F.lit(0)))
    number = F.col("k").cast("string")
    number = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    stem = F.regexp_replace("canonical", r"\.pdf$", "")
    out = named.withColumn("final", F.when(F.col("k") == 1, F.col("canonical")).otherwise(F.concat(stem, F.lit("_"), number, F.lit(".pdf"))))
    now = out.groupBy("name_key").agg(F.max("k").alias("used"))
    counters = known.join(now.select("name_key"), "name_key", "left_anti").unionByName(now)
    return out.select("file_id", "final", "name_key"), counters


def name_batches(stream: DataFrame, registry: str, checkpoint: str) -> StreamingQuery:
    """ST-4: each batch of stream(file_id, canonical) numbers its names on from those before it.

    registry/names holds the named files by batch, registry/counters one row for each name ever used, one folder a batch; the
    first batch finds none, any other failure to read them ends the query. A batch that is run again gives the same names."""

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = f"{registry}/counters/after={batch_id - 1}"
        system, where = _place(spark, before)
        if batch_id > 0 and not system.exists(where):
            raise FileNotFoundError(before)
        known = spark.read.schema(COUNTERS).parquet(before) if batch_id > 0 else spark.createDataFrame([], COUNTERS)
        batch.persist()
        try:
            named, counters = numbered_names(batch.select("file_id", "canonical"), known)
            named.write.mode("overwrite").parquet(f"{registry}/names/batch_id={batch_id}")
            counters.write.mode("overwrite").parquet(f"{registry}/counters/after={batch_id}")
            system.delete(_place(spark, f"{registry}/counters/after={batch_id - 2}")[1], True)  # the last two suffice to run a batch again
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
