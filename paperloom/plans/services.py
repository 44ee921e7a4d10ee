"""Queries that run the streaming operators and the model backends over the tables, once through."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pythonic, responses
from ..functions import rules as R
from ..operators import backends
from ..session import once, shared_checkpoint, ship, table
from ..streaming import streams
from .reference import canonical_name
from .runner import run


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for what a stream writes."""
    return f"{shared_checkpoint(spark)}/streams/{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    single = sf_dir if not _is_folder(spark, f"{sf_dir}/{name}.parquet") else f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    return (reader.option("pathGlobFilter", f"{name}.parquet") if single == sf_dir else reader).parquet(single)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-1, ST-2: the files of the corpus as a stream; each identity once, for good."""
    folder = _folder(spark)
    seen = streams.first_seen(_stream(spark, sf_dir, "corpus").select("file_id"), "file_id")
    seen.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema("file_id string").parquet(f"{folder}/out")


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-3: the events as a stream, counted in windows of five minutes."""
    folder = _folder(spark)
    counts = streams.event_counts(_stream(spark, sf_dir, "events"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-4: canonical names as a stream of two files: names of the second batch are numbered on from the first."""
    folder = _folder(spark)
    names = run(spark, sf_dir, canonical_name)
    half = F.pmod(F.xxhash64("file_id"), F.lit(2))
    for k in (0, 1):
        names.where(half == k).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        streams.name_batches(spark.readStream.schema("file_id string, canonical string").parquet(f"{folder}/in"), f"{folder}/registry", f"{folder}/state").awaitTermination()
    out = spark.read.parquet(f"{folder}/registry/names")
    return out.groupBy("name_key").agg(F.count("*").alias("n_files"), F.countDistinct(F.lower("final")).alias("n_names"))


def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-5 to ML-8, SCH-3: prompts from merged fields, completed by the first backend that opens (here a stub behind one that does not), answers parsed."""

    def broken() -> backends.Backend:
        raise OSError("no model here")

    ship(spark)
    state = table(spark, sf_dir, "documents_state").select("file_id", *[F.col(f"merged.{f}.value").alias(f) for f in ("title", "author", "date")], F.element_at(F.split("original_path", "/"), -1).alias("name")).distinct()
    asked = backends.with_prompt(state, {f"PDF metadata {f}": f for f in ("title", "author", "date")}, "name", "Read the page.")
    answers = backends.completed(asked, "file_id", "prompt", [broken, backends.Echo])
    parsed = answers.select("file_id", "error", once(responses.response_fields("response")).alias("r"))
    return parsed.select("file_id", F.col("r.title").alias("title"), F.col("error").isNull().alias("answered"))


def font_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-14: the largest text of each first page; recognised words are the spans here, and their certainty stands for the size of their letters."""
    ship(spark)
    words = table(spark, sf_dir, "ocr_word").where((F.col("page") == 1) & F.col("text").isNotNull() & (F.col("conf") >= 0)).select("file_id", "word_ord", (F.col("conf") / 5.0).alias("size"), "text").distinct()
    pages = words.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("word_ord", "size", "text"))).alias("w"))  # the words of one page
    return pages.select("file_id", pythonic.font_title(F.transform("w", lambda x: F.struct(x["size"].alias("size"), x["text"].alias("text")))).alias("title"))


def file_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-7: hashes of the whole contents of the tables' files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(sf_dir)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("checksum"))


QUERIES = {f.__name__: f for f in (stream_first_seen, stream_event_windows, stream_names, model_answers, font_titles, file_checksums)}


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"


def _suggested() -> str:
    """ML-3 in DuckDB SQL, step by step in nested selects."""
    words = R.FILE_WORDS
    fillers = ", ".join(f"'{w}'" for w in R.FILLER_WORDS)
    x = "regexp_replace(regexp_replace(" + _trim("coalesce(vlm_raw_response, '')") + ", '^```\\w*\\n?', ''), '\\n?```\\s*$', '')"
    first = _trim(f"string_split({x}, chr(10))[1]")
    bare = "trim(" + _trim(f"regexp_replace({first}, '^(?:FILENAME|filename)[:\\s]*', '')") + ", '\"''`')"
    plain = f"regexp_replace(regexp_replace(regexp_replace({bare}, '(?i)\\.pdf$', ''), '[<>:\"/\\\\|?*]', '', 'g'), '[\\s\\-]+', '_', 'g')"
    return f"""SELECT DISTINCT file_id, CASE WHEN length(name) <= 60 THEN name ELSE regexp_replace(left(name, 60), '_[^_]*$', '') END AS suggested_name FROM (
SELECT file_id, array_to_string(list_filter(CASE WHEN len(parts) > 3 THEN list_filter(parts, lambda p, i: NOT (length(p) BETWEEN 2 AND 5 AND regexp_matches(p, '^\\p{{L}}+$') AND i + length(p) <= len(parts) AND array_to_string(list_transform(parts[i + 1:i + length(p)], lambda w: left(w, 1)), '') = p)) ELSE parts END, lambda p: p NOT IN ({fillers})), '_') AS name FROM (
SELECT file_id, string_split(trim(lower(regexp_replace(CASE WHEN NOT contains(c, '_') AND length(c) > 25 THEN regexp_replace(c, '(?i)({words})', '_\\1_', 'g') ELSE c END, '_+', '_', 'g')), '_'), '_') AS parts FROM (
SELECT file_id, regexp_replace({plain}, '([a-z])([A-Z])', '\\1_\\2', 'g') AS c FROM documents_state WHERE vlm_raw_response IS NOT NULL) a) b) d"""


def sql() -> dict[str, str]:
    from ..functions.dialect import DUCK
    from .reference import event_windows

    names = canonical_name(DUCK).replace("@", "")
    hints = ", ".join(f"CASE WHEN trim(merged.{f}.value) <> '' THEN 'PDF metadata {f}: ' || merged.{f}.value END" for f in ("title", "author", "date"))
    name = "string_split(original_path, '/')[-1]"
    return {
        "stream_first_seen": "SELECT DISTINCT file_id FROM corpus",
        "stream_event_windows": event_windows(DUCK).replace("@", ""),
        "stream_names": f"SELECT lower(canonical) AS name_key, count(*) AS n_files, count(*) AS n_names FROM ({names}) t GROUP BY lower(canonical)",
        "model_answers": f"SELECT DISTINCT file_id, {_trim('left(prompt, 80)')} AS title, true AS answered FROM (SELECT file_id, concat_ws(chr(10), 'Read the page.', {hints}, CASE WHEN trim({name}) <> '' THEN 'Original file name: ' || {name} END) AS prompt FROM documents_state) p",
        "font_titles": f"""WITH w AS (SELECT DISTINCT file_id, word_ord, conf / 5.0 AS size, {_trim('text')} AS t FROM ocr_word WHERE page = 1 AND text IS NOT NULL AND conf >= 0), f AS (SELECT DISTINCT file_id FROM w),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY size DESC, word_ord) AS rn FROM w WHERE length(t) > 5) r WHERE rn = 1)
SELECT f.file_id, CASE WHEN b.size > 14 AND NOT ({' OR '.join(f"contains(lower(b.t), '{x}')" for x in R.BOILERPLATE)}) THEN b.t END AS title FROM f LEFT JOIN b ON f.file_id = b.file_id""",
        "file_checksums": "SELECT parse_filename(filename) AS name, sha256(content) AS checksum FROM read_blob('/root/testdata/sf0.01/*.parquet')",
        "file_responses": _suggested(),
    }
