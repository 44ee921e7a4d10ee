"""Queries that need Arrow functions; with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import pythonic, quality
from ..functions import rules as R
from ..functions.dialect import SPARK
from ..session import once, ship, spread, table


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TQ-0 to TQ-5."""
    ship(spark)
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality.with_quality(docs, "text").select("doc_id", F.round("text_quality", 6).alias("text_quality"))


def quality_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TQ, RT-1, AG-2: documents, score, strategy; counted by language and strategy."""
    ship(spark)
    docs = spread(table(spark, sf_dir, "documents").select("lang", "text"))
    scored = docs.select("lang", once(quality.quality_signals("text").getField("score")).alias("q"))
    route = F.when(F.col("q") >= R.QUALITY_HIGH, "text_heuristic").when(F.col("q") >= R.QUALITY_LOW, "vlm_plus_heuristic").otherwise("vlm_only")
    return scored.groupBy("lang", route.alias("strategy")).agg(F.count("*").alias("n"), F.round(F.avg(F.round("q", 6)), 5).alias("mean_quality"))


def date_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-2b."""
    ship(spark)
    df = spread(table(spark, sf_dir, "corpus").select("file_id", "raw_text"))
    return df.select("file_id", once(pythonic.date_context("raw_text")).alias("d")).select("file_id", "d.value", F.round("d.confidence", 6).alias("confidence"), "d.method")


def fuzzy_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-3's last resort, for embedded dates that the strict forms do not read."""
    ship(spark)
    keys = F.array(*[F.struct(F.lit(k).alias("date_key"), F.col("pdf_metadata")[k].alias("raw")) for k in R.DATE_KEYS])
    rows = table(spark, sf_dir, "corpus").select("file_id", F.explode(keys).alias("e")).select("file_id", "e.*").where(F.col("raw").isNotNull())
    strict = F.expr(X.pdf_day(SPARK, "raw"))
    return rows.withColumn("strict_day", once(strict)).withColumn("day", F.coalesce("strict_day", pythonic.fuzzy_day("raw"))).drop("strict_day")


def otsu_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR-3 on a histogram of word confidences of each file (256 bins)."""
    ship(spark)
    words = table(spark, sf_dir, "ocr_word").where(F.col("conf") >= 0).groupBy("file_id", F.floor(F.col("conf") * 255 / 100).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    packed = words.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # at most 256 bins a file
    histogram = F.expr("transform(sequence(0, 255), b -> coalesce(try_element_at(m, b), 0L))")
    return packed.select("file_id", pythonic.otsu(histogram).alias("threshold"))


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-2: the JSON sink's lines."""
    from .reference import BUILD
    from .runner import run

    df = run(spark, sf_dir, BUILD["export_csv_rows"])
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-1 to SRC-6, DD-1: the tables' own files, scanned as a folder: name, identity by content, size."""
    from ..sources.scan import scan

    return scan(spark, sf_dir, ("*.parquet",)).select(F.element_at(F.split("original_path", "/"), -1).alias("name"), "file_id", "file_size_bytes")


def scan_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: one file, whatever its size."""
    from ..sources.scan import scan

    return scan(spark, f"{sf_dir}/region.parquet", ("*.parquet",), bounds=(1 << 30, 1 << 31)).select("file_id", "file_size_bytes")


def operations_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-1: state and operations on file_id, both sides aggregated first."""
    ops = table(spark, sf_dir, "operations").where(F.col("file_id").isNotNull()).groupBy("file_id").agg(F.count("*").alias("n_operations"), F.sum((F.col("executed") == 1).cast("int")).alias("n_executed"))
    state = table(spark, sf_dir, "documents_state").groupBy("file_id").agg(F.max("status").alias("status"))
    return state.join(ops, "file_id", "left").select("file_id", "status", F.coalesce("n_operations", F.lit(0)).alias("n_operations"), F.coalesce("n_executed", F.lit(0)).alias("n_executed"))


QUERIES = {
    "text_quality": text_quality, "quality_routes": quality_routes, "date_context": date_context, "fuzzy_dates": fuzzy_dates, 
    "otsu_thresholds": otsu_thresholds, "json_documents": json_documents, "operations_join": operations_join, "scan_files": scan_files, "scan_one_file": scan_one_file,
}


_OTSU = """WITH h AS (SELECT file_id, CAST(floor(conf * 255 / 100) AS INT) AS bin, count(*) AS n FROM ocr_word WHERE conf >= 0 GROUP BY ALL),
g AS (SELECT f.file_id, t.bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT file_id FROM h) f CROSS JOIN (SELECT unnest(range(256)) AS bin) t LEFT JOIN h ON f.file_id = h.file_id AND t.bin = h.bin),
c AS (SELECT file_id, bin, sum(n) OVER w AS below, sum(n * bin) OVER w AS weighed, sum(n) OVER (PARTITION BY file_id) AS total, sum(n * bin) OVER (PARTITION BY file_id) AS whole FROM g WINDOW w AS (PARTITION BY file_id ORDER BY bin)),
s AS (SELECT file_id, bin, below * (total - below) * pow(CAST(weighed AS DOUBLE) / below - CAST(whole - weighed AS DOUBLE) / (total - below), 2) AS spread FROM c WHERE below > 0 AND below < total)
SELECT f.file_id, CAST(coalesce(b.bin, 0) AS INT) AS threshold FROM (SELECT DISTINCT file_id FROM h) f LEFT JOIN (SELECT file_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY round(spread, 6) DESC, bin) AS rn FROM s) r WHERE rn = 1) b ON f.file_id = b.file_id"""

_FILES = "SELECT parse_filename(filename) AS name, sha256(content[1:65536] || CAST(CAST(size AS VARCHAR) AS BLOB)) AS file_id, size AS file_size_bytes FROM read_blob('/root/testdata/sf0.01/{}.parquet')"


def _fuzzy() -> str:
    """The tables hold embedded dates of the strict forms alone; free text is tested by cases."""
    from . import oracles as O

    return " UNION ALL ".join(f"SELECT file_id, '{k}' AS date_key, pdf_metadata['{k}'] AS raw, {O._embedded_day(f'pdf_metadata[{O.q(k)}]')} AS day FROM corpus WHERE pdf_metadata['{k}'] IS NOT NULL" for k in R.DATE_KEYS)


def _json() -> str:
    from ..functions.dialect import DUCK
    from .reference import BUILD

    return f"SELECT CAST(to_json(t) AS VARCHAR) AS value FROM ({BUILD['export_csv_rows'](DUCK).replace('@', '')}) t"


def oracles() -> dict[str, str]:
    q = quality.oracle_sql()
    return {
        "otsu_thresholds": _OTSU,
        "fuzzy_dates": _fuzzy(),
        "json_documents": _json(),
        "scan_files": _FILES.format("*"),
        "scan_one_file": f"SELECT file_id, file_size_bytes FROM ({_FILES.format('region')}) t",
        "text_quality": q,
        "quality_routes": f"SELECT lang, strategy, count(*) AS n, round(avg(text_quality), 5) AS mean_quality FROM (SELECT d.lang, q.text_quality, CASE WHEN q.text_quality >= {R.QUALITY_HIGH} THEN 'text_heuristic' WHEN q.text_quality >= {R.QUALITY_LOW} THEN 'vlm_plus_heuristic' ELSE 'vlm_only' END AS strategy FROM ({q}) q JOIN documents d ON d.doc_id = q.doc_id) t GROUP BY lang, strategy",
        "operations_join": "SELECT s.file_id, s.status, coalesce(o.n, 0) AS n_operations, CAST(coalesce(o.e, 0) AS BIGINT) AS n_executed FROM (SELECT file_id, max(status) AS status FROM documents_state GROUP BY file_id) s LEFT JOIN (SELECT file_id, count(*) AS n, sum(CASE WHEN executed = 1 THEN 1 ELSE 0 END) AS e FROM operations WHERE file_id IS NOT NULL GROUP BY file_id) o ON s.file_id = o.file_id",
    }
