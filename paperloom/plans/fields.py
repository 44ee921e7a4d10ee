"""Queries of field extraction, model responses and their reconciliation. Texts are worked on where they are scanned; only narrow fields are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields, responses
from ..functions import rules as R
from ..session import once, ship, spread, table


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spread(table(spark, sf_dir, "corpus").select("file_id", "raw_text", "pdf_metadata"))


def _one_field(find):
    call = fields.single("x", find)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _corpus(spark, sf_dir).select("file_id", once(call("raw_text", "pdf_metadata")).alias("s"))
        return rows.select("file_id", F.col("s.x_value").alias("value"), F.round("s.x_confidence", 6).alias("confidence"), F.col("s.x_source").alias("source"), F.col("s.x_method").alias("method"))

    return query


date_best = _one_field(lambda text, meta: fields.find_date(text, meta, context=False, fuzzy=False))  # EX-1 to EX-3 without context
author_best = _one_field(fields.find_author)  # EX-5 to EX-8
report_id_best = _one_field(fields.find_identifier)  # EX-10 to EX-12
org_detect = _one_field(fields.find_organisation)  # EX-13
title_best = _one_field(fields.find_title)  # EX-15 to EX-18
doctype_generic = _one_field(lambda text, meta: fields.find_generic_type(text))  # EX-19


def doctype_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-20: domain type, its domain, and the subdomain."""
    rows = _corpus(spark, sf_dir).select("file_id", once(fields.domain_types("raw_text", "pdf_metadata")).alias("s"))
    return rows.select(
        "file_id", F.col("s.type_value").alias("value"), F.round("s.type_confidence", 6).alias("confidence"), F.col("s.domain_value").alias("domain"),
        F.col("s.subdomain_value").alias("subdomain"), F.round("s.subdomain_confidence", 6).alias("subdomain_confidence"), F.col("s.type_method").alias("method"),
    )


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, s: the fields of both stages, and keywords: one scan, one Arrow pass."""
    keywords = F.expr("slice(filter(transform(split(coalesce(pdf_metadata['keywords'], ''), ','), k -> trim(k)), k -> k <> ''), 1, 10)")
    return _corpus(spark, sf_dir).select("file_id", once(fields.both_stages("raw_text", "pdf_metadata")).alias("s"), keywords.alias("keywords"))


def _long(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(name).alias("field"), *[c[p].alias(p) for p in ("value", "confidence", "source", "method")]) for name, c in columns.items()])
    out = df.select("file_id", F.explode(each).alias("e")).select("file_id", "e.*")
    return out.withColumn("confidence", F.round("confidence", 6))


def heuristic_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-22: ten fields of each file with value, confidence, source and method."""
    return _long(_stages(spark, sf_dir), {n: fields.field_struct("h", n) for n in fields.HEURISTIC_FIELDS})


def metadata_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX-21: five fields of each file from its embedded metadata; keywords are a row of their own, joined by bars."""
    words = F.array_join("keywords", "|")
    kept = F.size("keywords") > 0
    listed = F.struct(F.when(kept, words).otherwise("").alias("value"), F.when(kept, 0.50).otherwise(0.0).alias("confidence"), F.when(kept, "metadata").otherwise("none").alias("source"), F.when(kept, "pdf_info_keywords").otherwise("none").alias("method"))
    return _long(_stages(spark, sf_dir), {**{n: fields.field_struct("m", n) for n in fields.METADATA_FIELDS}, "keywords": listed})


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, vlm_model, r (fields of the response) of every response; parsed beside the scan."""
    ship(spark)
    state = spread(table(spark, sf_dir, "documents_state").where(F.col("vlm_raw_response").isNotNull()).select("file_id", "vlm_model", "vlm_raw_response"))
    return state.select("file_id", "vlm_model", once(responses.response_fields("vlm_raw_response")).alias("r"))


def vlm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-1, ML-2: fields and confidences of model responses; broken responses give empty fields."""
    cols = []
    for k, confidence in R.RESPONSE_CONFIDENCE.items():
        cols += [F.col(f"r.{k}").alias(k), F.when(F.col(f"r.{k}").isNotNull(), F.lit(confidence)).otherwise(F.lit(0.0)).alias(f"{k}_confidence")]
    return _responses(spark, sf_dir).select("file_id", *cols, F.col("r.year").alias("year"), F.array_join("r.keywords", "|").alias("keywords"))


def file_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-3, over all model responses."""
    df = table(spark, sf_dir, "documents_state").where(F.col("vlm_raw_response").isNotNull())
    return responses.with_suggested_name(df.select("file_id", "vlm_raw_response"), "vlm_raw_response").select("file_id", "suggested_name").distinct()


def normal_value(x: Column) -> Column:
    """MG-4: what two values are compared by: lower case, no punctuation, single blanks; ends are trimmed before punctuation goes."""
    bare = F.regexp_replace(F.lower(x), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\s]", ""), r"(?U)\s+", " ")


def reconciled(candidates: Column) -> Column:
    """MG-1: candidates (array of struct value, confidence, source, method, in the order of their sources) that are not blank, the most confident first, equals in their order."""
    present = F.filter(candidates, lambda c: F.coalesce(F.regexp_like(c["value"], F.lit(r"(?U)\S")), F.lit(False)))
    return F.transform(F.array_sort(F.transform(present, lambda c, i: F.struct((-c["confidence"]).alias("rank"), i.alias("place"), c.alias("c")))), lambda x: x["c"])


def _agreed(ranked: Column) -> Column:
    """MG-2, MG-3: the first, raised if the second agrees; a defined nothing if there is none."""
    one, two = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    same = (normal_value(one["value"]) == normal_value(two["value"])) & (normal_value(one["value"]) != "")
    same = F.coalesce(same, F.lit(False))
    return F.when(
        one.isNotNull(),
        F.struct(
            one["value"].alias("value"), F.when(same, F.least(one["confidence"] + R.AGREEMENT_BOOST, F.lit(R.AGREEMENT_CAP))).otherwise(one["confidence"]).alias("confidence"),
            F.when(same, F.concat(one["source"], F.lit("+cross_validated"))).otherwise(one["source"]).alias("source"), one["method"].alias("method"),
        ),
    ).otherwise(F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit("none").alias("source"), F.lit("no_candidates").alias("method")))


def _of_model(name: str) -> Column:
    confidence = R.RESPONSE_YEAR if name == "year" else R.RESPONSE_CONFIDENCE[name]
    return F.struct(F.col(f"r.{name}").alias("value"), F.lit(confidence).alias("confidence"), F.lit("vlm").alias("source"), F.concat(F.lit("vlm:"), F.coalesce("vlm_model", F.lit("none"))).alias("method"))


def merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MG-1 to MG-4: fourteen fields of each file, reconciled from embedded metadata, model response and text.

    Fields are extracted beside the scans, and repeated rows dropped when only those narrow fields are left."""
    texts = _stages(spark, sf_dir).select("file_id", "s").dropDuplicates(["file_id"])
    models = _responses(spark, sf_dir).groupBy("file_id").agg(F.min(F.struct("r", "vlm_model")).alias("x")).select("file_id", "x.*")
    joined = texts.join(models, "file_id", "left")
    ranked = []
    for name in R.ALL_FIELDS:
        sources = [fields.field_struct("m", name)] if name in fields.METADATA_FIELDS else []
        sources += [_of_model(name)] if name in [*responses.RESPONSE_FIELDS, "year"] else []
        sources += [fields.field_struct("h", name)] if name in fields.HEURISTIC_FIELDS else []
        nothing = F.struct(F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence"), F.lit("none").alias("source"), F.lit("none").alias("method"))
        ranked.append(F.struct(F.lit(name).alias("field"), F.array(*(sources or [nothing])).alias("cands")))
    each = joined.select("file_id", F.explode(F.array(*ranked)).alias("e")).select("file_id", "e.field", once(reconciled(F.col("e.cands"))).alias("ranked"))
    out = each.select("file_id", "field", once(_agreed(F.col("ranked"))).alias("m"))
    return out.select("file_id", "field", "m.value", F.round("m.confidence", 6).alias("confidence"), "m.source", "m.method")


def merged_keywords(lists: Column) -> Column:
    """MG-5: lists (array of struct value, confidence, in the order of their sources): equal words (ignoring case) once, the most confident first, ten at most."""
    numbered = F.transform(lists, lambda k, i: F.struct((-k["confidence"]).alias("rank"), i.alias("place"), k["value"].alias("value"), k["confidence"].alias("confidence")))
    first = F.filter(numbered, lambda k: ~F.exists(numbered, lambda o: (o["place"] < k["place"]) & (F.lower(o["value"]) == F.lower(k["value"]))))
    return F.slice(F.array_sort(first), 1, 10)


def keyword_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MG-5: keywords of model, then metadata, one row each with its place."""

    def words(column: Column, confidence: float) -> Column:
        return F.transform(column, lambda k: F.struct(k.alias("value"), F.lit(confidence).alias("confidence")))

    given = F.expr("slice(filter(transform(split(coalesce(pdf_metadata['keywords'], ''), ','), k -> trim(k)), k -> k <> ''), 1, 10)")
    texts = table(spark, sf_dir, "corpus").select("file_id", words(given, 0.50).alias("metadata")).dropDuplicates(["file_id"])
    models = _responses(spark, sf_dir).groupBy("file_id").agg(F.min("r.keywords").alias("k")).select("file_id", words(F.col("k"), R.RESPONSE_KEYWORD).alias("model"))
    both = texts.join(models, "file_id", "full").select("file_id", F.concat(F.coalesce("model", F.array()), F.coalesce("metadata", F.array())).alias("lists"))
    rows = both.select("file_id", F.posexplode(merged_keywords(F.col("lists"))).alias("place", "k"))
    return rows.select("file_id", (F.col("place") + 1).alias("place"), F.col("k.value").alias("keyword"), "k.confidence")


def vlm_page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ML-4: gaps of the first page's fields filled from the second at nine tenths of its confidence; here the embedded title stands for the second page's."""
    one = _responses(spark, sf_dir).groupBy("file_id").agg(F.min("r").alias("r"))
    two = table(spark, sf_dir, "corpus").select("file_id", F.nullif(F.trim(F.col("pdf_metadata")["title"]), F.lit("")).alias("second")).dropDuplicates(["file_id"])
    first, filled = F.col("r.title").isNotNull(), F.col("r.title").isNull() & F.col("second").isNotNull()
    confidence = F.when(first, F.lit(R.RESPONSE_CONFIDENCE["title"])).when(filled, F.round(F.lit(R.RESPONSE_CONFIDENCE["title"] * R.PAGE_TWO_FACTOR), 6)).otherwise(F.lit(0.0))
    return one.join(two, "file_id", "left").select("file_id", F.coalesce("r.title", "second").alias("title"), confidence.alias("confidence"), F.when(filled, "vlm:page2").otherwise("vlm").alias("method"), F.col("r.author").alias("author"))


QUERIES = {
    "date_best": date_best, "author_best": author_best, "report_id_best": report_id_best, "org_detect": org_detect, "title_best": title_best, "doctype_generic": doctype_generic, "doctype_domain": doctype_domain,
    "heuristic_fields": heuristic_fields, "metadata_fields": metadata_fields, "vlm_parse": vlm_parse, "file_responses": file_responses, "merge_fields": merge_fields, "keyword_merge": keyword_merge, "vlm_page_merge": vlm_page_merge,
}
