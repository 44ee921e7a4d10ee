"""Problem 9: mixing sources to target weights by Poisson replication.

Each document is repeated as often as the inverse of a Poisson distribution gives for a uniform number hashed from its id and
the seed, cut at its source's max_repeats. The mean of the Poisson distribution is solved so that the cut mean is the wanted
rate. Rates follow from exact token counts of all documents; the total is the largest that every source can fill within its
cap, or less on request. Sizes are tokens of a public byte-pair vocabulary.

Defined results: null and empty texts have no tokens and are left out; sources without a target (null among them) are left
out and reported with a null target; a source with a target but no tokens gets share 0.
"""

from __future__ import annotations

import base64
import math
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship, spread, table
from .common import checked_broadcast

TOKENIZERS = os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
SEED = 20240817
#: Targets are planned on the driver and their thresholds broadcast: there is one row a source, and no more than this.
MAX_SOURCES = 10_000
#: All thresholds together, one for each allowed repetition of each source.
MAX_STEPS = 1_000_000

# Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict = {}


def _encoder(key: str, data: bytes):
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def with_tokens(df: DataFrame, path: str | None = None) -> DataFrame:
    """Add n_tokens (bigint) of the column text."""
    spark = df.sparkSession
    ship(spark)
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    with open(path, "rb") as f:
        held = checked_broadcast(spark, f.read(), 32 << 20)
    key = os.path.basename(path)

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(key, held.value).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn("n_tokens", count("text"))


def cut_mean(lam: float, cap: int) -> float:
    """The mean of min(X, cap), X Poisson with mean lam."""
    p, below, total = math.exp(-lam), 0.0, 0.0
    for k in range(cap):
        total += k * p
        below += p
        p *= lam / (k + 1)
    return total + cap * (1 - below)


def poisson_mean(rate: float, cap: int) -> float | None:
    """The mean of a Poisson distribution whose mean, cut at cap, is rate; None: every document gets cap copies."""
    if rate >= cap * (1 - 1e-9):
        return None
    lo, hi = 0.0, 700.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cut_mean(mid, cap) < rate else (lo, mid)
    return (lo + hi) / 2


def thresholds(rate: float, cap: int) -> list[float]:
    """Copies = how many of these the uniform number reaches."""
    lam = poisson_mean(rate, cap)
    if lam is None:
        return [0.0] * cap
    p, below, out = math.exp(-lam), 0.0, []
    for k in range(cap):
        below += p
        out.append(min(below, 1.0))
        p *= lam / (k + 1)
    return out


def plan_mix(spark: SparkSession, sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[tuple]:
    """(source, target_share, max_repeats, tokens, rate) of each source of targets, which has a row for each source, not more.

    sizes: as from source_tokens()."""
    if targets.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    have = {r.source: r.tokens for r in sizes.join(targets.select("source"), "source", "left_semi").select("source", "tokens").collect()}
    rows = [(r.source, float(r.target_share), int(r.max_repeats), int(have.get(r.source) or 0)) for r in targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)).collect()]
    room = [cap * tokens / share for _, share, cap, tokens in rows if tokens]
    if not room:
        return []
    most = min(room)
    total = most if total is None else min(total, most)
    return [(s, share, cap, tokens, min(total * share / tokens, float(cap)) if tokens else 0.0) for s, share, cap, tokens in rows]


def _uniform(seed: int, *columns: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")) / F.lit(float(1 << 53))


def with_copies(docs: DataFrame, plan: list[tuple], seed: int = SEED) -> DataFrame:
    """Add copies (int) to documents with doc_id, source and text; documents without text or of other sources are dropped.

    Copies follow from doc_id and source alone, so they are computed beside the scan, without a shuffle."""
    spark = docs.sparkSession
    if not plan:
        return docs.where(F.lit(False)).withColumn("copies", F.lit(0))
    if sum(cap for _, _, cap, _, _ in plan) > MAX_STEPS:
        raise ValueError(f"over {MAX_STEPS} thresholds to broadcast")
    steps = spark.createDataFrame([(s, thresholds(rate, cap)) for s, _, cap, _, rate in plan], "source string, steps array<double>")
    joined = docs.where(F.length("text") > 0).join(F.broadcast(steps), "source")
    return joined.withColumn("u", _uniform(seed, F.col("doc_id"))).withColumn("copies", F.expr("size(filter(steps, x -> u >= x))")).drop("u", "steps")


def source_tokens(docs: DataFrame) -> DataFrame:
    """source, n_documents, tokens: one scan, summed before the shuffle."""
    return with_tokens(docs.select("source", "text")).groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("tokens"))


def mixed(spark: SparkSession, docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: each copy a row, in an order hashed over the whole. n_tokens is computed only where it is selected.

    Places are uniform over all 64-bit numbers, so their high bits give the partition: one shuffle, no sampling of ranges."""
    plan = plan_mix(spark, cut(source_tokens(docs)), targets, total)
    rows = with_tokens(with_copies(docs.select("doc_id", "source", "text"), plan, seed).where(F.col("copies") > 0))
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor((F.shiftright("place", 11) + F.lit(1 << 52)) * F.lit(tasks / float(1 << 53))).cast("int"), F.lit(tasks - 1))
    return rows.repartitionById(tasks, part).sortWithinPartitions("place", "doc_id", "copy_no")


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), table(spark, sf_dir, "mix_target")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark, *_sources(spark, sf_dir)).select("doc_id", "source", "text", "copy_no", "place")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source, from the copies that p9_mixture makes."""
    docs, targets = _sources(spark, sf_dir)
    counted = cut(with_tokens(docs).withColumn("text", F.when(F.length("text") > 0, F.lit("x"))))  # sizes alone: the texts stay where they are
    have = counted.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("tokens"))
    copies = with_copies(counted, plan_mix(spark, have, targets))
    made = copies.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_repeats"))
    rows = have.join(targets, have.source.eqNullSafe(targets.source), "full").select(
        F.coalesce(have.source, targets.source).alias("source"), "target_share", "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )
    rows = rows.join(made, "source", "left").fillna(0, ["mixed_tokens", "most_repeats"])
    whole = made.agg(F.sum("mixed_tokens")).first()[0] or 0
    return rows.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), F.lit(whole)), F.lit(0.0)))


QUERIES = {"p9_mixture": p9_mixture, "p9_shares": p9_shares}
