"""Problem 8: benchmark passages in training text, found by a broadcast set of normalised n-grams and verified exactly.

Words are runs of a-z and 0-9 after lower-casing. Any run of RUN shared words covers a whole block of RUN / 2 words that
starts at a multiple of RUN / 2 in the document, so only those blocks are looked up; each hit is then extended word by word
to its full run in the item, which verifies it. The corpus is scanned once, whatever the size of the benchmark:

* a benchmark of up to INDEX_WORDS words (measured) is broadcast with its blocks, and hits are verified where they are found;
* a larger one stays distributed: a bit filter of its block hashes is broadcast (never over FILTER_BITS), documents that pass
  it are joined to the blocks by hash, and every candidate diagonal of document and item is verified. The filter only saves
  work, so the result is the same.

Defined results: null or short texts hold nothing; equal items each get their rows; repeated rows of a document give one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship, spread, table
from .common import checked_broadcast, skip_empty

RUN = 12
#: The broadcast index holds at most so many words, about three hundred bytes each in a Python worker.
INDEX_WORDS = 250_000
#: Bits of the filter of a larger benchmark (32 MB), however large that is; it is sent in segments of SEGMENT bits.
FILTER_BITS, SEGMENT = 1 << 28, 1 << 16

_WORDS = re.compile("[a-z0-9]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def build_index(items: list[tuple[int, str]], run: int = RUN) -> dict:
    half = run // 2
    grams: dict[tuple, list[tuple[int, int]]] = {}
    texts: dict[int, list[str]] = {}
    for item, text in items:
        w = texts[item] = words_of(text)
        for i in range(len(w) - half + 1):
            grams.setdefault(tuple(w[i : i + half]), []).append((item, i))
    return {"run": run, "grams": grams, "texts": texts}


def spans_of(text: str | None, index: dict) -> list[tuple[int, int, int]]:
    """(item, first word, end word) of every maximal shared run of at least index["run"] words, in document words."""
    run, grams, texts = index["run"], index["grams"], index["texts"]
    half, w = run // 2, words_of(text)
    out: set[tuple[int, int, int]] = set()
    for i in range(0, len(w) - half + 1, half):
        for item, j in grams.get(tuple(w[i : i + half]), ()):
            b = texts[item]
            lo, hi = 0, half
            while i - lo > 0 and j - lo > 0 and w[i - lo - 1] == b[j - lo - 1]:
                lo += 1
            while i + hi < len(w) and j + hi < len(b) and w[i + hi] == b[j + hi]:
                hi += 1
            if lo + hi >= run:
                out.add((item, i - lo, i + hi))
    return sorted(out)


def shared_runs(w: list[str], b: list[str], shift: int, run: int) -> list[tuple[int, int]]:
    """(first word, end word) in w of every run of at least run words that w[i] and b[i - shift] share."""
    out, start = [], None
    lo, hi = max(0, shift), min(len(w), len(b) + shift)
    for i in range(lo, hi + 1):
        if i < hi and w[i] == b[i - shift]:
            start = i if start is None else start
        elif start is not None:
            if i - start >= run:
                out.append((start, i))
            start = None
    return out


def _hashes(blocks: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(blocks, dtype=object), categorize=False).view(np.int64) if blocks else np.zeros(0, dtype=np.int64)


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Two places of the filter for each hash (rows)."""
    h = hashes.view(np.uint64)
    return np.stack([h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)]).astype(np.int64)


def _blocks(half: int, step: int):
    """item_id, place, hash of every step-th block of half words."""

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, places, texts = [], [], []
            for item, text in zip(pdf.item_id, pdf.text):
                w = words_of(text)
                own = range(0, len(w) - half + 1, step)
                ids += [item] * len(own)
                places += own
                texts += [" ".join(w[i : i + half]) for i in own]
            yield pd.DataFrame({"item_id": np.array(ids, dtype=np.int64), "place": np.array(places, dtype=np.int64), "hash": _hashes(texts)})

    return blocks


def block_filter(blocks: DataFrame, count: int) -> np.ndarray:
    """Bytes of the filter of blocks(hash), made in segments on the executors; its size follows count up to FILTER_BITS."""
    size = 1 << max(16, min(FILTER_BITS.bit_length() - 1, (16 * count).bit_length()))

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.unique(_bits(pdf.hash.to_numpy(), size))
            yield pd.DataFrame({"segment": bits // SEGMENT, "bit": (bits % SEGMENT).astype(np.int32)})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(SEGMENT, dtype=bool)
        flags[pdf.bit.to_numpy()] = True
        return pd.DataFrame({"segment": [pdf.segment.iloc[0]], "packed": [np.packbits(flags).tobytes()]})

    rows = blocks.select("hash").mapInPandas(skip_empty(segments), "segment bigint, bit int").distinct().groupBy("segment").applyInPandas(pack, "segment bigint, packed binary")
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.collect():  # at most FILTER_BITS / SEGMENT rows of SEGMENT / 8 bytes
        out[r.segment * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(bytes(r.packed), dtype=np.uint8)
    return out


def _joined_leaks(documents: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """The runs of a benchmark too large to broadcast."""
    spark, half = documents.sparkSession, run // 2
    blocks = cut(items.mapInPandas(skip_empty(_blocks(half, 1)), "item_id bigint, place bigint, hash bigint"))
    held = checked_broadcast(spark, block_filter(blocks, blocks.count()))

    def pass_filter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = held.value
        aligned = _blocks(half, half)
        for pdf in batches:
            frame = next(aligned(iter([pd.DataFrame({"item_id": np.arange(len(pdf)), "text": pdf.text})])))
            at = _bits(frame.hash.to_numpy(), bits.size * 8)
            hit = ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
            for row, own in frame[hit].groupby("item_id"):
                yield pd.DataFrame({"doc_id": [pdf.doc_id.iloc[row]], "text": [pdf.text.iloc[row]], "places": [own.place.to_numpy()], "hashes": [own.hash.to_numpy()]})

    hits = cut(documents.mapInPandas(skip_empty(pass_filter), "doc_id bigint, text string, places array<bigint>, hashes array<bigint>"))
    spots = hits.select("doc_id", F.explode(F.arrays_zip("places", "hashes")).alias("z")).select("doc_id", F.col("z.places").alias("at"), F.col("z.hashes").alias("hash"))
    lines = spots.join(blocks, "hash").select("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift")).distinct()
    pairs = lines.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts"))  # diagonals of one document and one item
    both = pairs.join(hits.select("doc_id", "text").distinct(), "doc_id").join(items.select("item_id", F.col("text").alias("item_text")), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, item, text, other, shifts in zip(pdf.doc_id, pdf.item_id, pdf.text, pdf.item_text, pdf.shifts):
                w, b = words_of(text), words_of(other)
                rows += {(doc, item, lo, hi) for shift in shifts for lo, hi in shared_runs(w, b, int(shift), run)}
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "end_word"])

    return both.mapInPandas(skip_empty(verify), _FOUND)


_FOUND = "doc_id bigint, item_id bigint, first_word int, end_word int"


def _index(items: DataFrame, run: int, most: int) -> dict | None:
    """The broadcast index of items(item_id, text), or None if they have over most words."""
    words = F.size(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    if (items.agg(F.sum(words)).first()[0] or 0) > most:
        return None
    return build_index([(r.item_id, r.text) for r in items.collect()], run)


def _inputs(documents: DataFrame, benchmark: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    ship(documents.sparkSession)
    return documents.select("doc_id", "text").where(F.length("text") >= run * 2 - 1), benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")


def leaks(documents: DataFrame, benchmark: DataFrame, run: int = RUN, most: int = INDEX_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, end_word, n_words of each shared run; benchmarks of over most words are joined."""
    docs, items = _inputs(documents, benchmark, run)
    index = _index(items, run, most)
    if index is None:
        out = _joined_leaks(docs, items, run)
    else:
        held = checked_broadcast(documents.sparkSession, index)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, *s) for d, t in zip(pdf.doc_id, pdf.text) for s in spans_of(t, held.value)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "end_word"])

        out = docs.mapInPandas(skip_empty(scan), _FOUND)
    return out.withColumn("n_words", F.col("end_word") - F.col("first_word"))


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words (first word, end word)."""
    places = [(m.start(), m.end()) for m in _WORDS.finditer(text.lower())]
    if len(text.lower()) != len(text):  # lower-casing changed the length: places are taken letter by letter
        places, low, at = [], [], []
        for k, ch in enumerate(text):
            for x in ch.lower():
                low.append(x)
                at.append(k)
        places = [(at[m.start()], at[m.end() - 1] + 1) for m in _WORDS.finditer("".join(low))]
    out, last = [], 0
    for a, b in sorted(spans):
        start, end = places[a][0], places[b - 1][1]
        if start > last:
            out.append(text[last:start])
        last = max(last, end)
    return "".join(out) + text[last:]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each item, how many documents hold it and the longest shared run."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return leaks(docs, table(spark, sf_dir, "benchmark")).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").cast("bigint").alias("longest_run"))


def cleaned(documents: DataFrame, benchmark: DataFrame, run: int = RUN, most: int = INDEX_WORDS) -> DataFrame:
    """doc_id, text less the leaked spans, removed_words of every row of documents."""
    docs, items = _inputs(documents, benchmark, run)
    index = _index(items, run, most)
    schema = "doc_id bigint, text string, removed_words bigint"

    def stripped(text: str | None, runs: list[tuple[int, int]]) -> tuple[str | None, int]:
        if not runs:
            return text, 0
        out = remove_spans(text, runs)
        return out, len(words_of(text)) - len(words_of(out))

    if index is not None:
        held = checked_broadcast(documents.sparkSession, index)

        def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(d, *stripped(t, [s[1:] for s in spans_of(t, held.value)])) for d, t in zip(pdf.doc_id, pdf.text)]
                yield pd.DataFrame(rows, columns=["doc_id", "text", "removed_words"])

        return documents.select("doc_id", "text").mapInPandas(skip_empty(strip), schema)
    spans = cut(_joined_leaks(docs, items, run).groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans")))

    def strip_joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, *stripped(t, [(s["first_word"], s["end_word"]) for s in own])) for d, t, own in zip(pdf.doc_id, pdf.text, pdf.spans)]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "removed_words"])

    held_back = documents.select("doc_id", "text")
    kept = held_back.join(spans, "doc_id", "left_anti").select("doc_id", "text", F.lit(0).cast("bigint").alias("removed_words"))
    return held_back.join(spans, "doc_id").mapInPandas(skip_empty(strip_joined), schema).unionByName(kept)


def p8_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text less the leaked spans, and how many words went."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned(docs, table(spark, sf_dir, "benchmark"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_clean_documents": p8_clean_documents}
