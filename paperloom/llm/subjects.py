"""Problem 3: the subjects of each document by distributed latent Dirichlet topic models.

1. Every document is encoded once: its distinct words, its words in order as places among these, the words of each sentence.
   Words are hashed to BUCKETS, the bound of the model, so no word is cut off by its rank; those in few documents say nothing.
2. Topics, one for each subject and one background for each language, are fitted on all documents by variational EM: each pass
   reads every encoded document and sends back expected counts summed by topic and word. The Dirichlet prior over the words of
   a topic is seeded from all labelled files (lift within a language) and from inspected terms.
3. Every fitted topic is mapped to a subject through its top terms, or to none; several topics may speak for one subject.
4. One more pass over them infers their topic proportions, from these the proportions of windows of sentences, and from
   these the subject of each sentence. A document has a subject that leads the proportions of some window of RUN sentences
   and that a run of RUN sentences treats, a single stray sentence aside.

Defined results: null, blank and sentence-less texts have no subject; sentences without a known term belong to the run that they
stand in; repeated rows give one row; without labels the inspected terms alone seed the model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship, spread, table
from .common import FUNCTION_WORDS, checked_broadcast, skip_empty
from .sentences import sentences

SUBJECTS = ["classification_societies", "naval_architecture", "marine_operations", "offshore_subsea", "equipment", "regulatory", "research", "commercial"]
LANGUAGES = ["en", "de", "fr", "es", "it", "nl", "pt"]
# Inspected terms of the subjects, in English.
INSPECTED = {
    "classification_societies": "class classification notation surveyor scantling scantlings survey approval society memorandum",
    "naval_architecture": "hull stability metacentric trim heel bending resistance lever midship squat girder displacement",
    "marine_operations": "cargo ballast bunkering pilot passage mooring watch draught stowage tugs voyage discharged",
    "offshore_subsea": "subsea pipeline riser umbilical manifold spool seabed cathodic pile rov corridor",
    "equipment": "engine injector purifier turbocharger switchboard bearing pump liner spindle filter alarm gyrocompass",
    "regulatory": "convention statutory flag detention circular administration deficiency audit compliance exemption",
    "research": "hypothesis regression dataset literature experiment thesis model samples studies confidence",
    "commercial": "invoice contract charter freight tender payment laytime demurrage buyer seller purchase credit",
}
#: Hashed word numbers, the bound of the matrix that the driver holds and sends; words of fewer documents say nothing.
BUCKETS, MIN_DOCUMENTS = 1 << 17, 3
PASSES, INNER, ASSIGN_INNER = 6, 12, 6
ALPHA, SEED_TOKENS, SMOOTH = 0.08, 3000.0, 0.002
#: Labelled words weigh against so many words of their language's average.
LIFT_TOKENS = 60
RUN = 4
#: Top terms that map a topic, and the least share of their weight that must belong to the subject.
TOP_TERMS, MAP_SHARE = 40, 0.3
#: Least expected words of a subject in a sentence, and times as many as of the next subject.
MASS, LEAD = 0.8, 1.3
#: Least share of a subject in the subject proportions of a window of RUN sentences.
WINDOW_SHARE = 0.5
MEMO_LIMIT = 500_000
#: Documents worked on at once, and at most so many of them, and of their places with fillings, in one step of inference.
BATCH, STEP, STEP_PLACES = 4000, 256, 1 << 16
#: A table of at most so many rows is sent to the tasks; a larger one is joined.
FEW_ROWS = 100_000
#: Splits of the input that one task of a pass reads, so that what the tasks send back stays a small share of it.
SPLITS_A_TASK = 16

_WORD = re.compile(r"[^\W\d_]{3,}")
K, B = len(SUBJECTS), len(LANGUAGES)
_FUNCTION = [frozenset(FUNCTION_WORDS[lang].split()) for lang in LANGUAGES]


def bucket(word: str) -> int:
    return crc32(word.encode()) & (BUCKETS - 1)


def encoded(texts: DataFrame) -> DataFrame:
    """file_id, lang (index), words, tokens, sizes, row of every row of texts whose sentences hold words, materialised.

    words: the distinct buckets in order; tokens: the place among these of each word in turn; sizes: the words of each sentence."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers: dict[str, int] = {}
        for pdf in batches:
            rows = []
            for file_id, text in zip(pdf.file_id, pdf.text):
                own = [_WORD.findall(s.lower()) for s in sentences(text)]
                flat = [w for ws in own for w in ws]
                if flat:
                    times = Counter(flat)
                    hits = [sum(times[w] for w in ws if w in times) for ws in _FUNCTION]
                    if len(numbers) > MEMO_LIMIT:
                        numbers.clear()
                    numbers.update((w, bucket(w)) for w in times if w not in numbers)
                    words, tokens = np.unique([numbers[w] for w in flat], return_inverse=True)
                    sizes = np.fromiter(map(len, own), dtype=np.uint32, count=len(own))
                    rows.append((file_id, int(np.argmax(hits)), words.astype(np.uint32).tobytes(), tokens.astype(_kind(len(words))).tobytes(), sizes.tobytes()))
            yield pd.DataFrame(rows, columns=["file_id", "lang", "words", "tokens", "sizes"])

    out = texts.select("file_id", "text").where(F.length("text") >= 20).mapInPandas(skip_empty(encode), "file_id string, lang int, words binary, tokens binary, sizes binary")
    return cut(out.withColumn("row", F.monotonically_increasing_id()))


def _kind(n: int) -> type:
    """The numbers that places among n words are stored in."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _few(rows: DataFrame) -> DataFrame:
    """rows, to be sent to the tasks if they are few."""
    return F.broadcast(rows) if rows.limit(FEW_ROWS + 1).count() <= FEW_ROWS else rows


def single(docs: DataFrame) -> DataFrame:
    """docs as from encoded(), one row for each file_id; it does not depend on the order of the rows which of several texts stays."""
    again = docs.groupBy("file_id").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("words", "tokens"), "row")).alias("first"))
    again = cut(again.where(F.col("n") > 1).select("file_id", F.col("first.row").alias("first")))
    n = again.limit(FEW_ROWS + 1).count()
    if not n:
        return docs
    out = docs.join(F.broadcast(again) if n <= FEW_ROWS else again, "file_id", "left").where(F.col("first").isNull() | (F.col("first") == F.col("row"))).drop("first")
    return out if n <= FEW_ROWS else cut(out)


def _lengths(arrays: list[np.ndarray]) -> np.ndarray:
    return np.fromiter(map(len, arrays), dtype=np.int64, count=len(arrays))


def entries(pdf: pd.DataFrame, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of known words of each document, these words, their counts, known of all words, entry of each token among all words)."""
    words = [np.frombuffer(w, dtype=np.uint32) for w in pdf.words]
    tokens = [np.frombuffer(t, dtype=_kind(len(w))) for t, w in zip(pdf.tokens, words)]
    n = _lengths(words)
    at = place[np.concatenate(words)]
    token = np.concatenate(tokens).astype(np.int64) + np.repeat(np.cumsum(n) - n, _lengths(tokens))
    known = at >= 0
    lengths = np.bincount(np.repeat(np.arange(len(n)), n)[known], minlength=len(n))
    return lengths, at[known], np.bincount(token, minlength=len(at))[known], known, token


def proportions(lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, phi: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(topic proportions of documents of so many terms each, those before the last step, count by mean of phi there for each term) under phi (words x topics).

    Documents of like lengths meet in one step, as matrices that the cache holds. The responsibility of topic k for a term is
    its phi times the last but one proportion times the third result by its count."""
    starts, order, k = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable"), phi.shape[1]
    theta, before, by = np.empty((len(lengths), k), dtype=phi.dtype), np.empty((len(lengths), k), dtype=phi.dtype), np.empty(len(terms), dtype=phi.dtype)
    counts, tiny, alpha = counts.astype(phi.dtype), phi.dtype.type(1e-30), phi.dtype.type(ALPHA)
    i = 0
    while i < len(order):
        own = order[i : i + STEP]
        own = own[: max(1, STEP_PLACES // max(int(lengths[own[-1]]), 1))]
        i += len(own)
        span = np.arange(lengths[own[-1]])
        filled = span < lengths[own][:, None]
        at = np.where(filled, starts[own][:, None] + span, 0)
        p, c = phi[terms[at]], np.where(filled, counts[at], phi.dtype.type(0))
        now = np.full((len(own), k), 1 / k, dtype=phi.dtype)
        for _ in range(inner):
            last = now
            q = c / np.maximum(np.matmul(p, now[:, :, None])[:, :, 0], tiny)
            now = now * np.matmul(q[:, None, :], p)[:, 0] + alpha
            now /= now.sum(axis=1, keepdims=True)
        theta[own], before[own], by[at[filled]] = now, last, q[filled]
    return theta, before, by


def infer(rows: list[np.ndarray], phi: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """proportions() of documents given as word numbers under phi (topics x words)."""
    each = [np.unique(w, return_counts=True) for w in rows]
    return proportions(_lengths([w for w, _ in each]), np.concatenate([w for w, _ in each]), np.concatenate([n for _, n in each]), np.ascontiguousarray(phi.T), inner)


class Topics:
    """Fitted topics: phi (active words x topics), place of each bucket among the active words or -1, and topics x subjects."""

    def __init__(self, phi: np.ndarray, place: np.ndarray, speaks: np.ndarray):
        self.phi, self.place, self.speaks = np.ascontiguousarray(phi.T, dtype=np.float32), place.astype(np.int32), speaks.astype(np.float32)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for i in range(0, len(pdf), BATCH):
            yield pdf.iloc[i : i + BATCH]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Topics, np.ndarray] | None:
    """(topics, seeds: subjects x active words) of docs as from encoded(), all of them; None if no word is in MIN_DOCUMENTS documents."""
    known = labels.where(F.col("subject").isin(*SUBJECTS)).groupBy("file_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    docs = single(docs).select("file_id", "lang", "words", "tokens")
    everywhere = np.arange(BUCKETS)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // SPLITS_A_TASK)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, B * BUCKETS))
        for pdf in _parts(batches):
            lengths, words, counts, _, _ = entries(pdf, everywhere)
            code = np.repeat(pdf.lang.to_numpy() * BUCKETS, lengths) + words
            np.add.at(total[0], code, counts)
            np.add.at(total[1], code, 1)
        code = np.flatnonzero(total[1])
        yield pd.DataFrame({"lang": code // BUCKETS, "word": code % BUCKETS, "n": total[0, code], "documents": total[1, code]})

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(B * K * BUCKETS)
        for pdf in _parts(batches):
            lengths, words, counts, _, _ = entries(pdf, everywhere)
            ends = np.cumsum(lengths)
            for lang, subjects, lo, hi in zip(pdf.lang, pdf.subjects, ends - lengths, ends):
                for subject in subjects:
                    total[(lang * K + SUBJECTS.index(subject)) * BUCKETS + words[lo:hi]] += counts[lo:hi] / len(subjects)
        code = np.flatnonzero(total)
        yield pd.DataFrame({"lang": code // BUCKETS // K, "topic": code // BUCKETS % K, "word": code % BUCKETS, "n": total[code]})

    whole = docs.coalesce(tasks).mapInPandas(skip_empty(start), "lang int, word int, n double, documents double").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")).toPandas()  # at most languages x BUCKETS
    own = docs.join(_few(known), "file_id").coalesce(tasks).mapInPandas(skip_empty(labelled), "lang int, topic int, word int, n double").groupBy("lang", "topic", "word").agg(F.sum("n").alias("n")).toPandas()  # at most languages x subjects x BUCKETS
    spread_over = np.bincount(whole.word, weights=whole.documents, minlength=BUCKETS)
    active = np.flatnonzero(spread_over >= MIN_DOCUMENTS)
    if not len(active):
        return None
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[active] = np.arange(len(active))
    v = len(active)
    base, cells = np.zeros((B, v)), np.zeros((B, K, v))
    whole, own = whole[place[whole.word] >= 0], own[place[own.word] >= 0]
    base[whole.lang, place[whole.word]] = whole.n
    cells[own.lang, own.topic, place[own.word]] = own.n
    seeds, keep = np.zeros((K, v)), np.ones((B, v))
    for b in range(B):
        if not base[b].sum():
            continue
        p = (base[b] + 1e-9) / base[b].sum()
        for k in range(K):
            n = cells[b, k].sum()
            if n:
                lift = (cells[b, k] + LIFT_TOKENS * p) / (n + LIFT_TOKENS) / p
                special = np.clip(1 - 1.6 / np.maximum(lift, 1e-9), 0, None) * (cells[b, k] >= 2)
                weight = (cells[b, k] / n) * special
                seeds[k] += weight / max(weight.sum(), 1e-12) * min(1.0, n / 300)
                keep[b] *= 1 - special
    for k, subject in enumerate(SUBJECTS):
        total = seeds[k].sum()
        seeds[k] = seeds[k] / total if total else seeds[k]
        inspected = [place[bucket(w)] for w in INSPECTED[subject].split() if place[bucket(w)] >= 0]
        if inspected:
            seeds[k, inspected] += 0.5 / len(inspected)
            keep[:, inspected] *= 0.05
    backgrounds = base * keep**2 + 1e-12
    backgrounds /= np.maximum(backgrounds.sum(axis=1, keepdims=True), 1e-9)
    prior = np.vstack([seeds / np.maximum(seeds.sum(axis=1, keepdims=True), 1e-12), backgrounds]) * SEED_TOKENS + SMOOTH
    idle = np.zeros(K + B, dtype=bool)
    idle[:K] = seeds.sum(axis=1) <= 0  # neither labels nor inspected terms speak for the subject here: it has no topic
    prior[idle] = 1e-9
    phi = np.where(idle[:, None], 1e-12, prior / prior.sum(axis=1, keepdims=True))
    topics = [f"t{k}" for k in range(K + B)]
    for _ in range(PASSES):
        held = checked_broadcast(docs.sparkSession, (np.ascontiguousarray(phi.T, dtype=np.float32), place))

        def expect(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            now, at = held.value
            total = np.zeros(now.shape)
            for pdf in _parts(batches):
                lengths, terms, counts, _, _ = entries(pdf, at)
                _, before, by = proportions(lengths, terms, counts, now)
                before = np.repeat(before, lengths, axis=0)
                for k in range(now.shape[1]):
                    total[:, k] += np.bincount(terms, weights=by * before[:, k], minlength=len(now))
            word = np.flatnonzero(total.any(axis=1))
            frame = pd.DataFrame(total[word] * now[word], columns=topics)
            frame.insert(0, "word", word.astype("int32"))
            yield frame

        sums = docs.select("words", "tokens").coalesce(tasks).mapInPandas(skip_empty(expect), "word int, " + ", ".join(f"{t} double" for t in topics)).groupBy("word").agg(*[F.sum(t).alias(t) for t in topics]).toPandas()  # one row an active word
        expected = prior.copy()
        expected[:, sums.word] += sums[topics].to_numpy().T
        expected[K:] *= keep**2  # a background never wins back the words that speak for a subject
        phi = np.where(idle[:, None], 1e-12, expected / expected.sum(axis=1, keepdims=True))
    return Topics(phi, place, mapped(phi, seeds, backgrounds.max(axis=0))), seeds


def top_terms(phi: np.ndarray, n: int = TOP_TERMS) -> list[np.ndarray]:
    """The words of each topic that are frequent in it and rare in others."""
    share = phi / np.maximum(phi.sum(axis=0, keepdims=True), 1e-12)
    return [np.argsort(-phi[t] * share[t] ** 2)[:n] for t in range(len(phi))]


def mapped(phi: np.ndarray, seeds: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Topics x subjects, 1 where a topic speaks for a subject: the one that most of the weight of its top terms belongs to by inspected and labelled terms.

    usual: how frequent each word is in the languages at large; a word belongs to a subject as far as it is seeded beyond that."""
    out = np.zeros((len(phi), K))
    belongs = seeds / np.maximum(seeds.sum(axis=0) + usual, 1e-12)
    for t, top in enumerate(top_terms(phi)):
        weight = phi[t, top]
        score = belongs[:, top] @ weight / max(weight.sum(), 1e-12)
        if weight.max() > 1e-9 and score.max() >= MAP_SHARE:
            out[t, score.argmax()] = 1
    return out


def run_subjects(subjects: list[int], run: int = RUN) -> dict[int, int]:
    """Subject -> longest run; a single sentence of another subject inside a run, and sentences of none, do not end it."""
    best: dict[int, int] = {}
    for k in set(subjects) - {-1}:
        length = stray = 0
        pending = 0
        for x in subjects:
            if x == k:
                length += 1 + pending
                pending = stray = 0
                best[k] = max(best.get(k, 0), length)
            elif x == -1 and length:
                pending += 1
            elif length:
                stray += 1
                if stray > 1 or pending > 1:
                    length = stray = pending = 0
    return {k: n for k, n in best.items() if n >= run}


def judged(pdf: pd.DataFrame, topics: Topics) -> list[dict[int, tuple[float, int]]]:
    """For each document of encoded(): subject -> (share of its proportions, longest run)."""
    lengths, terms, counts, known, token = entries(pdf, topics.place)
    theta, before, by = proportions(lengths, terms, counts, topics.phi, ASSIGN_INNER)
    r = topics.phi[terms] * np.repeat(before, lengths, axis=0) * (by / counts)[:, None]
    active = known[token]
    inverse = (np.cumsum(known) - 1)[token[active]]
    own = [np.frombuffer(s, dtype=np.uint32) for s in pdf.sizes]
    n_sentences = _lengths(own)
    until = np.concatenate([[0], np.cumsum(active)])
    last = np.cumsum(np.concatenate(own), dtype=np.int64)
    sizes = np.diff(until[last], prepend=0)  # known words of each sentence
    ends = np.cumsum(n_sentences)
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]

    def by_sentence(each: np.ndarray) -> np.ndarray:
        out = np.zeros((len(sizes), each.shape[1]), dtype=np.float32)
        out[filled] = np.add.reduceat(each, starts, axis=0)
        return out

    sums = np.vstack([np.zeros((1, r.shape[1]), dtype=np.float32), np.cumsum(by_sentence(r[inverse]), axis=0, dtype=np.float64)])
    lows, highs = np.repeat(ends - n_sentences, n_sentences), np.repeat(ends, n_sentences)
    at = np.arange(len(sizes))

    def windows(before: int, after: int) -> np.ndarray:
        return sums[np.minimum(at + after, highs)] - sums[np.maximum(at - before, lows)]

    beside = (windows(RUN // 2, RUN // 2 + 1) + ALPHA).astype(np.float32)  # proportions of the window around each sentence
    beside /= beside.sum(axis=1, keepdims=True)
    p = topics.phi[terms][inverse] * beside[np.repeat(at, sizes)]
    p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-30)
    mass = by_sentence(p) @ topics.speaks
    best, two = mass.argmax(axis=1), np.partition(mass, -2, axis=1)[:, -2:]
    label = np.where((two[:, 1] > MASS) & (two[:, 1] > LEAD * two[:, 0]), best, -1)
    ahead = windows(0, RUN) @ topics.speaks
    lead = ahead / np.maximum(ahead.sum(axis=1, keepdims=True), 1e-9) >= WINDOW_SHARE
    whole = theta @ topics.speaks
    whole = whole / np.maximum(whole.sum(axis=1, keepdims=True), 1e-9)
    out = []
    for d, (hi, n) in enumerate(zip(ends, n_sentences)):
        found = run_subjects(label[hi - n : hi].tolist())
        out.append({k: (float(whole[d, k]), length) for k, length in found.items() if lead[hi - n : hi, k].any()})
    return out


def assigned(docs: DataFrame, topics: Topics) -> DataFrame:
    """file_id, subject, share (of the document's subject proportions), n_sentences (longest run) of docs as from encoded()."""
    held = checked_broadcast(docs.sparkSession, topics)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _parts(batches):
            rows = []
            for file_id, found in zip(pdf.file_id, judged(pdf, held.value)):
                rows += [(file_id, SUBJECTS[k], share, n) for k, (share, n) in sorted(found.items())]
            yield pd.DataFrame(rows, columns=["file_id", "subject", "share", "n_sentences"])

    return docs.select("file_id", "words", "tokens", "sizes").mapInPandas(skip_empty(assign), _FOUND)


_FOUND = "file_id string, subject string, share double, n_sentences int"


def subjects_of(texts: DataFrame, labels: DataFrame) -> DataFrame:
    ship(texts.sparkSession)
    docs = encoded(texts)
    fitted = fit(docs, labels)
    if fitted is None:
        return texts.sparkSession.createDataFrame([], _FOUND)
    return assigned(docs, fitted[0])


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = spread(table(spark, sf_dir, "corpus").select("file_id", F.col("raw_text").alias("text")))
    return texts, table(spark, sf_dir, "subject_label").select("file_id", "subject").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects_of(*_inputs(spark, sf_dir)).select("file_id", "subject").distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject, files without a subject as a row of their own (null): files and summed shares; a file of two subjects counts in both by its proportions."""
    texts, labels = _inputs(spark, sf_dir)
    found = subjects_of(texts, labels).dropDuplicates(["file_id", "subject"])
    every = texts.select("file_id").distinct().join(found, "file_id", "left")
    return every.groupBy("subject").agg(F.countDistinct("file_id").alias("n_files"), F.sum(F.coalesce("share", F.lit(0.0))).alias("weight"))


def p3_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted topics for inspection: topic, the subject that it was mapped to (null: a background), its top terms in order."""
    texts, labels = _inputs(spark, sf_dir)
    ship(spark)
    fitted = fit(encoded(texts), labels)
    schema = "topic int, subject string, terms array<string>"
    if fitted is None:
        return spark.createDataFrame([], schema)
    topics, _ = fitted
    tops = top_terms(topics.phi.T, 20)
    wanted = {int(b) for b in np.flatnonzero(np.isin(topics.place, np.concatenate(tops)))}
    held = checked_broadcast(spark, wanted)

    def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = Counter(w for text in pdf.text if text for w in _WORD.findall(text.lower()))
            rows = [(bucket(w), w, n) for w, n in counts.items() if bucket(w) in held.value]
            yield pd.DataFrame(rows, columns=["bucket", "word", "n"])

    words = texts.select("text").mapInPandas(skip_empty(spelled), "bucket int, word string, n bigint").groupBy("bucket", "word").agg(F.sum("n").alias("n")).groupBy("bucket").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    name = {int(topics.place[r.bucket]): r.word for r in words.collect()}  # twenty words a topic
    rows = [(t, next((SUBJECTS[k] for k in range(K) if topics.speaks[t, k]), None), [name.get(int(w), "") for w in top]) for t, top in enumerate(tops)]
    return spark.createDataFrame(rows, schema)


QUERIES = {"p3_found": p3_found, "p3_shares": p3_shares, "p3_topics": p3_topics}
