"""Problem 5: the language of each text and of each stretch, by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A sentence is parsed into the longest pieces that occur in a
language's text; the language that needs the fewest pieces for each character wins, and the confidence is the share by which
the next language needs more. All sentences of a batch walk all automata together, one character a step.

Defined results: null, blank and sentence-less texts have no language; sentences without MIN_LETTERS letters
have no language of their own, those under MIN_CONFIDENCE follow their neighbours; a text without any surer sentence has the
language that it needs fewest pieces of, with its low confidence; labels are read in the written forms of LABELS, anything else names another language; ties go to the first language
of LANGUAGES; repeated rows give one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship, spread, table
from .common import FUNCTION_WORDS, checked_broadcast, skip_empty
from .sentences import sentences

LANGUAGES = ["en", "de", "fr", "es", "it", "nl", "pt"]
# Written forms of the languages, without region.
LABELS = {
    "en": "en eng english englisch anglais inglés inglese engels inglês", "de": "de deu ger german deutsch allemand alemán tedesco duits alemão", "fr": "fr fra fre french français francais französisch francés francese frans",
    "es": "es spa esp spanish español espanol castellano spanisch espagnol spagnolo spaans espanhol", "it": "it ita italian italiano italienisch italien italiaans", "nl": "nl nld dut dutch nederlands niederländisch néerlandais holandés olandese",
    "pt": "pt por ptb portuguese português portugues portugiesisch portugais portoghese portugees",
}
# Labels that say nothing.
NO_LABEL = ("", "unknown", "und", "unk", "none", "null", "n/a", "na", "?", "-", "mul", "zxx", "mis")
#: The automata are built from at most so many labelled documents and characters of each language.
TRAIN_DOCUMENTS, TRAIN_CHARS = 300, 15_000
MIN_LETTERS = 15
#: Sentences under this confidence follow their neighbours; they count where their own best language is that of the stretch.
MIN_CONFIDENCE = 0.25
RUN = 2

_LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøœùúûüß' "
_CODE = {ch: i for i, ch in enumerate(_LETTERS)}
ALPHABET = len(_LETTERS)


class _Table(dict):
    """Letters to codes; what is no letter parts words; digits are dropped."""

    def __missing__(self, key: int):
        ch = chr(key)
        out = _CODE.get(ch)
        if out is None:
            out = _CODE["'"] if ch in "’‘`´" else None if ch.isdigit() else _CODE[" "]
        self[key] = value = None if out is None else chr(out)
        return value


_TABLE = _Table()


def codes_of(sentence: str) -> bytes:
    """One byte a letter."""
    return " ".join(sentence.lower().split()).translate(_TABLE).encode("latin-1")


def build_automaton(text: bytes) -> np.ndarray:
    """Suffix automaton of text: a matrix of the next state of each state (rows) by letter, -1 where there is none."""
    links, lengths, nexts = [-1], [0], [{}]
    last = 0
    for c in text:
        current = len(links)
        links.append(0)
        lengths.append(lengths[last] + 1)
        nexts.append({})
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = current
            p = links[p]
        if p != -1:
            q = nexts[p][c]
            if lengths[p] + 1 == lengths[q]:
                links[current] = q
            else:
                clone = len(links)
                links.append(links[q])
                lengths.append(lengths[p] + 1)
                nexts.append(dict(nexts[q]))
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = links[p]
                links[q] = links[current] = clone
        last = current
    out = np.full((len(links), ALPHABET), -1, dtype=np.int32)
    for state, moves in enumerate(nexts):
        for c, to in moves.items():
            out[state, c] = to
    return out


def pieces(rows: list[bytes], automata: list[np.ndarray]) -> np.ndarray:
    """Number of pieces of each row (lines) in each automaton (columns)."""
    sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
    order = np.argsort(-sizes, kind="stable")
    counts = np.zeros((len(rows), len(automata)), dtype=np.int32)
    if not len(rows) or sizes[order[0]] == 0:
        return counts
    flat = np.frombuffer(b"".join(rows[i] for i in order), dtype=np.uint8).astype(np.int32)
    ordered = sizes[order]
    starts = np.concatenate(([0], np.cumsum(ordered)[:-1]))
    alive = np.searchsorted(-ordered, -np.arange(int(ordered[0])), side="left")
    flats = [a.reshape(-1) for a in automata]
    roots = [a[0] for a in automata]
    states = [np.zeros(len(rows), dtype=np.int32) for _ in automata]
    found = [np.ones(len(rows), dtype=np.int32) for _ in automata]
    for step in range(int(ordered[0])):
        n = int(alive[step])
        letter = flat[starts[:n] + step]
        for k, (moves, root) in enumerate(zip(flats, roots)):
            state = states[k]
            new = moves[state[:n] * ALPHABET + letter]
            missed = np.flatnonzero(new < 0)
            if missed.size:
                found[k][missed] += 1
                new[missed] = np.maximum(root[letter[missed]], 0)
            state[:n] = new
    for k in range(len(automata)):
        counts[order, k] = found[k]
    return counts


def vote(sentence: str) -> str | None:
    """The language with most function words, if it is alone; vets the labels of the training text."""
    words = sentence.lower().replace("’", "'").split()
    hits = {lang: sum(w in ws for w in words) for lang, ws in _FUNCTION.items()}
    best = max(hits.values())
    winners = [lang for lang, n in hits.items() if n == best]
    return winners[0] if best >= 2 and len(winners) == 1 else None


_FUNCTION = {lang: frozenset(words.split()) for lang, words in FUNCTION_WORDS.items()}


def label_code(label: Column) -> Column:
    """The language code that a label names; null for no label, other for any other language."""
    base = F.regexp_extract(F.lower(F.trim(F.coalesce(label, F.lit("")))), r"^([\p{L}?/-]*?)(?:[-_][\p{L}\p{N}]+)*$", 1)
    known = F.create_map(*[F.lit(x) for code, names in LABELS.items() for name in names.split() for x in (name, code)])
    bare = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(bare.isin(*NO_LABEL), None).otherwise(F.coalesce(F.try_element_at(known, base), F.try_element_at(known, bare), F.lit("other")))


def train(texts: DataFrame, labels: DataFrame) -> list[np.ndarray]:
    """Automata in the order of LANGUAGES from texts(file_id, text) and labels(file_id, code); a language without text gets an empty one.

    Executors cut the sampled documents to vetted sentences; the driver gets about TRAIN_CHARS characters a language."""
    ranked = labels.where(F.col("code").isin(*LANGUAGES)).select("code", "file_id", F.xxhash64(F.lit(3), "file_id").alias("h"))
    parts = None
    for code in LANGUAGES:
        top = ranked.where(F.col("code") == code).orderBy("h", "file_id").limit(TRAIN_DOCUMENTS)
        parts = top if parts is None else parts.unionByName(top)
    sampled = texts.select("file_id", "text").join(F.broadcast(parts.select("file_id", "code", "h").distinct()), "file_id")  # at most TRAIN_DOCUMENTS ids a language

    def vetted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file_id, code, h, text in zip(pdf.file_id, pdf.code, pdf.h, pdf.text):
                size = 0
                for k, s in enumerate(sentences(text)):
                    if size < TRAIN_CHARS and vote(s) == code:
                        rows.append((code, h, file_id, k, codes_of(s)))
                        size += len(rows[-1][-1])
            yield pd.DataFrame(rows, columns=["code", "h", "file_id", "place", "line"])

    lines = sampled.mapInPandas(skip_empty(vetted), "code string, h bigint, file_id string, place int, line binary")
    lines = lines.groupBy("code", "line").agg(F.min(F.struct("h", "file_id", "place")).alias("first"))
    before = Window.partitionBy("code").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    kept = lines.withColumn("size", F.coalesce(F.sum(F.octet_length("line")).over(before), F.lit(0))).where(F.col("size") < TRAIN_CHARS)
    text_of: dict[str, list[bytes]] = {code: [] for code in LANGUAGES}
    for r in kept.orderBy("first").select("code", "line").collect():
        text_of[r.code].append(bytes(r.line))
    return [build_automaton(bytes([_CODE[" "]]).join(text_of[code])) for code in LANGUAGES]


def stretches(best: list[int], sure: list[bool], mute: list[bool]) -> list[tuple[int, list[int], list[int]]]:
    """(language, its sentences, those of them that count) of one text in order; best: the language of each sentence.

    A sentence that is not sure goes with the stretch before it, or with the one after if only that is its own language; it
    counts where its own language is that of the stretch. A mute sentence has no language of its own. The caller settles
    texts without any sure sentence."""
    known = [k for k, x in enumerate(sure) if x]
    out: list[tuple[int, list[int], list[int]]] = []
    last = best[known[0]]
    ahead = 0
    for k, own in enumerate(best):
        while ahead < len(known) and known[ahead] < k:
            ahead += 1
        following = best[known[ahead]] if ahead < len(known) else last
        lang = own if sure[k] else following if own != last and own == following and not mute[k] else last
        if not out or out[-1][0] != lang:
            out.append((lang, [], []))
        out[-1][1].append(k)
        if sure[k] or (own == lang and not mute[k]):
            out[-1][2].append(k)
        last = lang
    return out


def judged(texts: DataFrame, automata: list[np.ndarray]) -> DataFrame:
    """file_id, segment_no, lang_code, n_sentences, n_chars, confidence: stretches of successive sentences in one language."""
    held = checked_broadcast(texts.sparkSession, automata)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = held.value
        for pdf in batches:
            place: dict[bytes, int] = {}
            unique: list[bytes] = []
            docs = []
            for file_id, text in zip(pdf.file_id, pdf.text):
                own = []
                for s in sentences(text):
                    c = codes_of(s)
                    at = place.get(c)
                    if at is None:
                        at = place[c] = len(unique)
                        unique.append(c)
                    own.append(at)
                if own:
                    docs.append((file_id, own))
            counts = pieces(unique, models)
            size = np.maximum(np.fromiter(map(len, unique), dtype=np.int64, count=len(unique)), 1)
            rates = counts / size[:, None]
            best = rates.argmin(axis=1) if len(unique) else np.zeros(0, dtype=int)
            two = np.partition(rates, 1, axis=1)[:, :2] if len(unique) else np.zeros((0, 2))
            sure = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
            mute = [len(c) - c.count(_CODE[" "]) < MIN_LETTERS for c in unique]
            rows = []
            for file_id, own in docs:
                langs, certain, silent = [int(best[i]) for i in own], [not mute[i] and sure[i] >= MIN_CONFIDENCE for i in own], [mute[i] for i in own]
                if any(certain):
                    parts = stretches(langs, certain, silent)
                    of = [sum(float(sure[own[k]]) for k in counted) / max(len(counted), 1) for _, _, counted in parts]
                elif not all(silent):  # nothing is sure: the language that the whole text needs fewest pieces of
                    total = sum(counts[i] for i in own if not mute[i])
                    lang, two_best = int(np.argmin(total)), np.sort(total)[:2]
                    parts = [(lang, list(range(len(own))), [k for k in range(len(own)) if langs[k] == lang and not silent[k]])]
                    of = [float(1 - two_best[0] / max(two_best[1], 1e-9))]
                else:
                    continue
                rows += [(file_id, k, LANGUAGES[lang], len(counted), sum(int(size[own[j]]) for j in places), c) for k, ((lang, places, counted), c) in enumerate(zip(parts, of))]
            yield pd.DataFrame(rows, columns=["file_id", "segment_no", "lang_code", "n_sentences", "n_chars", "confidence"])

    return texts.select("file_id", "text").mapInPandas(skip_empty(judge), "file_id string, segment_no int, lang_code string, n_sentences int, n_chars bigint, confidence double")


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ship(spark)
    texts = table(spark, sf_dir, "corpus").where(F.length("raw_text") >= 20).select("file_id", F.col("raw_text").alias("text"))
    state = table(spark, sf_dir, "documents_state").select("file_id", label_code(F.col("merged.language.value")).alias("code"))
    return spread(texts), state


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, labels = _inputs(spark, sf_dir)
    segments = judged(texts, train(texts, labels)).where(F.col("n_sentences") >= RUN)
    held = segments.groupBy("file_id").agg(F.collect_set("lang_code").alias("codes"))
    labelled = held.join(labels.distinct(), "file_id", "left")
    wrong = F.col("code").isNull() | ~F.array_contains("codes", F.col("code")) | (F.size("codes") >= 2)
    return labelled.where(wrong).select("file_id", F.explode("codes").alias("lang_code")).distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every file with its language and confidence."""
    texts, labels = _inputs(spark, sf_dir)
    return judged(texts, train(texts, labels)).distinct()


def p5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its main language, the confidence weighted by length, and its number of languages."""
    s = p5_segments(spark, sf_dir)
    per = s.groupBy("file_id", "lang_code").agg(F.sum("n_chars").alias("chars"), (F.sum(F.col("confidence") * F.col("n_chars")) / F.sum("n_chars")).alias("confidence"))
    return per.groupBy("file_id").agg(
        F.max_by("lang_code", F.struct("chars", "lang_code")).alias("lang_code"), F.max_by("confidence", F.struct("chars", "lang_code")).alias("confidence"), F.count("*").alias("n_languages")
    )


QUERIES = {"p5_found": p5_found, "p5_segments": p5_segments, "p5_languages": p5_languages}
