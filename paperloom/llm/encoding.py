"""Problem 2: text decoded with the wrong character encoding.

1. Words with letters beyond ASCII are counted over all records (JVM side, partial aggregates).
2. A smoothed character trigram model is trained on the words of clean records: those in which no chain of strict decoding
   applies and no replacement or control character stands.
3. Each word of a record is scored as it stands and after every encode-decode chain; the likeliest chain is taken if its
   gain in log-likelihood exceeds a margin validated on the clean words.
4. Characters lost to U+FFFD mark the field in any case; they are restored if the likeliest spelling beats all others by the margin.

Words are tried run by run for chains that end in UTF-8 (a garbled stretch may touch a clean one) and whole for single-byte chains.

Defined results: null and blank texts and maps hold nothing; a map counts as one field, whatever its keys; repeated rows give one row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from heapq import nlargest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship, spread, table
from .common import checked_broadcast, skip_empty

# Encodings that UTF-8 bytes are mistaken for, and single-byte ones mistaken for each other (wrong, right).
UTF8_READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1254", "iso8859-15", "cp866", "koi8-r"]
SINGLE_BYTE = [("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1252", "cp437")]

#: Words are parts without white space that hold a character beyond ASCII.
WORD = r"[^ \t\n\x0B\f\r]*[^\x00-\x7F][^ \t\n\x0B\f\r]*"
#: Trigrams, contexts and letters that make up less than this share of all count as unseen: so a level has at most the inverse.
GRAM_SHARE = 1e-6
#: Least margin in nats; the validated margin is the quantile of the gains on clean words if that is more.
FLOOR, QUANTILE, CEILING = 2.5, 0.999, 8.0
PURGES = 2
ADD = 0.05
MEMO_LIMIT = 300_000

_RUN = re.compile(r"[^\x00-\x7f]+")
_WORDS = re.compile(WORD)
_EDGE = "\x02"


def _encode(s: str, enc: str) -> bytes | None:
    """Bytes of s; code points under 256 that a Windows code page leaves open stand for themselves."""
    try:
        return s.encode(enc)
    except UnicodeEncodeError:
        if not enc.startswith("cp125"):
            return None
    out = bytearray()
    for ch in s:
        try:
            out += ch.encode(enc)
        except UnicodeEncodeError:
            if ord(ch) > 255:
                return None
            out.append(ord(ch))
    return bytes(out)


def _strict_utf8(run: str, enc: str) -> str | None:
    raw = _encode(run, enc)
    if raw is None:
        return None
    try:
        out = raw.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return out if out != run else None


def candidates(word: str) -> dict[str, str]:
    """Chain name -> word after it, for every chain that applies strictly; a chain of two steps undoes a double mistake."""
    out: dict[str, str] = {}
    for enc in UTF8_READ_AS:
        once = _RUN.sub(lambda m: _strict_utf8(m.group(), enc) or m.group(), word)
        if once != word:
            out[f"utf-8 as {enc}"] = once
            for second in ("cp1252", "latin-1"):
                twice = _RUN.sub(lambda m: _strict_utf8(m.group(), second) or m.group(), once)
                if twice != once:
                    out[f"utf-8 as {second}, as {enc}"] = twice
    for wrong, right in SINGLE_BYTE:
        raw = _encode(word, wrong)
        if raw is None:
            continue
        try:
            once = raw.decode(right)
        except UnicodeDecodeError:
            continue
        if once != word:
            out[f"{right} as {wrong}"] = once
    return out


def surely_garbled(word: str) -> bool:
    """Used only to choose the clean records that the model is trained on."""
    if any(ch == "�" or "\x7f" <= ch <= "\x9f" for ch in word):
        return True
    return any(_strict_utf8(m.group(), enc) for m in _RUN.finditer(word) for enc in UTF8_READ_AS[:6])


def _grams(word: str) -> Iterator[tuple[str, str]]:
    padded = _EDGE * 2 + word + _EDGE
    for i in range(2, len(padded)):
        yield padded[i - 2 : i], padded[i]


def _levels(gram: str) -> tuple[tuple[str, str], ...]:
    """The counts that a trigram adds to besides its own: its context, its bigram, the letter before the last, the last."""
    return ("2", gram[:2]), ("b", gram[1:]), ("m", gram[1]), ("1", gram[2])


class Model:
    """Character trigrams, smoothed by interpolation with bigrams, letters and a flat rest."""

    def __init__(self, counts: dict[str, int], lower: dict[str, dict[str, int]] | None = None):
        """counts of trigrams; lower: those of their contexts (2), bigrams (b), middle letters (m) and letters (1), else summed from counts."""
        if lower is None:
            lower = {"2": Counter(), "b": Counter(), "m": Counter(), "1": Counter()}
            for gram, n in counts.items():
                for level, part in _levels(gram):
                    lower[level][part] += n
        self.tri, self.tri_all, self.bi, self.bi_all, self.one = counts, lower["2"], lower["b"], lower["m"], lower["1"]
        self.total = sum(self.one.values()) or 1
        self.margin = FLOOR
        self.letters = [ch for ch in sorted(self.one, key=lambda c: (-self.one[c], c)) if ch.isalpha() and ord(ch) > 127 or ch in "’–…“”°"]
        self.memo: dict[str, tuple[str, str] | None] = {}

    def term(self, context: str, ch: str) -> float:
        p1 = (self.one.get(ch, 0) + ADD) / (self.total + ADD * 2000)
        n2 = self.bi_all.get(context[1], 0)
        p2 = (self.bi.get(context[1] + ch, 0) + 2 * p1) / (n2 + 2)
        n3 = self.tri_all.get(context, 0)
        return math.log((self.tri.get(context + ch, 0) + 2 * p2) / (n3 + 2))

    def score(self, word: str) -> float:
        out = 0.0
        for context, ch in _grams(word):
            out += self.term(context, ch)
        return out

    def best(self, word: str) -> tuple[float, str, str]:
        """(gain, chain, word after it) of the likeliest chain; a gain of minus infinity if none applies."""
        base, top = self.score(word), (-math.inf, "", word)
        for chain, fixed in candidates(word).items():
            gain = self.score(fixed) - base
            if gain > top[0]:
                top = (gain, chain, fixed)
        return top

    def restore(self, word: str) -> str:
        """Fill U+FFFD with the likeliest letters, if they beat all others by half the margin: an exact search for the two best
        spellings over the states of the model. Three lost letters on end leave no known neighbour in reach: such a word stays."""
        if "���" in word:
            return word
        states: dict[str, list[tuple]] = {_EDGE * 2: [(0.0, None)]}  # last two characters -> two best of (score, (entry before, character))
        for ch in word:
            following: dict[str, list[tuple]] = {}
            for last, entries in states.items():
                for c in self.letters if ch == "�" else ch:
                    gain = self.term(last, c)
                    following.setdefault(last[1] + c, []).extend((e[0] + gain, (e, c)) for e in entries)
            states = {k: v if len(v) < 3 else nlargest(2, v, key=lambda e: e[0]) for k, v in following.items()}
        ends = nlargest(2, [(e[0] + self.term(last, _EDGE), e[1]) for last, entries in states.items() for e in entries], key=lambda e: e[0])
        if not ends or (len(ends) > 1 and ends[0][0] - ends[1][0] <= self.margin / 2):
            return word
        out, step = [], ends[0][1]
        while step:
            entry, c = step
            out.append(c)
            step = entry[1]
        return "".join(reversed(out))

    def decide(self, word: str) -> tuple[str, str] | None:
        """(chain, restored word), or None for a word that stands as it should."""
        if word in self.memo:
            return self.memo[word]
        if len(self.memo) >= MEMO_LIMIT:
            self.memo.clear()
        if "�" in word:
            out = ("lost characters", self.restore(word))
        else:
            gain, chain, fixed = self.best(word)
            out = (chain, fixed) if gain > self.margin else None
        self.memo[word] = out
        return out


def _field_words(df: DataFrame) -> DataFrame:
    """file_id, field_name, words: the distinct words beyond ASCII of each field."""

    def words(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), 0))

    joined = F.array_join(F.map_values("pdf_metadata"), "\n")
    fields = F.array(
        F.struct(F.lit("raw_text").alias("field_name"), words(F.col("raw_text")).alias("words")),
        F.struct(F.lit("pdf_metadata").alias("field_name"), words(joined).alias("words")),
    )
    return df.select("file_id", F.explode(fields).alias("f")).select("file_id", "f.*").where(F.size("words") > 0)


def _clean_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of clean fields, counted per batch."""
    for pdf in batches:
        seen: dict[str, bool] = {}
        counts: Counter = Counter()
        for words in pdf.words:
            for w in words:
                if w not in seen:
                    seen[w] = surely_garbled(w)
            if not any(seen[w] for w in words):
                counts.update(words)
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


def _gram_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts: Counter = Counter()
        for w, n in zip(pdf.word, pdf.n):
            for context, ch in _grams(w):
                counts[context + ch] += int(n)
        levels: Counter = Counter({("3", gram): n for gram, n in counts.items()})
        for gram, n in counts.items():
            for key in _levels(gram):
                levels[key] += n
        yield pd.DataFrame([(level, part, n) for (level, part), n in levels.items()], columns=["level", "part", "n"])


def trained(field_words: DataFrame, held_out: int = 0) -> tuple[Model, DataFrame]:
    """(the model with its validated margin, clean words with counts); field_words has columns field_name and words.

    held_out: one word in so many (by hash) is no part of the training; 0: all are."""
    clean = cut(field_words.mapInPandas(skip_empty(_clean_counts), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    own = clean.where(F.pmod(F.xxhash64("word"), F.lit(held_out)) != 0) if held_out else clean
    model = _fit(own)
    for _ in range(PURGES):  # words that the first model would change are no clean words: fit again without them
        own = _weighed(own, model).where(F.col("gain") <= FLOOR).select("word", "n")
        model = _fit(own)
    at = _weighed(own, model).agg(F.expr(f"percentile_approx(gain, {QUANTILE}, 10000)").alias("q")).first().q
    model.margin = min(max(FLOOR, at if at is not None else FLOOR), CEILING)
    return model, clean


def train(field_words: DataFrame) -> Model:
    return trained(field_words)[0]


def _fit(words: DataFrame) -> Model:
    grams = cut(words.mapInPandas(skip_empty(_gram_counts), "level string, part string, n bigint").groupBy("level", "part").agg(F.sum("n").alias("n")))
    total = grams.where(F.col("level") == "3").agg(F.sum("n")).first()[0] or 0
    levels: dict[str, dict[str, int]] = {"3": {}, "2": {}, "b": {}, "m": {}, "1": {}}
    for r in grams.where(F.col("n") >= GRAM_SHARE * total).collect():  # at most 1 / GRAM_SHARE rows a level
        levels[r.level][r.part] = r.n
    return Model(levels.pop("3"), levels)


def _weighed(words: DataFrame, model: Model) -> DataFrame:
    held = checked_broadcast(words.sparkSession, model)

    @F.pandas_udf("double")
    def gain(column: pd.Series) -> pd.Series:
        return pd.Series([max(held.value.best(w)[0], -1e3) for w in column], dtype="float64")

    return cut(words.select("word", "n", gain("word").alias("gain")))


def garbled(df: DataFrame) -> DataFrame:
    """file_id, field_name, n_words, chain (the most frequent) of each field with garbled words; df as the table corpus."""
    spark = df.sparkSession
    ship(spark)
    words = _field_words(df)
    held = checked_broadcast(spark, train(words))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for pdf in batches:
            rows = []
            for file_id, field, words in zip(pdf.file_id, pdf.field_name, pdf.words):
                chains = Counter(d[0] for d in map(model.decide, words) if d)
                if chains:
                    rows.append((file_id, field, sum(chains.values()), min(chains, key=lambda c: (-chains[c], c))))
            yield pd.DataFrame(rows, columns=["file_id", "field_name", "n_words", "chain"])

    return words.mapInPandas(skip_empty(judge), "file_id string, field_name string, n_words bigint, chain string")


def repaired(df: DataFrame) -> DataFrame:
    """Every row of df with raw_text and pdf_metadata restored where possible, and how many words changed."""
    spark = df.sparkSession
    ship(spark)
    held = checked_broadcast(spark, train(_field_words(df)))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for pdf in batches:
            counts = []

            def swap(m: re.Match) -> str:
                found = model.decide(m.group())
                if found and found[1] != m.group():
                    counts[-1] += 1
                    return found[1]
                return m.group()

            texts, maps = [], []
            for text, pairs in zip(pdf.raw_text, pdf.pdf_metadata):
                counts.append(0)
                texts.append(_WORDS.sub(swap, text) if isinstance(text, str) else None)
                maps.append(None if pairs is None else [(k, _WORDS.sub(swap, v) if isinstance(v, str) else v) for k, v in (pairs.items() if isinstance(pairs, dict) else pairs)])
            yield pd.DataFrame({"file_id": pdf.file_id, "raw_text": texts, "pdf_metadata": [None if m is None else dict(m) for m in maps], "repaired_words": counts})

    return df.select("file_id", "raw_text", "pdf_metadata").mapInPandas(skip_empty(fix), "file_id string, raw_text string, pdf_metadata map<string,string>, repaired_words bigint")


def garblings(word: str) -> dict[str, str]:
    """Chain name -> how the word looks after that mistake, for every chain that can befall it; and with its first letter beyond ASCII lost."""
    out: dict[str, str] = {}
    for name, right, wrong in [(f"utf-8 as {enc}", "utf-8", enc) for enc in UTF8_READ_AS] + [(f"{right} as {wrong}", right, wrong) for wrong, right in SINGLE_BYTE]:
        try:
            garbled_word = word.encode(right).decode(wrong)
        except UnicodeError:
            continue
        if garbled_word != word and _WORDS.fullmatch(garbled_word):
            out[name] = garbled_word
    out["lost characters"] = re.sub(r"[^\x00-\x7f]", "�", word, count=1)
    return out


def accuracy(df: DataFrame) -> DataFrame:
    """chain, n_words, n_noticed, n_restored: clean words that the model has not seen, garbled by every chain and given to it. df as the table corpus."""
    ship(df.sparkSession)
    model, clean = trained(_field_words(df), held_out=5)
    held = checked_broadcast(df.sparkSession, model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            for word in pdf.word:
                for chain, wrong in garblings(word).items():
                    found = held.value.decide(wrong)
                    seen[(chain, "words")] += 1
                    seen[(chain, "noticed")] += found is not None
                    seen[(chain, "restored")] += found is not None and found[1] == word
            yield pd.DataFrame([(c, what, n) for (c, what), n in seen.items()], columns=["chain", "what", "n"])

    fresh = clean.where(F.pmod(F.xxhash64("word"), F.lit(5)) == 0)
    counts = fresh.mapInPandas(skip_empty(measure), "chain string, what string, n bigint")
    return counts.groupBy("chain").agg(*[F.sum(F.when(F.col("what") == w, F.col("n")).otherwise(0)).alias(f"n_{w}") for w in ("words", "noticed", "restored")])


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "corpus").select("file_id", "raw_text", "pdf_metadata"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled(_corpus(spark, sf_dir)).select("file_id", "field_name").distinct()


def p2_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields each chain of mistakes garbled."""
    found = garbled(_corpus(spark, sf_dir)).dropDuplicates(["file_id", "field_name"])
    return found.groupBy("field_name", "chain").agg(F.count("*").alias("n_fields"), F.sum("n_words").alias("n_words"))


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(_corpus(spark, sf_dir).dropDuplicates(["file_id"]))


def p2_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many held-out clean words of the corpus are noticed and restored after each kind of mistake."""
    return accuracy(_corpus(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_chains": p2_chains, "p2_repaired": p2_repaired, "p2_accuracy": p2_accuracy}
