"""Problem 10: per-document text statistics from chunks, and whether a text is prose, a list, a table or junk.

A text is cut into chunks of CHUNK code points. A chunk counts the words that start in it (it is given one character before
and LOOKAHEAD characters after, so that the kind of a word over a boundary is known once) and its own letters, and sums its
lines into three parts: the lines wholly inside, the fragment before its first line break and the fragment after its last.
Counts of fragments add up; what depends on order (list mark, gaps, full stop, capital, repetition) merges by their edges,
so chunks merge associatively: level by level inside a task, and for texts of over PIECE code points, whose pieces go to
different tasks, in rounds of FAN pieces, never all at once.

Defined results: null text counts as empty: zero counts, null ratios, kind null; texts under MIN_CHARS have no kind;
words of over LOOKAHEAD characters are neither function words nor numbers nor like words.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread, table
from .common import FUNCTION_WORDS, skip_empty

CHUNK = 1 << 12
#: Texts of over PIECE code points are spread over tasks; no string has over LONGEST.
PIECE, LONGEST = 1 << 18, 1 << 31
LOOKAHEAD = 64
FAN = 64
MIN_CHARS = 60
#: A line that could be an entry of a list without marks is no longer than this, and counts only beside PLAIN_LINES others.
PLAIN_CHARS = 60
PLAIN_LINES = 4

# Features of a line or of a part of one.
FEATURES = ["chars", "words", "letters", "common", "wordlike", "numeric", "gaps", "tabs", "bars", "commas", "semis", "marker", "symbols", "capital"]
# What a text adds up to.
TOTALS = ["chars", "words", "word_chars", "symbols", "common", "lines", "ended", "list_chars", "table_chars", "junk_chars", "prose_chars", "list_lines", "table_lines", "plain_chars", "plain_lines"]
N = len(FEATURES)

_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_MARK = re.compile(r"[ \t]*(?:[-*•–‣▪◦·+>○●■□☐☑✓]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]|\[[ xX✓]?\]|#\d+)[ \t]+[^ \t]")
_GAP = re.compile(r"[^ \n] {2,}(?=[^ \n])")
_WORDLIKE = re.compile(r"[^\W\d_]{2,}")
_VOWEL = re.compile(r"[aeiouyäöüáéíóúàèìòùâêîôûãõåæøœ]", re.I)
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-–’“”…°%/&]|_")
_NUMERIC = re.compile(r"[-+(]?[\d.,/%]*\d[\d.,/%)]*$|n/a$|-$|[A-Z]{1,5}[-/.]?\d[\dA-Z/.-]*$")
_HEX = re.compile(r"[0-9A-F]{2}$")
_COMMON = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
_END = tuple(".!?…:;")
_CLOSING = "\"'”’)»"
_LONG_RUN = re.compile(r"([ \t]{2})[ \t]+|(\d{4})\d+")
#: The longest repeated unit, and so many characters of a line's start (runs cut) as decide about a list mark.
UNIT, PREFIX = 12, 16


_MEMO: dict[str, int] = {}
MEMO_LIMIT = 200_000


def _word_kind(w: str) -> int:
    """1 a function word, 2 a number, 3 like a word, 0 none of these; kept in a memo of bounded size."""
    if len(w) > LOOKAHEAD:
        return 0
    low = w.lower().strip(".,;:!?()\"'“”’…")
    if low in _COMMON:
        kind = 1
    elif _NUMERIC.match(w) or _HEX.match(w):
        kind = 2
    else:
        kind = 3 if 1 < len(low) <= 40 and _WORDLIKE.search(low) and _VOWEL.search(low) else 0
    if len(_MEMO) >= MEMO_LIMIT:
        _MEMO.clear()
    if len(w) <= 40:
        _MEMO[w] = kind
    return kind


def _features(line: str, ahead: str = "", inside_word: bool = False) -> np.ndarray:
    """Of a line, or of the part of one that lies in a chunk; ahead: the text that follows it; inside_word: a word began before."""
    out = np.zeros(N)
    out[0] = len(line)
    words = _WORD.findall(line)
    letters = sum(map(len, words))
    if words and inside_word and line[0] not in " \t\r\f\v":
        words = words[1:]
    if words and ahead and line[-1] not in " \t\r\f\v":
        more = _WORD.match(ahead)
        if more:
            words[-1] += more.group()
    out[1] = len(words)
    common = wordlike = numeric = 0
    for w in words:
        kind = _MEMO.get(w)
        if kind is None:
            kind = _word_kind(w)
        if kind == 1:
            common += 1
            wordlike += 1
        elif kind == 2:
            numeric += 1
        elif kind == 3:
            wordlike += 1
    out[2:6] = letters, common, wordlike, numeric
    out[6] = len(_GAP.findall(line))
    out[7], out[8], out[9], out[10] = line.count("\t"), line.count("|"), line.count(","), line.count(";")
    out[11] = 0.0 if inside_word else float(bool(_MARK.match(line)))
    out[12] = len(_SYMBOL.findall(line))
    out[13] = 0.0 if inside_word else float(line[:1].isupper() and not line.isupper())
    return out


def _kind(f: np.ndarray) -> str:
    """Of a whole line: blank, list, table, junk or prose."""
    chars, words, _, common, wordlike, numeric, gaps, tabs, bars, commas, semis, marker, symbols = f[:13]
    if words == 0:
        return "blank"
    if tabs >= 1 or bars >= 2 or (gaps >= 1 and words <= 6 * gaps + 1):
        cells = words - bars
        return "junk" if bars and symbols - bars > 0.3 * cells and wordlike + numeric < 0.5 * cells else "table"
    if (commas >= 2 or semis >= 2) and words <= 1.6 * max(commas, semis) + 3 and common <= 3:
        return "table"
    if marker:
        return "list"
    if numeric >= 0.75 * words and words >= 2:
        return "junk"
    if common == 0 and wordlike < 0.5 * words:
        return "junk"
    if words >= 8 and common < 0.06 * words and wordlike < 0.75 * words:
        return "junk"
    return "prose"


def _repeated(line: str) -> bool:
    """One unit written over and over (letters, keyboard runs, one word)."""
    body = line.strip()
    if len(body) < 20:
        return False
    for size in range(1, UNIT + 1):
        unit = body[:size]
        if (unit * (len(body) // size + 1))[: len(body)] == body:
            return True
    return False


def _close(total: np.ndarray, f: np.ndarray, ended: bool, repeated: bool = False) -> None:
    """Add a whole line to the totals. A plain line could be an entry of a list without marks: short, capital first, no full stop."""
    kind = "junk" if repeated else _kind(f)
    total[0] += f[0]
    total[1] += f[1]
    total[2] += f[2]
    total[3] += f[12]
    total[4] += f[3]
    if kind == "blank":
        return
    total[5] += 1
    total[6] += ended
    total[{"list": 7, "table": 8, "junk": 9, "prose": 10}[kind]] += f[0]
    if kind == "prose" and f[13] and not ended and f[0] <= PLAIN_CHARS and f[1] <= 10:
        total[13] += f[0]
        total[14] += 1
    if kind in ("list", "table"):
        total[11 if kind == "list" else 12] += 1


def _prefix(s: str) -> str:
    """As much of a start as decides about a list mark: runs of spaces and of digits are cut to what the mark can tell apart."""
    return _LONG_RUN.sub(lambda m: m.group(1) or m.group(2), s)[:PREFIX]


def _tail(s: str) -> str:
    """The last character before closing quotes and white space, one of the quotes and one of the white space."""
    t = s.rstrip()
    u = t.rstrip(_CLOSING)
    return u[-1:] + t[len(u) :][:1] + s[len(t) :][:1]


def _ends(s: str) -> bool:
    return s.rstrip().rstrip(_CLOSING).endswith(_END)


def _periods(s: str) -> int:
    """Bit k is set if s repeats every k characters."""
    return sum(1 << k for k in range(1, UNIT + 1) if s[k:] == s[: max(len(s) - k, 0)])


def _edge(s: str) -> tuple:
    """Of a fragment what does not add up: (prefix, tail, not all upper case, spaces before, spaces after, anything else than spaces,
    white space before, core's length, start, end and periods, white space after). White space of over UNIT ends every repetition."""
    body = s.strip()
    spaces = min(2, len(s) - len(s.lstrip(" "))), min(2, len(s) - len(s.rstrip(" ")))
    lead = s[: len(s) - len(s.lstrip())][: UNIT + 1]
    return (_prefix(s[: 1 << 10]) if len(_prefix(s[: 1 << 10])) == PREFIX else _prefix(s), _tail(s), not ("A" + s).isupper(), *spaces, bool(s.strip(" ")),
            lead, len(body), body[:UNIT], body[-UNIT:], _periods(body), s[len(s.rstrip()) :][: UNIT + 1] if body else "")


def _join(a: tuple[np.ndarray, tuple], b: tuple[np.ndarray, tuple]) -> tuple[np.ndarray, tuple]:
    """The fragment of two that follow each other in a line."""
    (p, t, low, lead, trail, solid, white, n, start, end, periods, after), (p2, t2, low2, lead2, trail2, solid2, white2, n2, start2, end2, periods2, after2) = a[1], b[1]
    f = a[0] + b[0]
    between = min(2, trail + lead2)
    f[FEATURES.index("gaps")] += solid and solid2 and between == 2
    spaces = (lead if solid else between), (trail2 if solid2 else between)
    if n and n2:
        gap = after + white2
        periods &= periods2 & _periods(end + gap + start2) if len(gap) < UNIT else 0
        start, end = (start + gap + start2)[:UNIT] if n < UNIT else start, (end + gap + end2)[-UNIT:] if n2 < UNIT else end2
        n, after = n + len(gap) + n2, after2
    elif n:
        after = (after + white2)[: UNIT + 1]
    else:
        white, n, start, end, periods, after = (white + white2)[: UNIT + 1], n2, start2, end2, periods2, after2
    return f, (_prefix(p + p2), _tail(t + t2), low or low2, *spaces, solid or solid2, white, n, start, end, periods, after)


def _close_joined(total: np.ndarray, fragment: tuple[np.ndarray, tuple]) -> None:
    """Add a line that was put together."""
    f, edge = fragment[0].copy(), fragment[1]
    f[11] = float(bool(_MARK.match(edge[0])))
    f[13] = float(edge[0][:1].isupper() and edge[2])
    _close(total, f, _ends(edge[1]), edge[7] >= 20 and edge[10] > 0)


def chunk_state(text: str, before: str = "", ahead: str = "") -> tuple:
    """(totals of the lines inside, head fragment, tail fragment, has a line break); a fragment is (features, edge).

    Without a line break the whole chunk is the head, and the tail is empty."""
    total = np.zeros(len(TOTALS))
    lines = text.split("\n")
    inside = bool(before) and before not in " \t\n\r\f\v"
    follow = ahead.split("\n")[0] if ahead else ""
    head = _features(lines[0], follow if len(lines) == 1 else "", inside), _edge(lines[0])
    if len(lines) == 1:
        return total, head, (np.zeros(N), _edge("")), False
    for line in lines[1:-1]:
        _close(total, _features(line), _ends(line), _repeated(line))
    return total, head, (_features(lines[-1], follow), _edge(lines[-1])), True


def merge_states(a: tuple, b: tuple) -> tuple:
    """Associative: the state of two neighbouring runs of chunks."""
    total = a[0] + b[0]
    if not a[3]:
        return total, _join(a[1], b[1]), b[2], b[3]
    middle = _join(a[2], b[1])
    if not b[3]:
        return total, a[1], middle, True
    _close_joined(total, middle)
    return total, a[1], b[2], True


def finish(state: tuple) -> np.ndarray:
    total = state[0].copy()
    _close_joined(total, state[1])
    if state[3]:
        _close_joined(total, state[2])
    return total


def state_of(text: str, before: str = "", ahead: str = "", chunk: int = CHUNK) -> tuple:
    """The state of a text, or of a piece of one, from its chunks by merging neighbours level by level."""
    states = []
    for i in range(0, max(len(text), 1), chunk):
        follow = text[i + chunk : i + chunk + LOOKAHEAD]
        if len(follow) < LOOKAHEAD:
            follow += ahead[: LOOKAHEAD - len(follow)]
        states.append(chunk_state(text[i : i + chunk], text[i - 1] if i else before, follow))
    while len(states) > 1:
        merged = [merge_states(a, b) for a, b in zip(states[::2], states[1::2])]
        states = merged + states[len(merged) * 2 :]
    return states[0]


_STATE = "doc_id bigint, n_chars bigint, part bigint, total array<double>, head array<double>, head_edge binary, tail array<double>, tail_edge binary, broken boolean"
_STATE_COLUMNS = [c.split()[0] for c in _STATE.split(", ")]
_TOTALS = "doc_id bigint, n_chars bigint, " + ", ".join(f"t_{c} double" for c in TOTALS)
_TOTAL_COLUMNS = ["doc_id", "n_chars", *(f"t_{c}" for c in TOTALS)]


def _packed(state: tuple) -> tuple:
    total, head, tail, broken = state
    return total, head[0], pickle.dumps(head[1]), tail[0], pickle.dumps(tail[1]), broken


def _unpacked(r) -> tuple:
    return np.array(r.total), (np.array(r.head), pickle.loads(r.head_edge)), (np.array(r.tail), pickle.loads(r.tail_edge)), bool(r.broken)


def _whole(chunk: int):
    """Totals of texts that one task works on from end to end."""

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), len(TOTALS)))
            for k, text in enumerate(pdf.text):
                out[k] = finish(state_of(text, chunk=chunk) if len(text) > chunk else chunk_state(text))
            frame = pd.DataFrame(out, columns=_TOTAL_COLUMNS[2:])
            frame.insert(0, "doc_id", pdf.doc_id.to_numpy())
            frame.insert(1, "n_chars", [len(t) for t in pdf.text])
            yield frame

    return totals


def _pieces(size: int):
    """Pieces of huge texts, cut in one pass, each with the character before and the LOOKAHEAD characters after it."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text in zip(pdf.doc_id, pdf.text):
                for part, i in enumerate(range(0, len(text), size)):
                    yield pd.DataFrame([(doc, len(text), part, text[i : i + size], text[i - 1 : i] if i else "", text[i + size : i + size + LOOKAHEAD])], columns=["doc_id", "n_chars", "part", "piece", "before", "ahead"])

    return pieces


def _states(chunk: int):
    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.doc_id, r.n_chars, r.part, *_packed(state_of(r.piece, r.before, r.ahead, chunk))) for r in pdf.itertuples()]
            yield pd.DataFrame(rows, columns=_STATE_COLUMNS)

    return states


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    state = None
    for r in pdf.itertuples():
        state = _unpacked(r) if state is None else merge_states(state, _unpacked(r))
    return pd.DataFrame([(pdf.doc_id.iloc[0], pdf.n_chars.iloc[0], pdf.part.iloc[0] // FAN, *_packed(state))], columns=_STATE_COLUMNS)


def _final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(r.doc_id, r.n_chars, *finish(_unpacked(r))) for r in pdf.itertuples()]
        yield pd.DataFrame(rows, columns=_TOTAL_COLUMNS)


def text_statistics(df: DataFrame, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """One row per doc_id of df(doc_id bigint unique, text string) with counts, ratios and text_kind.

    Texts of up to piece code points are chunked and merged inside one task, without a shuffle. Longer ones are cut into
    pieces that go to different tasks; their states merge in as many rounds of FAN as the longest possible string needs."""
    ship(df.sparkSession)
    one = df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    done = one.where(F.length("text") <= piece).mapInPandas(skip_empty(_whole(chunk)), _TOTALS)
    cutup = one.where(F.length("text") > piece).mapInPandas(_pieces(piece), "doc_id bigint, n_chars bigint, part bigint, piece string, before string, ahead string")
    rest = cutup.repartition("doc_id", "part").mapInPandas(skip_empty(_states(chunk)), _STATE)
    reach = piece
    while reach < LONGEST:
        rest = rest.groupBy("doc_id", F.floor(F.col("part") / FAN)).applyInPandas(_merge, _STATE)
        reach *= FAN
    done = done.unionByName(rest.mapInPandas(skip_empty(_final), _TOTALS))
    words = F.nullif(F.col("t_words"), F.lit(0.0))
    lines = F.nullif(F.col("t_lines"), F.lit(0.0))
    filled = F.nullif(F.col("t_list_chars") + F.col("t_table_chars") + F.col("t_junk_chars") + F.col("t_prose_chars"), F.lit(0.0))
    plain = F.when(F.col("t_plain_lines") >= PLAIN_LINES, F.col("t_plain_chars")).otherwise(F.lit(0.0))
    other = F.col("t_list_chars") + F.col("t_table_chars") + F.col("t_junk_chars")
    best = F.greatest("t_list_chars", "t_table_chars", "t_junk_chars")
    kind = (
        F.when((F.col("n_chars") < MIN_CHARS) | filled.isNull(), None)
        .when((other <= 0.5 * filled) & (F.col("t_list_chars") + plain > 0.5 * filled), F.lit("list"))
        .when(other <= 0.5 * filled, F.lit("prose"))
        .when(F.col("t_table_chars") == best, F.lit("table"))
        .when(F.col("t_list_chars") == best, F.lit("list"))
        .otherwise(F.lit("junk"))
    )
    return done.select(
        "doc_id", "n_chars", F.col("t_words").cast("bigint").alias("word_count"), (F.col("t_word_chars") / words).alias("mean_word_length"),
        (F.col("t_symbols") / words).alias("symbol_ratio"), F.col("t_lines").cast("bigint").alias("line_count"), (F.col("t_ended") / lines).alias("ended_line_share"),
        (F.col("t_common") / words).alias("common_word_share"), (F.col("t_list_chars") / filled).alias("list_share"), (F.col("t_table_chars") / filled).alias("table_share"),
        (F.col("t_junk_chars") / filled).alias("junk_share"), kind.alias("text_kind"),
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return text_statistics(docs).where(F.col("text_kind").isin("list", "table", "junk")).select("doc_id", "text_kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def p10_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that plain SQL can repeat."""
    return p10_statistics(spark, sf_dir).select("doc_id", "n_chars", "word_count", "line_count")


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents and characters are of each kind."""
    out = p10_statistics(spark, sf_dir).groupBy(F.coalesce("text_kind", F.lit("short")).alias("text_kind"))
    return out.agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars"))


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics, "p10_word_counts": p10_word_counts, "p10_kinds": p10_kinds}
