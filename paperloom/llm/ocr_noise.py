"""Problem 6: noise of scanned pages: broken words, misread characters, running headers, page numbers.

1. Words and neighbouring pairs of all texts are counted (per batch, then merged by partial aggregates).
2. Symmetric-delete index: every word, and every word of the lexicon (seen MIN_COUNT times), is joined by the forms that one
   deletion leaves of it after letters are folded to strokes. Weighted edit distance with confusion pairs scores the pairs.
   A word is a misreading of one RATIO times as frequent (a rare word of any), at less than one plain edit; a plain edit is
   admitted inside long words, elsewhere only where both neighbours have often stood beside the other word.
3. Of each scanned text the lines that number pages and the lines that recur at page edges are taken out and broken words are
   joined. Words outside the commonest (a broadcast bounded by COMMON_SHARE) are joined to the index by equality, and to the
   counts of neighbouring pairs, which decide between repairs of equal cost. The lexicon is never in one place, so it has no cap.
4. What remains is joined to paragraphs.

Defined results: null and blank texts carry no noise and stay as they are; a word that is misread but resembles nothing in the
lexicon stays; only files with a scan (ocr_text is not null) carry noise; texts of under MIN_LINES lines have no page furniture; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, ship, spread, table
from .common import checked_broadcast, skip_empty

MIN_COUNT, RATIO = 3, 12
#: Words that make up so large a share of all words are broadcast as known: at most its inverse, 200,000 words.
COMMON_SHARE = 5e-6
#: How often both neighbours must have stood beside a word for a plain edit anywhere in it to be taken for a misreading.
CONTEXT = 12
#: File ids of scans are broadcast up to so many (64 bytes each), else joined.
BROADCAST_FILES = 500_000
MIN_LINES = 3
CONFUSION_COST, EDIT_COST, MAX_COST = 0.2, 1.0, 1.0
#: A plain edit is taken for a misreading only in words of so many letters, and not in their first letter or last two, where words are inflected.
MIN_PLAIN, INFLECTED = 5, 2

# What recognition reads (left) for what stands on the page (right).
CONFUSIONS = [("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("|", "l"), ("@", "a"), ("5", "s"), ("8", "b"), ("c", "e"), ("6", "b"), ("9", "g"), ("$", "s"), ("tl", "d"), ("nn", "m"), ("m", "rn"), ("q", "g"), ("g", "q"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl")]
# The strokes that a letter falls into; a word and its misreading fall into the same ones.
STROKES = str.maketrans({"!": "l", "1": "l", "|": "l", "i": "l", "@": "a", "0": "o", "5": "s", "$": "s", "8": "b", "6": "b", "9": "g", "c": "e", "m": "rn", "w": "vv", "d": "el", "h": "ll", "u": "ll", "q": "g", "ﬁ": "fl", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffl", "ﬄ": "ffl"})

_TOKEN = re.compile(r"[!@$|]?\w+(?:[-'’!@|$]\w+)*@?")
_BESIDE = re.compile(r"[\s.,;:?()\[\]\"“”„«»'‘’/…–—]?$")
_LETTERS = re.compile(r"[^\W\d_]")
_CODE_TOKEN = re.compile(r"[A-Z]{1,3}-?\d|\d+[.,]?\d*$|[xX]\d+$|\d+[a-zA-Z]{1,3}$")
_SYMBOL_INSIDE = re.compile(r"[^\W\d_][!@$|0158][^\W\d_]|^[!@][a-zà-ÿ]{3}|[a-zà-ÿ]{3}@$")
_ROMAN = re.compile(r"[ivxlc]+$")
_NUMBERED = re.compile(r"^\W*(?:page|seite|pagina|página|pág|sheet|blatt|folio|p|pag|pg|s)\.?\s*[\dlO]{1,4}(?:\s*(?:of|/|von|de|di|van|sur)\s*\d{1,4})?\W*$", re.I)
_OF = re.compile(r"^\W*\d{1,4}\s*(?:/|of|von|de|di|van|sur)\s*\d{1,4}\W*$", re.I)
_FENCED = re.compile(r"^(?:[-–—~*|=]+\s*(?:\d{1,4}|[ivxlc]{1,6})\s*[-–—~*|=]+|[\[(<{]\s*(?:\d{1,4}|[ivxlc]{1,6})\s*[\])>}])$", re.I)
_BARE = re.compile(r"^(?:\d{1,4}|[ivxlc]{1,7})$", re.I)
_CODED = re.compile(r"(?<!\S)(?=\S*\d)(?=\S*[A-Z])[\w/.-]{4,}(?!\S)")
_CLOSED = re.compile(r"[.!?…:;][\"”’)»]*$")
_BREAK_END = re.compile(r"[^\W\d_]{1,}[-‐¬\xad]$")
_HYPHENS = frozenset("-‐¬\xad")
_ROMANS = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def fold(word: str) -> str:
    return word.translate(STROKES)


@lru_cache(maxsize=1 << 14)
def _line_key(line: str) -> str:
    """The same for a running line and its misreadings."""
    return fold(line.strip().lower().replace(" ", ""))


def deletes(form: str) -> set[str]:
    return {form, *(form[:i] + form[i + 1 :] for i in range(len(form)))}


def weighted_distance(read: str, word: str) -> float:
    """Least cost to read `read` for `word`: confusion pairs are cheap, other edits are not. No confusion starts or ends alike on both sides, so what is equal at both ends is left out but for one letter."""
    lo, hi, most = 0, 0, min(len(read), len(word))
    while lo < most and read[lo] == word[lo]:
        lo += 1
    while hi < most - lo and read[-1 - hi] == word[-1 - hi]:
        hi += 1
    lo, hi = max(lo - 1, 0), max(hi - 1, 0)
    return _least_cost(read[lo : len(read) - hi], word[lo : len(word) - hi])


@lru_cache(maxsize=1 << 17)
def _least_cost(read: str, word: str) -> float:
    n, m = len(read), len(word)
    inf = float("inf")
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            here = cost[i][j]
            if here == inf:
                continue
            if i < n and j < m:
                step = 0.0 if read[i] == word[j] else EDIT_COST
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], here + step)
            if i < n:
                cost[i + 1][j] = min(cost[i + 1][j], here + EDIT_COST)
                for wrong, right in _CONFUSED.get(read[i], ()):
                    if read.startswith(wrong, i) and word.startswith(right, j):
                        a, b = i + len(wrong), j + len(right)
                        cost[a][b] = min(cost[a][b], here + CONFUSION_COST)
            if j < m:
                cost[i][j + 1] = min(cost[i][j + 1], here + EDIT_COST)
    return cost[n][m]


_CONFUSED: dict[str, list[tuple[str, str]]] = defaultdict(list)
for _wrong, _right in CONFUSIONS:
    _CONFUSED[_wrong[0]].append((_wrong, _right))


def one_edit(read: str, word: str) -> tuple[int, int] | None:
    """(equal letters before, after) if one Latin letter of a long word is read as another, left out or put in."""
    if min(len(read), len(word)) < MIN_PLAIN:
        return None
    head = 0
    while head < min(len(read), len(word)) and read[head] == word[head]:
        head += 1
    tail = 0
    while tail < min(len(read), len(word)) - head and read[-1 - tail] == word[-1 - tail]:
        tail += 1
    changed = read[head : len(read) - tail] + word[head : len(word) - tail]  # Latin letters only: other signs are no misreadings but broken encodings and kinds of apostrophes
    return (head, tail) if max(len(read), len(word)) - head - tail == 1 and all(c.isalpha() and c < "ɐ" for c in changed) else None


def plain_edit(read: str, word: str) -> bool:
    """Whether a plain edit needs no support of its neighbours: inside a long word; letters of equal strokes may stand anywhere."""
    if len(read) == len(word) and fold(read) == fold(word):
        return True
    kept = one_edit(read, word)
    return kept is not None and kept[0] >= 1 and kept[1] >= INFLECTED


def eligible(word: str) -> bool:
    return len(word) >= 3 and len(_LETTERS.findall(word)) >= 2 and not _ROMAN.match(word)


def _number(line: str) -> int | None:
    m = re.search(r"\d+", line)
    if m:
        return int(m.group())
    m = re.search(r"[ivxlc]+", line.lower())
    if not m:
        return None
    values = [_ROMANS[c] for c in m.group()]
    return sum(-v if k + 1 < len(values) and values[k + 1] > v else v for k, v in enumerate(values))


def page_numbers(lines: list[str]) -> set[int]:
    """Lines (stripped, no blank ones) that only number a page; bare numbers need a sequence or the text's first or last place."""
    sure = {k for k, x in enumerate(lines) if len(x) <= 24 and (_NUMBERED.match(x) or _OF.match(x) or _FENCED.match(x))}
    bare = [k for k, x in enumerate(lines) if len(x) <= 7 and _BARE.match(x)]
    for a, b in zip(bare, bare[1:]):
        if _number(lines[b]) == (_number(lines[a]) or 0) + 1:
            sure |= {a, b}
    if len(bare) == 1 and bare[0] in (0, len(lines) - 1):
        sure.add(bare[0])
    return sure


def running_headers(lines: list[str], numbers: set[int]) -> set[int]:
    """Lines that recur at page edges, with misreadings: lines that a reference number starts or ends, capitals, lines that interrupt a sentence or stand at a page number."""
    groups: dict[str, list[int]] = defaultdict(list)
    for k, x in enumerate(lines):
        if k not in numbers and 4 <= len(x) <= 160:
            groups[_line_key(x)].append(k)
    out: set[int] = set()
    for key, places in groups.items():
        if len(places) < 2 or places[-1] < MIN_LINES:
            continue
        line = lines[places[0]]
        upper = line.isupper() and len(line.split()) >= 2
        reference = _CODED.search(line)
        code = reference is not None and len(line.split()) <= 13 and not _CLOSED.search(line) and (reference.start() == 0 or reference.end() == len(line) or "|" in line or line.isupper())
        edge = cutting = 0
        for k in places:
            prev = next((j for j in range(k - 1, -1, -1) if j not in numbers), None)
            nxt = next((j for j in range(k + 1, len(lines)) if j not in numbers), None)
            edge += k - 1 in numbers or k + 1 in numbers or k == 0
            cutting += prev is not None and nxt is not None and not _CLOSED.search(lines[prev]) and lines[nxt][:1].islower() and line[:1].isupper() and not _CLOSED.search(line)
        if code or upper or (cutting and not _CLOSED.search(line)) or (edge >= 0.6 * len(places) and edge >= 2 and not _CLOSED.search(line)):
            out |= set(places)
    return out


def split_pages(text: str) -> tuple[list[str], set[int], set[int], list[bool]]:
    """(stripped lines that are not blank, page numbers, running headers, whether a blank line stands before)."""
    lines, gaps, blank = [], [], False
    for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        x = x.strip()
        if x:
            lines.append(x)
            gaps.append(blank)
        blank = not x
    if len(lines) < MIN_LINES:
        return lines, set(), set(), gaps
    numbers = page_numbers(lines)
    headers = running_headers(lines, numbers)
    # a header with a variant code beside it, as on odd and even pages
    keys = {_line_key(lines[k].split("|")[0]) for k in headers}
    if keys:
        headers |= {k for k, x in enumerate(lines) if k not in numbers and k >= MIN_LINES and not _CLOSED.search(x) and _line_key(x.split("|")[0]) in keys}
    return lines, numbers, headers, gaps


def joined_lines(lines: list[str], common: frozenset[str]) -> tuple[list[str], list[tuple[int, int, str]], bool]:
    """(lines with words over a line end made whole, (line, place in it, hyphenated form) of the breaks in doubt, whether one is beyond doubt).

    A break is in doubt if the whole word is not common: the hyphen could be the word's own."""
    out: list[str] = []
    doubts: list[tuple[int, int, str]] = []
    sure = False
    for line in lines:
        if out and out[-1][-1:] in _HYPHENS and line[:1].islower() and _BREAK_END.search(out[-1]):
            head = re.search(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*[-‐¬\xad]$", out[-1])
            tail = re.match(r"[\w'’!@|$-]+", line)
            a, b = head.group()[:-1].lower() if head else "", tail.group().lower().rstrip("-") if tail else ""
            if a and b:
                own = a + b not in common and f"{a}-{b}" in common
                if not own and a + b in common:
                    sure = True
                elif not own:
                    doubts.append((len(out) - 1, len(out[-1]) - 1, f"{a}-{b}"))
                whole = out[-1] + tail.group() if own else out[-1][:-1] + tail.group()
                rest = line[tail.end() :]
                punctuation = re.match(r"\S*", rest).group()
                out[-1] = whole + punctuation
                rest = rest[len(punctuation) :].strip()
                if rest:
                    out.append(rest)
                continue
        out.append(line)
    return out, doubts, sure


def is_whole(text: str, m: re.Match) -> bool:
    """Whether a space, a stop, a quote or the text's end stands on both sides: not a piece of a broken word."""
    return bool(_BESIDE.match(text[max(m.start() - 1, 0) : m.start()]) and _BESIDE.match(text[m.end() : m.end() + 1]))


def _looked_up(token: str, common: frozenset[str]) -> bool:
    word = token.lower()
    return word not in common and eligible(word) and not _CODE_TOKEN.match(token)


def _beyond(token: str) -> bool:
    """Misread beyond recognition: signs inside a word."""
    return len(_LETTERS.findall(token)) >= 4 and bool(_SYMBOL_INSIDE.search(token)) and not token[0].isdigit()


SPOT = "spot int, piece int, word string, other string, before string, after string, strict boolean, beyond boolean"


def spots_of(lines: list[str], doubts: list[tuple[int, int, str]], common: frozenset[str]) -> list[tuple]:
    """Rows of SPOT: the words to look up. piece: -1 the whole word, else its part between hyphens; other: the hyphenated form of a
    break in doubt; strict: no plain edits, as in what could be a name and in a piece of a word; beyond: misread in any case."""
    words: list[str] = []
    near: list[tuple[int, int, list[int]]] = []  # (first spot, line, spots of the words that are not common)
    for k, line in enumerate(lines):
        first = len(words)
        words += map(str.lower, _TOKEN.findall(line))
        rare = [i for i in range(first, len(words)) if words[i] not in common]
        if rare:
            near.append((first, k, rare))
    open_: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for k, place, form in doubts:
        open_[k].append((place, form))
    rows: list[tuple] = []
    for first, k, rare in near:
        line = lines[k]
        matches = list(_TOKEN.finditer(line))
        for spot in rare:
            m, word = matches[spot - first], words[spot]
            token = m.group()
            form = next((f for place, f in open_[k] if m.start() < place <= m.end()), "") if k in open_ else ""
            known = not _looked_up(token, common)
            if known and not form:
                continue
            parts = token.split("-")
            if not form and len(parts) > 1 and all(p.lower() in common or len(p) < 3 for p in parts):
                continue
            whole = is_whole(line, m)
            strict = not whole or (token[:1].isupper() and not token.isupper())
            beside = words[spot - 1] if spot else "", words[spot + 1] if spot + 1 < len(words) else ""
            rows.append((spot, -1, "" if known else word, form, *beside, strict, not known and _beyond(token)))
            if len(parts) > 1:
                for piece, p in enumerate(parts):
                    if len(p) > 2 and _looked_up(p, common):
                        rows.append((spot, piece, p.lower(), "", "", "", not whole or (p[:1].isupper() and not p.isupper()), _beyond(p)))
    return rows


def _kept_lines(text: str) -> tuple[list[str], list[str], bool, list[tuple[str, bool]]]:
    """(lines of the body, running headers, whether pages are numbered, body lines with whether a blank line stands before)."""
    lines, numbers, headers, gaps = split_pages(text)
    kept = [(x, gaps[k]) for k, x in enumerate(lines) if k not in numbers and k not in headers]
    return [x for x, _ in kept], [lines[k] for k in sorted(headers)], bool(numbers), kept


def paragraphs_of(kept: list[tuple[str, bool]]) -> list[list[str]]:
    """The lines of each paragraph."""
    out: list[list[str]] = []
    width = max((len(x) for x, _ in kept), default=0)
    for x, gap in kept:
        prev = out[-1][-1] if out else ""
        if out and (x[:1].islower() or (not gap and len(prev) > 0.62 * width)):
            out[-1].append(x)
        else:
            out.append([x])
    return out


def repaired_text(text: str, common: frozenset[str], repairs: dict[tuple[int, int], str], hyphens: set[int]) -> str:
    """Continuous paragraphs: furniture out, breaks joined, words put right, lines joined.

    repairs: (spot, piece) -> word; hyphens: spots whose break keeps its hyphen. Spots count over all paragraphs, as in _prepared."""
    out, spot = [], 0
    for lines, doubts in _paragraph_lines(text, common):
        line = lines[0] if lines else ""
        places = [place for _, place, _ in doubts]
        pieces, last = [], 0
        for m in _TOKEN.finditer(line):
            token, right = m.group(), None
            at = next((p for p in places if m.start() < p <= m.end()), None)
            if at is not None and spot in hyphens:
                right = line[m.start() : at] + "-" + line[at : m.end()]
            elif (spot, -1) in repairs:
                right = _cased(token, repairs[(spot, -1)])
            else:
                parts = token.split("-")
                if len(parts) > 1 and any((spot, k) in repairs for k in range(len(parts))):
                    right = "-".join(_cased(p, repairs[(spot, k)]) if (spot, k) in repairs else p for k, p in enumerate(parts))
            if right is not None:
                pieces += [line[last : m.start()], right]
                last = m.end()
            spot += 1
        out.append("".join(pieces) + line[last:])
    return "\n\n".join(out)


def _cased(token: str, found: str) -> str:
    if token.isupper() and len(token) > 1:
        return found.upper()
    return found[:1].upper() + found[1:] if token[:1].isupper() else found


def _paragraph_lines(text: str, common: frozenset[str]) -> list[tuple[list[str], list[tuple[int, int, str]]]]:
    """Each paragraph as one line with its breaks in doubt."""
    out = []
    for lines in paragraphs_of(_kept_lines(text)[3]):
        joined, doubts, _ = joined_lines(lines, common)
        starts = [0]
        for x in joined:
            starts.append(starts[-1] + len(x) + 1)
        out.append(([" ".join(joined)], [(0, starts[k] + place, form) for k, place, form in doubts]))
    return out


# --- counts and index -------------------------------------------------------------------------------------------------
_JOIN = re.compile(r"(?<=[^\W\d_])-\n[ \t]*(?=[a-zà-öø-ÿ])")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words: Counter = Counter()
        pairs: Counter = Counter()
        for text in pdf.text:
            tokens = _TOKEN.findall(_JOIN.sub("", text).lower())
            words.update(tokens)
            pairs.update(zip(tokens, tokens[1:]))
        digits = {w for w in words if w.isdigit()}
        word, after, n = [], [], []
        for w, k in words.items():
            if w not in digits:
                word.append(w)
                after.append("")
                n.append(k)
        for (w, x), k in pairs.items():
            if w not in digits and x not in digits:
                word.append(w)
                after.append(x)
                n.append(k)
        yield pd.DataFrame({"word": word, "after": after, "n": n})


def counted(texts: DataFrame) -> DataFrame:
    """word, after (empty for the word alone), n over texts(text)."""
    return cut(texts.select("text").where(F.col("text").isNotNull()).mapInPandas(skip_empty(_counts), "word string, after string, n bigint").groupBy("word", "after").agg(F.sum("n").alias("n")))


def _deletion_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        key, word, n, lexical = [], [], [], []
        for w, k in zip(pdf.word, pdf.n):
            if eligible(w):
                forms = deletes(fold(w))
                key += forms
                word += [w] * len(forms)
                n += [k] * len(forms)
                lexical += [k >= MIN_COUNT and not _SYMBOL_INSIDE.search(w)] * len(forms)
        yield pd.DataFrame({"key": key, "word": word, "n": n, "lexical": lexical})


#: Confusions that change what strokes a word falls into.
_UNLIKE = [(wrong, right) for wrong, right in CONFUSIONS if fold(wrong) != fold(right)]


def _may_confuse(read: str, word: str) -> bool:
    """Whether confusions alone could turn word into read: they leave the strokes as they are, but for a few."""
    return _folded(read) == _folded(word) or any(wrong in read and right in word for wrong, right in _UNLIKE)


_folded = lru_cache(maxsize=1 << 16)(fold)


def _scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs that can be misreadings. Where confusions alone do not explain a pair, its cost is at most one only for a single plain edit."""
    for pdf in batches:
        rows = []
        for u, v, n, m in zip(pdf.word, pdf.right, pdf.n, pdf.right_n):
            cost = weighted_distance(u, v) if _may_confuse(u, v) else None
            if cost is not None and cost < MAX_COST:
                rows.append((u, v, n, m, cost, "sure"))
            elif m >= RATIO * max(MIN_COUNT, n):
                if cost is None:
                    if kept := one_edit(u, v):
                        rows.append((u, v, n, m, EDIT_COST, "plain" if kept[0] >= 1 and kept[1] >= INFLECTED else "context"))
                elif cost <= EDIT_COST and (plain := plain_edit(u, v) or one_edit(u, v)):
                    rows.append((u, v, n, m, cost, "plain" if plain is True else "context"))
        yield pd.DataFrame(rows, columns=["word", "right", "n", "right_n", "cost", "kind"])


def build_index(counts: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[str]]:
    """(word, right, right_n, cost, kind) of every word that can be a misreading; (word) of the lexicon; its common words.

    kind: sure (less than one edit), plain (an edit that needs no support), context (one that needs its neighbours)."""
    words = counts.where(F.col("after") == "").select("word", "n")
    total = words.agg(F.sum("n")).first()[0] or 0
    keys = words.mapInPandas(skip_empty(_deletion_keys), "key string, word string, n bigint, lexical boolean")
    rights = keys.where("lexical").select("key", F.col("word").alias("right"), F.col("n").alias("right_n"))
    near = (F.col("word") != F.col("right")) & (F.abs(F.length("word") - F.length("right")) <= 3) & ((F.col("n") < MIN_COUNT) | (F.col("right_n") >= RATIO * F.col("n")))
    pairs = keys.select("key", "word", "n").join(rights, "key").where(near).select("word", "right", "n", "right_n").distinct()
    scored = cut(pairs.mapInPandas(skip_empty(_scored), "word string, right string, n bigint, right_n bigint, cost double, kind string"))
    purged = cut(scored.where((F.col("n") >= MIN_COUNT) & (F.col("kind") != "context")).select("word").distinct())
    signs = F.regexp_like("word", F.lit(_SYMBOL_INSIDE.pattern.replace("\\W", "\\P{L}").replace("[^\\P{L}\\d_]", "\\p{L}")))
    lexicon = cut(words.where((F.col("n") >= MIN_COUNT) & ~signs).join(purged, "word", "left_anti"))
    options = scored.join(lexicon.select("word"), "word", "left_anti").join(purged.withColumnRenamed("word", "right"), "right", "left_anti").select("word", "right", "right_n", "cost", "kind")
    common = frozenset(r.word for r in lexicon.where(F.col("n") >= max(MIN_COUNT, COMMON_SHARE * total)).select("word").collect())  # at most 1 / COMMON_SHARE words
    return cut(options), lexicon.select("word"), common


def decided(spots: DataFrame, counts: DataFrame, options: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of spots(file_id, field_name and SPOT): (those that are misread, with right; right is null beyond recognition), (breaks in doubt, with own)."""
    key = ["file_id", "field_name", "spot", "piece"]
    doubts = spots.where(F.col("other") != "").select(*key, "word", "other")
    own = doubts.join(lexicon.withColumnRenamed("word", "other").withColumn("has", F.lit(True)), "other", "left").join(lexicon.withColumn("hasnt", F.lit(True)), "word", "left")
    own = cut(own.groupBy(*key).agg(F.max(F.coalesce("has", F.lit(False)) & F.col("hasnt").isNull()).alias("own")))
    pairs = counts.where(F.col("after") != "")
    tried = spots.where(F.col("word") != "").join(options, "word")
    tried = tried.where(~F.col("strict") | (F.col("kind") == "sure"))
    tried = tried.join(pairs.select(F.col("word").alias("before"), F.col("after").alias("right"), F.col("n").alias("n_before")), ["before", "right"], "left")
    tried = tried.join(pairs.select(F.col("word").alias("right"), "after", F.col("n").alias("n_after")), ["right", "after"], "left").fillna(0, ["n_before", "n_after"])
    tried = tried.where((F.col("kind") != "context") | (F.least("n_before", "n_after") >= CONTEXT))
    best = tried.groupBy(*key).agg(F.min_by("right", F.struct("cost", (-F.col("n_before") - F.col("n_after")).alias("beside"), (-F.col("right_n")).alias("rarity"), "right")).alias("right"))
    beyond = spots.where("beyond").select(*key).distinct()
    wrong = best.join(beyond.withColumn("beyond", F.lit(True)), key, "full").select(*key, "right")
    return wrong.join(own.where("own").select(*key), key, "left_anti"), own


# --- operators --------------------------------------------------------------------------------------------------------
def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(file_id, field_name, text) of all fields that are not blank, and of those of scanned files."""
    ship(spark)
    raw = table(spark, sf_dir, "corpus").select("file_id", F.lit("raw_text").alias("field_name"), F.col("raw_text").alias("text")).where(F.length("text") > 0)
    state = table(spark, sf_dir, "documents_state").select("file_id", F.col("ocr_text").alias("text"))
    ocr = state.where(F.length("text") > 0).select("file_id", F.lit("ocr_text").alias("field_name"), "text")
    scans = cut(state.where(F.col("text").isNotNull()).select("file_id").distinct())
    held = F.broadcast(scans) if scans.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES else scans
    return spread(raw.unionByName(ocr)), spread(raw.join(held, "file_id", "left_semi").unionByName(ocr))


_KEYS = "file_id string, field_name string"


def _looks(texts: DataFrame, common: frozenset[str], whole: bool) -> DataFrame:
    """file_id, field_name, hyphenation, running_header, page_number, spots of every text; whole: spots over joined paragraphs, for repairs."""
    held = checked_broadcast(texts.sparkSession, common)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        names = [c.split()[0] for c in SPOT.split(", ")]
        for pdf in batches:
            rows = []
            for f, field, text in zip(pdf.file_id, pdf.field_name, pdf.text):
                body, headers, numbered, _ = _kept_lines(text)
                joined, doubts, sure = joined_lines(body, known)
                if whole:
                    lines, doubts = [], []
                    for own, places in _paragraph_lines(text, known):
                        doubts += [(len(lines), place, form) for _, place, form in places]
                        lines += own
                else:
                    lines = joined + headers
                rows.append((f, field, sure, bool(headers), numbered, [dict(zip(names, r)) for r in spots_of(lines, doubts, known)]))
            yield pd.DataFrame(rows, columns=["file_id", "field_name", "hyphenation", "running_header", "page_number", "spots"])

    return cut(texts.mapInPandas(skip_empty(look), f"{_KEYS}, hyphenation boolean, running_header boolean, page_number boolean, spots array<struct<{SPOT.replace(' ', ':').replace(',:', ',')}>>"))


def found_noise(texts: DataFrame, scanned: DataFrame) -> DataFrame:
    """file_id, field_name, noise_kind of scanned(file_id, field_name, text); texts(text) are all that words are counted in."""
    counts = counted(texts)
    options, lexicon, common = build_index(counts)
    looks = _looks(scanned.select("file_id", "field_name", "text").where(F.col("text").isNotNull()), common, whole=False)
    spots = looks.select("file_id", "field_name", F.explode("spots").alias("s")).select("file_id", "field_name", "s.*")
    wrong, own = decided(spots, counts, options, lexicon)
    kinds = [F.when(F.col(k), F.lit(k)) for k in ("hyphenation", "running_header", "page_number")]
    flat = looks.select("file_id", "field_name", F.explode(F.array_compact(F.array(*kinds))).alias("noise_kind"))
    broken = own.where(~F.col("own")).select("file_id", "field_name", F.lit("hyphenation").alias("noise_kind"))
    return flat.unionByName(broken).unionByName(wrong.select("file_id", "field_name", F.lit("misread").alias("noise_kind"))).distinct()


def repaired(texts: DataFrame, scanned: DataFrame) -> DataFrame:
    """file_id, field_name, text as readable paragraphs, changed; one row for each field of scanned."""
    counts = counted(texts)
    options, lexicon, common = build_index(counts)
    key = ["file_id", "field_name"]
    one = scanned.select(*key, "text").where(F.col("text").isNotNull()).dropDuplicates(key)
    looks = _looks(one, common, whole=True)
    wrong, own = decided(looks.select(*key, F.explode("spots").alias("s")).select(*key, "s.*"), counts, options, lexicon)
    rights = wrong.where(F.col("right").isNotNull()).groupBy(*key).agg(F.collect_list(F.struct("spot", "piece", "right")).alias("rights"))  # words of one text
    kept = own.where("own").groupBy(*key).agg(F.collect_list("spot").alias("hyphens"))
    held = checked_broadcast(texts.sparkSession, common)

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, own, hyphens in zip(pdf.text, pdf.rights, pdf.hyphens):
                words = {(r["spot"], r["piece"]): r["right"] for r in own} if own is not None else {}
                out.append(repaired_text(text, held.value, words, set(hyphens) if hyphens is not None else set()))
            yield pd.DataFrame({"file_id": pdf.file_id, "field_name": pdf.field_name, "text": out, "changed": [a != b for a, b in zip(out, pdf.text)]})

    return one.join(rights, key, "left").join(kept, key, "left").mapInPandas(skip_empty(mend), f"{_KEYS}, text string, changed boolean")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_noise(*_tables(spark, sf_dir))


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(*_tables(spark, sf_dir))


def p6_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields carry each kind of noise."""
    return p6_found(spark, sf_dir).groupBy("field_name", "noise_kind").agg(F.count("*").alias("n_fields"))


QUERIES = {"p6_found": p6_found, "p6_repaired": p6_repaired, "p6_kinds": p6_kinds}
