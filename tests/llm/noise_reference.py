"""The repair of one text at a time with a lexicon in memory: what the distributed operator is compared with."""

import re
from collections import defaultdict

import pandas as pd  # noqa: F401

from paperloom.llm.ocr_noise import *  # noqa: F403
from paperloom.llm.ocr_noise import _BREAK_END, _CLOSED, _CODE_TOKEN, _LETTERS, _SYMBOL_INSIDE, _TOKEN, _counts  # noqa: F401

MEMO_LIMIT = 300_000


class Lexicon:
    """Words with counts, the symmetric-delete index over their folded forms, and counts of neighbouring pairs."""

    def __init__(self, counts: dict[str, int], pairs: dict[tuple[str, str], int] | None = None):
        self.counts, self.pairs = counts, pairs or {}
        self.index: dict[str, list[str]] | None = None
        self.memo: dict[str, list[tuple[float, str]]] = {}

    def __getstate__(self):
        return {"counts": self.counts, "pairs": self.pairs, "index": None, "memo": {}}

    def candidates(self, word: str) -> list[tuple[float, str]]:
        """(cost, word of the lexicon), best first, for a lower-case word; costs under MAX_COST, or one plain edit of a word RATIO times as frequent."""
        out = self.memo.get(word)
        if out is not None:
            return out
        if self.index is None:
            self.index = defaultdict(list)
            for w in self.counts:
                if eligible(w):
                    for d in deletes(fold(w)):
                        self.index[d].append(w)
        seen: set[str] = set()
        for d in deletes(fold(word)):
            seen.update(self.index.get(d, ()))
        seen.discard(word)
        scored = [(weighted_distance(word, w), w) for w in seen if abs(len(w) - len(word)) <= 3]
        enough = RATIO * max(MIN_COUNT, self.counts.get(word, 0))
        out = sorted((c, w) for c, w in scored if c < MAX_COST or (c <= EDIT_COST and self.counts[w] >= enough and plain_edit(word, w)))
        out.sort(key=lambda x: (x[0], -self.counts[x[1]], x[1]))
        if len(self.memo) >= MEMO_LIMIT:
            self.memo.clear()
        self.memo[word] = out
        return out

    def purge(self) -> None:
        """Drop words that are misreadings of words RATIO times as frequent."""
        gone = {w for w, n in self.counts.items() if eligible(w) and any(self.counts[v] >= RATIO * n for _, v in self.candidates(w)[:3])}
        self.counts = {w: n for w, n in self.counts.items() if w not in gone}
        self.index, self.memo = None, {}

    def misread(self, token: str, before: str = "", after: str = "", whole: bool = True) -> str | None:
        """What a token stands for, in lower case; the token itself if it is misread beyond recognition; None if it is none.

        No plain edits in what could be a name, and in a piece of a word (not whole)."""
        word = token.lower()
        if word in self.counts or not eligible(word) or _CODE_TOKEN.match(token):
            return None
        if "-" in word and all(p in self.counts or len(p) < 3 for p in word.split("-")):
            return None
        found = self.candidates(word)
        if not whole or (token[:1].isupper() and not token.isupper()):
            found = [x for x in found if x[0] < MAX_COST]
        if not found and "-" in word:
            parts = [self.misread(p, whole=whole) if len(p) > 2 else None for p in token.split("-")]
            if any(parts):
                return "-".join(q or p.lower() for p, q in zip(token.split("-"), parts))
        if found:
            least = found[0][0]
            ties = [w for c, w in found if c - least < 1e-9]
            if len(ties) > 1 and self.pairs:
                ties.sort(key=lambda w: -(self.pairs.get((before, w), 0) + self.pairs.get((w, after), 0)))
            return ties[0]
        return word if len(_LETTERS.findall(token)) >= 4 and _SYMBOL_INSIDE.search(token) and not token[0].isdigit() else None


def join_breaks(lines: list[str], lexicon: Lexicon | None) -> tuple[list[str], int]:
    """(lines with words over a line end made whole, how many were broken)."""
    out: list[str] = []
    broken = 0
    for line in lines:
        if out and _BREAK_END.search(out[-1]) and line[:1].islower():
            head = re.search(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*[-‐¬\xad]$", out[-1])
            tail = re.match(r"[\w'’!@|$-]+", line)
            a, b = head.group()[:-1].lower() if head else "", tail.group().lower().rstrip("-") if tail else ""
            own = lexicon is not None and f"{a}-{b}" in lexicon.counts and a + b not in lexicon.counts
            if a and b:
                whole = out[-1] + tail.group() if own else out[-1][:-1] + tail.group()
                rest = line[tail.end() :]
                punctuation = re.match(r"\S*", rest).group()
                out[-1] = whole + punctuation
                rest = rest[len(punctuation) :].strip()
                broken += not own
                if rest:
                    out.append(rest)
                continue
        out.append(line)
    return out, broken


def has_misread(text: str, lexicon: Lexicon) -> bool:
    seen = set()
    for m in _TOKEN.finditer(text):
        token = m.group()
        if token.lower() not in lexicon.counts:
            key = (token, is_whole(text, m))
            if key not in seen and lexicon.misread(token, whole=key[1]) is not None:
                return True
            seen.add(key)
    return False


def clean_words(text: str, lexicon: Lexicon) -> tuple[str, int]:
    """(text with misread words put right, how many were misread)."""
    out, last, count, before = [], 0, 0, ""
    for m in _TOKEN.finditer(text):
        token = m.group()
        word = token.lower()
        if word not in lexicon.counts:
            after = ""
            if lexicon.pairs:
                nxt = _TOKEN.search(text, m.end())
                after = nxt.group().lower() if nxt else ""
            found = lexicon.misread(token, before, after, is_whole(text, m))
            if found is not None:
                count += 1
                right = found.upper() if token.isupper() and len(token) > 1 else found[:1].upper() + found[1:] if token[:1].isupper() or token[:1] in "58" and found[:1].isalpha() and text[m.end() : m.end() + 1] == "" else found
                out += [text[last : m.start()], right]
                last = m.end()
        before = word
    return "".join(out) + text[last:], count


def noise_kinds(text: str, lexicon: Lexicon) -> list[str]:
    lines, numbers, headers, _ = split_pages(text)
    kinds = []
    body = [x for k, x in enumerate(lines) if k not in numbers and k not in headers]
    joined, broken = join_breaks(body, lexicon)
    if broken:
        kinds.append("hyphenation")
    if has_misread("\n".join(joined), lexicon) or any(has_misread(lines[k], lexicon) for k in headers):
        kinds.append("misread")
    if headers:
        kinds.append("running_header")
    if numbers:
        kinds.append("page_number")
    return kinds


def repair(text: str, lexicon: Lexicon) -> str:
    """Continuous paragraphs: furniture out, breaks joined, words put right, lines joined."""
    lines, numbers, headers, gaps = split_pages(text)
    kept = [(x, gaps[k]) for k, x in enumerate(lines) if k not in numbers and k not in headers]
    paragraphs: list[list[str]] = []
    width = max((len(x) for x, _ in kept), default=0)
    for x, gap in kept:
        prev = paragraphs[-1][-1] if paragraphs else ""
        goes_on = bool(paragraphs) and (x[:1].islower() or (not gap and (len(prev) > 0.62 * width or _CLOSED.search(prev) and len(prev) > 0.62 * width)))
        if goes_on:
            paragraphs[-1].append(x)
        else:
            paragraphs.append([x])
    return "\n\n".join(clean_words(" ".join(join_breaks(p, lexicon)[0]), lexicon)[0] for p in paragraphs)
