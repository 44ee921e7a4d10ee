"""Splitting of raw text into sentences; headings, page furniture and fragments without an end are no sentences."""

from __future__ import annotations

import re

_END = re.compile(r"(?<=[.!?…])[\"”’)»]*\s+(?=[\"“«¿¡(]*[A-ZÀ-ÖØ-ÞŒ0-9@!|])")
_CLOSED = re.compile(r"[.!?…][\"”’)»]*\s*$")
_BREAK = re.compile(r"\n[ \t]*\n+")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-\n[ \t]*(?=[a-zà-öø-ÿ])")


def paragraphs(text: str) -> list[str]:
    """Runs of lines; a short line without an end before a line that starts anew is a heading, a paragraph of its own."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\n" not in text:
        return [text]
    text = _HYPHEN.sub("", text)
    out: list[str] = []
    for block in _BREAK.split(text):
        lines = [x.strip() for x in block.split("\n")]
        lines = [x for x in lines if x]
        if len(lines) < 2:
            out += lines
            continue
        width = max(map(len, lines))
        current: list[str] = []
        for k, line in enumerate(lines):
            current.append(line)
            if k + 1 < len(lines) and len(line) < 0.62 * width and not _CLOSED.search(line) and not lines[k + 1][0].islower():
                out.append(" ".join(current))
                current = []
        if current:
            out.append(" ".join(current))
    return out


def sentences(text: str | None) -> list[str]:
    """Sentences in order; each ends with a full stop or the like."""
    if not text:
        return []
    out: list[str] = []
    for p in paragraphs(text):
        parts = _END.split(p)
        if len(parts) > 1:
            out += parts[:-1]
        if parts and _CLOSED.search(parts[-1]):
            out.append(parts[-1])
    return [s for s in out if len(s) >= 20 and s.count(" ") >= 2]
