"""Reading PDF files into the corpus relation: embedded metadata, page count and the text of the first pages (SRC-7, SRC-8).

A small reader without other libraries: objects are found by their marks and in object streams, not by the cross-reference
table, so damaged tables do not matter; streams may be plain or deflated. Text is taken from the show operators of the pages'
content in single-byte encodings, which is what plainly made files use; a font with an encoding of its own gives no readable
text, which the quality score then shows. Encrypted files and files that are no PDF give no metadata, no pages and no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .scan import scan

# Keys of the information dictionary and the names that the rest of the engine uses.
INFO_KEYS = {"Title": "title", "Author": "author", "Subject": "subject", "Keywords": "keywords", "Creator": "creator", "Producer": "producer", "CreationDate": "creationDate", "ModDate": "modDate"}
MAX_PAGES = 5

_OBJECT = re.compile(rb"(?<![\d.])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_SHOWN = re.compile(rb"(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>)|(-?\d+\.?\d*|-?\.\d+)|\b(Tj|TJ|Td|TD|Tm|ET|BT)\b|(T\*|'|\")|([\[\]])", re.S)


def _literal(token: bytes) -> bytes:
    """The bytes of a string in parentheses or in angle brackets."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1]).decode()
        return bytes.fromhex(digits + "0" * (len(digits) % 2))
    body = token[1:-1]
    body = re.sub(rb"\\\r?\n", b"", body)
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() else _ESCAPES.get(m.group(1), m.group(1)), body, flags=re.S)


def _decoded(raw: bytes) -> str:
    if raw.startswith((b"\xfe\xff", b"\xff\xfe")):
        return raw.decode("utf-16", errors="replace")
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw[3:].decode("utf-8", errors="replace")
    return raw.decode("cp1252", errors="replace")


def _content(body: bytes) -> bytes:
    """The bytes of an object's stream; empty if it has none or a filter that is not read."""
    m = _STREAM.search(body)
    if not m:
        return b""
    head = body[: m.start()]
    if b"/FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(m.group(1))
        except zlib.error:
            return b""
    return b"" if b"/Filter" in head else m.group(1)


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            inner, first = _content(body), re.search(rb"/First\s+(\d+)", body)
            if inner and first:
                start = int(first.group(1))
                numbers = list(map(int, re.findall(rb"\d+", inner[:start])))
                places = list(zip(numbers[::2], numbers[1::2]))
                for k, (number, at) in enumerate(places):
                    end = places[k + 1][1] if k + 1 < len(places) else len(inner)
                    out.setdefault(number, inner[start + at : start + end])
    return out


def _value(body: bytes, key: str, objects: dict[int, bytes]) -> str | None:
    m = re.search(rb"/" + key.encode() + rb"\s*(\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\d+\s+\d+\s+R)", body, re.S)
    if not m:
        return None
    token = m.group(1)
    if token.endswith(b"R"):
        token = objects.get(int(token.split()[0]), b"").strip()
        if not token.startswith((b"(", b"<")):
            return None
    return _decoded(_literal(token))


def _pages(objects: dict[int, bytes]) -> list[bytes]:
    """Page objects in the order of the page tree; in the order of their numbers where there is no tree."""
    kinds = {n: "pages" if re.search(rb"/Type\s*/Pages\b", b) else "page" for n, b in objects.items() if re.search(rb"/Type\s*/Pages?\b", b)}
    children = {n: [int(x) for x in _REFERENCE.findall(m.group(1))] for n, k in kinds.items() if k == "pages" and (m := re.search(rb"/Kids\s*\[(.*?)\]", objects[n], re.S))}
    below = {c for own in children.values() for c in own}
    out: list[bytes] = []
    seen: set[int] = set()
    stack = [n for n in sorted(children, reverse=True) if n not in below]
    while stack:
        n = stack.pop()
        if n in seen:
            continue
        seen.add(n)
        if kinds.get(n) == "page":
            out.append(objects[n])
        stack += reversed(children.get(n, []))
    return out or [objects[n] for n in sorted(kinds) if kinds[n] == "page"]


def _page_text(page: bytes, objects: dict[int, bytes]) -> str:
    m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
    content = b"\n".join(_content(objects.get(int(n), b"")) for n in _REFERENCE.findall(m.group(1))) if m else b""
    lines: list[str] = [""]
    waiting: list[bytes] = []
    numbers: list[float] = []
    array = False
    for text, number, word, sign, bracket in _SHOWN.findall(content):
        if text:
            waiting.append(_literal(text))
        elif number:
            numbers.append(float(number))
            if array and float(number) < -200:
                waiting.append(b" ")  # a wide gap inside a line
        elif bracket:
            array = bracket == b"["
        else:
            if word in (b"Tj", b"TJ") or sign in (b"'", b'"'):
                if sign and lines[-1]:
                    lines.append("")
                lines[-1] += _decoded(b"".join(waiting))
            elif (word in (b"Td", b"TD") and len(numbers) >= 2 and numbers[-1] != 0) or word in (b"Tm", b"ET") or sign == b"T*":
                if lines[-1]:
                    lines.append("")
            waiting, numbers, array = [], [], False
    return "\n".join(x.rstrip() for x in lines if x.strip())


def read_pdf(data: bytes | None, max_pages: int = MAX_PAGES) -> tuple[dict[str, str], int | None, str]:
    """(embedded metadata, number of pages, text of the first pages)."""
    if not data or b"%PDF" not in data[:1024] or b"/Encrypt" in data:
        return {}, None, ""
    objects = _objects(data)
    info = re.findall(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    body = objects.get(int(info[-1]), b"") if info else b""
    meta = {name: v for key, name in INFO_KEYS.items() if (v := _value(body, key, objects)) is not None}
    pages = _pages(objects)
    texts = [_page_text(p, objects) for p in pages[:max_pages]]
    return meta, len(pages), "\n".join(t for t in texts if t)


def corpus_of(spark: SparkSession, folder: str, max_pages: int = MAX_PAGES, **rules) -> DataFrame:
    """The corpus relation of a folder of PDF files: the rules are those of scan; only files that it keeps are opened."""
    ship(spark)
    files = scan(spark, folder, **rules)
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("original_path"), "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [read_pdf(bytes(c), max_pages) for c in pdf.content]
            out = pdf[["file_id", "original_path", "file_size_bytes"]].copy()
            out["raw_text"], out["pdf_metadata"], out["page_count"] = [t for _, _, t in rows], [m for m, _, _ in rows], pd.array([n for _, n, _ in rows], dtype="Int32")
            yield out

    return contents.join(files, "original_path").mapInPandas(read, "file_id string, original_path string, file_size_bytes bigint, raw_text string, pdf_metadata map<string,string>, page_count int")
