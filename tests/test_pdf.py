"""The PDF reader on files made here: plain, deflated, with object streams, damaged."""

import zlib

from paperloom.sources import pdf


def made(pages, info, deflate=False, objstm=False, table=True):
    """A PDF with the given lines of text on each page and information dictionary (raw tokens)."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages)))), 3: b"<< " + b" ".join(b"/%s %s" % kv for kv in info.items()) + b" >>"}
    streams = {}
    for k, lines in enumerate(pages):
        content = b"BT /F1 12 Tf 72 720 Td " + b" ".join(b"%s 0 -14 Td" % line for line in lines) + b" ET"
        packed = zlib.compress(content) if deflate else content
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
        streams[11 + 2 * k] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(packed), b" /Filter /FlateDecode" if deflate else b"", packed)
    if objstm:
        bodies = list(objects.items())
        heads, at = [], 0
        for n, b in bodies:
            heads.append(b"%d %d" % (n, at))
            at += len(b) + 1
        head = b" ".join(heads) + b" "
        packed = zlib.compress(head + b"\n".join(b for _, b in bodies))
        streams[90] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(bodies), len(head), len(packed), packed)
        objects = {}
    out = b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in {**objects, **streams}.items())
    return out + (b"trailer << /Root 1 0 R /Info 3 0 R >>\nstartxref\n0\n%%EOF" if table else b"<< /Type /XRef /Root 1 0 R /Info 3 0 R >>")


INFO = {b"Title": b"(Rules \\(part 3\\) \\344)", b"Author": b"<FEFF004A00F600720067>", b"CreationDate": b"(D:20190315120000+05'30')", b"Producer": b"(Maker)"}
PAGES = [[b"(First line) Tj", b"[(Sec) -20 (ond) -300 (line)] TJ"], [], [b"(Page three) Tj", b"<466F7572> Tj"]]


def test_reads_every_kind():
    for kind in ({}, {"deflate": True}, {"deflate": True, "objstm": True}, {"table": False}):
        meta, n, text = pdf.read_pdf(made(PAGES, INFO, **kind))
        assert meta == {"title": "Rules (part 3) ä", "author": "Jörg", "creationDate": "D:20190315120000+05'30'", "producer": "Maker"}, kind
        assert n == 3 and text == "First line\nSecond line\nPage three\nFour", (kind, text)
    assert pdf.read_pdf(made([[b"(p%d) Tj" % k] for k in range(8)], {}), max_pages=5)[1:] == (8, "p0\np1\np2\np3\np4")


def test_what_is_no_pdf():
    assert pdf.read_pdf(None) == pdf.read_pdf(b"") == pdf.read_pdf(b"no pdf at all") == pdf.read_pdf(made(PAGES, INFO) + b"/Encrypt 5 0 R") == ({}, None, "")
    broken = made(PAGES, INFO, deflate=True).replace(b"stream\nx", b"stream\n\x00")
    assert pdf.read_pdf(broken)[1] == 3 and pdf.read_pdf(made([], {}))[1:] == (0, "")


def test_a_folder_becomes_a_corpus(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(PAGES, INFO).ljust(2000))
    (tmp_path / "copy.pdf").write_bytes(made(PAGES, INFO).ljust(2000))
    (tmp_path / "b.pdf").write_bytes(b"junk" * 600)
    rows = {r.original_path.rsplit("/", 1)[1]: r for r in pdf.corpus_of(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.pdf", "b.pdf"} and rows["a.pdf"].page_count == 3 and rows["a.pdf"].pdf_metadata["title"].startswith("Rules") and rows["b.pdf"].page_count is None and rows["b.pdf"].raw_text == ""
