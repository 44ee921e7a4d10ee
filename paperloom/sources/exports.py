"""Sinks of the preview relation: CSV, JSON, Markdown, XLSX. Spark writes data; the driver only formats bounded reports.

XLSX and Markdown are reports for people: XLSX streams rows to the driver up to the format's own limit of rows a sheet.
"""

from __future__ import annotations

import json
import zipfile
from datetime import datetime, timezone
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHEET_ROWS = 1_048_000


def to_csv(df: DataFrame, path: str) -> str:
    """SNK-1: a folder of CSV parts with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def to_json(df: DataFrame, path: str) -> str:
    """SNK-2: a folder of JSON lines."""
    df.write.mode("overwrite").json(path)
    return path


def write_envelope(df: DataFrame, path: str) -> str:
    """SNK-2: one JSON file with exported_at, total_documents and documents, written row by row on the driver; for large exports use to_json."""
    n = df.count()
    with open(path, "w", encoding="utf-8") as f:
        stamp = datetime.now(timezone.utc).isoformat(timespec="seconds")
        f.write('{\n  "exported_at": ' + json.dumps(stamp) + ',\n  "total_documents": ' + str(n) + ',\n  "documents": [')
        for k, r in enumerate(df.toLocalIterator()):
            f.write(("," if k else "") + "\n    " + json.dumps(r.asDict(), ensure_ascii=False, default=str))
        f.write("\n  ]\n}\n")
    return path


def label(kind):
    """RP-3: the type as exports for people show it."""
    return F.when(F.coalesce(kind, F.lit("")) == "", "Other").otherwise(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def summary(df: DataFrame) -> dict:
    """AG-5: total, counts by strategy, mean of positive confidences."""
    row = df.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)), 3).alias("mean")).first()
    by = {r.extraction_method: r["count"] for r in df.groupBy("extraction_method").count().orderBy("extraction_method").collect()}  # one row a method
    return {"total": row.n, "mean_confidence": row["mean"], "by_strategy": by}


def to_markdown(df: DataFrame, path: str) -> str:
    """SNK-4: summary, strategies and the first twenty rows."""
    s = summary(df)
    top = df.orderBy("renamed_file", "original_location").limit(20).select(F.left("original_file", F.lit(30)), F.left("renamed_file", F.lit(35)), F.left(label(F.col("document_type")), F.lit(20))).collect()
    lines = ["# Report", "", "| total | mean confidence |", "|---|---|", f"| {s['total']} | {s['mean_confidence']} |", "", "| strategy | documents |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in s["by_strategy"].items()]
    lines += ["", "| original | new name | type |", "|---|---|---|"] + [f"| {a} | {b} | {c} |" for a, b, c in top]
    Path(path).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return path


def to_xlsx(df: DataFrame, path: str) -> str:
    """SNK-3: one sheet with a serial number, a bold frozen header and a filter, and a summary sheet, written as plain OOXML."""
    df = df.withColumn("document_type", label(F.col("document_type"))).orderBy("renamed_file", "original_location")
    columns = ["Sr. No.", *df.columns]
    letter = lambda i: (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)

    def cell(i: int, r: int, v, style: int = 0) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f'<c r="{letter(i)}{r}" s="{style}"><v>{v}</v></c>'
        return f'<c r="{letter(i)}{r}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'

    def rows(values, start: int = 1):
        for r, row in enumerate(values, start):
            yield f'<row r="{r}">' + "".join(cell(i, r, v, int(r == 1)) for i, v in enumerate(row)) + "</row>"

    def data():
        yield columns
        for n, r in enumerate(df.toLocalIterator(), 1):
            if n > SHEET_ROWS:
                raise ValueError(f"a sheet holds {SHEET_ROWS} rows; export CSV instead")
            yield [n, *r]

    s = summary(df)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Documents" sheetId="1" r:id="r1"/><sheet name="Summary" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{t}" Target="{f}"/>' for i, (t, f) in enumerate([("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml"), ("styles", "styles.xml")], 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet {ns}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())
            for row in rows(data()):
                f.write(row.encode())
            f.write(f'</sheetData><autoFilter ref="A1:{letter(len(columns) - 1)}1"/></worksheet>'.encode())
        block = [["Total", s["total"]], ["Mean confidence", s["mean_confidence"]], *([k, v] for k, v in s["by_strategy"].items())]
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{''.join(rows(block, 2))}</sheetData></worksheet>")
    return path


def export(df: DataFrame, fmt: str, path: str) -> list[str]:
    """SNK-5: one format or all four."""
    writers = {"csv": to_csv, "json": to_json, "markdown": to_markdown, "excel": to_xlsx}
    ends = {"csv": "_csv", "json": "_json", "markdown": ".md", "excel": ".xlsx"}
    if fmt != "all" and fmt not in writers:
        raise ValueError(f"unknown format {fmt}; there are {', '.join(writers)} and all")
    return [writers[f](df, path + ends[f]) for f in (writers if fmt == "all" else [fmt])]
