"""Workbooks written with the standard library: sheets of rows to bytes, and one workbook a document."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Rows a sheet may have, by its format; longer tables go on in further sheets.
SHEET_ROWS = 1_048_576


def letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(ref: str, v) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(v))
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _parts(sheets: dict[str, list[list]]):
    """(name, rows) of sheets: legal, distinct names; tables beyond a sheet's rows continue."""
    used: set[str] = set()
    for title, rows in sheets.items():
        for i in range(0, max(1, len(rows)), SHEET_ROWS):
            base = re.sub(r"[\[\]:*?/\\]", " ", title)[:31] or "Sheet"
            name, n = base, 2
            while name.lower() in used:
                name, n = f"{base[:27]} ({n})", n + 1
            used.add(name.lower())
            yield name, rows[i : i + SHEET_ROWS]


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """The bytes of a workbook; the same sheets give the same bytes. None leaves a cell empty, control characters go."""
    parts = list(_parts(sheets)) or [("Sheet", [])]
    ids = range(1, len(parts) + 1)
    files = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in ids) + "</Types>",
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>'
        + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in zip(ids, parts, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>",
    }
    for i, (_, rows) in zip(ids, parts, strict=True):
        body = "".join(f'<row r="{r}">' + "".join(_cell(f"{letters(c)}{r}", v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
        files[f"xl/worksheets/sheet{i}.xml"] = f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{body}</sheetData></worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


#: Columns of the flat sheet.
FLAT = ("ordinal", "source_label", "canonical_key", "basis", "period_label", "value", "note_number", "page_index")


def document_workbooks(facts: DataFrame, columns: tuple[str, ...] = FLAT, title: str = "Rows") -> DataFrame:
    """doc_id, content, doc_hash: a flat workbook of each document's rows in printed order.

    A file is made by one task, so a document's rows meet there; documents, not rows, are what the data grow by.
    """
    cols = [F.col(c).cast("double").alias(c) if c == "value" else F.col(c) for c in columns]
    grouped = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))

    def run(batches):
        for batch in batches:
            for doc, rows in zip(batch.column(0), batch.column(1), strict=True):
                table = [list(columns), *([r[c] for c in columns] for r in rows.as_py())]
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], doc.type), pa.array([workbook({title: table})], pa.binary())], names=["doc_id", "content"])

    kind = facts.schema["doc_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"doc_id {kind}, content binary").withColumn("doc_hash", F.sha2("content", 256))
