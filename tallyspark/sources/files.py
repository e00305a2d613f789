"""File sources: format sniffing over binary files and workbooks read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def sniff(content: Column, path: Column) -> Column:
    """pdf, xlsx, xls, image or unknown, by the first bytes, then by the name."""
    head = F.hex(F.substring(content, 1, 8))
    name = F.lower(path)
    return (
        F.when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "xlsx").when(head.startswith("D0CF11E0A1B11AE1"), "xls")
        .when(head.startswith("89504E47") | head.startswith("FFD8FF"), "image").when(name.endswith(".pdf"), "pdf").when(name.endswith(".xlsx"), "xlsx")
        .when(name.endswith(".xls"), "xls").when(name.rlike(r"\.(png|jpe?g)$"), "image").otherwise("unknown")
    )


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """path, doc_hash, format, length, content of the files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.sha2("content", 256).alias("doc_hash"), sniff(F.col("content"), F.col("path")).alias("format"), "length", "content")


def cells_of(data: bytes):
    """(sheet, row, column, text, number, hidden) of a workbook's cells, rows and columns from 0."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS)
        for i, sheet in enumerate(sheets if sheets is not None else [], 1):
            part = f"xl/worksheets/sheet{i}.xml"
            if part not in names:
                continue
            hidden = sheet.get("state", "visible") != "visible"
            for c in ElementTree.fromstring(z.read(part)).iter(f"{{{_NS['m']}}}c"):
                letters, digits = re.match(r"([A-Z]+)([0-9]+)", c.get("r", "")).groups()
                column = 0
                for x in letters:
                    column = column * 26 + ord(x) - 64
                v, kind = c.find("m:v", _NS), c.get("t", "n")
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else v.text if v is not None else None
                if text is None:
                    continue
                if kind == "s":
                    text = shared[int(text)]
                number = float(text) if kind == "n" else None
                yield sheet.get("name"), int(digits) - 1, column - 1, text, number, hidden


def workbook_cells(files: DataFrame) -> DataFrame:
    """doc_hash, sheet, row, col, text, number, hidden of the workbooks among ``files``; a broken one gives one row of nulls and its error."""
    names = ["doc_hash", "sheet", "row", "col", "text", "number", "hidden", "error"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.string()]

    def run(batches):
        for batch in batches:
            for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(digest, *c, None) for c in cells_of(data)]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, AttributeError, ValueError, IndexError) as e:
                    rows = [(digest, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.where("format = 'xlsx'").select("doc_hash", "content").mapInArrow(run, "doc_hash string, sheet string, row int, col int, text string, number double, hidden boolean, error string")


def detect_columns(cells: DataFrame) -> DataFrame:
    """doc_hash, sheet, label_col (the column with most texts), value_cols (the others with a number, in order)."""
    counts = cells.where("col is not null").groupBy("doc_hash", "sheet", "col").agg(F.count_if(F.col("number").isNull()).alias("texts"), F.count("number").alias("numbers"))
    best = counts.groupBy("doc_hash", "sheet").agg(F.max(F.struct("texts", (-F.col("col")).alias("neg"))).alias("b"), F.array_sort(F.collect_list(F.when(F.col("numbers") > 0, F.col("col")))).alias("v"))
    label = (-F.col("b.neg")).cast("int")
    return best.withColumn("label_col", label).select("doc_hash", "sheet", "label_col", F.array_except("v", F.array("label_col")).alias("value_cols"))
