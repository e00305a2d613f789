"""Exports: wide rows, JSON rows, unit scaling, index of notes, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import csv_safe


def wide(facts: DataFrame, slots: list[tuple[str, str]], scale: float = 1.0) -> DataFrame:
    """A row for each printed line, never merged by caption, a column for each slot (basis, period), consolidated first; captions are made safe.

    facts: doc_id, ordinal (the line), source_label, canonical_key, basis, period_label, value. A line may have a value for each slot.
    """
    slot = lambda b, p: F.max(F.when((F.col("basis") == b) & (F.col("period_label") == p), F.col("value"))).cast("double")
    cells = [(slot(b, p) if scale == 1 else slot(b, p) * scale).alias(f"{b}_{p}") for b, p in slots]
    return facts.groupBy("doc_id", "ordinal", csv_safe(F.col("source_label")).alias("caption"), "canonical_key").agg(*cells)


def unit_factor(source: Column, target: float | None) -> Column:
    """source / target; 1 if either is unknown."""
    return F.coalesce(F.try_divide(source.cast("double"), F.lit(target)), F.lit(1.0)) if target else F.lit(1.0)


def json_rows(cells: DataFrame) -> DataFrame:
    """doc_id, canonical_key, json of its figures in order of basis and period."""
    items = F.array_sort(F.collect_list(F.struct("basis", "period_label", F.col("figure").cast("string").alias("figure"))))
    return cells.groupBy("doc_id", "canonical_key").agg(F.to_json(items).alias("json"))


def note_index(facts: DataFrame) -> DataFrame:
    """Notes of a document: first page, all pages in order, rows."""
    pages = F.array_sort(F.collect_set("page_index"))
    return facts.where("note_number <> ''").groupBy("doc_id", "note_number").agg(
        F.min("page_index").alias("start_page"), F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("pages"), F.count("*").alias("rows")
    )


def contributions(facts: DataFrame) -> DataFrame:
    """CELL, lines, trail: of every figure that several printed lines make, each line's caption, amount and page, and which the total doesn't add.

    facts: CELL, ordinal, source_label, page_index, value, keep (mark_summable()). Lines are in printed order; a figure's lines meet in one row, a document at most.
    """
    amount = F.format_number(F.col("value").cast("double"), 0)
    where = F.when(F.col("page_index").isNotNull(), F.concat(F.lit("  [p."), (F.col("page_index") + 1).cast("string"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("  "), F.coalesce("source_label", F.lit("")), F.lit(" = "), F.coalesce(amount, F.lit("—")), where, F.when(F.col("keep"), "").otherwise("  (same fact printed above — not added)"))
    cells = facts.groupBy("doc_id", "canonical_key", "basis", "period_label").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.struct("ordinal", line.alias("l")))).alias("ls"), F.sum(F.when(F.col("keep"), F.col("value"))).alias("t")).where("lines > 1")
    total = F.concat(F.lit("  Total = "), F.coalesce(F.format_number(F.col("t").cast("double"), 0), F.lit("—")))
    head = F.concat(F.lit("Combined from "), F.col("lines").cast("string"), F.lit(" printed lines:"))
    return cells.select("doc_id", "canonical_key", "basis", "period_label", "lines", F.array_join(F.concat(F.array(head), F.transform("ls", lambda x: x["l"]), F.array(total)), "\n").alias("trail"))


def statement_csv(statements: DataFrame, periods: tuple[str, ...]) -> DataFrame:
    """doc_id, csv: each document's statement as one text: a heading, then a line for each template row in order, figures as printed.

    statements: doc_id, statement, place, label, and a column of text for each period.
    """
    cell = lambda c: F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))
    line = F.concat_ws(",", cell(F.col("statement")), cell(csv_safe(F.col("label"))), *[cell(F.col(p)) for p in periods])
    head = ",".join(("Statement", "Line item", *periods))
    rows = statements.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("statement", "place", line.alias("l")))).alias("ls"))
    return rows.select("doc_id", F.array_join(F.concat(F.array(F.lit(head)), F.transform("ls", lambda x: x["l"])), "\r\n").alias("csv"))


#: Sheets of an analysis, in order, and what each shows.
SHEETS = {
    "Notes": ("note_number", "start_page", "pages", "rows"), "Ratios": ("ratio_key", "basis", "period_label", "ratio"), "Disclosures": ("family", "page", "snippet"), "Credit": ("category", "ratio_key", "ratio", "tone"),
}


def analysis_rows(parts: dict[str, DataFrame], include: tuple[str, ...] | None = None) -> DataFrame:
    """doc_id, sheet, cells (array of text) of the sheets asked for; a sheet without a frame, or that isn't asked for, is left out."""
    made = []
    for place, (name, columns) in enumerate(SHEETS.items()):
        if name in parts and (include is None or name in include):
            made.append(parts[name].select("doc_id", F.lit(place).alias("place"), F.lit(name).alias("sheet"), F.array(*[F.col(c).cast("string") for c in columns]).alias("cells")))
    if not made:
        raise ValueError("no sheet is asked for")
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out
