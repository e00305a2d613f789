"""Sheets of cells to labelled facts: columns, notes, bases, periods and units are read from a sheet's header rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import numbers
from tallyspark.functions.text import section_of_banner
from tallyspark.operators.layout import column_bases
from tallyspark.sources.files import detect_columns

SHEET = ["doc_hash", "sheet"]
#: Header rows that are read, and what a note column is headed.
HEADER_ROWS = 8
NOTE_HEADER = r"(?i)^\s*notes?( no\.?)?\s*$"
#: Words of bases, and declared units (phrase, currency, factor), longest first.
BASIS_WORDS = (("standalone", "(?i)standalone|company|separate"), ("consolidated", "(?i)consolidated|group"))
UNITS = (("rmb million", "RMB", 1e6), ("hk$'000", "HKD", 1e3), ("rmb'000", "RMB", 1e3), ("us$'000", "USD", 1e3), ("million", None, 1e6), ("'000", None, 1e3))


def basis_of(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for basis, pattern in reversed(BASIS_WORDS):
        out = F.when(text.rlike(pattern), basis).otherwise(out)
    return out


def unit_of(text: Column) -> Column:
    """struct (currency, factor) of the first declared unit that a text holds, blanks and letters' case aside; null if none."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(text), "[‘’]", "'"), r"\s+", "")
    out = F.lit(None).cast("struct<currency:string,factor:double>")
    for phrase, currency, factor in reversed(UNITS):
        out = F.when(folded.contains(phrase.replace(" ", "")), F.struct(F.lit(currency).cast("string").alias("currency"), F.lit(factor).alias("factor"))).otherwise(out)
    return out


def sheet_columns(cells: DataFrame) -> DataFrame:
    """sheet, label_col, note_col (null without one), value_cols: the note column's numbers are no values."""
    found = detect_columns(cells)
    head = cells.where((F.col("row") < HEADER_ROWS) & F.col("number").isNull() & F.col("text").rlike(NOTE_HEADER))
    note = head.join(found.select(*SHEET, "label_col"), SHEET).where("col <> label_col").groupBy(*SHEET).agg(F.min_by("col", F.struct("row", "col")).alias("note_col"))
    rest = F.when(F.col("note_col").isNull(), F.col("value_cols")).otherwise(F.array_except("value_cols", F.array("note_col")))
    return found.join(note, SHEET, "left").select(*SHEET, "label_col", "note_col", rest.alias("value_cols"))


def column_headers(cells: DataFrame, columns: DataFrame) -> DataFrame:
    """sheet, col, basis, period_label, heading, currency, factor of every value column.

    basis: from the first header row that names both, the last mark at or left of the column; consolidated otherwise.
    heading: from the first row of texts over value columns that is no basis band, no units row and holds no amount.
    period_label: by the heading's dates within the basis, newest first (current, prior, col2 ...), if all have one and they differ;
    else by place. A heading that names no period keeps its own name. A restated column of the same date gets " restated".
    unit: the column's own, topmost first, else the sheet's.
    """
    every = columns.select(*SHEET, F.explode("value_cols").alias("col"))
    head = cells.where(F.col("row") < HEADER_ROWS).select(*SHEET, "row", "col", "text", "number")
    over = head.join(every, [*SHEET, "col"])
    marks = head.where("number is null").withColumn("marker", basis_of(F.col("text"))).where("marker is not null")
    bands = marks.groupBy(*SHEET, "row").agg(F.count_distinct("marker").alias("_n")).where("_n >= 2").groupBy(*SHEET).agg(F.min("row").alias("row"))
    band = marks.join(bands, [*SHEET, "row"]).select(*SHEET, "col", "marker")
    based = column_bases(every.withColumn("_value", F.lit(True)).join(band, [*SHEET, "col"], "full_outer"), SHEET, "col", "marker").where("_value").select(*SHEET, "col", F.coalesce("basis", F.lit("consolidated")).alias("basis"))
    year = F.col("number").between(1900, 2100) & (F.col("number") == F.floor("number"))
    row = over.groupBy(*SHEET, "row").agg(
        F.count_if(F.col("number").isNotNull() & ~year).alias("amounts"), F.count_if(F.col("number").isNull()).alias("texts"),
        F.bool_or(F.col("number").isNull() & basis_of(F.col("text")).isNotNull()).alias("band"), F.bool_and(F.when(F.col("number").isNull(), unit_of(F.col("text")).isNotNull())).alias("units"),
    )
    first = row.where("amounts = 0 and texts > 0 and not band and not coalesce(units, false)").groupBy(*SHEET).agg(F.min("row").alias("row"))
    years = row.where("amounts = 0 and texts = 0").groupBy(*SHEET).agg(F.min("row").alias("_y"))
    at = first.join(years, SHEET, "full_outer").select(*SHEET, F.coalesce("row", "_y").alias("row"))
    heads = over.join(at, [*SHEET, "row"]).select(*SHEET, "col", F.regexp_replace("text", r"\.0$", "").alias("heading"))
    unit = over.where("number is null").withColumn("_u", unit_of(F.col("text"))).where("_u is not null").groupBy(*SHEET, "col").agg(F.min_by("_u", "row").alias("_own"))
    whole = head.where("number is null").groupBy(*SHEET, "row").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"])).alias("_t"))
    sheet_unit = whole.withColumn("_u", unit_of(F.col("_t"))).where("_u is not null").groupBy(*SHEET).agg(F.min_by("_u", "row").alias("_sheet"))
    rows = based.join(heads, [*SHEET, "col"], "left").join(unit, [*SHEET, "col"], "left").join(sheet_unit, SHEET, "left")

    date = numbers.period_date(F.col("heading"))
    key = F.when(date["y"].isNotNull(), date["y"] * 10000 + date["m"] * 100 + date["d"])
    rows = rows.withColumn("_date", key).withColumn("_period", F.coalesce(F.trim("heading"), F.lit("")).eqNullSafe("") | key.isNotNull()).withColumn("_old", F.coalesce(F.col("heading").rlike("(?i)restated"), F.lit(False)))
    side = Window.partitionBy(*SHEET, "basis", "_period")
    dated = (F.min(F.col("_date").isNotNull()).over(side)) & (F.min("_date").over(side) != F.max("_date").over(side))
    slot = F.when(dated, F.dense_rank().over(side.orderBy(F.desc("_date")))).otherwise(F.row_number().over(side.orderBy("col")))
    rows = rows.withColumn("_slot", slot)
    shared = F.row_number().over(Window.partitionBy(*SHEET, "basis", "_period", "_slot").orderBy("_old", "col"))
    label = F.when(F.col("_slot") == 1, "current").when(F.col("_slot") == 2, "prior").otherwise(F.concat(F.lit("col"), (F.col("_slot") - 1).cast("string")))
    suffix = F.when(shared == 1, "").when(F.col("_old"), " restated").otherwise(F.concat(F.lit("#"), shared.cast("string")))
    named = F.when(F.col("_period"), F.concat(label, suffix)).otherwise(F.trim("heading"))
    return rows.select(*SHEET, "col", "basis", named.alias("period_label"), "heading", F.coalesce("_own", "_sheet").alias("_u")).select(*SHEET, "col", "basis", "period_label", "heading", "_u.currency", "_u.factor")


def workbook_facts(cells: DataFrame) -> DataFrame:
    """doc_hash, sheet, row, source_label, section, note_number, cell, basis, period_label, currency, factor, value of labelled amounts.

    cells: doc_hash, sheet, row, col, text, number. Texts that read as numbers count as amounts. A row without amounts whose caption
    names a section is its banner and carries down; a caption without amounts that names none ends nothing. Sheets without a label
    column or amounts give no rows. A sheet's cells are grouped by their key; rows of a sheet are windowed, not collected.
    """
    cells = cells.where("col is not null").withColumn("number", F.coalesce("number", numbers.parse_number(F.col("text")).cast("double")))
    raw = cells.withColumn("number", F.when(F.col("text").rlike(r"\p{L}"), F.lit(None)).otherwise(F.col("number")))
    columns = sheet_columns(raw)
    heads = column_headers(raw, columns)
    labels = raw.join(columns.select(*SHEET, F.col("label_col").alias("col")), [*SHEET, "col"]).where("number is null").select(*SHEET, "row", F.trim("text").alias("source_label"))
    refs = raw.join(columns.select(*SHEET, F.col("note_col").alias("col")), [*SHEET, "col"]).select(*SHEET, "row", F.regexp_extract("text", r"([0-9]{1,3}(\([a-z]\))?)", 1).alias("note_number"))
    amounts = raw.where("number is not null").join(heads, [*SHEET, "col"])
    year_row = F.bool_and((F.col("number").between(1900, 2100)) & (F.col("number") == F.floor("number"))).over(Window.partitionBy(*SHEET, "row"))
    amounts = amounts.withColumn("_years", year_row).where(~(F.col("_years") & (F.col("row") < HEADER_ROWS))).drop("_years")
    has = amounts.select(*SHEET, "row").distinct().withColumn("_has", F.lit(True))
    w = Window.partitionBy(*SHEET).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    banner = F.when(F.col("_has").isNull(), section_of_banner(F.col("source_label")))
    placed = labels.join(has, [*SHEET, "row"], "left").withColumn("section", F.last(banner, True).over(w)).where("_has").drop("_has")
    cell = F.concat(numbers.column_letters(F.col("col")), (F.col("row") + 1).cast("string"))
    rows = placed.join(amounts, [*SHEET, "row"]).join(refs, [*SHEET, "row"], "left")
    return rows.select(*SHEET, "row", "source_label", "section", F.nullif("note_number", F.lit("")).alias("note_number"), cell.alias("cell"), "basis", "period_label", "currency", "factor", F.col("number").alias("value"))
