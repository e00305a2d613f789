"""Faces against notes: ties with a sign, the best table of a note, block subtotals, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tie_status(residual: Column, face: Column, details: Column, absolute: float, relative: float, near: float = 0.05) -> Column:
    """tied, untied (within ``near`` of the face) or unconfirmed (no details, or further off)."""
    tol = F.greatest(F.lit(absolute), F.abs(face) * relative)
    return F.when(details == 0, "unconfirmed").when(F.abs(residual) <= tol, "tied").when(F.abs(residual) <= F.abs(face) * near, "untied").otherwise("unconfirmed")


def reconcile(faces: DataFrame, notes: DataFrame, absolute: float = 1.0, relative: float = 0.005) -> DataFrame:
    """Faces (doc_id, basis, period_label, face) joined with note tables (doc_id, basis, period_label, table_id, total, rows).

    A table is read with the sign, + first, that ties in all of its periods. Of a note's tables the one with the smallest
    residual is taken; of equals, the earlier. A face without tables is unconfirmed.
    """
    slot = ["doc_id", "basis", "period_label"]
    both = faces.join(notes, slot, "left")
    tol = F.greatest(F.lit(absolute), F.abs(F.col("face")) * relative)
    table = Window.partitionBy("doc_id", "basis", "table_id")
    plus = F.bool_and(F.abs(F.col("face") - F.col("total")) <= tol).over(table)
    minus = F.bool_and(F.abs(F.col("face") + F.col("total")) <= tol).over(table)
    sign = F.when(F.coalesce(plus, F.lit(False)), 1).when(F.coalesce(minus, F.lit(False)), -1).otherwise(1)
    rows = both.withColumn("orientation", sign).withColumn("residual", F.col("face") - F.coalesce(F.col("total"), F.lit(0.0)) * F.col("orientation"))
    first = Window.partitionBy(*slot).orderBy(F.abs("residual"), F.col("table_id").asc_nulls_last())
    best = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return best.select(*slot, "table_id", "face", "residual", "orientation", tie_status(F.col("residual"), F.col("face"), F.coalesce("rows", F.lit(0)), absolute, relative).alias("status"))


def prune_notes(notes: DataFrame, cited: DataFrame) -> DataFrame:
    """Notes of the numbers that are cited, or whose parent number is."""
    parent = F.regexp_extract("note_number", r"^\s*([0-9]{1,3})", 1)
    return notes.join(cited.select("doc_id", F.col("note_number").alias("_cited")).distinct(), (notes.doc_id == cited.doc_id) & ((F.col("_cited") == notes.note_number) | (F.col("_cited") == parent)), "left_semi")


def conflicts(facts: DataFrame, a: str, b: str, tol: float) -> DataFrame:
    """Slots where two concepts that should agree are printed with different amounts."""
    one = lambda k: F.sum(F.when(F.col("canonical_key") == k, F.col("value"))).cast("double")
    both = facts.where(F.col("canonical_key").isin(a, b)).groupBy("doc_id", "basis", "period_label").agg(one(a).alias("a"), one(b).alias("b"))
    return both.where(F.abs(F.col("a") - F.col("b")) > tol)


def resolve_citations(cites: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, cited, note: a cited number, its parent ("16" of "16(b)") only where that itself doesn't exist, else null."""
    have = notes.select("doc_id", "note_number").distinct()
    own = have.withColumnRenamed("note_number", "cited").withColumn("_own", F.col("cited"))
    up = have.select("doc_id", F.col("note_number").alias("_up"))
    rows = cites.withColumn("_up", F.regexp_extract("cited", r"^\s*([0-9]{1,3})", 1))
    return rows.join(own, ["doc_id", "cited"], "left").join(up.withColumn("_parent", F.col("_up")), ["doc_id", "_up"], "left").select("doc_id", "cited", F.coalesce("_own", "_parent").alias("note"))


def link_kinds(links: DataFrame) -> DataFrame:
    """Links of a concept and a note with their kind: MANY_NOTES of one concept, SPLITS of one note, else ONE."""
    notes = F.count("*").over(Window.partitionBy("doc_id", "canonical_key"))
    faces = F.count("*").over(Window.partitionBy("doc_id", "note_number"))
    return links.withColumn("relationship", F.when(notes > 1, "MANY_NOTES").when(faces > 1, "SPLITS").otherwise("ONE"))
