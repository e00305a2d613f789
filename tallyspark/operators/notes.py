"""Face rows and the notes that itemise them: splits, sole components, containment, suspects, sweeps and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ["basis", "period_label"]


def reconcile_face(faces: DataFrame, details: DataFrame, absolute: float = 1.0, relative: float = 0.005, near: float = 0.05) -> DataFrame:
    """doc_id, slot, reconciled, residual, status. faces: doc_id, slot, face. details: doc_id, slot, item_id, value, mapped.

    An item read twice counts once. reconciled: the face less what template lines of their own take; residual: less all details.
    Without details a face is unconfirmed, its residual the face itself.
    """
    once = details.dropDuplicates(["doc_id", *SLOT, "item_id"])
    sums = once.groupBy("doc_id", *SLOT).agg(F.sum(F.when(F.col("mapped"), F.col("value"))).alias("_own"), F.sum("value").alias("_all"), F.count("value").alias("_n"))
    j = faces.join(sums, ["doc_id", *SLOT], "left")
    residual, tol = F.col("face") - F.coalesce("_all", F.lit(0.0)), F.greatest(F.lit(absolute), F.abs("face") * relative)
    status = F.when(F.coalesce("_n", F.lit(0)) == 0, "unconfirmed").when(F.abs(residual) <= tol, "tied").when(F.abs(residual) <= F.abs("face") * near, "untied").otherwise("unconfirmed")
    return j.select("doc_id", *SLOT, (F.col("face") - F.coalesce("_own", F.lit(0.0))).alias("reconciled"), residual.alias("residual"), status.alias("status"))


def orientation(parents: DataFrame, parts: DataFrame, keys: list[str], tol: float = 1.0) -> DataFrame:
    """keys, orientation: the one sign (+1 first) with which the parts equal the parent in every column; 0 if neither does.

    parents: keys, slot, parent. parts: keys, slot, total. A column that the parts lack is not accounted for.
    """
    j = parents.join(parts, [*keys, *SLOT], "left")
    fits = lambda s: F.bool_and(F.coalesce(F.abs(F.col("parent") - s * F.col("total")) <= tol, F.lit(False)))
    return j.groupBy(*keys).agg(F.when(fits(1), 1).when(fits(-1), -1).otherwise(0).alias("orientation"))


def split_from_disclosure(parents: DataFrame, items: DataFrame, tol: float = 1.0) -> DataFrame:
    """Components that replace a printed aggregate: doc_id, table_id, concept, slot, figure (in the aggregate's sign).

    parents: doc_id, slot, parent. items: doc_id, table_id, concept, slot, value, of the notes that the aggregate cites, only concepts of
    its section. A table accounts for the aggregate if it has two concepts or more and adds up to it, with one sign, in every column.
    If exactly one table does, it is taken; if none does, all tables together are tried (table_id null); several are ambiguous and give nothing.
    """

    def fitting(rows: DataFrame, keys: list[str]) -> DataFrame:
        sums = rows.groupBy(*keys, *SLOT).agg(F.sum("value").alias("total"))
        wide = rows.groupBy(*keys).agg(F.count_distinct("concept").alias("_c")).where("_c >= 2").drop("_c")
        columns = parents.join(wide, "doc_id")
        return orientation(columns, sums, keys, tol).where("orientation <> 0")

    single = fitting(items, ["doc_id", "table_id"])
    alone = single.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).where("_n = 1").drop("_n")
    whole = fitting(items, ["doc_id"]).join(single.select("doc_id").distinct(), "doc_id", "left_anti")
    cell = ["doc_id", "table_id", "concept", *SLOT]
    figure = F.sum("value") * F.first("orientation")
    taken = items.join(alone, ["doc_id", "table_id"]).groupBy(*cell).agg(figure.alias("figure"))
    pooled = items.join(whole, "doc_id").withColumn("table_id", F.lit(None).cast(items.schema["table_id"].dataType)).groupBy(*cell).agg(figure.alias("figure"))
    return taken.unionByName(pooled)


def sole_components(grid: DataFrame, subtotal: str, child: str, siblings: tuple[str, ...]) -> DataFrame:
    """doc_id, slot, inferred: the subtotal's figure for its only named child, where neither the child nor a sibling is printed in the document."""
    seen = grid.groupBy("doc_id").agg(F.count(F.coalesce(*[F.col(c) for c in (child, *siblings)])).alias("_n")).where("_n = 0").select("doc_id")
    return grid.where(F.col(subtotal).isNotNull()).join(seen, "doc_id", "left_semi").select("doc_id", *SLOT, F.col(subtotal).cast("double").alias("inferred"))


def enforce_containment(facts: DataFrame, parent: str, children: tuple[str, ...], value: str, tol: float = 1.0) -> DataFrame:
    """doc_id, slot, parent, children, explained: gross parents to unfile, because a child is printed in the same document.

    A column without children has null children and isn't explained.
    """
    has = facts.where(F.col("canonical_key").isin(*children)).select("doc_id").distinct()
    some = facts.where(F.col("canonical_key").isin(parent, *children)).join(has, "doc_id", "left_semi")
    p, c = F.sum(F.when(F.col("canonical_key") == parent, F.col(value))), F.sum(F.when(F.col("canonical_key") != parent, F.col(value)))
    rows = some.groupBy("doc_id", *SLOT).agg(p.alias("parent"), c.alias("children")).where("parent is not null")
    return rows.withColumn("explained", F.coalesce(F.abs(F.col("parent") - F.col("children")) <= tol, F.lit(False)))


def sign_suspect(grid: DataFrame, target: str, terms: tuple[str, ...], tol: float = 1.0) -> DataFrame:
    """doc_id, slot, suspect of sums that don't hold: the one participant (target included) whose sign alone explains the gap, else null."""
    parts = [F.col(t).cast("double") for t in terms]
    goal = F.col(target).cast("double")
    expected = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    gap = goal - expected
    flips = [F.when(F.abs(gap + 2 * p) <= tol, F.lit(t)) for t, p in zip(terms, parts, strict=True)] + [F.when(F.abs(gap - 2 * goal) <= tol, F.lit(target))]
    found = F.array_compact(F.array(*flips))
    rows = grid.where(goal.isNotNull() & F.coalesce(*parts).isNotNull() & (F.abs(gap) > tol))
    return rows.select("doc_id", *SLOT, F.when(F.size(found) == 1, found[0]).alias("suspect"))


def sweep_notes(items: DataFrame, cited: DataFrame, permitted: tuple[str, ...]) -> DataFrame:
    """Unclaimed rows of cited notes added to the residual of the citing section: doc_id, section, slot, figure, components.

    items: doc_id, note_number, slot, value (unclaimed ones). cited: doc_id, note_number, section. A note that several sections cite
    goes to none: whose residual it is can't be told.
    """
    owner = cited.groupBy("doc_id", "note_number").agg(F.min("section").alias("section"), F.max("section").alias("_hi")).where("section = _hi").drop("_hi")
    rows = items.join(owner.where(F.col("section").isin(*permitted)), ["doc_id", "note_number"])
    return rows.groupBy("doc_id", "section", *SLOT).agg(F.sum("value").alias("figure"), F.count("*").alias("components"))


def plug_suspected(published: DataFrame, itemised: DataFrame, unit: Column | float = 1.0) -> DataFrame:
    """Residuals published beyond what their components add up to: doc_id, slot, figure, itemised, excess."""
    sums = itemised.groupBy("doc_id", *SLOT).agg(F.sum("value").alias("itemised"))
    j = published.join(sums, ["doc_id", *SLOT], "left").withColumn("itemised", F.coalesce("itemised", F.lit(0.0)))
    return j.withColumn("excess", F.col("figure") - F.col("itemised")).where(F.abs("excess") > unit)


def best_entry_per_note(entries: DataFrame) -> DataFrame:
    """One entry a note: consolidated before others, current before others, then the smaller residual."""
    rank = F.struct(F.col("basis") != "consolidated", F.col("period_label") != "current", F.abs("residual"), "basis", "period_label")
    return entries.groupBy("doc_id", "note_number").agg(F.min_by(F.struct("basis", "period_label", "status", "residual"), rank).alias("e")).select("doc_id", "note_number", "e.*")


def note_summary(entries: DataFrame) -> DataFrame:
    """doc_id, note_number, summary: how many face lines and how many columns tie; lines and columns are counted apart."""
    tied = F.col("status") == "tied"
    c = entries.groupBy("doc_id", "note_number").agg(
        F.count_distinct("face_item").alias("lines"), F.count("*").alias("cols"), F.count_if(tied).alias("tied"), F.count_if(F.col("status") == "untied").alias("untied")
    )
    text = F.format_string("%d line(s), %d of %d column(s) tied", "lines", "tied", "cols")
    return c.select("doc_id", "note_number", F.concat(text, F.when(F.col("untied") > 0, F.format_string(", %d off", "untied")).otherwise("")).alias("summary"))


def validation_caption(status: Column, failed: Column, skipped: Column) -> Column:
    """What a reader has to be told about a statement's checks; null if everything held."""
    return F.when(status == "UNVALIDATED", "Not validated: no check could run").when(status == "FAILED", F.concat(F.lit("Failed checks: "), failed.cast("string"))).when(status == "PARTIAL", F.concat(F.lit("Checks not run: "), skipped.cast("string")))
