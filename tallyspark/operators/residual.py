"""Rows that no concept claims: eligibility, the section they belong to, what is swept and what triggers a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_role(caption: Column) -> Column:
    low = F.lower(F.trim(caption))
    return F.when(low.rlike("^sub-? ?total"), "SUBTOTAL").when(low.rlike(r"^(grand )?total\b"), "TOTAL").otherwise("LINE")


def exclusion(caption: Column, role: Column, words: int = 12) -> Column:
    """Why a row isn't swept, the first reason that holds; null if it may be."""
    low = F.lower(caption)
    return (
        F.when(role == "SUBTOTAL", "subtotal").when(role == "TOTAL", "total").when(low.rlike("attributable to"), "attribution").when(low.rlike("per share"), "per_share")
        .when((F.size(F.split(F.trim(low), r"\s+")) > words) | low.rlike("as follows"), "narrative").when(low.rlike(r"^notes? [0-9]+$"), "note_ref")
    )


def place_rows(rows: DataFrame, keys: list[str], order: str, own: str, subtotal_of: str, mapped: str) -> DataFrame:
    """``rows`` with placed: the section of a row's own banner, else of the next subtotal, else of the mapped row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    after = F.first(subtotal_of, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.last(mapped, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("placed", F.coalesce(own, after, before))


def sweep(facts: DataFrame, claimed: Column, section: Column) -> DataFrame:
    """Unclaimed figures summed into their section's residual: doc_id, basis, period_label, canonical_key, figure, components, largest (of their sizes)."""
    rows = facts.where(~claimed & section.isNotNull()).withColumn("canonical_key", F.concat(section, F.lit("__others")))
    return rows.groupBy("doc_id", "basis", "period_label", "canonical_key").agg(F.sum("value").alias("figure"), F.count("*").alias("components"), F.max(F.abs("value")).alias("largest"))


def triggers(swept: DataFrame, totals: DataFrame, share: float = 0.05, most: int = 6, part: float = 0.02) -> DataFrame:
    """Reasons to look at a residual: its share of the section's total, that of a single component, the number of components, a sign against the total's,
    a gap (totals may say unallocated_gap), or no total at all.
    """
    j = swept.join(totals, ["doc_id", "basis", "period_label"], "left")
    f, t = F.col("figure").cast("double"), F.col("total").cast("double")
    gap = F.when(F.col("status") == "unallocated_gap", "gap") if "status" in totals.columns else F.lit(None).cast("string")
    reasons = F.array_compact(F.array(F.when(F.abs(f) > F.abs(t) * share, "share"), F.when(F.col("largest").cast("double") > F.abs(t) * part, "component"), F.when(F.col("components") > most, "count"), F.when(f * t < 0, "sign"), gap, F.when(t.isNull(), "no_total")))
    return j.withColumn("reasons", F.array_join(reasons, ","))


def block_subtotals(items: DataFrame) -> DataFrame:
    """Subtotals against the rows they name: items doc_id, ordinal, value, component_ordinals (null for plain rows).

    At least two components, all of which must carry a value; otherwise the subtotal isn't checked.
    """
    parents = items.where("size(component_ordinals) >= 2").select("doc_id", "ordinal", F.col("value").alias("printed"), F.explode("component_ordinals").alias("part"), F.size("component_ordinals").alias("wanted"))
    parts = items.select("doc_id", F.col("ordinal").alias("part"), F.col("value").alias("v"))
    sums = parents.join(parts, ["doc_id", "part"], "left").groupBy("doc_id", "ordinal", "printed", "wanted").agg(F.count("v").alias("have"), F.sum("v").alias("total"))
    return sums.where("have = wanted").select("doc_id", "ordinal", "printed", "total", (F.abs(F.col("printed") - F.col("total")) <= 1).alias("ties"))


def containment(grid: DataFrame, parent: str, children: tuple[str, ...], tol: float = 1.0) -> DataFrame:
    """Slots where a gross parent is printed beside some of its children: filed is false; explained says whether they add up to it."""
    p, cs = F.col(parent).cast("double"), [F.col(c).cast("double") for c in children]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cs[1:]), F.coalesce(cs[0], F.lit(0.0)))
    rows = grid.where(F.col(parent).isNotNull() & F.coalesce(*children).isNotNull())
    return rows.select("doc_id", "basis", "period_label", (F.abs(p - total) <= tol).alias("explained"))


def majority(rows: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """The most frequent choice of each key; of equals the first in order of presentation (its smallest ``place``)."""
    votes = rows.groupBy(*keys, choice).agg(F.count("*").alias("n"), F.min("place").alias("p"))
    return votes.groupBy(*keys).agg(F.max_by(choice, F.struct("n", -F.col("p"))).alias(choice))
