"""Relations that a rulebook declares over sections, and what a failed one does to the figures that took part."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("doc_id", "basis", "period_label")
#: Roles of lines that are sums, the greatest validation of a figure in a failed relation, and the shape of an identity.
SUMS, CAP = ("subtotal", "total"), 0.5
NAME = r"[A-Za-z_][A-Za-z0-9_]*"
IDENTITY = re.compile(rf"^\s*({NAME})\s*=\s*([+-]?\s*{NAME}(?:\s*[+-]\s*{NAME})*)\s*$")
TERM = re.compile(rf"([+-]?)\s*({NAME})")


@dataclass(frozen=True)
class Relation:
    """target against the signed sum of terms (key, sign); broken says why it can't be evaluated."""

    id: str
    target: str
    terms: tuple[tuple[str, int], ...]
    broken: str = ""


def parse_identities(identities: dict[str, str], key_of: dict[str, str]) -> tuple[Relation, ...]:
    """Identities such as "a = b + c - d" over the names of a template. One that can't be read, names something unknown or names a term twice is broken."""
    out = []
    for name, text in identities.items():
        found = IDENTITY.match(text)
        if not found:
            out.append(Relation(name, "", (), "unparsable_expr"))
            continue
        terms = [(key_of.get(term), -1 if sign == "-" else 1) for sign, term in TERM.findall(found[2])]
        target = key_of.get(found[1])
        known = tuple((k, s) for k, s in terms if k)
        if target is None or len(known) < len(terms):
            out.append(Relation(name, target or "", known, "unresolved_terms"))
        elif len({k for k, _ in known}) < len(known):
            out.append(Relation(name, target, known, "repeated_term"))
        else:
            out.append(Relation(name, target, known))
    return tuple(out)


def section_members(concepts: DataFrame) -> DataFrame:
    """section, key, part (subtotal, residual or dedicated), rank (of subtotals by rising priority) of a rulebook's concepts: key, section, unit_of_account, value_scope, priority, place."""
    from pyspark.sql import Window

    part = F.when(F.col("unit_of_account") == "subtotal", "subtotal").when(F.col("value_scope") == "exclusive_residual", "residual").otherwise("dedicated")
    rows = concepts.where("section is not null").withColumn("part", part)
    order = F.row_number().over(Window.partitionBy("section", "part").orderBy(F.coalesce("priority", F.lit(0)), "place"))
    return rows.select("section", "key", "part", order.alias("rank"))


def reconcile_sections(figures: DataFrame, members: DataFrame, components: DataFrame, unit: float = 1.0, per_row: bool = True) -> DataFrame:
    """section, slot, subtotal, reported, dedicated, residual, rows, tolerance, difference, status of every section a slot has figures of.

    The subtotal is that of the highest rank that is printed. What it lacks of the dedicated figures and of the residual's swept components is the
    difference, which a rounding unit for each row that takes part may explain. figures: CELL, canonical_key, figure. components: CELL, section, value.
    """
    f = figures.where("figure is not null").join(F.broadcast(members.withColumnRenamed("key", "canonical_key")), "canonical_key")
    v = F.col("figure").cast("double")
    sums = f.groupBy(*CELL, "section").agg(
        F.max_by(F.struct(F.col("canonical_key").alias("key"), v.alias("v")), F.when(F.col("part") == "subtotal", F.col("rank"))).alias("s"),
        F.sum(F.when(F.col("part") == "dedicated", v)).alias("dedicated"), F.count_if(F.col("part") == "dedicated").alias("n"),
    )
    swept = components.groupBy(*CELL, "section").agg(F.sum(F.col("value").cast("double")).alias("residual"), F.count("*").alias("c"))
    rows = sums.join(swept, [*CELL, "section"], "full_outer")
    n = F.coalesce("n", F.lit(0)) + F.coalesce("c", F.lit(0)) + F.when(F.col("s.key").isNotNull(), 1).otherwise(0)
    rows = rows.withColumn("rows", n).withColumn("tolerance", F.col("rows") * unit if per_row else F.lit(unit))
    gap = F.col("s.v") - F.coalesce("dedicated", F.lit(0.0)) - F.coalesce("residual", F.lit(0.0))
    status = F.when(F.col("s.key").isNull(), "no_reported_subtotal").when(F.abs(gap) <= F.col("tolerance"), "tied").otherwise("unallocated_gap")
    return rows.select(*CELL, "section", F.col("s.key").alias("subtotal"), F.col("s.v").alias("reported"), "dedicated", "residual", "rows", "tolerance", gap.alias("difference"), status.alias("status"))


def section_relations(nodes: DataFrame) -> DataFrame:
    """section, target, members, broken: a relation for each section of a template: its last sum in printed order against its other lines that are no headers.

    nodes: section, place, key (null for headings), role.
    """
    sums = F.col("role").isin(*SUMS)
    closing = F.max_by(F.when(sums, F.col("key")), F.when(sums, F.col("place")))
    lines = F.array_sort(F.collect_list(F.when(~sums & (F.col("role") != "header"), F.struct("place", "key"))))
    made = nodes.where("key is not null").groupBy("section").agg(closing.alias("target"), lines.alias("l"))
    return made.where(F.size("l") > 0).select("section", "target", F.transform("l", lambda x: x["key"]).alias("members"), F.when(F.col("target").isNull(), "no_reported_subtotal").alias("broken"))


def cap_validation(facts: DataFrame, results: DataFrame) -> DataFrame:
    """``facts`` with validation capped and flags: figures that took part in a failed blocking relation, or are of a section that failed.

    facts: CELL, canonical_key, validation (null: none yet). results: CELL, keys (array), status, severity, section (its relation's, or null).
    """
    failed = results.where("status = 'fail'")
    took = failed.select(*CELL, F.explode("keys").alias("canonical_key"), F.when(F.col("severity") == "blocking", 2).otherwise(1).alias("w"))
    took = took.groupBy(*CELL, "canonical_key").agg(F.max("w").alias("_w"))
    shut = failed.where("section is not null").select("doc_id", F.explode("keys").alias("canonical_key")).distinct().withColumn("_s", F.lit(True))
    rows = facts.join(took, [*CELL, "canonical_key"], "left").join(shut, ["doc_id", "canonical_key"], "left")
    hit = F.coalesce(F.col("_w") == 2, F.lit(False)) | F.coalesce("_s", F.lit(False))
    flags = F.concat_ws(",", F.when(F.col("_s"), "section_unreconciled"), F.when(hit, "structural_mismatch"), F.when(~hit & (F.col("_w") == 1), "structural_warning"))
    return rows.withColumn("validation", F.when(hit, F.least(F.lit(CAP), F.coalesce("validation", F.lit(1.0)))).otherwise(F.col("validation"))).withColumn("flags", flags).drop("_w", "_s")


def explained(grid: DataFrame, ratio: str, sides: tuple) -> DataFrame:
    """doc_id, basis, period_label, ratio_key, side, key, sign, figure: what a ratio was made of; of a term's keys the first that has a figure, missing ones as null."""
    has = set(grid.columns)
    items = []
    for side, terms in zip(("numerator", "denominator"), sides, strict=True):
        for keys, sign, _ in terms:
            there = [k for k in keys if k in has]
            first = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in there], F.lit(keys[0])) if there else F.lit(keys[0])
            value = F.coalesce(*[F.col(k).cast("double") for k in there]) if there else F.lit(None).cast("double")
            items.append(F.struct(F.lit(ratio).alias("ratio_key"), F.lit(side).alias("side"), first.alias("key"), F.lit(sign).alias("sign"), value.alias("figure")))
    return grid.select(*CELL, F.inline(F.array(*items)))


def review_cards(failures: DataFrame, asserted: DataFrame) -> DataFrame:
    """Failed relations (doc_id, target, slot, difference) that no card asserts already with the same difference."""
    same = ["doc_id", "target", "slot", "_d"]
    mark = lambda df: df.withColumn("_d", F.round("difference", 2))
    return mark(failures).join(mark(asserted).select(*same).distinct(), same, "left_anti").drop("_d")


def leftovers(facts: DataFrame, declared: tuple[str, ...], basis: str) -> DataFrame:
    """Lines of a basis with a figure that reach no key that the template shows on a face, outside matrices. facts: matrix (boolean)."""
    there = F.coalesce(F.col("canonical_key").isin(*declared), F.lit(False))
    return facts.where((F.coalesce("basis", F.lit("consolidated")) == basis) & F.col("value").isNotNull() & ~there & ~F.col("matrix"))
