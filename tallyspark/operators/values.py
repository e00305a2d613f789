"""Figures of concepts: what may be added, which basis and which period is meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import caption_key

CELL = ["doc_id", "canonical_key", "basis", "period_label"]


def mark_summable(facts: DataFrame, amount: str = "value") -> DataFrame:
    """``facts`` with keep: false where the same caption and amount was printed before on another page.

    The page compared with is the first one seen; a row without a page always counts. Rows are in ``ordinal`` order.
    """
    w = Window.partitionBy(*CELL, caption_key(F.col("source_label")), amount).orderBy("ordinal")
    first = F.first("page_index").over(w)
    keep = (F.row_number().over(w) == 1) | F.col("page_index").isNull() | first.eqNullSafe(F.col("page_index"))
    return facts.withColumn("keep", F.col(amount).isNotNull() & keep)


def concept_figures(facts: DataFrame, amount: str = "value", arranged: bool = False) -> DataFrame:
    """The figure of every cell, and how many rows don't add to it: figure, duplicates, edited.

    An edited row's figure (the first one's) replaces the printed ones; else the rows that count are summed (mark_summable() says which),
    null if there are none. Three aggregations of one partitioning, without a sort. facts: place orders the rows of a document.
    arranged: the facts are partitioned by cell already (store_facts()), so that nothing is shuffled.
    """
    known = facts.where(F.col(amount).isNotNull()).withColumn("caption", caption_key(F.col("source_label")))
    same = [*CELL, "caption", amount]
    pages = (known if arranged else known.repartition(*CELL)).groupBy(*same, "page_index").agg(F.count("*").alias("n"), F.min("place").alias("at"), F.min(F.when(F.col("edited"), F.col("place"))).alias("edited_at"))
    apart = F.sum(F.when(F.col("page_index").isNull(), F.col("n")))
    first = F.min_by(F.struct("page_index", "n"), "at")
    counted = F.when(first["page_index"].isNull(), apart).otherwise(first["n"] + F.coalesce(apart, F.lit(0)))
    facts_once = pages.groupBy(*same).agg(counted.alias("counted"), F.sum("n").alias("n"), F.min("edited_at").alias("edited_at"))
    typed = F.min_by(F.when(F.col("edited_at").isNotNull(), F.col(amount)), "edited_at")
    total = F.sum(F.col(amount) * F.col("counted"))
    return facts_once.groupBy(*CELL).agg(F.coalesce(typed, total).alias("figure"), F.sum(F.col("n") - F.col("counted")).alias("duplicates"), F.max(F.col("edited_at").isNotNull()).alias("edited"))


def grid_of(figures: DataFrame, keys: tuple[str, ...], value: str = "figure") -> DataFrame:
    """A row for each document, basis and period, a column for each concept."""
    return figures.groupBy("doc_id", "basis", "period_label").agg(*[F.max(F.when(F.col("canonical_key") == k, F.col(value))).alias(k) for k in keys])


def concept_grid(facts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The figures of some concepts as a grid."""
    return grid_of(concept_figures(facts.where(F.col("canonical_key").isin(*keys))), keys)


def current_prior(figures: DataFrame, value: str = "figure") -> DataFrame:
    """Current and prior figures: a named period wins; columns count by place only if no value names a period."""
    by = lambda name: F.max(F.when(F.col("period_label") == name, F.col(value)))
    named = F.max(F.col("period_label").isin("current", "prior"))
    return figures.groupBy("doc_id", "canonical_key", "basis").agg(
        F.when(named, by("current")).otherwise(by("col2")).alias("current"), F.when(named, by("prior")).otherwise(by("col3")).alias("prior")
    )


def bases_present(facts: DataFrame) -> DataFrame:
    return facts.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.coalesce("basis", F.lit("consolidated")))).alias("bases"))


def effective_basis(bases: Column, wanted: str) -> Column:
    """A wish for consolidated figures falls back on the only other basis; never the other way round."""
    return F.when(F.array_contains(bases, wanted), F.lit(wanted)).when((F.lit(wanted) == "consolidated") & (F.size(bases) == 1), bases[0]).otherwise(F.lit(wanted))
