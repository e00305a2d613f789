"""What people change: rates, page selections, settings, filings of single rows. Everything is appended; the newest word counts."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_rate(base: Column, quote: Column, rate: Column) -> Column:
    """Why a rate can't be taken: codes of three capitals, apart from each other, and a positive finite rate; null if it can."""
    code = lambda c: F.coalesce(F.trim(c).rlike("^[A-Z]{3}$"), F.lit(False))
    number = rate.try_cast("double")
    ok = number.isNotNull() & ~F.isnan(number) & (number > 0) & (number < float("inf"))
    return F.when(~code(base) | ~code(quote), "bad_code").when(F.trim(base) == F.trim(quote), "same_currency").when(~F.coalesce(ok, F.lit(False)), "bad_rate")


def rate_master(changes: DataFrame) -> DataFrame:
    """base, quote, as_of, rate, changes: the newest valid word on each pair and day; one that was withdrawn last is gone.

    changes: base, quote, as_of, rate (text), action (put or delete), at, id.
    """
    rows = changes.where((F.col("action") == "delete") | valid_rate(F.col("base"), F.col("quote"), F.col("rate")).isNull())
    last = rows.groupBy("base", "quote", "as_of").agg(F.max_by(F.struct("action", "rate"), F.struct("at", "id")).alias("r"), F.count("*").alias("changes"))
    return last.where("r.action = 'put'").select("base", "quote", "as_of", F.col("r.rate").cast("double").alias("rate"), "changes")


def selected_pages(pages: DataFrame, choices: DataFrame) -> DataFrame:
    """doc_id, page_index, included: the newest choice of a document (an array of pages), else its faces and notes; a choice that names no page of it counts as none.

    pages: doc_id, page_index, kind. choices: doc_id, chosen, at.
    """
    newest = choices.groupBy("doc_id").agg(F.max_by("chosen", "at").alias("_c"))
    rows = pages.join(newest, "doc_id", "left")
    hit = F.coalesce(F.array_contains("_c", F.col("page_index")), F.lit(False))
    named = F.max(hit).over(Window.partitionBy("doc_id"))
    return rows.select("doc_id", "page_index", F.when(named, hit).otherwise(F.col("kind").isin("FACE", "NOTES")).alias("included"))


def scope_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if("included").alias("focused"), F.count_if(~F.col("included")).alias("skipped"))


def refile(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """``rows`` with the concept of the newest order for their anchor; an order whose anchor is of several rows of its document, or of none, changes nothing and says why.

    rows: doc_id, line, anchor, canonical_key. orders: doc_id, anchor, to_key, at. Returns line's key and outcome (null, refiled, ambiguous).
    """
    newest = orders.groupBy("doc_id", "anchor").agg(F.max_by("to_key", "at").alias("_to"))
    found = rows.join(newest, ["doc_id", "anchor"], "left")
    one = F.count("*").over(Window.partitionBy("doc_id", "anchor")) == 1
    outcome = F.when(F.col("_to").isNotNull(), F.when(one, "refiled").otherwise("ambiguous"))
    return found.withColumn("outcome", outcome).withColumn("canonical_key", F.when(F.col("outcome") == "refiled", F.col("_to")).otherwise(F.col("canonical_key"))).drop("_to")


def unplaced(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Orders whose anchor no row has."""
    return orders.join(rows.select("doc_id", "anchor").distinct(), ["doc_id", "anchor"], "left_anti")


def anchor(page: Column, x0: Column, y0: Column, grid: float = 0.01) -> Column:
    """Where a caption stands, snapped to a grid, so that a second reading finds it again."""
    return F.concat_ws(":", page.cast("string"), F.floor(x0 / grid).cast("string"), F.floor(y0 / grid).cast("string"))


#: Judgements from the most to the least pressing.
RANKS = ("conflict", "stale", "open", "accepted")


def rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, RANKS)), status)


@dataclass(frozen=True)
class Settings:
    """What an extraction may be told, each within its range."""

    auto_accept_confidence: float = 0.85
    mapping_margin: float = 0.1
    evidence_floor: float = 0.55
    alias_coverage_floor: float = 0.6
    candidate_cap: int = 40
    subset_size: int = 3
    subset_candidates: int = 14
    subsets_offered: int = 8
    header_top: float = 0.4
    wrapped_lines: int = 3


RANGES = {
    "auto_accept_confidence": (0.0, 1.0), "mapping_margin": (0.0, 1.0), "evidence_floor": (0.0, 1.0), "alias_coverage_floor": (0.0, 1.0), "candidate_cap": (1, 500), "subset_size": (1, 3),
    "subset_candidates": (1, 14), "subsets_offered": (1, 50), "header_top": (0.1, 1.0), "wrapped_lines": (0, 10),
}


def with_settings(base: Settings, changes: dict) -> Settings:
    """Settings with some changed; an unknown name, another type or a value out of range is an error and changes nothing."""
    kinds = {f.name: type(getattr(base, f.name)) for f in fields(base)}
    for name, value in changes.items():
        if name not in kinds or isinstance(value, bool) or not isinstance(value, kinds[name] | (int if kinds[name] is float else kinds[name])):
            raise ValueError(f"no setting {name}={value!r}")
        low, high = RANGES[name]
        if not low <= value <= high:
            raise ValueError(f"{name} has to lie between {low} and {high}")
    return replace(base, **{k: kinds[k](v) for k, v in changes.items()})
