"""Latest and as-of lookups, judgements, overlays of edits, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key by ``order``; an aggregation, so it combines before the shuffle and needs no sort."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in (*order, *rest)])


def resolve_rates(rates: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (base, quote) with the newest direct rate, else the inverse of the newest opposite one, else null. No third currency."""
    best = latest(rates.where("rate > 0"), ["base", "quote"], "as_of", "created_at", "id")
    direct = best.select("base", "quote", F.col("rate").alias("d"), F.col("as_of").alias("d_at"))
    inverse = best.select(F.col("quote").alias("base"), F.col("base").alias("quote"), F.col("rate").alias("i"), F.col("as_of").alias("i_at"))
    joined = wanted.join(direct, ["base", "quote"], "left").join(inverse, ["base", "quote"], "left")
    how = F.when(F.col("d").isNotNull(), "direct").when(F.col("i").isNotNull(), "inverse").otherwise("missing")
    return joined.select("base", "quote", F.coalesce("d", F.try_divide(F.lit(1.0), F.col("i"))).alias("rate"), F.coalesce("d_at", "i_at").alias("as_of"), how.alias("how"))


def digest(*cols: Column) -> Column:
    """SHA-256 of the values as a JSON object, so that no two lists of values are written alike."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"v{i:03d}") for i, c in enumerate(cols)]), {"ignoreNullFields": "false"}), 256)


def judgement_status(findings: DataFrame, judgements: DataFrame) -> DataFrame:
    """findings (subject_key, digest) against judgements (subject_key, judged): accepted, stale, open; conflict if a subject has several digests."""
    many = Window.partitionBy("subject_key")
    rows = findings.join(judgements, "subject_key", "left")
    clash = F.min("digest").over(many) != F.max("digest").over(many)
    status = F.when(clash, "conflict").when(F.col("judged").isNull(), "open").when(F.col("judged") == F.col("digest"), "accepted").otherwise("stale")
    return rows.withColumn("status", status)


def orphaned(findings: DataFrame, judgements: DataFrame) -> DataFrame:
    return judgements.join(findings, "subject_key", "left_anti")


def overlay(cells: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """cells with the newest edit of each slot in place: figure, edited. A withdrawn edit (null value, revert true) gives the original back."""
    newest = latest(edits, keys, "edited_at").select(*keys, F.col("new_value"), F.col("revert"))
    rows = cells.join(newest, keys, "left")
    live = F.col("new_value").isNotNull() & ~F.coalesce("revert", F.lit(False))
    return rows.withColumn("edited", live).withColumn("figure", F.when(live, F.col("new_value")).otherwise(F.col("figure"))).drop("new_value", "revert")


def next_versions(stored: DataFrame, published: DataFrame) -> DataFrame:
    """Published definitions (name, definition) that differ from the newest stored one, with the next version number."""
    newest = latest(stored, ["name"], "version").select("name", F.col("version").alias("_v"), F.col("definition").alias("_old"))
    rows = published.join(newest, "name", "left")
    return rows.where(F.col("_old").isNull() | (digest(F.col("_old")) != digest(F.col("definition")))).select("name", (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "definition")
