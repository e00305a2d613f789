"""Rule artefacts as data: validation, versions, changes, similarity of captions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """problem, key: keys given twice, children that no node has, nodes that are their own child. nodes: key; edges: parent, child."""
    twice = nodes.groupBy("key").count().where("count > 1").select(F.lit("duplicate_key").alias("problem"), "key")
    dangling = edges.join(nodes.select(F.col("key").alias("child")).distinct(), "child", "left_anti").select(F.lit("unknown_child").alias("problem"), F.col("child").alias("key"))
    own = edges.where("parent = child").select(F.lit("self_child").alias("problem"), F.col("parent").alias("key"))
    return twice.union(dangling).union(own).distinct()


def changed_keys(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose value differs or that one side lacks."""
    j = stored.withColumnRenamed("value", "_old").join(current.withColumnRenamed("value", "_new"), keys, "full_outer")
    return j.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(*keys)


def with_latest(versions: DataFrame, keys: list[str], order: str) -> DataFrame:
    newest = F.max(order).over(Window.partitionBy(*keys))
    return versions.withColumn("is_latest", F.col(order) == newest)


def _ratio(a: str, b: str) -> float:
    """100 * (1 - insertions and deletions / letters of both)."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def similarity(caption: str | None, alias: str | None) -> float:
    """Likeness of the sorted words, times 0.4 + 0.6 of the share of the alias's words that the caption has (by a ratio of 80)."""
    a, b = (caption or "").split(), (alias or "").split()
    if not a or not b:
        return 0.0
    covered = sum(any(_ratio(x, y) >= 80 for x in a) for y in b) / len(b)
    return _ratio(" ".join(sorted(a)), " ".join(sorted(b))) / 100 * (0.4 + 0.6 * covered)


def alias_similarity(caption: Column, alias: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run(caption, alias)
