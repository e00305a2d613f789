"""Rollups over a grid of concepts, as column expressions in dependency order: no shuffle of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_order(rollups) -> tuple[list, set[str]]:
    """Rollups sorted so that children come first, and the keys of those in a cycle, which aren't computed."""
    waiting, done, out = {r[0]: r for r in rollups}, set(), []
    while True:
        ready = [r for k, r in waiting.items() if not any(c in waiting for c in r[2])]
        if not ready:
            return out, set(waiting)
        for r in ready:
            out.append(r)
            done.add(waiting.pop(r[0])[0])


def combined(op: str, children: list[Column]) -> Column:
    """Missing children are skipped; null if all are missing. diff takes the others from the first."""
    zero = F.lit(0).cast("decimal(38,4)")
    parts = [F.coalesce(c, zero) for c in children]
    out = parts[0]
    for p in parts[1:]:
        out = out + p if op == "sum" else out - p
    return F.when(F.coalesce(*children).isNotNull(), out.cast("decimal(38,4)"))


def evaluate(grid: DataFrame, rollups, overrides: dict[str, Column] | None = None) -> DataFrame:
    """``grid`` with a column for each rollup: an override wins over the computed figure, which wins over a printed one."""
    order, cyclic = in_order(rollups)
    for key, op, children in order:
        have = [F.col(c) for c in children if c in grid.columns and c not in cyclic]
        if have:
            value = combined(op, have)
            if overrides and key in overrides:
                value = F.coalesce(overrides[key].cast("decimal(38,4)"), value)
            grid = grid.withColumn(key, F.coalesce(value, F.col(key)) if key in grid.columns else value)
    return grid


def expressions(have: dict[str, Column], rollups) -> dict[str, Column]:
    """``have`` with an expression for each rollup, over those of its children."""
    out, (order, cyclic) = dict(have), in_order(rollups)
    for key, op, children in order:
        parts = [out[c] for c in children if c in out and c not in cyclic]
        if parts:
            out[key] = F.coalesce(combined(op, parts), out[key]) if key in out else combined(op, parts)
    return out


def long_form(grid: DataFrame, keys, name: str = "figure") -> DataFrame:
    """doc_id, basis, period_label, canonical_key, figure of the keys that have one."""
    items = F.array(*[F.struct(F.lit(k).alias("canonical_key"), F.col(k).alias(name)) for k in keys])
    return grid.select("doc_id", "basis", "period_label", F.inline(items)).where(F.col(name).isNotNull())
