"""Sentences and review queues out of figures: movements, strengths and weaknesses, derived indicators."""

from __future__ import annotations

import re
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from tallyspark.functions import numbers

#: (ratio, good from, weak below): what a ratio says; a bound of None says nothing.
TONES = (("current_ratio", 1.5, 1.0), ("equity_ratio", 0.4, None), ("interest_coverage", 4.0, 2.0), ("net_margin", 10.0, None), ("cash_ratio", 0.3, None), ("asset_turnover", 0.5, None))


def commentary(ratio_rows: DataFrame, tones=TONES) -> DataFrame:
    """doc_id, slot, strengths, weaknesses (names in order), score: the share of judged ratios that are strengths, null without any."""
    good = bad = F.lit(False)
    for key, high, low in tones:
        here = F.col("ratio_key") == key
        good = good | (here & (F.col("ratio") >= high))
        bad = bad | (here & (F.col("ratio") < (high if low is None else low)))
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("ratio_key")))), ",")
    judged = F.count_if(F.coalesce(good | bad, F.lit(False)))
    return ratio_rows.groupBy("doc_id", "basis", "period_label").agg(names(good).alias("strengths"), names(bad).alias("weaknesses"), F.try_divide(F.count_if(F.coalesce(good, F.lit(False))), judged).alias("score"))


def movement_notes(pairs: DataFrame, label: str) -> DataFrame:
    """``pairs`` (current, prior) as sentences; the percentage is of the prior figure's size, and left out where that is 0."""
    c, p = F.col("current").cast("double"), F.col("prior").cast("double")
    verb = F.when(c > p, "rose").when(c < p, "fell").otherwise("was unchanged")
    share = F.try_divide(F.abs(c - p), F.abs(p)) * 100
    text = F.when(c == p, F.concat(label, F.lit(" was unchanged"))).otherwise(F.concat(label, F.lit(" "), verb, F.lit(" by "), F.format_string("%.0f", F.abs(c - p)), F.coalesce(F.format_string(" (%.0f%%)", F.round(share)), F.lit(""))))
    return pairs.where(c.isNotNull() & p.isNotNull()).withColumn("sentence", text)


def indicators(grid: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """``grid`` with a column for each formula, which may use columns and other indicators; a circle or an unknown name is refused."""
    names = {k: set(re.findall(r"[a-z_][a-z0-9_]*", f)) for k, f in formulas.items()}
    for k, used in names.items():
        if missing := used - set(formulas) - set(grid.columns):
            raise ValueError(f"{k}: unknown {sorted(missing)}")
    order = TopologicalSorter({k: used & set(formulas) for k, used in names.items()}).static_order()
    for k in order:
        grid = grid.withColumn(k, numbers.formula(formulas[k]))
    return grid


#: The order in which reasons not to check a relation are looked for.
LADDER = ("broken", "statement_absent", "unsupported_op", "derived_input", "target_missing", "all_missing", "components_missing", "mixed_scale")


def check_relations(figures: DataFrame, terms: DataFrame, rules: DataFrame, absolute: float = 1.0, relative: float = 0.001) -> DataFrame:
    """rule, doc_id, slot, status, reason, expected, actual: relations that are data, checked for every slot of a document that has figures.

    figures: doc_id, slot, key, figure, scale, derived. terms: rule, key, sign (0 is the target), place (the order in which a rule's terms are
    added, by key where there is none; sums of doubles depend on it). rules: rule, statement, op, broken, nil (missing parts are nil). A relation
    is skipped for the first reason of LADDER that holds. rules and terms are rulebook data: they are broadcast, and figures take one shuffle, by slot.
    """
    slot = ["doc_id", "basis", "period_label"]
    kind = figures.schema["figure"].dataType
    exact = f"decimal(38,{kind.scale})" if isinstance(kind, DecimalType) else "double"
    if "place" not in terms.columns:
        terms = terms.withColumn("place", F.lit(0))
    book = rules.join(terms.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("place", "key", "sign"))).alias("_terms"), F.count_if(F.col("sign") != 0).alias("_parts")), "rule", "left")
    slots = figures.groupBy(*slot).agg(F.array_sort(F.collect_list(F.struct("key", "figure", "scale", "derived"))).alias("_figures"))
    of_term = lambda t: F.transform(F.filter("_figures", lambda f: f["key"] == t["key"]), lambda f: F.struct(t["key"].alias("key"), t["sign"].alias("sign"), f["figure"].alias("figure"), f["scale"].alias("scale"), f["derived"].alias("derived")))
    every = slots.crossJoin(F.broadcast(book)).withColumn("_hits", F.coalesce(F.flatten(F.transform("_terms", of_term)), F.array()))
    every = every.withColumns({"_target": F.filter("_hits", lambda h: (h["sign"] == 0) & h["figure"].isNotNull()), "_added": F.filter("_hits", lambda h: (h["sign"] != 0) & h["figure"].isNotNull())})
    total = lambda c, by: F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast(exact), lambda s, h: (s + by(h)).cast(exact)))
    distinct = lambda c, name: F.size(F.array_distinct(F.filter(F.transform(c, lambda h: h[name]), lambda v: v.isNotNull())))
    every = every.select(
        "rule", *slot, "statement", "op", "broken", "nil", F.coalesce("_parts", F.lit(0)).alias("_parts"), F.transform("_figures", lambda f: F.substring_index(f["key"], "_", 1)).alias("_have"),
        total("_target", lambda h: h["figure"]).alias("actual"), total("_added", lambda h: h["figure"] * h["sign"]).alias("expected"),
        distinct("_added", "key").alias("_got"), distinct("_hits", "scale").alias("_scales"), F.exists("_hits", lambda h: h["derived"]).alias("_derived"),
    )
    got = F.col("_got")
    tests = (
        F.col("broken"), ~F.array_contains("_have", F.col("statement")), ~F.col("op").isin("sum", "diff"), F.coalesce("_derived", F.lit(False)), F.col("actual").isNull(), got == 0,
        (got < F.col("_parts")) & ~F.col("nil"), F.col("_scales") > 1,
    )
    reason = F.coalesce(*[F.when(t, name) for t, name in zip(tests, LADDER, strict=True)])
    ok = F.abs(F.col("actual") - F.col("expected")) <= F.greatest(F.lit(absolute), F.abs("expected") * relative)
    rows = every.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "broken", "error").when(F.col("reason").isNotNull(), "skipped").when(ok, "pass").otherwise("fail"))
    return rows.select("rule", *slot, "status", "reason", "expected", "actual")
