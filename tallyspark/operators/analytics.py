"""Ratios, credit stance, trends, netting and the search for gaps."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _side(terms, present) -> Column:
    """The signed sum; null if a required input is missing, or all are; a missing optional one is 0.

    A term's key may be several, of which the first that has a figure counts. Keys that the grid lacks are missing.
    """
    values, required = [], []
    for keys, sign, optional in terms:
        cols = [F.col(k).cast("double") for k in ((keys,) if isinstance(keys, str) else keys) if k in present]
        c = F.coalesce(*cols) if cols else F.lit(None).cast("double")
        values.append((c, sign))
        if not optional:
            required.append(c.isNotNull())
    out = F.coalesce(values[0][0], F.lit(0.0)) * values[0][1]
    for c, sign in values[1:]:
        out = out + F.coalesce(c, F.lit(0.0)) * sign
    known = F.coalesce(*[c for c, _ in values]).isNotNull()
    for r in required:
        known = known & r
    return F.when(known, out)


def ratios(grid: DataFrame, catalogue) -> DataFrame:
    """doc_id, basis, period_label, ratio_key, ratio of a grid that has the rollups."""
    has = set(grid.columns)
    items = [F.struct(F.lit(k).alias("ratio_key"), (F.try_divide(_side(num, has), _side(den, has)) * unit).alias("ratio")) for k, unit, num, den in catalogue]
    return grid.select("doc_id", "basis", "period_label", F.inline(F.array(*items)))


def cash_conversion_cycle(ratio_rows: DataFrame) -> DataFrame:
    """Days of sales and of inventory less days of payables, where all three are known."""
    day = lambda k: F.max(F.when(F.col("ratio_key") == k, F.col("ratio")))
    return ratio_rows.groupBy("doc_id", "basis", "period_label").agg((day("dso") + day("dio") - day("dpo")).alias("ccc"))


def credit_factors(ratio_rows: DataFrame, factors) -> DataFrame:
    """doc_id, basis, period_label, category, ratio_key, ratio, tone (1 strong, 0 adequate, -1 weak): of each category the first ratio that is known.

    factors: category to (ratio, whether more is better, strong bound, weak bound) in order of preference. Ratios are judged as shown, to 2 places.
    """
    ranked = [(c, i, *f) for c, fs in factors.items() for i, f in enumerate(fs)]
    table = ratio_rows.sparkSession.createDataFrame(ranked, "category string, rank int, ratio_key string, more boolean, strong double, weak double")
    r = F.round("ratio", 2)
    up = F.when(r >= F.col("strong"), 1).when(r < F.col("weak"), -1).otherwise(0)
    down = F.when(r <= F.col("strong"), 1).when(r > F.col("weak"), -1).otherwise(0)
    rows = ratio_rows.where("ratio is not null").join(F.broadcast(table), "ratio_key").withColumn("tone", F.when(F.col("more"), up).otherwise(down))
    first = rows.groupBy("doc_id", "basis", "period_label", "category").agg(F.min_by(F.struct("ratio_key", r.alias("ratio"), "tone"), "rank").alias("f"))
    return first.select("doc_id", "basis", "period_label", "category", "f.ratio_key", "f.ratio", "f.tone")


def credit_stance(slots: DataFrame, factors: DataFrame, signals: DataFrame | None = None, weights: dict[str, int] | None = None) -> DataFrame:
    """slots (doc_id, basis, period_label) with factors, supportive, constraining, flags and stance.

    signals: doc_id, family of disclosures found. Doubt of a going concern makes a view weak; a qualified audit, or signals of weight 3 and more, make a strong one adequate.
    """
    keys = ["doc_id", "basis", "period_label"]
    sums = factors.groupBy(*keys).agg(F.count("*").alias("factors"), F.avg("tone").alias("average"), F.count_if(F.col("tone") > 0).alias("supportive"), F.count_if(F.col("tone") < 0).alias("constraining"))
    rows = slots.join(sums, keys, "left").na.fill(0, ["factors", "supportive", "constraining"])
    if signals is None:
        rows = rows.withColumn("flags", F.array().cast("array<string>"))
    else:
        known = signals.where(F.col("family").isin(*weights)).groupBy("doc_id").agg(F.array_sort(F.collect_set("family")).alias("flags"))
        rows = rows.join(known, "doc_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    penalty = functools.reduce(lambda a, b: a + b, [F.array_contains("flags", k).cast("int") * w for k, w in (weights or {"": 0}).items()])
    plain = F.when(F.col("average") >= 0.5, "strong").when(F.col("average") >= -0.25, "adequate").otherwise("weak")
    capped = F.array_contains("flags", "auditor_qualification") | (penalty >= 3)
    stance = F.when(F.col("factors") == 0, "insufficient").when(F.array_contains("flags", "going_concern"), "weak").when(capped & (plain == "strong"), "adequate").otherwise(plain)
    return rows.select(*keys, "factors", "supportive", "constraining", F.array_join("flags", ",").alias("flags"), stance.alias("stance"))


def trends(current_prior: DataFrame) -> DataFrame:
    """Movement of a concept: amount and percent of the signed prior figure; 0 where that is 0 or a figure is missing."""
    c, p = F.col("current").cast("double"), F.col("prior").cast("double")
    return current_prior.select(
        "doc_id", "basis", "canonical_key", (c - p).alias("change"), F.coalesce(F.try_divide(c - p, p) * 100, F.lit(0.0)).alias("percent"),
        F.when(c > p, "up").when(c < p, "down").when(c == p, "flat").otherwise("unknown").alias("direction"),
    )


def netting(grid: DataFrame, target: str, minus: tuple[str, ...]) -> DataFrame:
    """target less those of ``minus`` that are present, and the formula that was used."""
    out, used = F.col(target).cast("double"), []
    for k in minus:
        out = out - F.coalesce(F.col(k).cast("double"), F.lit(0.0))
        used.append(F.when(F.col(k).isNotNull(), F.lit(k)))
    rows = grid.where(F.col(target).isNotNull())
    return rows.select("doc_id", "basis", "period_label", out.alias("net"), F.concat_ws(" - ", F.lit(target), *used).alias("formula"))


def find_gaps(printed: DataFrame, computed: DataFrame, sections, tol: float = 0.5) -> DataFrame:
    """Subtotals whose printed current figure differs from the computed one, where their section has a line of others.

    printed, computed: doc_id, basis, period_label, canonical_key, figure; computed has calculated lines only. sections: the
    keys of each section. doc_id, basis, target_key, others_key, gap, prior_gap; that is null if a prior figure is missing.
    """
    others = {}
    for keys in sections:
        for k in keys:
            bucket = k.partition("__")[0] + "__others"
            if "__" in k and bucket in keys:
                others.setdefault(k, bucket)
    both = printed.withColumn("side", F.lit("p")).unionByName(computed.withColumn("side", F.lit("c"))).where(F.col("canonical_key").isin(*others))
    at = lambda side, period: F.sum(F.when((F.col("side") == side) & (F.col("period_label") == period), F.col("figure").cast("double")))
    slots = both.groupBy("doc_id", "basis", F.col("canonical_key").alias("target_key")).agg(
        (at("p", "current") - at("c", "current")).alias("gap"), (at("p", "prior") - at("c", "prior")).alias("prior_gap")
    )
    bucket = F.element_at(F.create_map(*[F.lit(x) for pair in others.items() for x in pair]), F.col("target_key")) if others else F.lit(None).cast("string")
    return slots.where(F.abs("gap") > tol).select("doc_id", "basis", "target_key", bucket.alias("others_key"), "gap", "prior_gap")


def gap_subsets(gaps: DataFrame, leftovers: DataFrame, tol: float = 0.5, first: int = 14, most: int = 3, offered: int = 8, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Sets of at most three of a document's first leftovers that close its gap: smaller sets first, then in printed order, eight a gap.

    The bounds are the feature. gaps: ``by``, gap, and prior_gap if known. leftovers: ``by``, pos, amount, and prior if known. Where
    the prior gap counts, a set has to close it too, with no prior amount missing. Candidates are an array of at most
    ``first`` structs beside the gap, so a document's sets are made in its own row and no rows are paired.
    """
    null = F.lit(None).cast("double")
    prior = F.col("prior") if "prior" in leftovers.columns else null
    place = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    pool = leftovers.select(*by, "pos", F.coalesce("amount", F.lit(0)).alias("amount"), prior.alias("prior")).withColumn("place", place).where(F.col("place") <= first)
    some = pool.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "amount", "prior"))).alias("c"))
    sets = (
        "concat(transform(c, a -> struct(1 as n, array(a.pos) as members, a.amount as total, a.prior as prior)), "
        "flatten(transform(c, a -> transform(filter(c, b -> b.pos > a.pos), b -> struct(2 as n, array(a.pos, b.pos) as members, a.amount + b.amount as total, a.prior + b.prior as prior)))), "
        "flatten(transform(c, a -> flatten(transform(filter(c, b -> b.pos > a.pos), b -> transform(filter(c, d -> d.pos > b.pos), d -> struct(3 as n, array(a.pos, b.pos, d.pos) as members, a.amount + b.amount + d.amount as total, a.prior + b.prior + d.prior as prior)))))))"
    )
    both = f"(prior_gap is null or abs(prior_gap) <= {tol} or coalesce(abs(s.prior - prior_gap) <= {tol}, false))"
    closing = F.expr(f"filter({sets}, s -> s.n <= {most} and abs(s.total - gap) <= {tol} and {both})")
    known = gaps if "prior_gap" in gaps.columns else gaps.withColumn("prior_gap", null)
    ranked = known.where(F.abs("gap") > tol).join(some, list(by)).withColumn("s", F.slice(F.array_sort(closing), 1, offered))
    return ranked.select(*gaps.columns, F.posexplode("s").alias("rank", "s")).select(*gaps.columns, F.array_join(F.transform("s.members", lambda x: x.cast("string")), ",").alias("members"), (F.col("rank") + 1).alias("rank"))
