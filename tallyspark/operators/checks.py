"""Structural checks of statements: relations, guards, suspects of a wrong sign, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tolerance(expected: Column, absolute: float, relative: float) -> Column:
    return F.greatest(F.lit(absolute), F.abs(expected) * relative)


def check_relation(grid: DataFrame, rule: str, target: Column, terms: list[tuple[str, int]], absolute: float = 1.0, relative: float = 0.001) -> DataFrame:
    """A row a slot: target against the signed sum of terms. Skipped without the target or without all of the terms.

    suspect: the one term whose opposite sign would close the difference, if there is exactly one.
    """
    have = [F.col(k).cast("double") for k, _ in terms]
    expected = sum((F.coalesce(c, F.lit(0.0)) * s for c, (_, s) in zip(have[1:], terms[1:], strict=True)), F.coalesce(have[0], F.lit(0.0)) * terms[0][1])
    actual = target.cast("double")
    diff = actual - F.col("expected")
    tol = tolerance(F.col("expected"), absolute, relative)
    closes = [F.when((F.coalesce(c, F.lit(0.0)) != 0) & (F.abs(diff + 2 * s * c) <= tol), k) for c, (k, s) in zip(have, terms, strict=True)]
    status = F.when(F.col("actual").isNull(), "skipped").when(F.col("parts") == 0, "skipped").when(F.abs(F.col("difference")) <= F.col("tolerance"), "pass").otherwise("fail")
    reason = F.when(F.col("actual").isNull(), "target_missing").when(F.col("parts") == 0, "components_missing")
    rows = grid.withColumn("expected", expected).withColumn("actual", actual).withColumn("difference", diff).withColumn("tolerance", tol)
    rows = rows.withColumn("parts", sum((c.isNotNull().cast("int") for c in have[1:]), have[0].isNotNull().cast("int")))
    rows = rows.withColumn("_closes", F.array_compact(F.array(*closes)))
    return rows.select(
        "doc_id", "basis", "period_label", F.lit(rule).alias("rule_id"), status.alias("status"), reason.alias("reason"), "expected", "actual", "difference",
        F.when((status == "fail") & (F.size("_closes") == 1), F.col("_closes")[0]).alias("suspect"),
    )


def coverage(results: DataFrame, group: str = "rule_id") -> DataFrame:
    """Passes, failures and skips of each group and of ``__all__``, with rates and a status: one pass, by grouping sets."""
    counts = results.rollup(group).agg(
        F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "skipped").alias("skipped")
    )
    evaluated = F.col("passed") + F.col("failed")
    declarable = evaluated + F.col("skipped")
    rate = F.try_divide(evaluated, declarable)
    status = F.when(declarable == 0, "ABSENT").when(evaluated == 0, "UNVALIDATED").when(F.col("failed") > 0, "FAILED").when(rate == 1, "PASSED").otherwise("PARTIAL")
    return counts.select(
        F.coalesce(group, F.lit("__all__")).alias("scope"), "passed", "failed", "skipped",
        F.try_divide(F.col("passed"), evaluated).alias("validation_rate"), rate.alias("coverage_rate"), status.alias("status"),
    )


def guards(grid: DataFrame, a: str, b: str, c: str, eliminated: str | None = None) -> DataFrame:
    """Violations of guards between concepts: sign, mutual exclusion, equality, equality while a third isn't zero, and one that consolidation should have eliminated."""
    x, y, z = (F.col(k).cast("double") for k in (a, b, c))
    found = F.array_compact(F.array(
        F.when(x < 0, F.lit("sign_expectation")), F.when((x != 0) & (y != 0) & (z == 0), F.lit("mutually_exclusive")),
        F.when((x == y) & (x != 0), F.lit("equal_values")), F.when((x == y) & (z != 0), F.lit("equal_while_third_non_zero")),
        F.when((F.col("basis") == "consolidated") & (F.col(eliminated).cast("double") != 0), F.lit("consolidation_eliminated")) if eliminated else F.lit(None).cast("string"),
    ))
    return grid.select("doc_id", "basis", "period_label", F.explode(found).alias("guard"))


def unsigned_cohort(facts: DataFrame, keys: tuple[str, ...], least: int = 3) -> DataFrame:
    """Documents and bases where all non-zero figures of ``keys`` are positive, over at least ``least`` concepts."""
    some = facts.where(F.col("canonical_key").isin(*keys) & (F.col("value") != 0))
    return some.groupBy("doc_id", "basis").agg(F.bool_and(F.col("value") > 0).alias("all_positive"), F.count_distinct("canonical_key").alias("concepts")).where(
        F.col("all_positive") & (F.col("concepts") >= least)
    ).select("doc_id", "basis", "concepts")


#: What each reason not to check says of the rule or of the filing.
TAXONOMY = {
    "target_not_extracted": "INPUT_ABSENT", "target_missing": "INPUT_ABSENT", "components_not_mapped": "INPUT_ABSENT", "components_missing": "INPUT_ABSENT", "all_missing": "INPUT_ABSENT",
    "mixed_scale": "INPUT_ABSENT", "ambiguous_mapping": "INPUT_ABSENT", "precondition_absent": "INPUT_ABSENT", "derived_input": "TAUTOLOGICAL", "no_reported_subtotal": "NO_REPORTED_SUBTOTAL",
    "statement_absent": "STATEMENT_ABSENT", "broken": "UNEVALUABLE_RULE", "unsupported_op": "UNEVALUABLE_RULE", "unparsable_expr": "UNEVALUABLE_RULE", "unresolved_terms": "UNEVALUABLE_RULE",
    "repeated_term": "UNEVALUABLE_RULE", "guard_unrecognised": "UNEVALUABLE_RULE", "guard_components_unknown": "UNEVALUABLE_RULE",
}


def alarms(results: DataFrame) -> DataFrame:
    """code, scope, count: statements of which nothing was checked, scopes with more circular rules than checked ones, rules that can't run, and blocking ones among them.

    results: rule, statement, status, reason, severity. ``__all__`` is the scope of all statements together.
    """
    bucket = F.create_map(*[F.lit(x) for kv in TAXONOMY.items() for x in kv])[F.col("reason")]
    rows = results.withColumn("checked", F.col("status").isin("pass", "fail")).withColumn("bucket", F.when(~F.col("checked"), F.coalesce(bucket, F.lit("UNCLASSIFIED"))))
    sums = rows.rollup("statement").agg(F.count_if("checked").alias("done"), F.count_if(F.col("bucket") == "TAUTOLOGICAL").alias("circular"), F.count_if(F.col("bucket").isNotNull() & (F.col("bucket") != "STATEMENT_ABSENT")).alias("declarable"), F.grouping("statement").alias("g"))
    scope = F.when(F.col("g") == 1, "__all__").otherwise(F.col("statement"))
    idle = sums.where("g = 0 and done = 0 and declarable > 0").select(F.lit("unvalidated_statement").alias("code"), scope.alias("scope"), "declarable")
    circle = sums.where("circular > done").select(F.lit("tautology_exceeds_checks"), scope, "circular")
    defects = rows.where("bucket in ('UNEVALUABLE_RULE', 'UNCLASSIFIED')").groupBy("rule").agg(F.count("*").alias("n"), F.max(F.when(F.col("bucket") == "UNEVALUABLE_RULE", F.col("severity") == "blocking")).alias("b"))
    return idle.union(circle).union(defects.select(F.lit("pipeline_defect"), "rule", "n")).union(defects.where("b").select(F.lit("unenforceable_rule"), "rule", "n"))
