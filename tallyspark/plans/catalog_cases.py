"""Scalar rules over worked examples: each case is a row of a literal frame, and the SQL lists the results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import documents as docs
from tallyspark.functions import numbers, text
from tallyspark.plans.catalog import query


def literal(v) -> str:
    return "null" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def told(cases: list[tuple], names: str) -> str:
    """SQL: the cases and their results as rows."""
    return f"select * from (values {', '.join('(' + ', '.join(map(literal, c)) + ')' for c in cases)}) t({names})"


def frame(spark, inputs: list[tuple], schema: str):
    return spark.createDataFrame(inputs, schema)


DATES = [
    ("31 December 2024", 2024, 12, 31), ("As at 30th June 2023", 2023, 6, 30), ("2024", 2024, 0, 0), ("FY2023", 2023, 0, 0), ("二零二三年十二月三十一日", 2023, 12, 31), ("二〇二四年", 2024, 0, 0),
    ("2024年12月31日", 2024, 12, 31), ("２０２４年６月３０日", 2024, 6, 30), ("31/12/2024", 2024, 12, 31), ("2024-12-31", 2024, 12, 31), ("30.06.2022", 2022, 6, 30), ("Year ended 31 Mar 2021", 2021, 3, 31),
    ("二零二三年三月三十一日止年度", 2023, 3, 31), ("十二月 2020", 2020, 12, 0),
]


@query("period_date", told([*DATES, ("Note", None, None, None), ("", None, None, None)], "heading, y, m, d"))
def period_date(spark, d):
    rows = frame(spark, [(c[0],) for c in DATES] + [("Note",), ("",)], "heading string")
    return rows.select("heading", numbers.period_date(F.col("heading")).alias("x")).select("heading", "x.y", "x.m", "x.d")


BANNERS = [
    ("NON-CURRENT ASSETS", "non_current_assets", "non_current_assets"), ("Current liabilities", "current_liabilities", "current_liabilities"), ("EQUITY AND LIABILITIES", None, None), ("Total current assets", "current_assets", None),
    ("流動資產", "current_assets", "current_assets"), ("Current assets 流動資產", "current_assets", "current_assets"), ("Equity investments designated", "equity", None), ("Cash flows from operating activities", "cash_flow_from_operating_activities", None),
    ("Other comprehensive income", "other_comprehensive_income", "other_comprehensive_income"), ("Total comprehensive loss attributable to", "total_comprehensive_income_attributable_to", None), ("Loss attributable to owners", "profit_attributable_to", None),
    ("Non-operating expenses", "non_operating_expenses", "non_operating_expenses"), ("Income tax expense", "tax_expense", None), ("Revenue", "income", "income"), ("Deferred tax assets", None, None), ("權益及負債", None, None), ("", None, None),
]


@query("section_of_banner", told(BANNERS, "banner, section, alone"))
def section_of_banner(spark, d):
    b = F.col("banner")
    return frame(spark, [(c[0],) for c in BANNERS], "banner string").select("banner", text.section_of_banner(b).alias("section"), text.section_of_banner_only(b).alias("alone"))


LABELS = [
    ("Deferred tax (note 32) 年內（附註32）", "deferred tax 年内", "deferred tax 年内"), ('PRC corporate income tax ("CIT")', "prc corporate income tax", "prc corporate income tax"), ("Senior notes 2025", "senior notes 2025", "senior notes"),
    ("Note 15: Trade receivables", "trade receivables", "trade receivables"), ("Trésorerie & équivalents", "tresorerie equivalents", "tresorerie equivalents"), ("銷售成本", "销售成本", "销售成本"), ("Interest on lease liabilities 16(b),(c)", "interest on lease liabilities 16 b c", "interest on lease liabilities"),
    ("16(b)", "16 b", "16 b"), ("Ｒｅｖｅｎｕｅ", "revenue", "revenue"), ("Pledged deposits (note", "pledged deposits", "pledged deposits"), ("Straße", "straße", "straße"), ("ﬁxed assets", "fixed assets", "fixed assets"), ("Loss (2022)", "loss", "loss"), ("", "", ""),
]


@query("label_cases", told(LABELS, "caption, label, key"))
def label_cases(spark, d):
    c = F.col("caption")
    return frame(spark, [(x[0],) for x in LABELS], "caption string").select("caption", text.normalize_label(c).alias("label"), text.caption_key(c).alias("key"))


SEGMENTS = [("REVENUE 收益", "REVENUE 收益|REVENUE|收益"), ("Cost of sales 銷售成本 及 開支 (a)", "Cost of sales 銷售成本 及 開支 (a)|Cost of sales (a)|銷售成本 及 開支"), ("Revenue", "Revenue"), ("收益", "收益"), ("", "")]


@query("label_segments", told(SEGMENTS, "caption, parts"))
def label_segments(spark, d):
    return frame(spark, [(x[0],) for x in SEGMENTS], "caption string").select("caption", F.array_join(text.label_segments(F.col("caption")), "|").alias("parts"))


BUCKETS = [
    ("bs_s1_non_current_assets", None, None, "non_current_assets", "section"), ("bs_equity_reserves", None, None, "equity", "section"), ("bs_equity_and_non_current_liabilities", None, None, "others", "unknown_section"),
    ("bs_top_level", None, None, "others", "statement_total"), ("cf_s1_cash_flow_from_operating_activities", None, None, "cash_flow_operating", "section"), ("pl_s8_other_comprehensive_income", None, None, "others", "outside_taxonomy"),
    ("pl_odd", None, None, "others", "unknown_section"), (None, None, None, "others", "unresolved"), ("eq_s1_movements", None, None, "changes_in_equity", "statement"), ("bs_s2_equity", "equity_changes", None, "changes_in_equity", "statement"),
    ("pl_s4_tax_expense", None, None, "expenses", "section"), ("pl_s5_exceptional_items", None, None, "non_operating", "section"), ("pl_s3_non_operating_expenses", None, "interest", "interest", "declared"), ("bs_s1_equity", None, "loans", "others", "unknown_declared_bucket"),
    ("bs_s3_current_assets_and_liabilities", None, None, "current_assets", "section"), (None, "balance_sheet", None, "others", "unresolved"),
]


@query("bucket_of", told(BUCKETS, "section, statement, declared, bucket, reason"))
def bucket_of(spark, d):
    b = docs.bucket_of(F.col("section"), F.col("statement"), F.col("declared"))
    rows = frame(spark, [x[:3] for x in BUCKETS], "section string, statement string, declared string")
    return rows.select("*", b.alias("b")).select("section", "statement", "declared", "b.*")


PERCENTS = [(0.0, "0%"), (0.004, "<1%"), (0.005, "<1%"), (0.006, "1%"), (0.5, "50%"), (1.0, "100%")]


@query("shown_percent", told(PERCENTS, "ratio, shown"))
def shown_percent(spark, d):
    return frame(spark, [(x[0],) for x in PERCENTS], "ratio double").select("ratio", docs.shown_percent(F.col("ratio")).alias("shown"))
