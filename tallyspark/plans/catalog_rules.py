"""Queries over the rulebook's own work: captions in their place, pages, units and signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import numbers
from tallyspark.functions.text import names_period
from tallyspark.operators import checks, classify, export, mapping, normalise, ordered, overlays
from tallyspark.operators.mapping import Concept
from tallyspark.plans.catalog import query
from tallyspark.plans.catalog_cases import frame, told
from tallyspark.sources.facts import table

_CB, _NB = "bs_current_liabilities__current_borrowings", "bs_non_current_liabilities__non_current_borrowings"
RULEBOOK = (
    Concept("bs_current_assets__trade_receivables", aliases=("Trade receivables", "Accounts receivable"), priority=50, excludes=("impairment",), keywords=("trade", "receivable")),
    Concept(_CB, aliases=("Bank borrowings", "Interest-bearing borrowings"), priority=40, family="borrowings", confusable=(_NB,)),
    Concept(_NB, aliases=("Bank borrowings", "Long-term loans"), priority=40, family="borrowings", confusable=(_CB,)),
    Concept("pl_income__revenue_from_operations", aliases=("Revenue", "营业收入"), priority=60, regex=("^total revenue",)),
    Concept("pl_profit_before_tax", aliases=("Profit before tax",), priority=70, regex=("^profit before",)),
    Concept("pl_profit_before_exceptional_items", aliases=("Profit before exceptional items and tax",), mode="derive"),
    Concept("cf_cash_flow_from_investing_activities__net_cash", aliases=("Net cash flow",), priority=30, regex=("^net cash.*activities",)),
    Concept("cf_cash_flow_from_financing_activities__net_cash", priority=20, regex=("^net cash.*activities",)),
    Concept("pl_non_operating_expenses__interest_expense", aliases=("Finance costs",), priority=10),
    Concept("cf_cash_flow_from_operating_activities__interest_paid", aliases=("Finance costs",), priority=20, statement="cash_flow"),
    Concept("bs_equity__others", aliases=("Other reserves",), mode="residual"),
    Concept("eq_total", aliases=("Balance at end of year",), statement="equity_changes"),
)
_K = [c.key for c in RULEBOOK]
#: caption, statement, banner, canonical_key, method, confidence
CAPTIONS = [
    ("Trade receivables (note 12)", "balance_sheet", "CURRENT ASSETS", _K[0], "exact", 1.0), ("Impairment of trade receivables", "balance_sheet", None, None, "unmapped", 0.0), ("Other trade and receivable items", None, None, _K[0], "rule", 0.95),
    ("Bank borrowings", "balance_sheet", None, None, "tie", 0.0), ("Bank borrowings", "balance_sheet", "Current liabilities", _CB, "exact", 1.0), ("Bank borrowings", "balance_sheet", "NON-CURRENT LIABILITIES", _NB, "exact", 1.0),
    ("Long-term loans", "balance_sheet", "Current liabilities", _CB, "rerouted", 1.0), ("Long-term loans", "cash_flow", None, None, "unmapped", 0.0), ("REVENUE 營業收入", "profit_and_loss", None, _K[3], "exact", 1.0), ("營業收入", "profit_and_loss", "Revenue", _K[3], "exact", 1.0),
    ("Total revenue and gains", "profit_and_loss", None, _K[3], "rule", 0.95), ("Profit before exceptional items and tax", "profit_and_loss", None, None, "computed", 0.0), ("Profit before tax and other items", "profit_and_loss", None, _K[4], "rule", 0.95),
    ("Net cash from all activities", "cash_flow", None, _K[6], "rule", 0.6), ("Net cash used in financing activities", "cash_flow", None, _K[7], "rule", 0.95), ("Finance costs", "profit_and_loss", None, _K[8], "exact", 1.0),
    ("Finance costs", "cash_flow", "Operating activities", _K[9], "exact", 1.0), ("Finance costs", None, None, _K[9], "exact", 1.0), ("Other reserves", "balance_sheet", "Equity", None, "unmapped", 0.0), ("Balance at end of year", "equity_changes", None, _K[11], "exact", 1.0),
    ("", None, None, None, "unmapped", 0.0),
]


@query("map_in_place", told(CAPTIONS, "caption, statement, banner, canonical_key, method, confidence"))
def map_in_place(spark, d):
    rows = frame(spark, [c[:3] for c in CAPTIONS], "caption string, statement string, banner string")
    return mapping.map_captions(rows, RULEBOOK).select("caption", "statement", "banner", "canonical_key", "method", "confidence")


# ---- pages ---------------------------------------------------------------------------------------------------------

_P = "profit_and_loss"
#: lines of a page, and what is read from them: statement, scope, narrative, notes banner, numbered heading, back matter
PAGES = [
    (("12", "ACME Limited Annual Report 2024", "CONSOLIDATED STATEMENT OF FINANCIAL POSITION", "31 December 2024", "Group 2024 2023", "Inventories 1,200 1,100 900"), "balance_sheet", "consolidated", False, False, False, False),
    (("CONSOLIDATED STATEMENT OF", "CASH FLOWS", "Profit before tax 100 90"), "cash_flow", "consolidated", False, False, False, False),
    (("CONSOLIDATED STATEMENT OF PROFIT OR LOSS AND OTHER COMPREHENSIVE INCOME", "Revenue 10 9"), _P, "consolidated", False, False, False, False),
    (("STATEMENTS OF LOSS", "Research costs (10) (9)"), _P, None, False, False, False, False), (("綜合權益變動表(續)", "於二零二四年"), "changes_in_equity", "consolidated", False, False, False, False),
    (("Independent Auditor's Report", "We have audited the consolidated statement of cash flows"), None, None, True, False, False, False),
    (("NOTES TO THE CONSOLIDATED FINANCIAL STATEMENTS", "1. GENERAL INFORMATION", "The Company is a limited company."), None, None, False, True, True, False),
    (("Contents", "Statement of financial position", "Statement of cash flows", "Statement of changes in equity", "Income statement"), None, None, False, False, False, False),
    (("FIVE YEAR FINANCIAL SUMMARY", "Revenue 1 2 3 4 5"), None, None, False, False, False, True), (("SUMMARY OF STATEMENT OF PROFIT OR LOSS", "2024 2023"), None, None, False, False, False, False),
    (("Statement of financial position of the Company", "Investments in subsidiaries 5 4"), "balance_sheet", "company", False, False, False, False), (("16. TRADE RECEIVABLES", "Trade receivables 1,000 900"), None, None, False, False, True, False),
    (("These items are included in cost of sales in the consolidated statement of profit or loss and in other places",), None, None, False, False, False, False), (("BALANCE SHEETS", "The Group The Company", "Cash 10 5"), "balance_sheet", "mixed", False, False, False, False), (("",), None, None, False, False, False, False),
]


def _filing(spark):
    rows = [(i, n, t, n * 0.05) for i, (lines, *_) in enumerate(PAGES) for n, t in enumerate(lines)]
    lines = frame(spark, rows, "page_index int, line_no int, text string, y double")
    return classify.page_features(lines.withColumn("doc_id", F.lit(1)))


@query("page_features", told([(i, *p[1:]) for i, p in enumerate(PAGES)], "page_index, statement, scope, narrative, notes_banner, numbered, back_matter"))
def page_features(spark, d):
    return _filing(spark).select("page_index", "statement", "scope", "narrative", "notes_banner", (F.col("note_heading") | F.col("note_one")).alias("numbered"), "back_matter")


#: The best path by hand: costs and scores added up page by page.
_STATES = ("FACE", "FACE", "FACE", "FACE", "FACE", "NOTES", "NOTES", "NOTES", "POST", "FACE", "FACE", "NOTES", "FACE", "FACE", "FACE")


@query("classified_pages", told(list(enumerate(_STATES)), "page_index, state"))
def classified_pages(spark, d):
    """The whole way from lines to kinds of pages."""
    return ordered.decode_pages(classify.page_scores(_filing(spark))).select("page_index", "state")


#: How much better each page's state fits it than the next best, by hand, and the confidence of that.
_MARGINS = list(zip(range(15), _STATES, (9.0, 9.0, 8.0, 9.0, 8.0, -8.0, 14.5, -1.0, 6.0, 0.5, 8.0, 3.0, -1.0, 9.0, -1.0), (0.95, 0.95, 0.9, 0.95, 0.9, 0.3, 0.97, 0.45, 0.8, 0.525, 0.9, 0.65, 0.45, 0.95, 0.45), strict=True))


@query("page_margins", told(_MARGINS, "page_index, state, margin, confidence"))
def page_margins(spark, d):
    scored = classify.page_scores(_filing(spark))
    found = ordered.decode_pages(scored).join(scored, ["doc_id", "page_index"])
    return classify.margins(found, ordered.STATES).select("page_index", "state", "margin", "confidence")


@query("page_confidence", "select p_partkey, round(least(0.97, greatest(0.30, 0.5 + (p_size - 25) / 20.0)), 4) as confidence from part")
def page_confidence(spark, d):
    return table(spark, d, "part").select("p_partkey", classify.confidence(F.col("p_size") - 25.0).alias("confidence"))


# ---- units and signs -----------------------------------------------------------------------------------------------

UNITS = [
    ("Amounts in RMB'000", "thousand", "CNY"), ("RMB’000,000", "million", "CNY"), ("HK$ million (thousands elsewhere)", "million", "HKD"), ("人民幣千元", "thousand", "CNY"), ("₹ crores", "crore", "INR"), ("€ billions", "billion", "EUR"),
    ("港幣百萬元", "million", "HKD"), ("US$ 3.000", None, "USD"), ("10億円", "hundred million", None), ("nothing here", None, None), ("Rs. lakhs", "lakh", "INR"),
]


@query("unit_scale_detect", told(UNITS, "caption, scale, currency"))
def unit_scale_detect(spark, d):
    c = F.col("caption")
    return frame(spark, [(u[0],) for u in UNITS], "caption string").select("caption", normalise.scale_label(c).alias("scale"), normalise.currency(c).alias("currency"))


_UNIT_PAGES = [(1, 0, "OTHER", "Annual report of a HK$ company"), (1, 1, "OTHER", "Chairman"), (1, 9, "FACE", "Balance sheet RMB'000"), (1, 10, "FACE", "US$ million"), (2, 0, "OTHER", "€ million"), (3, 5, "FACE", "plain £"), (4, 3, "NOTES", "RMB'000")]


@query("document_units", told([(1, "thousand", "HKD"), (2, "million", "EUR"), (3, None, "GBP")], "doc_id, scale, currency"))
def document_units(spark, d):
    return normalise.document_units(frame(spark, _UNIT_PAGES, "doc_id int, page_index int, kind string, text string"))


PERCENT_CASES = [("1,204", 1204.0), ("45.2%", None), ("(3.1)%", None), ("(12)", -12.0), ("-", None)]


@query("money_refuses_percent", told(PERCENT_CASES, "printed, amount"))
def money_refuses_percent(spark, d):
    return frame(spark, [(p,) for p, _ in PERCENT_CASES], "printed string").select("printed", normalise.money(F.col("printed")).cast("double").alias("amount"))


_SIGNED = "s as (select o_custkey as doc_id, o_orderpriority as statement, 'c' || o_orderkey % 5 as k, case when o_custkey % 3 = 0 and o_orderkey % 11 = 0 then -1.0 else 1.0 end * (o_orderkey % 50) as v, o_orderkey % 13 = 0 as done, o_orderkey as line from orders)"


@query("negate_unsigned", f"with {_SIGNED}, c as (select doc_id, statement, bool_and(v > 0) as p, count(distinct k) as n from s where k in ('c0', 'c1', 'c2', 'c3') and v <> 0 and not done group by all) select s.doc_id, line, case when p and n >= 3 and k <> 'c4' and v <> 0 and not done then -v else v end as value, coalesce(p and n >= 3, false) and k <> 'c4' and v <> 0 and not done as negated from s left join c using (doc_id, statement)")
def negate_unsigned(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("statement"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("canonical_key"),
        (F.when((F.col("o_custkey") % 3 == 0) & (k % 11 == 0), -1.0).otherwise(1.0) * (k % 50)).alias("value"), (k % 13 == 0).alias("sign_normalised"), k.alias("line"),
    )
    return normalise.negate_unsigned(rows, ("c0", "c1", "c2", "c3")).select("doc_id", "line", "value", "negated")


_EXPECTED = [("c0", "balance_sheet", "positive_expected", "instant", "balance"), ("c1", "balance_sheet", None, "instant", "balance"), ("c2", "cash_flow", "negative_expected", "duration", "flow"), ("c3", "cash_flow", "either", "duration", "subtotal"), ("c4", "profit_and_loss", "negative_expected", "duration", "flow")]


@query("check_expectations", "with e(k, home, sign, t, u) as (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in r) + ")" for r in _EXPECTED) + "), shape(statement, wt, wu) as (values ('balance_sheet', 'instant', 'balance'), ('cash_flow', 'duration', 'flow'), ('profit_and_loss', 'duration', 'flow')), "
       "r as (select o_orderkey as line, case o_custkey % 3 when 0 then 'balance_sheet' when 1 then 'cash_flow' else 'profit_and_loss' end as statement, 'c' || o_orderkey % 5 as k, (o_orderkey % 50 - 25)::double as v from orders) "
       "select line, case when t = wt and (u = wu or u = 'subtotal') then k end as canonical_key, case when v <> 0 and (sign = 'positive_expected' and v < 0 or sign = 'negative_expected' and v > 0) then 0.35 else 1.0 end as sign_confidence from r join e using (k) join shape using (statement)")
def check_expectations(spark, d):
    k = F.col("o_orderkey")
    st = F.element_at(F.array(*map(F.lit, ("balance_sheet", "cash_flow", "profit_and_loss"))), (F.col("o_custkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "orders").select(k.alias("line"), st.alias("statement"), F.concat(F.lit("c"), (k % 5).cast("string")).alias("canonical_key"), (k % 50 - 25).cast("double").alias("value"))
    expected = frame(spark, _EXPECTED, "canonical_key string, statement string, sign string, temporality string, unit_of_account string")
    return normalise.check_expectations(rows, expected).select("line", "canonical_key", "sign_confidence")


@query("contradicts_section", "select o_custkey as doc_id, o_orderpriority as line, coalesce(bool_and(case when v = 0 then null when s = 'assets' then v < 0 when s = 'costs' then v > 0 end), false) as contradicts from (select *, o_orderkey % 30 - 5 as v, case o_orderpriority when '1-URGENT' then 'assets' when '2-HIGH' then 'costs' else 'cash' end as s from orders) group by all")
def contradicts_section(spark, d):
    s = F.when(F.col("o_orderpriority") == "1-URGENT", "assets").when(F.col("o_orderpriority") == "2-HIGH", "costs").otherwise("cash")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("line"), s.alias("section"), (F.col("o_orderkey") % 30 - 5).alias("value"))
    return normalise.contradicts_section(rows, {"assets": "positive_expected", "costs": "negative_expected"})


RESTATED = [("2023 (Restated)", True, "thousand"), ("2023 RMB'000", False, "thousand"), ("二零二三年（經重列）", True, None), ("RMB million", False, "million"), ("", False, None)]


@query("column_markers", told(RESTATED, "heading, restated, unit"))
def column_markers(spark, d):
    h = F.col("heading")
    return frame(spark, [(r[0],) for r in RESTATED], "heading string").select("heading", normalise.restated(h, ("restated", "重列")).alias("restated"), normalise.declared_unit(h, {"'000": "thousand", "(Restated)": "thousand", "million": "million"}).alias("unit"))


@query("presented_figures", "select o_orderkey, case o_orderpriority when '1-URGENT' then o_totalprice when '2-HIGH' then o_totalprice * 7.8 when '3-MEDIUM' then o_totalprice * 0.5 end / 1000 as shown from orders")
def presented_figures(spark, d):
    p = F.col("o_orderpriority")
    figures = table(spark, d, "orders").select("o_orderkey", F.when(p == "1-URGENT", "HKD").when(p == "2-HIGH", "USD").when(p == "3-MEDIUM", "JPY").otherwise("XXX").alias("currency"), F.col("o_totalprice").alias("figure"))
    rates = frame(spark, [("USD", 7.8), ("JPY", 0.5)], "base string, rate double")
    return normalise.presented(figures, rates, "HKD", 1000.0).select("o_orderkey", "shown")


DISPLAY = [(1.25, "x", "1.25×"), (12.5, "%", "12.5%"), (37.0, "days", "37.0 days"), (None, "x", "—")]


@query("ratio_display", told(DISPLAY, "value, unit, shown"))
def ratio_display(spark, d):
    return frame(spark, [x[:2] for x in DISPLAY], "value double, unit string").select("value", "unit", normalise.display(F.col("value"), F.col("unit")).alias("shown"))


@query("elapsed_ms", "select event_id, greatest(0, epoch_us(ts) // 1000 - epoch_ms(timestamp '2024-01-02')) as ms from events")
def elapsed_ms(spark, d):
    return table(spark, d, "events").select("event_id", normalise.elapsed_ms(F.lit("2024-01-02").cast("timestamp"), F.col("ts")).alias("ms"))


#: sheet, basis, column, heading, label
HEADINGS = [
    ("a", "consolidated", 2, "31 December 2023", "prior"), ("a", "consolidated", 3, "31 December 2024", "current"), ("a", "standalone", 4, "2024", "current"), ("a", "standalone", 5, "2023", "prior"),
    ("b", "consolidated", 2, "2024", "current"), ("b", "consolidated", 3, "2023 (restated)", "prior_restated"), ("b", "consolidated", 4, "2023", "prior"), ("c", "consolidated", 2, "", "current"), ("c", "consolidated", 3, "", "prior"), ("c", "consolidated", 4, "2020", "col2"),
    ("d", "consolidated", 2, "Retained profits", "Retained profits"), ("d", "consolidated", 3, "2024", "current"), ("e", "consolidated", 2, "FY2024", "current"), ("e", "consolidated", 3, "FY2023", "prior"), ("e", "consolidated", 4, "FY2024", "current_col4"),
]


@query("column_labels", told(HEADINGS, "sheet, basis, col, heading, period_label"))
def column_labels(spark, d):
    h = F.col("heading")
    rows = frame(spark, [x[:4] for x in HEADINGS], "sheet string, basis string, col int, heading string")
    rows = rows.withColumns({"date": numbers.period_date(h), "period": (h == "") | names_period(h), "restated": normalise.restated(h, ("restated",))})
    return ordered.column_labels(rows, ["sheet", "basis"], "date", "period", "restated", "heading").join(rows.select("sheet", "basis", "col", "heading"), ["sheet", "basis", "col"])


RATES = [("USD", "EUR", "0.9", None), ("usd", "EUR", "0.9", "bad_code"), ("USD", "USD", "1", "same_currency"), ("USD", "EUR", "-1", "bad_rate"), ("USD", "EUR", "n/a", "bad_rate"), ("USD", "EUR", "Infinity", "bad_rate"), (None, "EUR", "1", "bad_code"), ("USD", "EUR", "NaN", "bad_rate")]


@query("valid_rates", told(RATES, "base, quote, rate, problem"))
def valid_rates(spark, d):
    rows = frame(spark, [r[:3] for r in RATES], "base string, quote string, rate string")
    return rows.withColumn("problem", overlays.valid_rate(F.col("base"), F.col("quote"), F.col("rate")))


#: rule, statement, status, reason, severity
RESULTS = [
    ("r1", "bs", "pass", None, "blocking"), ("r2", "bs", "fail", None, "blocking"), ("r3", "cf", "skipped", "target_missing", "warning"), ("r4", "pl", "skipped", "derived_input", "warning"), ("r5", "pl", "skipped", "derived_input", "warning"),
    ("r6", "pl", "pass", None, "warning"), ("r7", "eq", "skipped", "statement_absent", "warning"), ("r8", "bs", "error", "unparsable_expr", "blocking"), ("r9", "bs", "skipped", "unsupported_op", "warning"), ("r10", "bs", "skipped", "something new", "blocking"),
]


@query("coverage_alarms", told([("unvalidated_statement", "cf", 1), ("tautology_exceeds_checks", "pl", 2), ("pipeline_defect", "r8", 1), ("pipeline_defect", "r9", 1), ("pipeline_defect", "r10", 1), ("unenforceable_rule", "r8", 1)], "code, scope, rows"))
def coverage_alarms(spark, d):
    return checks.alarms(frame(spark, RESULTS, "rule string, statement string, status string, reason string, severity string")).withColumnRenamed("declarable", "rows")


@query("scaled_figures", "select p_partkey, case when p_size % 3 = 0 then p_retailprice else p_retailprice * (case p_size % 3 when 1 then 1000 else 1 end) / 1000000 end as shown from part")
def scaled_figures(spark, d):
    """Stated in thousands, in units or in nothing known, shown in millions where the unit is known."""
    k = F.col("p_size") % 3
    factor = export.unit_factor(F.when(k == 1, 1000.0).when(k == 2, 1.0), 1000000.0)
    return table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * factor).alias("shown"))
