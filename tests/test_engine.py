"""The fact engine: golden values, and every query against its SQL."""

import io
import math
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import numbers, text
from tallyspark.operators import analytics, asof, checks, mapping, ordered, reconcile, rollup, values
from tallyspark.plans import ratio_catalogue as rc
from tallyspark.plans import rules
from tallyspark.plans.all import ORACLE, QUERIES
from tallyspark.sources import files
from tallyspark.streaming import events

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    try:
        return repr(round(float(x), 4) + 0.0)
    except (TypeError, ValueError):
        return str(x)


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name in ORACLE:
        found = duck.execute(ORACLE[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())
    else:
        assert got


@pytest.mark.parametrize(
    ("printed", "kwargs", "want"),
    [("1,204", {}, "1204"), ("(1,204)", {}, "-1204"), ("−5.5", {}, "-5.5"), ("7-", {}, "-7"), ("8,", {}, None), ("", {}, None), ("n/a", {}, None), ("HK$ 3,410", {}, "3410"), ("1.204,50", {"thousands": ".", "decimal": ","}, "1204.5"), ("12,34,567", {}, "1234567")],
)
def test_parse_number(spark, printed, kwargs, want):
    got = one(spark, numbers.parse_number(F.lit(printed), **kwargs))
    assert got == (None if want is None else Decimal(want))


def test_labels(spark):
    assert one(spark, text.normalize_label(F.lit('Trésorerie  (12) ("gloss") & Banques'))) == "tresorerie banques"
    assert one(spark, text.caption_key(F.lit("Trade receivables 14 b"))) == "trade receivables"
    assert one(spark, text.caption_key(F.lit("A 1"))) == "a 1"
    assert one(spark, text.detect_locale(F.lit("资产负债表"))) == "zh" and one(spark, text.detect_locale(F.lit("Bilan"))) == "fr" and one(spark, text.detect_locale(F.lit(""))) == "en"


def test_dates_and_units(spark):
    assert tuple(one(spark, numbers.period_date(F.lit("31 December 2024")))) == (2024, 12, 31)
    assert tuple(one(spark, numbers.period_date(F.lit("FY2023")))) == (2023, 0, 0)
    assert one(spark, numbers.scale_of(F.lit("RMB million and thousand"))) == 1_000_000
    assert one(spark, numbers.column_letters(F.lit(701))) == "ZZ" and one(spark, numbers.column_number(F.lit("AB"))) == 27 and one(spark, numbers.column_number(F.lit("a1"))) is None


def test_formulas(spark):
    assert one(spark, numbers.formula("=SUM(a, b) / 2 - ABS(-1)"), a=4.0, b=6.0) == 4.0
    assert one(spark, numbers.formula("a / (b - 6)"), a=4.0, b=6.0) is None
    for bad in ("__import__('os')", "a.b", "IF(a, 1, 2)", "a >"):
        with pytest.raises(ValueError):
            numbers.formula(bad)


def test_rollups_skip_missing_and_flag_cycles(spark):
    grid = spark.createDataFrame([(1, "c", "current", Decimal(5), None), (2, "c", "current", None, None)], "doc_id long, basis string, period_label string, a decimal(28,4), b decimal(28,4)")
    out = rollup.evaluate(grid, (("d", "diff", ("t", "a")), ("t", "sum", ("a", "b")))).orderBy("doc_id").collect()
    assert [(r["t"], r["d"]) for r in out] == [(5, 0), (None, None)]
    assert rollup.in_order((("x", "sum", ("y",)), ("y", "sum", ("x",)), ("z", "sum", ("a",)))) == ([("z", "sum", ("a",))], {"x", "y"})


def test_duplicate_facts_compare_with_the_first_page(spark):
    rows = [(1, i, "Cash 3", "k", "c", "current", page, Decimal(7)) for i, page in enumerate([1, 2, 1, None, 2])]
    f = spark.createDataFrame(rows, "doc_id long, ordinal int, source_label string, canonical_key string, basis string, period_label string, page_index int, value decimal(28,4)")
    assert [r["keep"] for r in values.mark_summable(f).orderBy("ordinal").collect()] == [True, False, True, True, False]


def test_sign_suspect(spark):
    grid = spark.createDataFrame([(1, "c", "current", 10.0, -4.0, 14.0)], "doc_id long, basis string, period_label string, a double, b double, t double")
    r = checks.check_relation(grid, "r", F.col("t"), [("a", 1), ("b", 1)]).first()
    assert (r["status"], r["difference"], r["suspect"]) == ("fail", 8.0, "b")


def test_ties(spark):
    faces = spark.createDataFrame([(1, "c", "current", 100.0), (1, "c", "prior", 90.0), (2, "c", "current", 5.0)], "doc_id long, basis string, period_label string, face double")
    notes = spark.createDataFrame([(1, "c", "current", 1, -100.0, 3), (1, "c", "prior", 1, -90.0, 3), (1, "c", "current", 0, 60.0, 2)], "doc_id long, basis string, period_label string, table_id int, total double, rows long")
    got = {(r["doc_id"], r["period_label"]): (r["table_id"], r["orientation"], r["status"]) for r in reconcile.reconcile(faces, notes).collect()}
    assert got == {(1, "current"): (1, -1, "tied"), (1, "prior"): (1, -1, "tied"), (2, "current"): (None, 1, "unconfirmed")}


def test_ratios_need_their_inputs(spark):
    grid = spark.createDataFrame([(1, "c", "current", 6.0, None)], "doc_id long, basis string, period_label string, a double, b double")
    got = {r["ratio_key"]: r["ratio"] for r in analytics.ratios(grid, (("x", 1.0, (("a", 1, False), ("b", 1, True)), (("a", 1, False),)), ("y", 1.0, (("b", 1, False),), (("a", 1, False),)))).collect()}
    assert got == {"x": 1.0, "y": None}


NAMES = {
    "tca": rc.TOTAL_CURRENT_ASSETS, "inv": rc.INVENTORIES, "rec": rc.TRADE_RECEIVABLES, "cash": "bs_current_assets__cash_and_cash_equivalents", "tcl": rc.TOTAL_CURRENT_LIABILITIES, "cb": rc.CURRENT_BORROWINGS,
    "cpl": rc.CURRENT_PORTION_OF_DEBT, "pay": rc.TRADE_PAYABLES, "tncl": rc.TOTAL_NON_CURRENT_LIABILITIES, "ncb": "bs_non_current_liabilities__non_current_borrowings", "bonds": "bs_non_current_liabilities__non_current_bonds_payable",
    "leases": "bs_non_current_liabilities__non_current_lease_liabilities", "notes": "bs_non_current_liabilities__non_current_notes_payable", "eq": rc.TOTAL_EQUITY, "ta": rc.TOTAL_ASSETS, "rev": rc.REVENUE, "cogs": rc.COST_OF_GOODS_SOLD,
    "toc": rc.TOTAL_OPERATING_COST, "ebit": rc.OPERATING_PROFIT, "da": rc.DEPRECIATION, "int": rc.INTEREST, "profit": rc.PROFIT, "cfo": rc.OPERATING_CASH, "capex": rc.CAPITAL_EXPENDITURE, "intp": rc.INTEREST_PAID, "rep": rc.REPAYMENT,
}
GOLDEN = {
    "tca": 6614, "inv": 2000, "rec": 3410, "cash": 1204, "tcl": 3300, "cb": 800, "cpl": 200, "pay": 1500, "tncl": 4200, "ncb": 3000, "bonds": 1000, "eq": 9114, "ta": 16614,
    "rev": 20000, "cogs": -12000, "ebit": 3200, "da": -800, "int": -400, "profit": 2400, "cfo": 3500, "capex": -1500, "intp": -380, "rep": -600,
}


def ratios_of(spark, figures):
    grid = spark.createDataFrame([(1, "c", "current", *map(float, figures.values()))], "doc_id long, basis string, period_label string, " + ", ".join(f"{NAMES[k]} double" for k in figures))
    rows = analytics.ratios(grid, rc.CATALOGUE)
    return {r["ratio_key"]: r["ratio"] for r in rows.collect()} | {"ccc": analytics.cash_conversion_cycle(rows).first()["ccc"]}


def test_ratio_catalogue(spark):
    got = ratios_of(spark, GOLDEN)
    want = {
        "gross_gearing": 5000 / 9114, "net_gearing": 3796 / 9114, "debt_to_capital": 500000 / 14114, "debt_ratio": 750000 / 16614, "debt_to_ebitda": 1.25, "net_debt_to_ebitda": 0.949,
        "ebitda_interest_coverage": 10.0, "debt_service_coverage": 4000 / 1400, "cfo_to_total_debt": 70.0, "fcf_to_total_debt": 40.0, "ffo_to_total_debt": 64.0, "cash_debt_service_coverage": 3500 / 980,
        "ebitda_margin": 20.0, "return_on_capital_employed": 320000 / 13314, "cash_ratio": 1204 / 3300, "dso": 3410 / 20000 * 365, "dio": 2000 / 12000 * 365, "dpo": 1500 / 12000 * 365,
        "ccc": 3410 / 20000 * 365 + 500 / 12000 * 365,
    }
    assert len(got) == 32 and all(v is not None for v in got.values())
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_ratio_fallbacks(spark):
    got = ratios_of(spark, {"inv": 2000, "toc": -15000, "ebit": 5, "eq": 1000, "ncb": 400})
    assert got["dio"] == pytest.approx(2000 / 15000 * 365) and got["gross_gearing"] == pytest.approx(0.4)
    assert ratios_of(spark, GOLDEN | {"leases": 700, "notes": 300})["gross_gearing"] == pytest.approx(6000 / 9114)
    assert got["dpo"] is None and got["interest_coverage"] is None and got["debt_ratio"] is None and got["ccc"] is None


def test_gap_subsets_are_ordered_and_bounded(spark):
    gaps = spark.createDataFrame([(1, 3.0)], "doc_id long, gap double")
    left = spark.createDataFrame([(1, i, 1.0) for i in range(1, 8)] + [(1, 8, 3.0)], "doc_id long, pos int, amount double")
    got = [r["members"] for r in analytics.gap_subsets(gaps, left).orderBy("rank").collect()]
    assert got == ["8", "1,2,3", "1,2,4", "1,2,5", "1,2,6", "1,2,7", "1,3,4", "1,3,5"]


def test_gap_subsets_take_the_first_leftovers_and_both_periods(spark):
    gaps = spark.createDataFrame([(1, 3.0, 5.0), (2, 3.0, None), (3, 3.0, 0.2), (4, 0.4, None)], "doc_id long, gap double, prior_gap double")
    rows = [(20, 3.0, 4.0), (30, 3.0, 5.0), (40, 3.0, None), (50, 1.0, 2.0), (60, 2.0, 3.0), *((100 + i, 0.0, 0.0) for i in range(8)), (200, 3.0, 5.0), (300, 3.0, 5.0)]
    left = spark.createDataFrame([(d, *r) for d in (1, 2, 3, 4) for r in rows], "doc_id long, pos int, amount double, prior double")
    got = {}
    for r in analytics.gap_subsets(gaps, left).orderBy("doc_id", "rank").collect():
        got.setdefault(r["doc_id"], []).append(r["members"])
    assert got[1][:4] == ["30", "200", "30,100", "30,101"] and got[2][:4] == got[3][:4] == ["20", "30", "40", "200"] and set(got) == {1, 2, 3}


def test_find_gaps(spark):
    at = "doc_id long, basis string, period_label string, canonical_key string, figure double"
    t, u, o = "bs_a__total_a", "bs_b__total_b", "bs_a__others"
    printed = spark.createDataFrame([(1, "c", "current", t, 10.0), (1, "c", "prior", t, 8.0), (1, "c", "current", u, 10.0), (2, "c", "current", t, 7.5), (3, "c", "current", t, 9.0), (1, "c", "current", "net", 9.0), (5, "c", "prior", t, 9.0)], at)
    computed = spark.createDataFrame([(1, "c", "current", t, 7.0), (1, "c", "prior", t, 3.0), (1, "c", "current", u, 1.0), (2, "c", "current", t, 7.0), (3, "c", "current", t, 7.0), (4, "c", "current", t, 7.0), (1, "c", "current", "net", 1.0), (5, "c", "prior", t, 1.0)], at)
    gaps = analytics.find_gaps(printed, computed, [("bs_a__x", o, t), ("bs_b__x", u), ("net",)])
    assert sorted(map(tuple, gaps.collect())) == [(1, "c", t, o, 3.0, 5.0), (3, "c", t, o, 2.0, None)]
    left = spark.createDataFrame([(1, "c", 1, 3.0, 5.0), (1, "c", 2, 3.0, 1.0), (1, "s", 3, 3.0, 5.0), (3, "c", 4, 2.0, None)], "doc_id long, basis string, pos int, amount double, prior double")
    assert sorted((r["doc_id"], r["target_key"], r["members"]) for r in analytics.gap_subsets(gaps, left, by=("doc_id", "basis")).collect()) == [(1, t, "1"), (3, t, "4")]


def test_rates(spark):
    rows = [("USD", "EUR", 0.9, "2024-01-01", 1, 1), ("USD", "EUR", 0.8, "2024-01-02", 1, 2), ("GBP", "USD", 1.25, "2024-01-01", 1, 3)]
    rates = spark.createDataFrame(rows, "base string, quote string, rate double, as_of string, created_at int, id int")
    want = spark.createDataFrame([("USD", "EUR"), ("USD", "GBP"), ("EUR", "GBP")], "base string, quote string")
    assert {(r["base"], r["quote"]): (r["rate"], r["how"]) for r in asof.resolve_rates(rates, want).collect()} == {("USD", "EUR"): (0.8, "direct"), ("USD", "GBP"): (0.8, "inverse"), ("EUR", "GBP"): (None, "missing")}


def test_mapping_ties(spark):
    rows = spark.createDataFrame([(c, None, None) for c in ("Small Ring", "Blue Gizmo", "Old gizmo", None)], "caption string, statement string, banner string")
    got = {r["caption"]: r for r in mapping.map_captions(rows, rules.CONCEPTS).collect()}
    assert got["Small Ring"]["method"] == "tie" and got["Small Ring"]["canonical_key"] is None and "," in got["Small Ring"]["candidates"]
    assert got["Blue Gizmo"]["method"] == "unmapped" and got["Old gizmo"]["confidence"] == 0.95 and got[None]["method"] == "unmapped"


def test_pages_follow_the_costs(spark):
    rows = [(1, i, *map(float, e)) for i, e in enumerate([(9, 0, 0, 0), (0, 9, 0, 0), (0, 0, 9, 0), (0, 0, 0, 0), (0, 0, 0, 20)])]
    p = spark.createDataFrame(rows, "doc_id long, page_index int, PRE double, FACE double, NOTES double, POST double")
    assert [r["state"] for r in ordered.decode_pages(p).orderBy("page_index").collect()] == ["PRE", "FACE", "NOTES", "NOTES", "POST"]


def workbook() -> bytes:
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="BS"/><sheet name="Old" state="hidden"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Cash</t></si><si><r><t>Trade </t></r><r><t>payables</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>1204</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>-500</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {ns}><sheetData><row><c r="AA3" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    (tmp_path / "broken.bin").write_bytes(b"PK\x03\x04 nothing")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.png").write_bytes(b"?")
    (tmp_path / "d").write_bytes(b"?")
    found = files.scan_files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["format"] for r in found.collect()} == {"a.xlsx": "xlsx", "broken.bin": "xlsx", "b.pdf": "pdf", "c.png": "image", "d": "unknown"}
    cells = files.workbook_cells(found)
    rows = {(r["sheet"], r["row"], r["col"]): (r["text"], r["number"], r["hidden"]) for r in cells.where("error is null").collect()}
    assert rows == {("BS", 0, 0): ("Cash", None, False), ("BS", 0, 1): ("1204", 1204.0, False), ("BS", 1, 0): ("Trade payables", None, False), ("BS", 1, 1): ("-500", -500.0, False), ("Old", 2, 26): ("x", None, True)}
    assert cells.where("error is not null").count() == 1
    assert {r["sheet"]: (r["label_col"], r["value_cols"]) for r in files.detect_columns(cells).collect()}["BS"] == (0, [1])


def test_streams_give_the_batch_rows(spark, sf_dir, tmp_path):
    from pathlib import Path

    (tmp_path / "in").mkdir()
    (tmp_path / "in/e.parquet").write_bytes(Path(sf_dir, "events.parquet").read_bytes())
    stream = events.hourly_totals(events.read_events(spark, f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = events.hourly_totals(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, batch.collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_notes_split(spark):
    from tallyspark.operators import notes

    parents = spark.createDataFrame([(1, "c", "current", -30.0), (1, "c", "prior", -20.0), (2, "c", "current", 9.0), (3, "c", "current", 10.0)], "doc_id int, basis string, period_label string, parent double")
    items = spark.createDataFrame(
        [(1, 7, k, "c", p, v) for k, p, v in (("a", "current", 10.0), ("b", "current", 20.0), ("a", "prior", 5.0), ("b", "prior", 15.0))]
        + [(2, t, k, "c", "current", v) for t in (1, 2) for k, v in (("a", 4.0), ("b", 5.0))] + [(3, 1, "a", "c", "current", 10.0)],
        "doc_id int, table_id int, concept string, basis string, period_label string, value double",
    )
    got = {(r.doc_id, r.table_id, r.concept, r.period_label): r.figure for r in notes.split_from_disclosure(parents, items).collect()}
    # 1 is split with its sign; 2 has two tables that would do; 3 has a single component
    assert got == {(1, 7, "a", "current"): -10.0, (1, 7, "b", "current"): -20.0, (1, 7, "a", "prior"): -5.0, (1, 7, "b", "prior"): -15.0}


def test_document_labels(spark):
    from tallyspark.functions import documents as docs

    null = F.lit(None).cast("string")
    bucket = lambda s, st=null, de=null: tuple(one(spark, docs.bucket_of(F.lit(s), st, de)))
    assert bucket("bs_s2_current_assets") == ("current_assets", "section") and bucket("bs_s1_non_current_assets") == ("non_current_assets", "section")
    assert bucket("bs_equity_and_non_current_liabilities") == ("others", "unknown_section")
    assert bucket(None) == ("others", "unresolved") and bucket("x", null, F.lit("Nothing such")) == ("others", "unknown_declared_bucket")
    assert tuple(one(spark, docs.badge(F.lit(None).cast("double")))) == ("med", None) and tuple(one(spark, docs.badge(F.lit(0.85)))) == ("high", 85)
    assert one(spark, docs.human_size(F.lit(10))) == "1 KB" and one(spark, docs.human_size(F.lit(1572864))) == "1.5 MB"
    pages = spark.createDataFrame([(1, 0, "Annual report\nBig Fish Ltd | Annual report"), (2, 0, None), (3, 7, "Late Ltd")], "doc_id int, page_index int, text string")
    assert [tuple(r) for r in docs.entity_names(pages).collect()] == [(1, "Big Fish Ltd")]


def test_workbook_round_trip(spark):
    from tallyspark.sinks.workbooks import workbook
    from tallyspark.sources.workbook import workbook_facts

    sheet = [
        ["Balance sheet", None, None, None, None, None], [None, "Note", "Consolidated", None, "Company", None], [None, None, "RMB'000", "HK$'000", None, None],
        [None, None, "31 December 2023", "31 December 2024", "31 December 2024", "31 December 2023"], ["Current assets", None, None, None, None, None],
        ["Inventories", 14, 5.0, 7.5, "(3)", None], ["Cash & <bank>", None, "1,204", 2.0, 4.0, 1.0],
    ]
    years = [["Item", "2024", "2023", "2023 restated", "Retained profits"], ["Revenue", 9.0, 8.0, 7.0, 1.0]]
    data = workbook({"BS": sheet, "Q/1": years, "Empty": []})
    assert data == workbook({"BS": sheet, "Q/1": years, "Empty": []})
    df = spark.createDataFrame([("h", "xlsx", data), ("bad", "xlsx", b"PK")], "doc_hash string, format string, content binary")
    cells = files.workbook_cells(df)
    assert cells.where("error is not null").count() == 1
    got = {(r.sheet, r.cell): (r.source_label, r.section, r.note_number, r.basis, r.period_label, r.currency, r.factor, r.value) for r in workbook_facts(cells).collect()}
    ca = "current_assets"
    assert got == {
        ("BS", "C6"): ("Inventories", ca, "14", "consolidated", "prior", "RMB", 1000.0, 5.0), ("BS", "D6"): ("Inventories", ca, "14", "consolidated", "current", "HKD", 1000.0, 7.5),
        ("BS", "E6"): ("Inventories", ca, "14", "standalone", "current", "HKD", 1000.0, -3.0), ("BS", "C7"): ("Cash & <bank>", ca, None, "consolidated", "prior", "RMB", 1000.0, 1204.0),
        ("BS", "D7"): ("Cash & <bank>", ca, None, "consolidated", "current", "HKD", 1000.0, 2.0), ("BS", "E7"): ("Cash & <bank>", ca, None, "standalone", "current", "HKD", 1000.0, 4.0),
        ("BS", "F7"): ("Cash & <bank>", ca, None, "standalone", "prior", "HKD", 1000.0, 1.0), ("Q 1", "B2"): ("Revenue", None, None, "consolidated", "current", None, None, 9.0),
        ("Q 1", "C2"): ("Revenue", None, None, "consolidated", "prior", None, None, 8.0), ("Q 1", "D2"): ("Revenue", None, None, "consolidated", "prior restated", None, None, 7.0),
        ("Q 1", "E2"): ("Revenue", None, None, "consolidated", "Retained profits", None, None, 1.0),
    }


def test_sinks(spark, sf_dir, tmp_path):
    from tallyspark.sinks import tables
    from tallyspark.sinks.workbooks import document_workbooks

    few = spark.createDataFrame(
        [(1, 1, "a, \"b\"", "consolidated", "prior", 2.0), (1, 2, "=x", "standalone", "current", 3.0), (1, 3, "c", "consolidated", "current", None), (2, 1, "d", "consolidated", "2024", 5.0)],
        "doc_id int, ordinal int, source_label string, basis string, period_label string, value double",
    )
    got = {r.doc_id: r.content for r in tables.csv_documents(few).collect()}
    assert got[1] == '﻿Caption,prior (consolidated),current (consolidated),current (standalone)\r\n"a, ""b""",2.0,,\r\n\'=x,,,3.0\r\nc,,,\r\n'
    assert got[2] == "﻿Caption,Value\r\nd,5.0\r\n"
    wide = few.withColumns({"canonical_key": F.lit("k"), "note_number": F.lit("1"), "page_index": F.lit(0)})
    books = document_workbooks(wide).cache()
    folder = f"{tmp_path}/objects"
    for _ in range(2):
        tables.put_objects(books, folder)
    assert spark.read.parquet(folder).count() == 2
    found = tables.get_objects(spark, folder, books.select("doc_hash").union(spark.createDataFrame([("ff00",)], ["doc_hash"])))
    assert found.count() == 3 and found.where("content is null").count() == 1
    cells = files.workbook_cells(found.where("content is not null").withColumn("format", F.lit("xlsx")))
    assert cells.where("row > 0 and col = 1").orderBy("text").select("text").distinct().count() == 4


def test_pages(spark):
    from tallyspark.operators import pages

    rows = spark.createDataFrame(
        [(1, 1, "Title", False, True, 0.0, 1.0, 0.1), (1, 2, "Amounts due", False, False, 2.0, 3.0, 0.1), (1, 3, "from related parties", True, False, 3.2, 4.2, 0.1), (1, 4, "far", False, False, 9.0, 10.0, 0.1), (1, 5, "Cash", True, False, 12.0, 13.0, 0.1), (1, 6, "indented", False, False, 13.1, 14.1, 0.5), (1, 7, "Other", True, False, 14.2, 15.2, 0.1)],
        "page int, n int, text string, valued boolean, heading boolean, top double, bottom double, left double",
    )
    got = [r.caption for r in pages.wrapped_captions(rows, ["page"], "n").orderBy("n").collect()]
    assert got == ["Title", "Amounts due from related parties", "far", "Cash", "indented", "Other"]
    words = lambda *ws: F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.lit(t).alias("text")) for a, b, t in ws])
    row = one(spark, pages.scan_row(words((0.1, 0.2, "Cash"), (0.3, 0.32, "14"), (0.6, 0.7, "1,204"), (0.8, 0.9, "(7)"))))
    assert (row.label, row.note, row["values"]) == ("Cash", "14", ["1,204", "(7)"])
    row = one(spark, pages.scan_row(words((0.1, 0.2, "Stage"), (0.205, 0.21, "3"), (0.6, 0.7, "9"))))
    assert (row.label, row.note, row["values"]) == ("Stage", None, ["3", "9"])
    row = one(spark, pages.scan_row(words((0.1, 0.2, "Only"), (0.21, 0.3, "words"))))
    assert (row.label, row.note, row["values"]) == ("Only words", None, [])


def test_indicators_refuse_circles(spark):
    from tallyspark.operators import narrative

    grid = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert narrative.indicators(grid, {"y": "=x * 2", "x": "=a / b"}).first().y is None
    with pytest.raises(ValueError):
        narrative.indicators(grid, {"y": "=x", "x": "=y"})
    with pytest.raises(ValueError):
        narrative.indicators(grid, {"y": "=nothing + a"})


def test_rulebook_codecs():
    from tallyspark.sinks import rulebooks

    nodes = [
        {"section": "assets", "key": "bs_a", "label": "A & <b>", "role": "line", "children": [], "order": 1, "kpi": {"x": [1, 2]}},
        {"section": "assets", "key": "bs_t", "label": "总额", "role": "total", "op": "sum", "children": ["bs_a"], "order": 2},
    ]
    assert rulebooks.read_template(rulebooks.template_workbook(nodes)) == nodes
    bad = [{"section": "s", "key": "a", "op": "sum"}, {"section": "t", "key": "a", "children": ["a", "z"]}, {"section": "s"}]
    with pytest.raises(ValueError) as e:
        rulebooks.read_template(rulebooks.template_workbook(bad))
    for part in ("row 2: a is calculated but has no children", "row 3: key a is given in row 2", "row 3: a is its own child", "row 3: unknown child z", "row 4: no key", "row 4: section s is taken up again"):
        assert part in str(e.value)
    book = rulebooks.skeleton(nodes)
    book[0] |= {"aliases": ["a, b", "c"], "note": None, "tolerance": 0.5}
    assert rulebooks.read_rulebook(rulebooks.rulebook_workbook(book)) == book


def test_gates(spark):
    from tallyspark.operators import gates

    null = F.lit(None).cast("string")
    assert one(spark, gates.page_kind(F.lit(101), F.lit(0.03), F.lit(0.6))) == "MIXED" and one(spark, gates.page_kind(F.lit(3), F.lit(0.03), F.lit(0.6))) == "SCANNED"
    assert one(spark, gates.page_kind(F.lit(3), F.lit(0.0), F.lit(0.1))) == "NATIVE"
    assert one(spark, gates.is_statement_line(null)) is True and one(spark, gates.is_statement_line(F.lit("Header"))) is False
    assert one(spark, gates.names_another_class(F.lit("cf_investing__x"), null)) is False
    requests = spark.createDataFrame([(1, 5, {"b": "2", "a": "1"}), (2, 6, {}), (3, 7, None)], "request int, doc_id int, options map<string,string>")
    runs = spark.createDataFrame([(9, 5, {"a": "1", "b": "2"}, "done"), (8, 6, {"a": "1"}, "running")], "run int, doc_id int, options map<string,string>, status string")
    assert {r.request: (r.run, r.decision) for r in gates.adopt_runs(requests, runs).collect()} == {1: (9, "adopt"), 2: (8, "conflict"), 3: (None, "start")}


def test_similarity_and_json(spark, sf_dir):
    import json

    from tallyspark.operators import templates

    assert templates.similarity("trade receivables", "receivables trade") == 1.0
    assert templates.similarity("at bank cash", "cash") == 0.5  # 4 of 16 letters twice, the alias covered
    assert templates.similarity("stock", "cash") < 0.2 and templates.similarity(None, "cash") == 0.0 == templates.similarity("cash", "")
    want = {}
    for r in QUERIES["concept_value"](spark, sf_dir).collect():
        want.setdefault((r.doc_id, r.canonical_key), []).append((r.basis, r.period_label, r.figure))
    got = {(r.doc_id, r.canonical_key): [(x["basis"], x["period_label"], float(x["figure"])) for x in json.loads(r.json)] for r in QUERIES["rows_json"](spark, sf_dir).collect()}
    assert got == {k: sorted(v) for k, v in want.items()}


def test_run_scopes(spark):
    """A face page past the notes that shows a statement again is the company's; untitled pages take the one before."""
    from tallyspark.operators import classify

    pages = [(0, "FACE", "balance_sheet", "consolidated"), (1, "FACE", None, None), (2, "NOTES", None, None), (3, "FACE", "balance_sheet", None), (4, "FACE", None, None), (5, "FACE", "cash_flow", None)]
    rows = spark.createDataFrame([(1, *p) for p in pages], "doc_id int, page_index int, state string, statement string, scope string")
    got = [r["scope"] for r in classify.run_scopes(rows).orderBy("page_index").collect()]
    assert got == ["consolidated", "consolidated", None, "company", "company", "company"]
    early = spark.createDataFrame([(1, 0, "NOTES", None, None), (1, 1, "FACE", "balance_sheet", None)], rows.schema)
    assert [r["scope"] for r in classify.run_scopes(early).orderBy("page_index").collect()] == [None, None]


def test_page_margins(spark):
    from tallyspark.operators import classify, ordered

    row = spark.createDataFrame([("FACE", 1.0, 7.0, -4.0, -2.0), ("POST", 1.0, 0.0, 0.0, -2.0)], "state string, PRE double, FACE double, NOTES double, POST double")
    assert [(r["margin"], r["confidence"]) for r in classify.margins(row, ordered.STATES).collect()] == [(6.0, 0.8), (-3.0, 0.35)]


def test_ports(spark):
    from tallyspark import ports

    registry = ports.builtin()
    assert registry.names(ports.OCR) == ["stub"]
    with pytest.raises(ports.Unavailable):
        registry.make(ports.FX, "stub").rate("USD", "EUR", "2024-01-01")
    with pytest.raises(KeyError):
        registry.make(ports.OCR, "nothing")
    with pytest.raises(ValueError):
        registry.register(ports.OCR, "stub", object)

    class Reader:
        def words(self, image):
            return [{"text": w, "x0": 0.0, "y0": 0.0, "x1": 0.1, "y1": 0.1} for w in image.decode().split()]

    pages = spark.createDataFrame([(1, 0, b"two words"), (2, 3, b"")], "doc_id long, page_index int, image binary")
    assert [(r["doc_id"], r["text"]) for r in ports.ocr_words(pages, Reader).collect()] == [(1, "two"), (1, "words")]

    class Model:
        def answer(self, instructions, payload):
            return {"a": "k1", "b": "unknown", "z": "k1"}

    groups = spark.createDataFrame([("g", "{}", ["a", "b"], ["k1", "k2"])], "group string, payload string, items array<string>, keys array<string>")
    assert [tuple(r) for r in ports.answers(groups, Model, "map").collect()] == [("g", "a", "k1")]
    assert ports.payload(b=1, a=[2]) == '{"a":[2],"b":1}'


def test_settings():
    from tallyspark.operators.overlays import Settings, with_settings

    assert with_settings(Settings(), {"mapping_margin": 0, "candidate_cap": 50}).candidate_cap == 50
    for bad in ({"nothing": 1}, {"candidate_cap": 0}, {"candidate_cap": 1.5}, {"mapping_margin": "x"}, {"mapping_margin": True}):
        with pytest.raises(ValueError):
            with_settings(Settings(), bad)


def test_rulebook_errors():
    from tallyspark.operators import rulebooks

    with pytest.raises(ValueError, match="c inherits 'x'"):
        rulebooks.resolve_inherits({"section_defaults": {}, "mappings": [{"canonical_key": "c", "inherits": "x"}]})
    assert rulebooks.resolve_inherits({"mappings": []}) == {"mappings": []}
    assert len(rulebooks.unknown_keys({str(i): 0 for i in range(99)}, {})) == rulebooks.MOST_UNKNOWN


def test_concept_figures_edits(spark):
    """The first edited row replaces the sum; a row on the same page adds, one on another page is the same fact."""
    at = "doc_id int, canonical_key string, basis string, period_label string, source_label string, page_index int, place int, edited boolean, value decimal(28,4)"
    rows = [("a", "cash", 1, 1, False, 5), ("a", "cash", 1, 2, False, 5), ("a", "cash 3", 2, 3, False, 5), ("a", "bank", 2, 4, False, 5), ("b", "cash", 1, 1, False, 5), ("b", "cash", 1, 2, True, 9), ("b", "bank", 3, 3, True, 7), ("c", "cash", None, 1, False, 5), ("c", "cash", 2, 2, False, 5), ("c", "cash", None, 3, False, 5), ("d", "cash", 1, 1, False, None)]
    f = spark.createDataFrame([(1, k, "c", "p", label, page, n, e, None if v is None else Decimal(v)) for k, label, page, n, e, v in rows], at)
    got = {r["canonical_key"]: (r["figure"], r["duplicates"], r["edited"]) for r in values.concept_figures(f).collect()}
    assert got == {"a": (15, 1, False), "b": (9, 0, True), "c": (10, 1, False)}


def test_stored_facts_need_no_shuffle(spark, sf_dir, tmp_path):
    from tallyspark.sources.facts import facts, store_facts

    stored = store_facts(facts(spark, sf_dir), "stored_facts", 4, str(tmp_path / "facts"))
    figures = values.concept_figures(stored, arranged=True)
    assert "Exchange" not in figures._jdf.queryExecution().executedPlan().toString()
    want = values.concept_figures(facts(spark, sf_dir))
    assert sorted(map(str, figures.collect())) == sorted(map(str, want.collect()))
    spark.sql("drop table stored_facts")


def test_pages_are_read_one_after_another(spark):
    """A page is no data frame of its own, goes on over the batches for Python, and lacks nothing where its key is null."""
    from tallyspark.operators import scan
    from tallyspark.plans.catalog_structure import NOTE_PAGE, READ, page_words

    words = page_words(NOTE_PAGE)
    rows = [(doc, page, *w, False, "company") for w in reversed(words) for doc in (None, *range(40)) for page in (1, 2)]
    made = scan.page_facts(spark.createDataFrame(rows, "doc_id long, page_index int, x0 double, x1 double, y0 double, y1 double, text string, on_face boolean, scope string"))
    plan = made._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = [tuple(r) for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    wanted = [(doc, page, *r[1:]) for doc in (None, *range(40)) for page in (1, 2) for r in READ if r[0] == 1]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_sizes_round_halves_to_even(spark):
    from tallyspark.functions import documents as docs

    sizes = [n for k in range(4, 400) for n in (k * 262144 - 1, k * 262144, k * 262144 + 1)] + [1, 1048575, 2**40 + 262144, 2**50 + 3 * 262144, 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", docs.human_size(F.col("n")).alias("size")).collect()
    assert {r.n: r.size for r in rows} == {n: f"{n / 1048576:.1f} MB" if n >= 1048576 else f"{max(1, n // 1024)} KB" for n in sizes}


def test_relations_add_their_parts_in_order(spark):
    """0.1 + 0.2 + 0.3 is a hair over 0.6, 0.3 + 0.2 + 0.1 isn't; neither joins nor the order of rows matter."""
    from tallyspark.operators.narrative import check_relations

    cells = [("bs_c", 0.3), ("bs_b", 0.2), ("bs_a", 0.1), ("bs_t", 1.6), ("bs_n", None)]
    figures = spark.createDataFrame([(doc, None if doc % 5 == 0 else "b", "p", k, v, 1.0, False) for k, v in cells for doc in range(60)], "doc_id long, basis string, period_label string, key string, figure double, scale double, derived boolean").repartition(7, "key")
    order = {"up": "abc", "down": "cba"}
    terms = spark.createDataFrame([(r, f"bs_{k}", int(k not in "t"), i) for r, parts in order.items() for i, k in enumerate("t" + parts + "n")], "rule string, key string, sign int, place int")
    rules = spark.createDataFrame([(r, "bs", "sum", False, True) for r in (*order, "bare")], "rule string, statement string, op string, broken boolean, nil boolean")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {tuple(r) for r in check_relations(figures, terms, rules, 1.0, 0.0).select("rule", "doc_id", "basis", "status", "reason", "expected", "actual").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    told = {"up": ("pass", None, 0.1 + 0.2 + 0.3, 1.6), "down": ("fail" if 1.6 - (0.3 + 0.2 + 0.1) > 1.0 else "pass", None, 0.3 + 0.2 + 0.1, 1.6), "bare": ("skipped", "target_missing", None, None)}
    assert told["up"][2] != told["down"][2]
    assert got == {(r, doc, None if doc % 5 == 0 else "b", *t) for r, t in told.items() for doc in range(60)}
