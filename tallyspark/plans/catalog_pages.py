"""Queries over words of pages, sentences, relations as data, and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import narrative, pages, values
from tallyspark.plans import rules
from tallyspark.plans.catalog import FACTS, FIGURES, _grid, _ratio_sql, GRID, query
from tallyspark.operators import analytics
from tallyspark.sinks import tables
from tallyspark.sources.facts import facts, table

INV, REC, OCA, PAY, BOR, OCL = rules.LEAVES
CA_T, CL_T = rules.ROLLUPS[1][0], rules.ROLLUPS[2][0]


def _words(spark, d):
    """Words of a page: an order is a row, a line is a word."""
    return table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("page"), F.col("l_orderkey").alias("row"), (F.col("l_quantity") * 16).alias("x"), F.col("l_linenumber").cast("string").alias("n"),
        F.when(F.col("l_suppkey") % 3 == 0, F.concat((F.col("l_linenumber") % 90).cast("string"), F.lit(",000"))).otherwise((F.col("l_linenumber") % 90).cast("string")).alias("text"),
    )


_WORDS = "words as (select o_custkey as page, l_orderkey as row, l_quantity * 16 as x, case when l_suppkey % 3 = 0 then (l_linenumber % 90) || ',000' else (l_linenumber % 90)::varchar end as text, l_suppkey % 3 <> 0 as bare from lineitem join orders on l_orderkey = o_orderkey)"


@query("value_bands", f"with {_WORDS}, m as (select *, case when x - lag(x) over (partition by page order by x) > 40 then 1 else 0 end as new from words), c as (select *, sum(new) over (partition by page order by x range unbounded preceding) as c from m), g as (select page, c, median(x) as middle, count(*) as cells from c group by page, c having count(distinct row) >= 3 and not count(*) filter (where bare) >= greatest(2, count(*) * 0.8)) select page, row_number() over (partition by page order by middle) as band, middle, cells from g qualify count(*) over (partition by page) >= 2")
def value_bands(spark, d):
    return pages.value_bands(_words(spark, d), ["page"], "x", 40.0)


@query("phrases", "with w as (select l_orderkey as row, l_quantity * 10 as l, l_quantity * 10 + 20 as r, l_suppkey::varchar as t from lineitem), m as (select *, case when l - max(r) over (partition by row order by l, r, t rows between unbounded preceding and 1 preceding) > 30 then 1 else 0 end as new from w), p as (select *, sum(new) over (partition by row order by l, r, t rows unbounded preceding) as place from m) select row, place, string_agg(t, ' ' order by l, r, t) as text, min(l) as l, max(r) as r from p group by row, place")
def phrases(spark, d):
    q = F.col("l_quantity") * 10
    w = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), q.alias("left"), (q + 20).alias("right"), F.col("l_suppkey").cast("string").alias("text"))
    return pages.phrases(w, ["row"], 30.0).withColumnsRenamed({"left": "l", "right": "r"})


@query("split_banner", "select p_partkey, case when p_partkey % 2 = 0 then 'Current assets' end as banner, p_name as caption from part")
def split_banner(spark, d):
    from tallyspark.functions.text import section_of_banner

    p = table(spark, d, "part")
    runs = p.where("p_partkey % 2 = 0").select("p_partkey", F.lit(0).alias("place"), F.lit("Current assets").alias("text")).union(p.select("p_partkey", F.lit(1), "p_name"))
    return pages.split_banner(runs, ["p_partkey"], F.coalesce(section_of_banner(F.col("text")).isNotNull(), F.lit(False)))


_WRAP = (
    f"{FACTS}, rows as (select doc_id, ordinal, source_label as text, quantity > 20 as valued, quantity < 4 as heading, page_index from facts), "
    "j as (select *, coalesce(not valued and not heading and (lead(page_index) over w <> 3 or page_index = 3 and lead(page_index) over w = 3), false) as joins from rows window w as (partition by doc_id order by ordinal)), "
    "n as (select *, case when coalesce(lag(joins) over (partition by doc_id order by ordinal), false) then 0 else 1 end as new from j), "
    "r as (select *, sum(new) over (partition by doc_id order by ordinal rows unbounded preceding) as run from n), "
    "u as (select *, row_number() over (partition by doc_id, run order by ordinal desc) - 1 as up, max(case when valued then ordinal end) over (partition by doc_id, run) as ends from r), "
    "t as (select *, case when ends is not null and up <= 3 then ends else ordinal end as target from u)"
)


@query("wrapped_captions", f"with {_WRAP} select doc_id, target as ordinal, string_agg(text, ' ' order by ordinal) as caption from t group by doc_id, target")
def wrapped_captions(spark, d):
    f = facts(spark, d, ordered=True)
    top = F.col("ordinal") * 10 + F.when(F.col("page_index") == 3, 900).otherwise(0)
    bottom = F.col("ordinal") * 10 + 9
    rows = f.select("doc_id", "ordinal", F.col("source_label").alias("text"), (F.col("quantity") > 20).alias("valued"), (F.col("quantity") < 4).alias("heading"), top.cast("double").alias("top"), F.when(F.col("page_index") == 3, top + 9).otherwise(bottom).cast("double").alias("bottom"), F.lit(0.1).alias("left"))
    # a row of page 3 is set far below; what follows it is above it again, which isn't tight either
    return pages.wrapped_captions(rows, ["doc_id"], "ordinal", tight=(-1e9, 0.6))


@query("scan_row", "select p_partkey, p_name as label, case when p_partkey % 2 = 0 then p_size::varchar end as note, case when p_partkey % 3 = 0 then '' else p_partkey || ',000|(7)' end as vals from part where p_partkey % 2 = 1 or p_partkey % 3 <> 0 union all select p_partkey, p_name || ' Note ' || p_size, null, '' from part where p_partkey % 2 = 0 and p_partkey % 3 = 0 and false union all select p_partkey, p_name || ' Note', null, p_size::varchar from part where p_partkey % 2 = 0 and p_partkey % 3 = 0")
def scan_row(spark, d):
    at = lambda i, t: F.struct(F.lit(i * 0.1).alias("left"), F.lit(i * 0.1 + 0.095).alias("right"), t.alias("text"))
    names = F.split("p_name", " ")
    ref = F.when(F.col("p_partkey") % 2 == 0, F.array(at(3, F.lit("Note")), at(4, F.col("p_size").cast("string"))))
    vals = F.when(F.col("p_partkey") % 3 != 0, F.array(at(5, F.concat(F.col("p_partkey").cast("string"), F.lit(",000"))), at(6, F.lit("RMB")), at(7, F.lit("(7)"))))
    none = F.array().cast("array<struct<left:double,right:double,text:string>>")
    words = F.concat(F.array(at(1, names[0]), at(2, names[1])), F.coalesce(ref, none), F.coalesce(vals, none))
    s = pages.scan_row(words)
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.label", "s.note", F.array_join("s.values", "|").alias("vals"))


@query("note_column", f"with {_WORDS}, h as (select page, unnest([100, 300, 500, 700]) as hx from (select distinct page from words)), n as (select page, hx, count(*) as n from words join h using (page) where bare and abs(hx - x) <= 40 group by all having count(*) >= 2) select page, max_by(hx, n * 10000 - hx)::double as note_x from n group by page")
def note_column(spark, d):
    w = _words(spark, d)
    heads = w.select("page").distinct().select("page", F.explode(F.array(*[F.lit(float(x)) for x in (100, 300, 500, 700)])).alias("hx"))
    return pages.note_column(heads, w, ["page"], "x", 40.0)


@query("header_region", f"with {FACTS} select doc_id, ordinal from (select *, min(case when quantity > 45 then ordinal end) over (partition by doc_id) as f from facts) where (f is null or ordinal <= f) and ordinal <= 20")
def header_region(spark, d):
    f = facts(spark, d, ordered=True).select("doc_id", "ordinal", "quantity", (F.col("ordinal") / 50).alias("y"))
    return pages.header_region(f, ["doc_id"], "ordinal", F.col("quantity") > 45, "y").select("doc_id", "ordinal")


@query("dominant_rotation", "select p_brand, max_by(r, n * 1000 - r) as rotation from (select p_brand, p_size % 4 * 90 as r, sum(length(p_name)) as n from part group by all) group by p_brand")
def dominant_rotation(spark, d):
    return pages.dominant_rotation(table(spark, d, "part").select("p_brand", (F.col("p_size") % 4 * 90).alias("rotation"), F.col("p_name").alias("text")), ["p_brand"])


@query("reading_space", "with b as (select p_partkey, p_size / 128 as a, p_size / 256 as b, p_size / 128 + 0.25 as c, p_size / 256 + 0.125 as d, p_partkey % 4 as r from part) select p_partkey, case r when 0 then a when 1 then b when 2 then 1 - c else 1 - d end as x0, case r when 0 then b when 1 then 1 - c when 2 then 1 - d else a end as y0, case r when 0 then c when 1 then d when 2 then 1 - a else 1 - b end as x1, case r when 0 then d when 1 then 1 - a when 2 then 1 - b else c end as y1 from b")
def reading_space(spark, d):
    s = F.col("p_size")
    box = F.struct((s / 128).alias("x0"), (s / 256).alias("y0"), (s / 128 + 0.25).alias("x1"), (s / 256 + 0.125).alias("y1"))
    return table(spark, d, "part").select("p_partkey", pages.reading_space(box, F.col("p_partkey") % 4 * 90).alias("b")).select("p_partkey", "b.*")


@query("bases_of_columns", "with c as (select distinct p_brand as page, p_size as x from part), n as (select *, count(*) over (partition by page) as n, row_number() over (partition by page order by x) - 1 as i, case when abs(x - 15) <= abs(x - 35) then 0 else 1 end as near from c) select page, x, case when n % 2 = 0 then case when i < n / 2 then 'consolidated' else 'standalone' end when max(near) over (partition by page order by x) = 0 then 'consolidated' else 'standalone' end as basis from n")
def bases_of_columns(spark, d):
    c = table(spark, d, "part").select(F.col("p_brand").alias("page"), F.col("p_size").alias("x")).distinct()
    heads = F.array(*[F.struct(F.lit(x).alias("cx"), F.lit(b).alias("basis")) for x, b in ((15, "consolidated"), (35, "standalone"))])
    return pages.bases_of_columns(c, c.select("page").distinct().select("page", F.inline(heads)), ["page"], "x")


@query("equity_matrix", f"with {FACTS}, c as (select doc_id, ordinal // 4 as row, case when quantity > 10 then canonical_key end as component, page_index, value from facts), k as (select *, count(*) over (partition by doc_id, row) as n from c where component is not null), r as (select * from k where n >= 2), m as (select doc_id, component, list_sort(list(page_index))[len(list(page_index)) // 2 + 1] as m from r group by all), o as (select doc_id, component, row_number() over (partition by doc_id order by m, component) as place from m) select doc_id, row, component, place, cast(value as double) as value from r join o using (doc_id, component)")
def equity_matrix(spark, d):
    f = facts(spark, d, ordered=True)
    cells = f.select("doc_id", F.floor(F.col("ordinal") / 4).alias("row"), F.when(F.col("quantity") > 10, F.col("canonical_key")).alias("component"), F.col("page_index").alias("column_index"), F.col("value").cast("double").alias("value"))
    return pages.matrix(cells, ["doc_id"])


@query("equity_closing", f"with {FACTS} select doc_id, max_by(quantity, ordinal) as closing from facts where quantity > 10 group by doc_id")
def equity_closing(spark, d):
    f = facts(spark, d, ordered=True).select("doc_id", "ordinal", F.when(F.col("quantity") > 10, F.col("quantity")).alias("v"))
    return pages.closing_figure(f, ["doc_id"], "ordinal", "v")


# ---- sentences and indicators --------------------------------------------------------------------------------------

_TONES = (("current_ratio", 1.5, 1.0), ("quick_ratio", 1.0, None))


@query("commentary", f"with {GRID}, r as ({_ratio_sql()}), j as (select *, coalesce(ratio_key = 'current_ratio' and ratio >= 1.5 or ratio_key = 'quick_ratio' and ratio >= 1, false) as good, coalesce(ratio_key = 'current_ratio' and ratio < 1 or ratio_key = 'quick_ratio' and ratio < 1, false) as bad from r) select doc_id, basis, period_label, coalesce(string_agg(ratio_key, ',' order by ratio_key) filter (where good), '') as strengths, coalesce(string_agg(ratio_key, ',' order by ratio_key) filter (where bad), '') as weaknesses, count(*) filter (where good) / nullif(count(*) filter (where good or bad), 0) as score from j group by all")
def commentary(spark, d):
    return narrative.commentary(analytics.ratios(_grid(spark, d), rules.RATIOS), _TONES)


@query("movement_notes", f"with {FIGURES}, p as (select doc_id, canonical_key, basis, cast(max(figure) filter (where period_label = 'current') as double) as c, cast(max(figure) filter (where period_label = 'prior') as double) as p from figures group by all) select doc_id, canonical_key, basis, split_part(canonical_key, '__', 2) || case when c = p then ' was unchanged' else case when c > p then ' rose' else ' fell' end || ' by ' || cast(round(abs(c - p)) as bigint) || ' (' || cast(round(abs(c - p) / abs(p) * 100) as bigint) || '%)' end as sentence from p where c is not null and p is not null")
def movement_notes(spark, d):
    pairs = values.current_prior(values.concept_figures(facts(spark, d).where("period_label <> 'col2'"))).withColumn("label", F.split("canonical_key", "__")[1])
    return narrative.movement_notes(pairs, "label").select("doc_id", "canonical_key", "basis", "sentence")


@query("indicators", "select p_partkey, p_size * 2 + p_retailprice as base, (p_size * 2 + p_retailprice) / nullif(p_size - 5, 0) as per_unit, least((p_size * 2 + p_retailprice) / nullif(p_size - 5, 0), 100) as capped from part")
def indicators(spark, d):
    made = narrative.indicators(table(spark, d, "part"), {"capped": "=MIN(per_unit, 100)", "per_unit": "=base / (p_size - 5)", "base": "=p_size * 2 + p_retailprice"})
    return made.select("p_partkey", *[F.col(c).cast("double") for c in ("base", "per_unit", "capped")])


_REL = {"ca": (CA_T, (INV, REC, OCA), "bs", "sum", False, True), "strict": (CA_T, (INV, REC, OCA), "bs", "sum", False, False), "cash": ("cf_net", (INV,), "cf", "sum", False, True), "odd": (CA_T, (INV,), "bs", "ratio", False, True), "torn": (CA_T, (INV,), "bs", "sum", True, True)}


@query("relations_as_data", f"with {GRID}, s as (select doc_id, basis, period_label, cast({CA_T} as double) + doc_id % 4 as a, coalesce(cast({INV} as double), 0) + coalesce(cast({REC} as double), 0) + coalesce(cast({OCA} as double), 0) as e, ({INV} is not null)::int + ({REC} is not null)::int + ({OCA} is not null)::int as got from grid), "
       "r as (select *, unnest(['ca', 'strict', 'cash', 'odd', 'torn']) as rule from s), w as (select *, case when rule = 'torn' then 'broken' when rule = 'cash' then 'statement_absent' when rule = 'odd' then 'unsupported_op' when a is null then 'target_missing' when got = 0 then 'all_missing' when got < 3 and rule = 'strict' then 'components_missing' end as reason from r) "
       "select rule, doc_id, basis, period_label, reason, case when reason = 'broken' then 'error' when reason is not null then 'skipped' when abs(a - e) <= greatest(1, abs(e) * 0.00001) then 'pass' else 'fail' end as status from w")
def relations_as_data(spark, d):
    g = _grid(spark, d).withColumn(CA_T, F.col(CA_T).cast("double") + F.col("doc_id") % 4)
    keys = (*rules.LEAVES, CA_T)
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("figure")) for k in keys])
    figures = g.select("doc_id", "basis", "period_label", F.inline(cells)).withColumns({"scale": F.lit(1.0), "derived": F.lit(False)})
    terms = spark.createDataFrame([(r, k, s, i) for r, (t, parts, *_) in _REL.items() for i, (k, s) in enumerate(((t, 0), *((p, 1) for p in parts)))], "rule string, key string, sign int, place int")
    made = spark.createDataFrame([(r, st, op, broken, nil) for r, (_, _, st, op, broken, nil) in _REL.items()], "rule string, statement string, op string, broken boolean, nil boolean")
    return narrative.check_relations(figures, terms, made, 1.0, 0.00001).select("rule", "doc_id", "basis", "period_label", "reason", "status")


_HEADERS = (
    f"{FACTS}, s as (select doc_id, basis, period_label, min(ordinal) as o from facts group by all), p as (select *, row_number() over (partition by doc_id order by basis <> 'consolidated', o) as place, count(*) over (partition by doc_id) as n, min(basis) over (partition by doc_id) <> max(basis) over (partition by doc_id) as two from s), "
    "hd as (select doc_id, basis, period_label, place, n, case when n = 1 then 'Value' when two then period_label || ' (' || basis || ')' else period_label end as header from p)"
)


@query("csv_headers", f"with {_HEADERS} select doc_id, basis, period_label, place, header from hd")
def csv_headers(spark, d):
    return tables.csv_headers(tables.slot_order(facts(spark, d, ordered=True)))


@query("csv_documents", f"with {_HEADERS}, h as (select doc_id, string_agg(header, ',' order by place) as heads from hd group by doc_id), l as (select doc_id, ordinal, source_label || ',' || repeat(',', place - 1) || value::varchar || repeat(',', n - place) as line from facts join hd using (doc_id, basis, period_label)), b as (select doc_id, string_agg(line, chr(13) || chr(10) order by ordinal) as body from l group by doc_id) select doc_id, chr(65279) || 'Caption,' || heads || chr(13) || chr(10) || body || chr(13) || chr(10) as content from b join h using (doc_id)")
def csv_documents(spark, d):
    return tables.csv_documents(facts(spark, d, ordered=True).drop("place"))


@query("workbook_round_trip", f"with {FACTS} select doc_id::double as doc_id, ordinal::double as ordinal, source_label, cast(value as double) as value from facts")
def workbook_round_trip(spark, d):
    """Every document's rows written to a workbook and read back from its bytes."""
    from tallyspark.sinks.workbooks import document_workbooks
    from tallyspark.sources.files import workbook_cells

    books = document_workbooks(facts(spark, d, ordered=True), ("doc_id", "ordinal", "source_label", "value"))
    cells = workbook_cells(books.withColumn("format", F.lit("xlsx"))).where("row > 0")
    at = lambda i, c: F.max(F.when(F.col("col") == i, F.col(c)))
    return cells.groupBy("doc_hash", "row").agg(at(0, "number").alias("doc_id"), at(1, "number").alias("ordinal"), at(2, "text").alias("source_label"), at(3, "number").alias("value")).drop("doc_hash", "row")
