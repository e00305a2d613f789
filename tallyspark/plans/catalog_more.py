"""Further queries: layout, residuals, templates, documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import numbers, text
from tallyspark.functions.text import DISCLOSURES
from tallyspark.operators import analytics, layout, reconcile, residual, templates, values
from tallyspark.plans import rules
from tallyspark.plans.catalog import FACTS, FIGURES, GRID, ORACLE, _grid, _relation, _RELATION, query
from tallyspark.plans.ratio_catalogue import CATALOGUE, CREDIT_FACTORS, CREDIT_SIGNALS, RATIOS
from tallyspark.sources.facts import facts, table

INV, REC, OCA, PAY, BOR, OCL = rules.LEAVES
CA_T, CL_T = rules.ROLLUPS[1][0], rules.ROLLUPS[2][0]


@query("row_clusters", "with recursive w as (select o_custkey as page, o_orderkey as w, cast(o_totalprice / 1000 as double) as y, row_number() over (partition by o_custkey order by o_totalprice / 1000, o_orderkey) as k from orders), "
       "c as (select page, w, k, 1 as row, 1 as n, y as total from w where k = 1 union all select w.page, w.w, w.k, case when abs(w.y - c.total / c.n) <= 20 then c.row else c.row + 1 end, case when abs(w.y - c.total / c.n) <= 20 then c.n + 1 else 1 end, case when abs(w.y - c.total / c.n) <= 20 then c.total + w.y else w.y end from c join w on w.page = c.page and w.k = c.k + 1) select page, row, w from c")
def row_clusters(spark, d):
    words = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), (F.col("o_totalprice") / 1000).alias("y"), F.col("o_orderkey").alias("w"))
    return layout.row_clusters(words, ["page"], "y", "w", 20.0)


@query("page_chrome", f"with {FACTS} select doc_id, source_label, count(distinct page_index) as pages from facts group by all having count(distinct page_index) >= 3")
def page_chrome(spark, d):
    return layout.running_headers(facts(spark, d), "doc_id", "page_index", "source_label", 3)


@query("basis_runs", "with h as (select o_custkey as sheet, o_orderkey as col, case when o_orderstatus = 'F' then 'consolidated' when o_orderstatus = 'P' then 'standalone' end as m from orders), l as (select *, last_value(m ignore nulls) over (partition by sheet order by col) as a, first_value(m ignore nulls) over (partition by sheet order by col rows between current row and unbounded following) as b, min(m) over (partition by sheet) as lo, max(m) over (partition by sheet) as hi from h) select sheet, col, case when lo <> hi then coalesce(a, b) end as basis from l")
def basis_runs(spark, d):
    m = F.when(F.col("o_orderstatus") == "F", "consolidated").when(F.col("o_orderstatus") == "P", "standalone")
    h = table(spark, d, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderkey").alias("col"), m.alias("m"))
    return layout.column_bases(h, ["sheet"], "col", "m").select("sheet", "col", "basis")


@query("note_sections", f"with {FACTS}, s as (select doc_id, ordinal, sum(case when quantity >= 45 then 1 else 0 end) over (partition by doc_id order by ordinal) as segment from facts) select * from s where segment > 0")
def note_sections(spark, d):
    return layout.note_sections(facts(spark, d, ordered=True).select("doc_id", "ordinal", "quantity"), ["doc_id"], "ordinal", F.col("quantity") >= 45).select("doc_id", "ordinal", "segment")


@query("scale_conflicts", f"with {FACTS}, m as (select doc_id, ordinal, quantity, page_index = 0 as t from facts), r as (select *, coalesce(sum(t::int) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding), 0) as run from m), s as (select *, sum(quantity) over (partition by doc_id, run order by ordinal rows between unbounded preceding and 1 preceding) as running from r) "
       "select doc_id, ordinal, quantity, running from s where t and coalesce(running, 0) <> 0 and (abs(abs(quantity / running) / 10 - 1) <= 0.2 or abs(abs(quantity / running) * 10 - 1) <= 0.2)")
def scale_conflicts(spark, d):
    rows = facts(spark, d, ordered=True).select("doc_id", "ordinal", "quantity", "page_index")
    return layout.scale_conflicts(rows, ["doc_id"], "ordinal", "quantity", F.col("page_index") == 0, 10.0, 0.2).select("doc_id", "ordinal", "quantity", "running")


@query("cell_context", "with c as (select distinct p_brand as sheet, cast(p_partkey % 200 as int) as row, cast(p_size % 10 as int) as col from part), t as (select p_brand as sheet, cast(p_partkey % 200 as int) as t_row, cast(p_size % 10 as int) as t_col from part group by all) select c.sheet, row, col, t_row, t_col from c join t on c.sheet = t.sheet and abs(row - t_row) <= 5 and abs(col - t_col) <= 5")
def cell_context(spark, d):
    p = table(spark, d, "part")
    at = lambda *names: [F.col("p_brand").alias("sheet"), (F.col("p_partkey") % 200).cast("int").alias(names[0]), (F.col("p_size") % 10).cast("int").alias(names[1])]
    return layout.cell_context(p.select(*at("row", "col")).distinct(), p.select(*at("t_row", "t_col")).distinct(), ["sheet"], 5)


@query("range_bands", "select p_partkey, case when p_size > 0 and p_size <= 10 then 0 when p_size > 10 and p_size <= 30 then 1 when p_size > 30 and p_size <= 45 then 2 end as band from part")
def range_bands(spark, d):
    return layout.bands(table(spark, d, "part"), [0.0, 10.0, 30.0, 45.0], "p_size").select("p_partkey", "band")


@query("split_words", "select p_partkey, 0 as place, split_part(p_name, ' ', 1) as word, round(10 + p_size * length(split_part(p_name, ' ', 1)) / length(p_name), 6) as word_right from part union all select p_partkey, 1, split_part(p_name, ' ', 2), round(10 + p_size, 6) from part")
def split_words(spark, d):
    items = table(spark, d, "part").select("p_partkey", "p_name", F.lit(10.0).alias("x0"), (F.lit(10.0) + F.col("p_size")).alias("x1"))
    return layout.split_words(items, ["p_partkey"], "p_name", "x0", "x1").select("p_partkey", "place", "word", F.round("right", 6).alias("word_right"))


@query("box_union", "select p_brand, min(least(p_size, p_retailprice)) / 100 as x0, max(greatest(p_size, p_retailprice)) / 100 as x1, min(p_size) / 200.0 as y0, max(p_size + 1) / 200.0 as y1 from part group by p_brand")
def box_union(spark, d):
    s, r = F.col("p_size").cast("double"), F.col("p_retailprice")
    boxes = table(spark, d, "part").select("p_brand", layout.box_of(F.array(s, s, r, s, r, s + 1, s, s + 1), F.lit(100.0), F.lit(200.0)).alias("box"))
    return boxes.groupBy("p_brand").agg(layout.union_box().alias("b")).select("p_brand", "b.*")


@query("note_row_role", "select p_partkey, case p_partkey % 4 when 0 then 'SUBTOTAL' when 1 then 'TOTAL' else 'LINE' end as role, case p_partkey % 4 when 0 then 'subtotal' when 1 then 'total' when 2 then 'per_share' end as excluded from part")
def note_row_role(spark, d):
    caption = F.concat(F.element_at(F.array(*map(F.lit, ("Sub-total ", "Total ", "Earnings per share ", ""))), (F.col("p_partkey") % 4 + 1).cast("int")), "p_name")
    role = residual.row_role(caption)
    return table(spark, d, "part").select("p_partkey", role.alias("role"), residual.exclusion(caption, role).alias("excluded"))


@query("section_placement", f"with {FACTS}, r as (select doc_id, ordinal, case when quantity > 45 then canonical_key end as own, case when page_index = 5 then canonical_key end as sub, case when page_index < 2 then canonical_key end as mapped from facts) select doc_id, ordinal, coalesce(own, first_value(sub ignore nulls) over (partition by doc_id order by ordinal rows between 1 following and unbounded following), last_value(mapped ignore nulls) over (partition by doc_id order by ordinal rows between unbounded preceding and 1 preceding)) as placed from r")
def section_placement(spark, d):
    k = F.col("canonical_key")
    rows = facts(spark, d, ordered=True).select("doc_id", "ordinal", F.when(F.col("quantity") > 45, k).alias("own"), F.when(F.col("page_index") == 5, k).alias("sub"), F.when(F.col("page_index") < 2, k).alias("mapped"))
    return residual.place_rows(rows, ["doc_id"], "ordinal", "own", "sub", "mapped").select("doc_id", "ordinal", "placed")


_SWEPT = f"{FACTS}, swept as (select doc_id, basis, period_label, split_part(canonical_key, '__', 1) || '__others' as canonical_key, cast(sum(value) as double) as figure, count(*) as components, cast(max(abs(value)) as double) as largest from facts where quantity < 20 group by all)"


@query("residual_sweep", f"with {_SWEPT} select * from swept")
def residual_sweep(spark, d):
    return _swept(spark, d).withColumns({c: F.col(c).cast("double") for c in ("figure", "largest")})


def _swept(spark, d):
    return residual.sweep(facts(spark, d), F.col("quantity") >= 20, F.split("canonical_key", "__")[0])


@query("residual_triggers", f"with {_SWEPT}, t as (select doc_id, basis, period_label, cast(sum(value) as double) as total, case when doc_id % 4 = 0 then 'unallocated_gap' end as status from facts where quantity >= 20 group by all) select doc_id, basis, period_label, canonical_key, concat_ws(',', case when abs(figure) > abs(total) * 0.05 then 'share' end, case when largest > abs(total) * 0.02 then 'component' end, case when components > 6 then 'count' end, case when figure * total < 0 then 'sign' end, case when status = 'unallocated_gap' then 'gap' end, case when total is null then 'no_total' end) as reasons from swept left join t using (doc_id, basis, period_label)")
def residual_triggers(spark, d):
    totals = facts(spark, d).where("quantity >= 20").groupBy("doc_id", "basis", "period_label").agg(F.sum("value").alias("total")).withColumn("status", F.when(F.col("doc_id") % 4 == 0, "unallocated_gap"))
    return residual.triggers(_swept(spark, d), totals).select("doc_id", "basis", "period_label", "canonical_key", "reasons")


@query("block_subtotal", f"with {FACTS}, i as (select doc_id, ordinal, quantity as printed, lead(quantity, 1) over w as one, lead(quantity, 2) over w as two from facts window w as (partition by doc_id order by ordinal)) select doc_id, ordinal, printed, one + two as total, abs(printed - one - two) <= 1 as ties from i where ordinal % 3 = 1 and one + two is not null")
def block_subtotal(spark, d):
    o = F.col("ordinal")
    items = facts(spark, d, ordered=True).select("doc_id", "ordinal", F.col("quantity").alias("value"), F.when(o % 3 == 1, F.array(o + 1, o + 2)).alias("component_ordinals"))
    return residual.block_subtotals(items)


@query("containment", f"with {GRID} select doc_id, basis, period_label, abs(cast({INV} as double) - coalesce(cast({REC} as double), 0) - coalesce(cast({OCA} as double), 0)) <= 20000 as explained from grid where {INV} is not null and coalesce({REC}, {OCA}) is not null")
def containment(spark, d):
    return residual.containment(_grid(spark, d), INV, (REC, OCA), 20000.0)


@query("bucket_vote", f"with {FACTS}, v as (select doc_id, split_part(canonical_key, '__', 1) as bucket, count(*) as n, min(ordinal) as p from facts group by all) select doc_id, bucket from (select *, row_number() over (partition by doc_id order by n desc, p) as k from v) where k = 1")
def bucket_vote(spark, d):
    rows = facts(spark, d, ordered=True).select("doc_id", F.split("canonical_key", "__")[0].alias("bucket"), F.col("ordinal").alias("place"))
    return residual.majority(rows, ["doc_id"], "bucket")


@query("bucket_segments", f"with {FACTS} select doc_id, split_part(canonical_key, '__', 1) as bucket, count(*) as items, count(distinct note_number) as notes, array_to_string(list_sort(list(distinct page_index)), ',') as pages from facts group by all")
def bucket_segments(spark, d):
    return facts(spark, d).groupBy("doc_id", F.split("canonical_key", "__")[0].alias("bucket")).agg(
        F.count("*").alias("items"), F.count_distinct("note_number").alias("notes"), F.array_join(F.transform(F.array_sort(F.collect_set("page_index")), lambda x: x.cast("string")), ",").alias("pages")
    )


@query("shared_notes", f"with {FACTS} select doc_id, note_number, count(distinct split_part(canonical_key, '__', 1)) as buckets from facts group by all having count(distinct split_part(canonical_key, '__', 1)) > 1")
def shared_notes(spark, d):
    return facts(spark, d).groupBy("doc_id", "note_number").agg(F.count_distinct(F.split("canonical_key", "__")[0]).alias("buckets")).where("buckets > 1")


@query("cited_notes", f"with {FACTS}, have as (select distinct doc_id, note_number || case when page_index < 3 then '(b)' else '' end as n from facts), cites as (select distinct doc_id, note_number || '(b)' as cited, note_number from facts) select c.doc_id, cited, case when a.n is not null then cited when b.n is not null then note_number end as note from cites c left join have a on a.doc_id = c.doc_id and a.n = cited left join have b on b.doc_id = c.doc_id and b.n = note_number")
def cited_notes(spark, d):
    f = facts(spark, d)
    have = f.select("doc_id", F.concat("note_number", F.when(F.col("page_index") < 3, "(b)").otherwise("")).alias("note_number"))
    return reconcile.resolve_citations(f.select("doc_id", F.concat("note_number", F.lit("(b)")).alias("cited")).distinct(), have)


@query("link_notes", f"with {FACTS}, l as (select distinct doc_id, canonical_key, note_number from facts where quantity > 30) select *, case when count(*) over (partition by doc_id, canonical_key) > 1 then 'MANY_NOTES' when count(*) over (partition by doc_id, note_number) > 1 then 'SPLITS' else 'ONE' end as relationship from l")
def link_notes(spark, d):
    return reconcile.link_kinds(facts(spark, d).where("quantity > 30").select("doc_id", "canonical_key", "note_number").distinct())


@query("balance_identity", f"with {GRID} select doc_id, basis, period_label, case when {CA_T} is null or {CL_T} is null then null when abs({CA_T} - {CL_T}) <= 5000 then 1.0 else 0.4 end as validation from grid")
def balance_identity(spark, d):
    a, b = F.col(CA_T), F.col(CL_T)
    return _grid(spark, d).select("doc_id", "basis", "period_label", F.when(a.isNull() | b.isNull(), None).when(F.abs(a - b) <= 5000, 1.0).otherwise(0.4).alias("validation"))


@query("blocked_sections", f"with {_RELATION} select doc_id, 'bs_current_assets' as section, array_to_string(list_sort(list(distinct basis || '/' || period_label)), ',') as slots from res where status = 'fail' group by doc_id")
def blocked_sections(spark, d):
    slot = F.concat_ws("/", "basis", "period_label")
    return _relation(spark, d).where("status = 'fail'").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(slot)), ",").alias("slots")).select("doc_id", F.lit("bs_current_assets").alias("section"), "slots")


@query("skip_reasons", f"with {_RELATION} select case when r.actual is null then 'target_missing' else 'components_missing' end as reason, count(*) as slots from res r where status = 'skipped' group by 1")
def skip_reasons(spark, d):
    return _relation(spark, d).where("status = 'skipped'").groupBy("reason").agg(F.count("*").alias("slots"))


@query("matrix_columns", "select p_brand, list_sort(list(p_size))[len(list(p_size)) // 2 + 1] as column_index, count(*) as cells from part group by p_brand having count(*) >= 2")
def matrix_columns(spark, d):
    xs = F.array_sort(F.collect_list("p_size"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.element_at(xs, F.floor(F.size(xs) / 2).cast("int") + 1).alias("column_index"), F.count("*").alias("cells")).where("cells >= 2")


@query("median_gap", "select p_brand, median(p_retailprice) as middle from part group by p_brand")
def median_gap(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.percentile("p_retailprice", 0.5).alias("middle"))


@query("note_order", "select distinct regexp_extract(p_brand, '[0-9]+') || case when p_size > 25 then '(b)' else '' end as note, cast(regexp_extract(p_brand, '[0-9]+') as int) as number, case when p_size > 25 then 'b' else '' end as suffix from part order by number, suffix")
def note_order(spark, d):
    n = table(spark, d, "part").select(F.concat(F.regexp_extract("p_brand", "[0-9]+", 0), F.when(F.col("p_size") > 25, "(b)").otherwise("")).alias("note")).distinct()
    key = numbers.note_sort(F.col("note"))
    return n.select("note", key["n"].alias("number"), key["s"].alias("suffix")).orderBy("number", "suffix")


@query("versions_latest", "select o_orderkey, o_orderkey = max_by(o_orderkey, o_orderkey) over (partition by o_custkey) as is_latest from orders")
def versions_latest(spark, d):
    return templates.with_latest(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey").select("o_orderkey", "is_latest")


@query("changed_keys", "select o_orderkey from orders where o_orderkey % 3 = 0 or o_orderkey % 11 = 0 or o_orderkey % 7 = 0")
def changed_keys(spark, d):
    o = table(spark, d, "orders")
    stored = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("value"))
    current = o.where("o_orderkey % 11 <> 0 or o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("value"))
    return templates.changed_keys(stored, current, ["o_orderkey"])


@query("template_problems", "select 'duplicate_key' as problem, cast(p_size as varchar) as key from part group by p_size having count(*) > 1 union select 'unknown_child', cast(p_size + 25 as varchar) from part where p_size + 25 not in (select p_size from part) union select 'self_child', cast(p_size as varchar) from part where p_size = 7")
def template_problems(spark, d):
    p = table(spark, d, "part")
    edges = p.select(F.col("p_size").cast("string").alias("parent"), (F.col("p_size") + 25).cast("string").alias("child")).union(p.where("p_size = 7").select(F.col("p_size").cast("string"), F.col("p_size").cast("string")))
    return templates.validate(p.select(F.col("p_size").cast("string").alias("key")), edges)


@query("sign_less_add", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_linenumber % 5 = 0 then l_quantity - 25 else case when l_returnflag = 'A' then -1 else 1 end * case l_linestatus when 'F' then -abs(l_quantity - 25) else abs(l_quantity - 25) end end as signed from lineitem")
def sign_less_add(spark, d):
    caption = F.concat(F.when(F.col("l_linestatus") == "F", "Less: ").otherwise("Add: "), F.lit("x"))
    signed = numbers.printed_sign(caption, F.col("l_quantity") - 25, F.col("l_returnflag") == "A", F.col("l_linenumber") % 5 == 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", signed.alias("signed"))


def _disclosure_sql(text: str) -> str:
    parts = []
    for family, patterns in DISCLOSURES.items():
        at = "coalesce(" + ", ".join(f"nullif(length(split_part({text}, regexp_extract({text}, '{p}'), 1)) + 1, case when regexp_matches({text}, '{p}') then 0 else length(split_part({text}, regexp_extract({text}, '{p}'), 1)) + 1 end)" for p in patterns) + ")"
        parts.append(f"select doc_id, '{family}' as family, {at} as found_at from p")
    return " union all ".join(parts)


@query("disclosure_scan", f"with p as (select conv_id as doc_id, turn, lower(text) as t, case when turn % 2 = 1 then (turn + 100)::varchar end as folio from _said), f as ({_disclosure_sql('t').replace('select doc_id, ', 'select doc_id, turn, folio, ')}) select doc_id, family, arg_min(coalesce(folio, (turn + 1)::varchar), turn) as page from f where found_at is not null group by doc_id, family".replace("_said", "(select conv_id, turn, text || case (conv_id + turn) % 5 when 0 then ' material uncertainty as to going concern' when 1 then ' Capital Commitments and guarantees' when 2 then ' a lawsuit and Qualified Opinion' else '' end as text from (select conv_id, turn, max(text) as text from conversations group by all))"))
def disclosure_scan(spark, d):
    """Turns of a conversation as pages; odd ones have a printed number."""
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    said = F.element_at(F.array(*map(F.lit, (" material uncertainty as to going concern", " Capital Commitments and guarantees", " a lawsuit and Qualified Opinion", "", ""))), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    folio = F.when(F.col("turn") % 2 == 1, (F.col("turn") + 100).cast("string"))
    pages = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), F.concat("text", said).alias("text"), folio.alias("folio"))
    return text.scan_disclosures(pages).select("doc_id", "family", "page")


@query("parse_rate", "select event_id, case when value > 5 then value end as rate from events")
def parse_rate(spark, d):
    printed = F.when(F.col("value") > 5, F.col("value").cast("string")).when(F.col("event_id") % 2 == 0, F.concat(F.lit("-"), F.col("value").cast("string"))).otherwise("n/a")
    return table(spark, d, "events").select("event_id", numbers.parse_rate(printed).cast("double").alias("rate"))


@query("alias_similarity")
def alias_similarity(spark, d):
    names = table(spark, d, "part").select("p_name").distinct()
    pairs = names.select("p_name", F.explode(F.array(*[F.lit(a) for a in sorted({a for c in rules.CONCEPTS for a in c.aliases})])).alias("alias"))
    return pairs.withColumn("score", F.round(templates.alias_similarity(F.col("p_name"), F.col("alias")), 6))


@query("summed_columns", f"with {FACTS} select doc_id, basis, period_label, cast(sum(value) as double) as total, count(distinct canonical_key) as concepts from facts group by all")
def summed_columns(spark, d):
    return facts(spark, d).groupBy("doc_id", "basis", "period_label").agg(F.sum("value").cast("double").alias("total"), F.count_distinct("canonical_key").alias("concepts"))


@query("effective_figures", f"with {FIGURES} select doc_id, canonical_key, basis, period_label, case when doc_id % 10 = 0 and period_label = 'current' then 1.0 else cast(figure as double) end as figure, doc_id % 10 = 0 and period_label = 'current' as edited from figures")
def effective_figures(spark, d):
    cells = values.concept_figures(facts(spark, d)).select(*values.CELL, F.col("figure").cast("double").alias("printed"))
    slots = F.when(F.col("doc_id") % 10 == 0, F.array(F.concat("basis", F.lit("/current"))))
    edited = F.coalesce(F.array_contains(slots, F.concat_ws("/", "basis", "period_label")), F.lit(False))
    return cells.select(*values.CELL, F.when(edited, 1.0).otherwise(F.col("printed")).alias("figure"), edited.alias("edited"))


_CONCEPTS = sorted({k for _, _, _, num, den in RATIOS for keys, _, _ in (*num, *den) for k in keys})
_EXPENSES = tuple(k for k in _CONCEPTS if k.startswith("pl_expenses") or "interest" in k or "repayment" in k or "purchase_of" in k)


def _book(spark, d):
    """Figures of every concept of the catalogue: a document's lines by part, expenses negative, some concepts missing in many documents."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    key = F.element_at(F.array(*map(F.lit, _CONCEPTS)), (F.col("l_partkey") % len(_CONCEPTS) + 1).cast("int"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc_id"), F.lit("consolidated").alias("basis"), F.when(F.col("l_returnflag") == "R", "prior").otherwise("current").alias("period_label"), key.alias("canonical_key"), "l_quantity")
    sums = rows.groupBy("doc_id", "basis", "period_label", "canonical_key").agg(F.sum("l_quantity").alias("q"))
    return values.grid_of(sums.withColumn("figure", F.when(F.col("canonical_key").isin(*_EXPENSES), -F.col("q")).otherwise(F.col("q"))), tuple(_CONCEPTS))


_BOOK = (
    "rows as (select o_custkey as doc_id, 'consolidated' as basis, case when l_returnflag = 'R' then 'prior' else 'current' end as period_label, l_partkey % " + str(len(_CONCEPTS)) + " as k, sum(l_quantity) as q from lineitem join orders on l_orderkey = o_orderkey group by all), "
    "book as (select doc_id, basis, period_label, " + ", ".join(f"max({'-' if k in _EXPENSES else ''}q) filter (where k = {i}) as {k}" for i, k in enumerate(_CONCEPTS)) + " from rows group by all)"
)


def _side_sql(terms) -> str:
    first = lambda keys: f"coalesce({', '.join(keys)}, null)"
    need = [f"{first(keys)} is not null" for keys, _, optional in terms if not optional] or [f"coalesce({', '.join(k for keys, _, _ in terms for k in keys)}, null) is not null"]
    total = " + ".join(f"coalesce({first(keys)}, 0) * {sign}" for keys, sign, _ in terms)
    return f"case when {' and '.join(need)} then {total} end"


_BOOK_RATIOS = f"{_BOOK}, r as (" + " union all ".join(f"select doc_id, basis, period_label, '{key}' as ratio_key, ({_side_sql(num)}) / nullif({_side_sql(den)}, 0) * {factor} as ratio from book" for key, factor, _, num, den in RATIOS) + ")"


@query("ratio_catalogue", f"with {_BOOK_RATIOS} select doc_id, basis, period_label, ratio_key, round(ratio, 6) + 0 as ratio from r where ratio is not null")
def ratio_catalogue(spark, d):
    """All ratios of the catalogue."""
    return analytics.ratios(_book(spark, d), CATALOGUE).where("ratio is not null").withColumn("ratio", F.round("ratio", 6))


_FACTOR_ROWS = ", ".join(f"('{c}', {i}, '{k}', {more}, {strong}, {weak})" for c, fs in CREDIT_FACTORS.items() for i, (k, more, strong, weak) in enumerate(fs))
_WEIGHTS = ", ".join(f"('{k}', {w})" for k, w in CREDIT_SIGNALS.items())
_SIGNALS = "signals as (select c_custkey as doc_id, case c_custkey % 6 when 0 then 'going_concern' when 1 then 'auditor_qualification' when 2 then 'litigation' when 3 then 'related_party' end as family from customer where c_custkey % 6 < 4 union all select c_custkey, 'guarantees' from customer where c_custkey % 6 = 2 union all select c_custkey, 'contingent_liabilities' from customer where c_custkey % 12 = 2)"


@query("credit_factors", f"with {_BOOK_RATIOS}, f(category, rank, ratio_key, more, strong, weak) as (values {_FACTOR_ROWS}), j as (select r.*, category, rank, more, strong, weak, cast(round(cast(ratio as decimal(30,10)), 2) as double) as v from r join f using (ratio_key) where ratio is not null) "
       "select doc_id, basis, period_label, category, arg_min(ratio_key, rank) as ratio_key, arg_min(v, rank) as ratio, arg_min(case when more then case when v >= strong then 1 when v < weak then -1 else 0 end else case when v <= strong then 1 when v > weak then -1 else 0 end end, rank) as tone from j group by all")
def credit_factors(spark, d):
    return analytics.credit_factors(analytics.ratios(_book(spark, d), CATALOGUE), CREDIT_FACTORS)


@query("credit_stance", ORACLE["credit_factors"].replace("with ", "with " + _SIGNALS + ", ", 1).replace("select doc_id, basis, period_label, category, arg_min", "factor as (select doc_id, basis, period_label, category, arg_min", 1).replace("from r join f using (ratio_key) where ratio is not null) ", "from r join f using (ratio_key) where ratio is not null), ", 1)
       + f"), w(family, weight) as (values {_WEIGHTS}), fl as (select doc_id, string_agg(family, ',' order by family) as flags, sum(weight) as penalty from signals join w using (family) group by doc_id), "
       "a as (select b.doc_id, b.basis, b.period_label, count(tone) as factors, count(*) filter (where tone > 0) as supportive, count(*) filter (where tone < 0) as constraining, avg(tone) as average from book b left join factor using (doc_id, basis, period_label) group by all) "
       "select a.doc_id, a.basis, a.period_label, factors, supportive, constraining, coalesce(flags, '') as flags, case when factors = 0 then 'insufficient' when contains(coalesce(flags, ''), 'going_concern') then 'weak' when average >= 0.5 and (contains(coalesce(flags, ''), 'auditor_qualification') or coalesce(penalty, 0) >= 3) then 'adequate' when average >= 0.5 then 'strong' when average >= -0.25 then 'adequate' else 'weak' end as stance from a left join fl using (doc_id)")
def credit_stance(spark, d):
    book = _book(spark, d)
    k = F.col("c_custkey") % 6
    family = F.when(k == 0, "going_concern").when(k == 1, "auditor_qualification").when(k == 2, "litigation").when(k == 3, "related_party")
    c = table(spark, d, "customer")
    more = F.array_compact(F.array(family, F.when(k == 2, "guarantees"), F.when(F.col("c_custkey") % 12 == 2, "contingent_liabilities")))
    signals = c.select(F.col("c_custkey").alias("doc_id"), F.explode(more).alias("family"))
    factors = analytics.credit_factors(analytics.ratios(book, CATALOGUE), CREDIT_FACTORS)
    return analytics.credit_stance(book.select("doc_id", "basis", "period_label"), factors, signals, CREDIT_SIGNALS)
