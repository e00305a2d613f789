"""Queries over what is served of stored results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import analytics, views
from tallyspark.plans.catalog import FACTS, query
from tallyspark.plans.catalog_cases import frame, told
from tallyspark.plans.catalog_more import _BOOK_RATIOS, _book
from tallyspark.plans.ratio_catalogue import CATALOGUE, DAYS, PERCENT, RATIOS
from tallyspark.sources.facts import facts, table


def _documents(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("owner"), F.col("o_orderdate").alias("created_at"))


@query("visible_documents", "select o_orderkey as doc_id from orders where o_orderpriority = '2-HIGH' order by o_orderdate desc, o_orderkey desc")
def visible_documents(spark, d):
    return views.visible(_documents(spark, d), "2-HIGH", "analyst").select("doc_id")


MAY = [("a", "viewer", False), ("b", "analyst", True), ("c", "reviewer", True), ("d", "admin", True), ("e", "guest", False), ("f", None, False)]


@query("permissions", told(MAY, "person, role, allowed"))
def permissions(spark, d):
    return views.may(frame(spark, [m[:2] for m in MAY], "person string, role string"), "edit")


@query("note_views", f"""with {FACTS}, n as (select doc_id, note_number, ordinal, page_index, source_label, period_label, quantity, case when ordinal % 3 = 0 then 'Note (Continued)' else 'Note ' || source_label end as title from facts) select doc_id, note_number, arg_min(title, ordinal) filter (where ordinal % 3 <> 0) as title, array_to_string(list_sort(list(distinct page_index)), ',') as pages, '[' || string_agg('{{"caption":"' || source_label || '","period":"' || period_label || '","value":"' || quantity::varchar || '"}}', ',' order by ordinal) || ']' as cells from n group by doc_id, note_number""")
def note_views(spark, d):
    f = facts(spark, d, ordered=True)
    title = F.when(F.col("ordinal") % 3 == 0, "Note (Continued)").otherwise(F.concat(F.lit("Note "), "source_label"))
    return views.note_views(f.select("doc_id", "note_number", title.alias("title"), "page_index", "ordinal", F.col("source_label").alias("caption"), "period_label", F.col("quantity").alias("value")))


_UNIT = {key: "%" if factor == PERCENT else "days" if factor == DAYS else "x" for key, factor, *_ in RATIOS}
_CATEGORY = {key: category for key, _, category, *_ in RATIOS}
_KINDS = ", ".join(f"('{k}', '{_CATEGORY[k]}', {views.CATEGORIES.index(_CATEGORY[k]) + 1}, '{_UNIT[k]}')" for k in _UNIT)


@query("indicators_view", f"with {_BOOK_RATIOS}, k(ratio_key, category, place, unit) as (values {_KINDS}) select doc_id, period_label, ratio_key, category, place, unit, ratio is not null as available, case when ratio is null then '—' end as dash from r join k using (ratio_key)")
def indicators_view(spark, d):
    rows = views.indicators_view(analytics.ratios(_book(spark, d), CATALOGUE), _CATEGORY, _UNIT)
    return rows.select("doc_id", "period_label", "ratio_key", "category", "place", "unit", F.col("ratio").isNotNull().alias("available"), F.when(F.col("shown") == "—", "—").alias("dash"))


@query("adopted_roles", f"with {FACTS} select doc_id, ordinal, case when page_index <> 2 and canonical_key = 'bs_current_assets__others' then 'subtotal' when page_index = 2 then 'header' else 'line' end as role from facts")
def adopted_roles(spark, d):
    lines = facts(spark, d, ordered=True).select("doc_id", "ordinal", "canonical_key", F.when(F.col("page_index") == 2, "header").otherwise("line").alias("role"))
    roles = frame(spark, [("bs_current_assets__others", "subtotal"), ("bs_current_assets__inventories", "line")], "canonical_key string, node_role string")
    return views.adopt_roles(lines, roles).select("doc_id", "ordinal", "role")


@query("fact_ids", f"with {FACTS} select doc_id, ordinal, doc_id || '|' || canonical_key || '|' || basis || '|' || period_label || '|' || case when page_index < 3 then page_index::varchar else '' end as id from facts")
def fact_ids(spark, d):
    page = F.when(F.col("page_index") < 3, F.col("page_index"))
    return facts(spark, d, ordered=True).select("doc_id", "ordinal", views.fact_id(F.col("doc_id"), F.col("canonical_key"), F.col("basis"), F.col("period_label"), page).alias("id"))


HEADINGS = [("EQUITY HOLDERS OF THE PARENT", "14", True), ("NON-CURRENT ASSETS", "2024,2023", True), ("Inventories", "14", False), ("TOTAL", "1200", False), ("NET", "0.5", False), ("権益", "14", False), ("REVENUE", "", False)]


@query("headings_with_note", told(HEADINGS, "caption, figures, heading"))
def headings_with_note(spark, d):
    rows = frame(spark, [h[:2] for h in HEADINGS], "caption string, figures string")
    figures = F.transform(F.filter(F.split("figures", ","), lambda x: x != ""), lambda x: x.cast("double"))
    return rows.select("caption", "figures", views.is_heading_with_note(F.col("caption"), figures).alias("heading"))


@query("shown_keys", "select p_name as key, min(p_partkey) as place from part where p_type = 'SMALL' group by p_name")
def shown_keys(spark, d):
    return views.shown_keys(table(spark, d, "part").select(F.col("p_partkey").alias("place"), F.col("p_type").alias("statement"), F.col("p_name").alias("key")), "SMALL")


@query("log_tail", "select o_custkey as doc_id, array_to_string(list_slice(l, greatest(len(l) - 2, 1), len(l)), ',') as lines from (select o_custkey, list(o_orderkey order by o_orderkey) as l from orders group by o_custkey)")
def log_tail(spark, d):
    logs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return logs.select("doc_id", F.array_join(F.transform(views.tail(F.col("l"), 3), lambda x: x.cast("string")), ",").alias("lines"))


@query("run_progress", "with s as (select user_id as run, event_type as stage, ascii(event_type) * 100 + ascii(substr(event_type, 2)) as place, arg_max(case when event_id % 3 = 0 then 'running' else 'done' end, ts) as status from events group by all) select run, count(*) filter (where status = 'done') as done, count(*) as total, arg_min(stage, place) filter (where status <> 'done') as current, cast(floor(count(*) filter (where status = 'done') * 100 / count(*)) as int) as percent from s group by run")
def run_progress(spark, d):
    kind = F.col("event_type")
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), kind.alias("stage"), (F.ascii(kind) * 100 + F.ascii(F.substring(kind, 2, 100))).alias("place"), F.when(F.col("event_id") % 3 == 0, "running").otherwise("done").alias("status"), F.col("ts").alias("at"))
    return views.progress(e)
