"""Queries over gates, integrity, versions and trails."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import gates
from tallyspark.plans.catalog import FACTS, query
from tallyspark.sources.facts import facts, table

_PAGES = "pg as (select o_custkey as doc_id, o_orderkey as page_index, case when o_orderkey % 17 = 0 then 0 else o_orderkey % 300 end as chars, o_totalprice / 500000 as image, case when o_orderkey % 301 = 0 then 90 else 0 end as rotation, case when o_orderkey % 101 = 0 then 700.0 else 595.0 end as width from orders), pk as (select *, case when chars > 100 and image > 0.5 then 'MIXED' when chars > 100 then 'NATIVE' when image > 0.5 then 'SCANNED' else 'NATIVE' end as kind from pg)"


def _pages(spark, d):
    k = F.col("o_orderkey")
    p = table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), k.alias("page_index"), F.when(k % 17 == 0, 0).otherwise(k % 300).alias("chars"), (F.col("o_totalprice") / 500000).alias("image"),
        F.when(k % 301 == 0, 90).otherwise(0).alias("rotation"), F.when(k % 101 == 0, 700.0).otherwise(595.0).alias("width"), F.lit(842.0).alias("height"),
    )
    return p.withColumn("kind", gates.page_kind(F.col("chars"), F.lit(0.1), F.col("image")))


@query("page_kind", f"with {_PAGES} select page_index, kind from pk")
def page_kind(spark, d):
    return _pages(spark, d).select("page_index", "kind")


_DOCS = "dc as (select c_custkey as doc_id, case when c_custkey % 19 = 0 then 'unknown' else 'pdf' end as format from customer)"
_FOUND = (
    f"{_PAGES}, {_DOCS}, s as (select doc_id, count(*) as n, count(*) filter (where kind = 'SCANNED') as s, bool_or(rotation <> 0) as turned, bool_or(chars = 0 and kind <> 'SCANNED') as blank, count(distinct width) as sizes from pk group by doc_id), "
    "j as (select dc.doc_id, format, n, s, turned, blank, sizes from dc left join s using (doc_id)), f as (select doc_id, unnest(list_filter([case when format = 'unknown' then 'UNKNOWN_FORMAT' end, case when n is null then 'NO_PAGES' end, case when s > 0 and s < n then 'MIXED_SCAN' end, case when turned then 'ROTATED_PAGE' end, case when blank then 'BLANK_PAGE' end, case when sizes > 1 then 'INCONSISTENT_DIMENSIONS' end], lambda x: x is not null)) as finding from j)"
)


def _docs(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("doc_id"), F.when(k % 19 == 0, "unknown").otherwise("pdf").alias("format"))


@query("document_integrity", f"with {_FOUND} select doc_id, finding, case when finding in ('UNKNOWN_FORMAT', 'NO_PAGES') then 'blocker' else 'warning' end as severity from f")
def document_integrity(spark, d):
    return gates.integrity(_docs(spark, d), _pages(spark, d))


@query("unblocked_documents", f"with {_FOUND} select doc_id from dc where doc_id not in (select doc_id from f where finding in ('UNKNOWN_FORMAT', 'NO_PAGES'))")
def unblocked_documents(spark, d):
    docs = _docs(spark, d)
    return gates.unblocked(docs, gates.integrity(docs, _pages(spark, d))).select("doc_id")


@query("reclaim_faces", "with p as (select o_custkey as doc_id, o_orderkey as page_index, case o_orderstatus when 'F' then 'FACE' when 'O' then 'NOTES' else 'POST' end as state, o_orderkey % 5 = 0 as m from orders) select doc_id, page_index, case when state = 'NOTES' and not m and lag(state) over w = 'FACE' and lead(state) over w = 'FACE' then 'FACE' else state end as state from p window w as (partition by doc_id order by page_index)")
def reclaim_faces(spark, d):
    s = F.col("o_orderstatus")
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_index"), F.when(s == "F", "FACE").when(s == "O", "NOTES").otherwise("POST").alias("state"), (F.col("o_orderkey") % 5 == 0).alias("notes_mark"))
    return gates.reclaim_faces(p).drop("notes_mark")


@query("noise_rows", "select p_partkey, p_partkey % 3 <> 0 and p_size <= 31 as noise from part")
def noise_rows(spark, d):
    caption = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, "Year ended").otherwise("")
    noise = gates.is_noise_row(caption, F.array(F.col("p_size").cast("double"), F.lit(2024.0)), F.lit(False))
    return table(spark, d, "part").select("p_partkey", noise.alias("noise"))


@query("exclusive_class", "select p_partkey, p_partkey % 4 <> 3 and p_size % 3 <> 2 and p_partkey % 4 <> p_size % 3 and p_partkey % 4 < 2 as refused from part")
def exclusive_class(spark, d):
    pick = lambda c, n, *o: F.element_at(F.array(*map(F.lit, o)), (F.col(c) % n + 1).cast("int"))
    caption = pick("p_partkey", 4, "Net cash from operating activities", "Investing cash flows", "Operating and investing flows", "Other")
    key = pick("p_size", 3, "cf_operating_activities__x", "cf_investing_activities__y", "bs_equity__z")
    return table(spark, d, "part").select("p_partkey", gates.names_another_class(key, caption).alias("refused"))


@query("family_reroute", "select p_partkey, case when p_size % 3 = 0 then 'bs_current_liabilities__loans' when p_size % 3 = 1 then 'bs_non_current_liabilities__loans' else p_name end as canonical_key, case p_partkey % 3 when 0 then 'current' when 1 then 'non_current' end as banner_section, case when p_size % 3 = 2 then p_name when p_partkey % 3 = 0 then 'bs_current_liabilities__loans' when p_partkey % 3 = 1 then 'bs_non_current_liabilities__loans' when p_size % 3 = 0 then 'bs_current_liabilities__loans' else 'bs_non_current_liabilities__loans' end as routed from part")
def family_reroute(spark, d):
    keys = {"current": "bs_current_liabilities__loans", "non_current": "bs_non_current_liabilities__loans"}
    families = spark.createDataFrame([("loans", k, s) for s, k in keys.items()], "family string, key string, section string")
    s, p = F.col("p_size") % 3, F.col("p_partkey") % 3
    answers = table(spark, d, "part").select("p_partkey", F.when(s == 0, keys["current"]).when(s == 1, keys["non_current"]).otherwise(F.col("p_name")).alias("canonical_key"), F.when(p == 0, "current").when(p == 1, "non_current").alias("banner_section"))
    return gates.reroute(answers, families)


@query("computed_refusal", f"with {FACTS} select doc_id, ordinal, source_label like '%gizmo' as refused, case when source_label not like '%gizmo' then canonical_key end as canonical_key from facts")
def computed_refusal(spark, d):
    names = table(spark, d, "part").where("p_name like '%gizmo'").select(F.col("p_name").alias("norm"))
    mapped = facts(spark, d, ordered=True).select("doc_id", "ordinal", F.col("source_label").alias("norm"), "canonical_key")
    return gates.refuse_computed(mapped, names).select("doc_id", "ordinal", "refused", "canonical_key")


@query("batch_groups", f"with {FACTS}, r as (select doc_id, split_part(canonical_key, '__', 1) as statement, source_label as line, array_to_string(list_sort(list(distinct basis || '/' || period_label)), ',') as slots from facts group by all) select doc_id, statement, slots, count(*) as rows, min(line) as first from r group by all")
def batch_groups(spark, d):
    return gates.batch_groups(facts(spark, d).select("doc_id", F.split("canonical_key", "__")[0].alias("statement"), F.col("source_label").alias("line"), "basis", "period_label"))


@query("template_in_force", "with v as (select p_brand as name, max(p_size) as n from part group by p_brand), h as (select distinct p_brand as name, p_size as version from part), p as (select c_custkey as owner, 'Brand#' || (c_custkey % 60) as name, case when c_custkey % 2 = 0 then c_custkey % 53 end as pinned from customer) select owner, p.name, case when pinned is not null and h.version is null then null else coalesce(pinned, n) end as version, case when pinned is not null and h.version is null then 'missing' when pinned < n then 'superseded' when pinned is not null then 'pinned' when n is not null then 'in_force' else 'engine_default' end as label from p left join v using (name) left join h on h.name = p.name and h.version = pinned")
def template_in_force(spark, d):
    k = F.col("c_custkey")
    pins = table(spark, d, "customer").select(k.alias("owner"), F.concat(F.lit("Brand#"), (k % 60).cast("string")).alias("name"), F.when(k % 2 == 0, k % 53).alias("pinned"))
    return gates.in_force(pins, table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_size").cast("long").alias("version")))


@query("declared_statements", "select p_brand as template, p_type as statement, row_number() over (partition by p_brand order by min(p_partkey)) as place from part where p_type in ('SMALL', 'LARGE', 'PROMO') and p_size > 10 group by p_brand, p_type")
def declared_statements(spark, d):
    s = table(spark, d, "part").select(F.col("p_brand").alias("template"), F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("statement"), (F.col("p_size") > 10).cast("int").alias("n_sections"))
    return gates.declared_statements(s, ("SMALL", "LARGE", "PROMO"))


@query("self_vetoing", "select distinct p_type as key, p_name as alias, '^(hot|cold) ' as pattern from part where p_type in ('SMALL', 'PROMO') and regexp_matches(p_name, '^(hot|cold) ')")
def self_vetoing(spark, d):
    aliases = table(spark, d, "part").select(F.col("p_type").alias("key"), F.col("p_name").alias("alias")).distinct()
    return gates.self_vetoing(aliases, spark.createDataFrame([("SMALL", "^(hot|cold) "), ("PROMO", "^(hot|cold) ")], "key string, pattern string"))


@query("served_trail", "select event_id as entry, ts as at, case when event_id % 2 = 0 then 'live' else 'seeded' end as origin from events")
def served_trail(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("entry"), F.col("ts").alias("at"))
    return gates.trail(e.where("entry % 2 = 0").withColumn("origin", F.lit("live")), e.withColumn("origin", F.lit("seeded")))


@query("document_search", "with h as (select doc_id, instr(lower(text), '@') as found_at from documents where contains(text, '@') order by doc_id limit 21) select doc_id, found_at, count(*) over () > 20 as truncated from h order by doc_id limit 20")
def document_search(spark, d):
    return gates.search(table(spark, d, "documents"), "@", 20).select("doc_id", F.col("at").cast("long").alias("found_at"), "truncated")


@query("judgement_history", "with e as (select user_id as subject_key, event_type as digest, event_id, row_number() over (partition by user_id order by ts desc, event_type desc) as k, count(*) over (partition by user_id) as version from events) select subject_key, digest as judged, version from e where k = 1 and digest <> 'signup'")
def judgement_history(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("subject_key"), F.col("ts").alias("at"), F.col("event_type").alias("digest"), F.when(F.col("event_type") == "signup", "withdraw").otherwise("accept").alias("action"))
    return gates.apply_judgements(e)


@query("adopt_runs", "with r as (select o_custkey as doc_id, max(o_orderkey) filter (where o_orderstatus = 'F') as done, max(o_orderkey) filter (where o_orderstatus = 'P') as busy from orders group by o_custkey) select c_custkey as request, c_custkey as doc_id, coalesce(case when c_custkey % 2 = 0 then done end, busy) as run, case when c_custkey % 2 = 0 and done is not null then 'adopt' when busy is not null then 'conflict' else 'start' end as decision from customer left join r on doc_id = c_custkey")
def adopt_runs(spark, d):
    o, s = table(spark, d, "orders"), F.col("o_orderstatus")
    runs = o.select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("doc_id"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("options"), F.when(s == "F", "done").when(s == "P", "running").otherwise("failed").alias("status"))
    k = F.col("c_custkey")
    options = F.create_map(F.lit("b"), F.when(k % 2 == 0, "2").otherwise("3"), F.lit("a"), F.lit("1"))
    return gates.adopt_runs(table(spark, d, "customer").select(k.alias("request"), k.alias("doc_id"), options.alias("options")), runs)


_NODES = [(1, "assets", "bs_current_assets__inventories", "Inventories"), (2, "assets", "bs_current_assets__trade_receivables", "Trade receivables"), (3, "liabilities", "bs_current_liabilities__others", "Others"), (4, "equity", "bs_equity", "Equity")]


@query("statement_rows", f"with {FACTS}, n(place, section, key, label) as (values " + ", ".join(map(str, _NODES)) + "), c as (select doc_id, canonical_key as key, basis, period_label, sum(quantity) as printed, case when count(*) > 1 then sum(quantity) + 1 end as computed, min(page_index) = 0 as edited, min(quantity) / 50 as confidence from facts group by all), f as (select *, case when edited then printed else coalesce(computed, printed) end as v from c), g as (select doc_id, key, max(v) filter (where basis = 'consolidated' and period_label = 'current') as consolidated_current, max(v) filter (where basis = 'consolidated' and period_label = 'prior') as consolidated_prior, min(confidence) as confidence from f group by all) select d.doc_id, place, section, n.key, label, consolidated_current, consolidated_prior, confidence from (select distinct doc_id from facts) d, n left join g on g.doc_id = d.doc_id and g.key = n.key")
def statement_rows(spark, d):
    from tallyspark.sinks.rulebooks import statement_rows as rows

    s = F.sum("quantity")
    cells = facts(spark, d).groupBy("doc_id", F.col("canonical_key").alias("key"), "basis", "period_label").agg(s.alias("printed"), F.when(F.count("*") > 1, s + 1).alias("computed"), (F.min("page_index") == 0).alias("edited"), (F.min("quantity") / 50).alias("confidence"))
    return rows(cells, spark.createDataFrame(_NODES, "place int, section string, key string, label string"), [("consolidated", "current"), ("consolidated", "prior")])
