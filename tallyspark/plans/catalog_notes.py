"""Queries over faces, notes and document labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import documents as docs
from tallyspark.operators import notes
from tallyspark.plans import rules
from tallyspark.plans.catalog import FACTS, query
from tallyspark.sources.facts import facts, table

INV, REC, OCA, PAY, BOR, OCL = rules.LEAVES
SLOT = ["basis", "period_label"]


def _pick(col, *options):
    return F.element_at(F.array(*map(F.lit, options)), (F.col(col) % len(options) + 1).cast("int"))


def _pick_sql(col, *options):
    return f"case {col} % {len(options)} " + " ".join(f"when {i} then '{o}'" for i, o in enumerate(options)) + " end"


@query("section_of_key", f"with {FACTS} select distinct canonical_key, split_part(canonical_key[4:], '__', 1) as section, 'balance_sheet' as statement from facts")
def section_of_key(spark, d):
    key = F.col("canonical_key")
    return facts(spark, d).select(key).distinct().select(key, docs.section_of_key(key).alias("section"), docs.statement_of_key(key).alias("statement"))


@query("confidence_badge", "select o_orderkey, case when o_orderkey % 7 = 0 then 'med' when o_orderkey % 32 >= 27.2 then 'high' when o_orderkey % 32 >= 22.4 then 'med' else 'low' end as category, case when o_orderkey % 7 <> 0 then cast(round_even(o_orderkey % 32 * 3.125, 0) as int) end as percent from orders")
def confidence_badge(spark, d):
    c = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 32) / 32.0)
    return table(spark, d, "orders").select("o_orderkey", docs.badge(c).alias("b")).select("o_orderkey", "b.*")


@query("human_size", "select o_orderkey, case when o_orderkey * 64 >= 1048576 then format('{:.1f} MB', o_orderkey * 64 / 1048576) else greatest(1, o_orderkey * 64 // 1024) || ' KB' end as size from orders")
def human_size(spark, d):
    return table(spark, d, "orders").select("o_orderkey", docs.human_size(F.col("o_orderkey") * 64).alias("size"))


@query("citation", "select p_partkey, case when p_partkey % 3 = 0 then p_brand || '!C' || p_size when p_partkey % 3 = 1 then 'p.' || p_size else 'p.' || (p_partkey % 50 + 1) end as place from part")
def citation(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    return table(spark, d, "part").select("p_partkey", docs.citation(F.when(k == 0, F.col("p_brand")), F.concat(F.lit("C"), size), F.when(k == 1, size), F.col("p_partkey") % 50).alias("place"))


@query("run_ids", "select event_id, 'acme-' || event_type || '-' || strftime(date_trunc('hour', ts), '%Y%m%d-%H%M%S') || case when row_number() over w > 1 then '-' || row_number() over w else '' end as run_id from events window w as (partition by event_type, date_trunc('hour', ts) order by event_id)")
def run_ids(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.date_trunc("hour", "ts").alias("at"))
    return docs.run_ids(e, F.concat(F.lit("ACME / "), "event_type", F.lit(".")), "at", "event_id").select("event_id", "run_id")


@query("normalise_steps", "select p_partkey, p_name as caption from part")
def normalise_steps(spark, d):
    caption = F.concat(F.lit("(a) "), F.upper("p_name"), F.lit("†  （note "), F.col("p_size").cast("string"), F.lit("） ："))
    return table(spark, d, "part").select("p_partkey", docs.apply_steps(caption, ["width", "footnote", "trailing_colon", "numbering", "annotation", "case_fold", "whitespace"]).alias("caption"))


@query("entity_names", "select c_custkey as doc_id, 'ACME ' || c_mktsegment || ' Holdings' as entity from customer")
def entity_names(spark, d):
    page = F.concat(F.lit("Annual Report 2024\nNotes to the Group accounts\n ACME "), "c_mktsegment", F.lit(" Holdings / Annual Report 2024"))
    return docs.entity_names(table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_index"), page.alias("text")))


@query("printed_folio", "select l_orderkey as doc_id, l_linenumber as page_index, coalesce(min_by(l_suppkey % 900, struct_pack(a := 50 - l_quantity, b := cast(l_suppkey % 900 as varchar))) filter (where l_quantity >= 47), min_by(l_suppkey % 900, struct_pack(a := l_quantity, b := cast(l_suppkey % 900 as varchar))) filter (where l_quantity <= 3))::varchar as folio from lineitem where l_quantity >= 47 or l_quantity <= 3 group by all")
def printed_folio(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_index"), (F.col("l_quantity") / 50).alias("y"), F.concat(F.lit(" - "), (F.col("l_suppkey") % 900).cast("string"), F.lit(" -")).alias("text"))
    return docs.folios(lines)


# ---- faces and notes -----------------------------------------------------------------------------------------------

_FACE = f"{FACTS}, face as (select doc_id, basis, period_label, sum(quantity) as face from facts where page_index < 5 group by all), det as (select *, canonical_key = '{INV}' as mapped from facts where page_index >= 5)"


def _face(spark, d):
    return facts(spark, d).where("page_index < 5").groupBy("doc_id", *SLOT).agg(F.sum("quantity").alias("face"))


def _details(spark, d):
    rows = facts(spark, d, ordered=True).where("page_index >= 5")
    twice = rows.unionAll(rows.where("ordinal % 3 = 0"))
    return twice.select("doc_id", *SLOT, F.col("ordinal").alias("item_id"), F.col("quantity").alias("value"), (F.col("canonical_key") == INV).alias("mapped"))


@query("face_reconciliation", f"with {_FACE}, s as (select doc_id, basis, period_label, sum(quantity) as total, sum(quantity) filter (where mapped) as own from det group by all) select f.doc_id, f.basis, f.period_label, face - coalesce(own, 0) as reconciled, face - coalesce(total, 0) as residual, case when total is null then 'unconfirmed' when abs(face - total) <= greatest(1, abs(face) * 0.005) then 'tied' when abs(face - total) <= abs(face) * 0.05 then 'untied' else 'unconfirmed' end as status from face f left join s using (doc_id, basis, period_label)")
def face_reconciliation(spark, d):
    return notes.reconcile_face(_face(spark, d), _details(spark, d))


_SPLIT = (
    f"{FACTS}, it as (select doc_id, page_index % 2 as table_id, canonical_key as concept, basis, period_label, quantity as v from facts where canonical_key in ('{INV}','{REC}','{OCA}') and basis = 'standalone' and period_label = 'col2'), "
    "pa as (select doc_id, basis, period_label, case when doc_id % 3 = 0 then -sum(v) when doc_id % 3 = 1 then sum(v) filter (where table_id = 1) else sum(v) + 7 end as parent from it group by doc_id, basis, period_label), "
    "t as (select doc_id, table_id, sum(v) as total, count(distinct concept) as c from it group by all), "
    "one as (select doc_id, table_id, case when abs(parent - total) <= 1 then 1 else -1 end as o, count(*) over (partition by doc_id) as n from t join pa using (doc_id) where c >= 2 and least(abs(parent - total), abs(parent + total)) <= 1), "
    "al as (select doc_id, case when abs(parent - sum(v)) <= 1 then 1 else -1 end as o from it join pa using (doc_id) where doc_id not in (select doc_id from one) group by doc_id, parent having count(distinct concept) >= 2 and least(abs(parent - sum(v)), abs(parent + sum(v))) <= 1)"
)


def _aggregates(spark, d):
    it = facts(spark, d).where(F.col("canonical_key").isin(INV, REC, OCA) & (F.col("basis") == "standalone") & (F.col("period_label") == "col2"))
    it = it.select("doc_id", (F.col("page_index") % 2).alias("table_id"), F.col("canonical_key").alias("concept"), *SLOT, F.col("quantity").alias("value"))
    k, s = F.col("doc_id") % 3, F.sum("value")
    figure = F.when(k == 0, -s).when(k == 1, F.sum(F.when(F.col("table_id") == 1, F.col("value")))).otherwise(s + 7)
    return it.groupBy("doc_id", *SLOT).agg(figure.alias("parent")), it


@query("split_from_disclosure", f"with {_SPLIT} select it.doc_id, it.table_id, concept, basis, period_label, sum(v) * any_value(o) as figure from it join one on it.doc_id = one.doc_id and it.table_id = one.table_id where n = 1 group by all union all select it.doc_id, null, concept, basis, period_label, sum(v) * any_value(o) from it join al using (doc_id) group by all")
def split_from_disclosure(spark, d):
    return notes.split_from_disclosure(*_aggregates(spark, d))


_GRIDQ = f"{FACTS}, g as (select doc_id, basis, period_label, sum(quantity) filter (where canonical_key = '{INV}') as a, sum(quantity) filter (where canonical_key = '{REC}') as b, sum(quantity) filter (where canonical_key = '{OCA}') as c from facts group by all)"


def _gridq(spark, d):
    at = lambda k: F.sum(F.when(F.col("canonical_key") == k, F.col("quantity")))
    return facts(spark, d).groupBy("doc_id", *SLOT).agg(at(INV).alias("a"), at(REC).alias("b"), at(OCA).alias("c"))


@query("sole_components", f"with {_GRIDQ} select doc_id, basis, period_label, a as inferred from g where a is not null and doc_id not in (select doc_id from g where coalesce(b, c) is not null)")
def sole_components(spark, d):
    return notes.sole_components(_gridq(spark, d), "a", "b", ("c",))


@query("containment_enforced", f"with {_GRIDQ} select doc_id, basis, period_label, a as parent, case when b is not null or c is not null then coalesce(b, 0) + coalesce(c, 0) end as children, coalesce(abs(a - (case when b is not null or c is not null then coalesce(b, 0) + coalesce(c, 0) end)) <= 1, false) as explained from g where a is not null and doc_id in (select doc_id from g where coalesce(b, c) is not null)")
def containment_enforced(spark, d):
    return notes.enforce_containment(facts(spark, d), INV, (REC, OCA), "quantity")


@query("sign_suspect", f"with {_GRIDQ}, s as (select *, a - coalesce(b, 0) - coalesce(c, 0) as gap from g where a is not null and coalesce(b, c) is not null), f as (select *, list_filter(['b', 'c', 'a'], lambda x: case x when 'b' then coalesce(abs(gap + 2 * b) <= 6, false) when 'c' then coalesce(abs(gap + 2 * c) <= 6, false) else abs(gap - 2 * a) <= 6 end) as found from s where abs(gap) > 6) select doc_id, basis, period_label, case when len(found) = 1 then found[1] end as suspect from f")
def sign_suspect(spark, d):
    return notes.sign_suspect(_gridq(spark, d), "a", ("b", "c"), 6.0)


@query("sweep_notes", f"with {FACTS}, o as (select doc_id, note_number, min(split_part(canonical_key, '__', 1)) as section from facts where quantity > 40 group by all having count(distinct split_part(canonical_key, '__', 1)) = 1) select f.doc_id, section, basis, period_label, sum(quantity) as figure, count(*) as components from facts f join o using (doc_id, note_number) where quantity < 20 and section = 'bs_current_assets' group by all")
def sweep_notes(spark, d):
    f = facts(spark, d)
    cited = f.where("quantity > 40").select("doc_id", "note_number", F.split("canonical_key", "__")[0].alias("section"))
    return notes.sweep_notes(f.where("quantity < 20").withColumn("value", F.col("quantity")).select("doc_id", "note_number", *SLOT, "value"), cited, ("bs_current_assets",))


@query("plug_suspected", f"with {_FACE}, s as (select doc_id, basis, period_label, sum(quantity) as itemised from det group by all) select doc_id, basis, period_label, face as figure, coalesce(itemised, 0) as itemised, face - coalesce(itemised, 0) as excess from face left join s using (doc_id, basis, period_label) where abs(face - coalesce(itemised, 0)) > 10")
def plug_suspected(spark, d):
    det = facts(spark, d).where("page_index >= 5").withColumn("value", F.col("quantity"))
    return notes.plug_suspected(_face(spark, d).withColumnRenamed("face", "figure"), det, 10.0)


_ENTRIES = f"{FACTS}, e as (select doc_id, note_number, basis, period_label, min(canonical_key) as face_item, sum(quantity) as residual, case when sum(quantity) < 20 then 'tied' when sum(quantity) < 40 then 'untied' else 'unconfirmed' end as status from facts group by doc_id, note_number, basis, period_label)"


def _entries(spark, d):
    s = F.sum("quantity")
    status = F.when(s < 20, "tied").when(s < 40, "untied").otherwise("unconfirmed")
    return facts(spark, d).groupBy("doc_id", "note_number", *SLOT).agg(F.min("canonical_key").alias("face_item"), s.alias("residual"), status.alias("status"))


@query("best_entry_per_note", f"with {_ENTRIES} select doc_id, note_number, basis, period_label, status, residual from (select *, row_number() over (partition by doc_id, note_number order by basis <> 'consolidated', period_label <> 'current', abs(residual), basis, period_label) as k from e) where k = 1")
def best_entry_per_note(spark, d):
    return notes.best_entry_per_note(_entries(spark, d))


@query("note_summary", f"with {_ENTRIES}, c as (select doc_id, note_number, count(distinct face_item) as l, count(*) as n, count(*) filter (where status = 'tied') as t, count(*) filter (where status = 'untied') as u from e group by all) select doc_id, note_number, l || ' line(s), ' || t || ' of ' || n || ' column(s) tied' || case when u > 0 then ', ' || u || ' off' else '' end as summary from c")
def note_summary(spark, d):
    return notes.note_summary(_entries(spark, d))


@query("validation_caption", "select o_orderkey, case o_orderkey % 4 when 0 then 'Not validated: no check could run' when 1 then 'Failed checks: ' || o_orderkey % 9 when 2 then 'Checks not run: ' || o_orderkey % 11 end as caption from orders")
def validation_caption(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", notes.validation_caption(_pick("o_orderkey", "UNVALIDATED", "FAILED", "PARTIAL", "PASSED"), k % 9, k % 11).alias("caption"))
