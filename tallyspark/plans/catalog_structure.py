"""Queries over declared relations, rulebooks, pages read as a whole, overlays and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import analytics, export, overlays, rulebooks, scan, structure, values
from tallyspark.operators.narrative import check_relations
from tallyspark.plans import rules
from tallyspark.plans.catalog import FACTS, FIGURES, GRID, _grid, _keep, _ratio_sql, query
from tallyspark.plans.catalog_cases import frame, told
from tallyspark.plans.catalog_more import _BOOK, _book
from tallyspark.plans.ratio_catalogue import RATIOS
from tallyspark.sources.facts import facts, table

INV, REC, OCA, PAY, BOR, OCL = rules.LEAVES
CA_T, CL_T, NET = rules.ROLLUPS[1][0], rules.ROLLUPS[2][0], "bs_net_current"
CONCEPTS = [
    ("a_sub", "bs_s2_current_assets", "subtotal", None, 5, 0), ("a_total", "bs_s2_current_assets", "subtotal", None, 9, 1), (INV, "bs_s2_current_assets", "balance", None, 1, 2), (REC, "bs_s2_current_assets", "balance", None, None, 3),
    (OCA, "bs_s2_current_assets", "balance", "exclusive_residual", None, 4), (PAY, "bs_s5_current_liabilities", "balance", None, 1, 5), ("loose", None, "balance", None, 1, 6),
]
_CONCEPT = "key string, section string, unit_of_account string, value_scope string, priority int, place int"


@query("section_members", told([
    ("bs_s2_current_assets", "a_sub", "subtotal", 1), ("bs_s2_current_assets", "a_total", "subtotal", 2), ("bs_s2_current_assets", INV, "dedicated", 2), ("bs_s2_current_assets", REC, "dedicated", 1),
    ("bs_s2_current_assets", OCA, "residual", 1), ("bs_s5_current_liabilities", PAY, "dedicated", 1),
], "section, key, part, rank"))
def section_members(spark, d):
    return structure.section_members(frame(spark, CONCEPTS, _CONCEPT))


_SECTION = "bs_s2_current_assets"


@query("section_reconciliation", f"with {FIGURES}, f as (select doc_id, basis, period_label, max(figure) filter (where canonical_key = '{INV}')::double as i, max(figure) filter (where canonical_key = '{REC}')::double as r, max(figure) filter (where canonical_key = '{BOR}')::double as hi, max(figure) filter (where canonical_key = '{OCL}')::double as lo from figures where canonical_key in ('{INV}','{REC}','{BOR}','{OCL}') group by all), "
       f"c as (select doc_id, basis, period_label, sum(value)::double as residual, count(*) as c from facts where canonical_key = '{OCA}' group by all), j as (select doc_id, basis, period_label, f.* exclude (doc_id, basis, period_label), residual, coalesce(c, 0) as c from f full join c using (doc_id, basis, period_label)), "
       f"s as (select *, case when hi is not null then '{BOR}' when lo is not null then '{OCL}' end as subtotal, coalesce(hi, lo) as reported, case when coalesce(i, r) is not null then coalesce(i, 0) + coalesce(r, 0) end as dedicated, (i is not null)::int + (r is not null)::int + c + (coalesce(hi, lo) is not null)::int as rows from j) "
       "select doc_id, basis, period_label, subtotal, round(reported - coalesce(dedicated, 0) - coalesce(residual, 0), 2) + 0 as difference, rows, case when subtotal is null then 'no_reported_subtotal' when abs(reported - coalesce(dedicated, 0) - coalesce(residual, 0)) <= rows * 10000 then 'tied' else 'unallocated_gap' end as status from s")
def section_reconciliation(spark, d):
    """Borrowings, else other liabilities, stand for the printed subtotal of a section of inventories and receivables; other assets are its swept lines."""
    members = frame(spark, [(_SECTION, OCL, "subtotal", 1), (_SECTION, BOR, "subtotal", 2), (_SECTION, INV, "dedicated", 1), (_SECTION, REC, "dedicated", 2)], "section string, key string, part string, rank int")
    f = facts(spark, d)
    swept = f.where(F.col("canonical_key") == OCA).select("doc_id", "basis", "period_label", F.lit(_SECTION).alias("section"), "value")
    found = structure.reconcile_sections(values.concept_figures(f), members, swept, 10000.0)
    return found.select("doc_id", "basis", "period_label", "subtotal", F.round("difference", 2).alias("difference"), "rows", "status")


IDENTITIES = {"net": "net = assets - debts", "sum": "assets = + a + b", "odd": "assets == a", "lost": "net = assets - ghosts", "twice": "net = a + a"}


@query("parse_identities", told([("net", "K_net", "K_assets:1,K_debts:-1", ""), ("sum", "K_assets", "K_a:1,K_b:1", ""), ("odd", "", "", "unparsable_expr"), ("lost", "K_net", "K_assets:1", "unresolved_terms"), ("twice", "K_net", "K_a:1,K_a:1", "repeated_term")], "id, target, terms, broken"))
def parse_identities(spark, d):
    found = structure.parse_identities(IDENTITIES, {k: f"K_{k}" for k in ("net", "assets", "debts", "a", "b")})
    return frame(spark, [(r.id, r.target, ",".join(f"{k}:{s}" for k, s in r.terms), r.broken) for r in found], "id string, target string, terms string, broken string")


@query("identities_checked", f"with {GRID}, s as (select doc_id, basis, period_label, cast({NET} as double) + case when doc_id % 3 = 0 then 5 else 0 end as a, cast({CA_T} as double) as x, cast({CL_T} as double) as y from grid) select doc_id, basis, period_label, case when a is null then 'target_missing' when coalesce(x, y) is null then 'all_missing' when x is null or y is null then 'components_missing' end as reason, case when a is null or x is null or y is null then 'skipped' when abs(a - (x - y)) <= greatest(1, abs(x - y) * 0.0000001) then 'pass' else 'fail' end as status from s")
def identities_checked(spark, d):
    """A parsed identity over the documents' figures."""
    (r,) = structure.parse_identities({"net": "net = assets - debts"}, {"net": NET, "assets": CA_T, "debts": CL_T})
    g = _grid(spark, d).withColumn(NET, F.col(NET).cast("double") + F.when(F.col("doc_id") % 3 == 0, 5).otherwise(0))
    cells = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("figure")) for k in (NET, CA_T, CL_T)])
    figures = g.select("doc_id", "basis", "period_label", F.inline(cells)).withColumns({"scale": F.lit(1.0), "derived": F.lit(False)})
    terms = frame(spark, [(r.id, r.target, 0), *((r.id, k, s) for k, s in r.terms)], "rule string, key string, sign int")
    made = frame(spark, [(r.id, "bs", "sum", bool(r.broken), False)], "rule string, statement string, op string, broken boolean, nil boolean")
    return check_relations(figures, terms, made, 1.0, 0.0000001).select("doc_id", "basis", "period_label", "reason", "status")


NODES = [("ca", 1, None, "header"), ("ca", 2, "inv", "line"), ("ca", 3, "sub", "subtotal"), ("ca", 4, "cash", "line"), ("ca", 5, "tot", "total"), ("top", 1, "assets", "total"), ("open", 1, "x", "line")]


@query("section_relations", told([("ca", "tot", "inv,cash", None), ("open", None, "x", "no_reported_subtotal")], "section, target, members, broken"))
def section_relations(spark, d):
    found = structure.section_relations(frame(spark, NODES, "section string, place int, key string, role string"))
    return found.select("section", "target", F.array_join("members", ",").alias("members"), "broken")


@query("capped_validation", f"with {FIGURES}, r as (select doc_id, basis, period_label from figures where canonical_key = '{INV}' and figure > 100000) select f.doc_id, f.canonical_key, f.basis, f.period_label, "
       f"case when canonical_key in ('{INV}', '{REC}') and r.doc_id is not null and f.doc_id % 2 = 0 or canonical_key = '{OCA}' and f.doc_id % 5 = 0 and f.doc_id in (select doc_id from r) then least(0.5, case when f.doc_id % 3 = 0 then 0.4 else 1.0 end) when f.doc_id % 3 = 0 then 0.4 end as validation, "
       f"concat_ws(',', case when canonical_key = '{OCA}' and f.doc_id % 5 = 0 and f.doc_id in (select doc_id from r) then 'section_unreconciled' end, case when canonical_key in ('{INV}', '{REC}') and r.doc_id is not null and f.doc_id % 2 = 0 or canonical_key = '{OCA}' and f.doc_id % 5 = 0 and f.doc_id in (select doc_id from r) then 'structural_mismatch' end, case when canonical_key in ('{INV}', '{REC}') and r.doc_id is not null and f.doc_id % 2 = 1 then 'structural_warning' end) as flags "
       "from figures f left join r on r.doc_id = f.doc_id and r.basis = f.basis and r.period_label = f.period_label")
def capped_validation(spark, d):
    f = values.concept_figures(facts(spark, d))
    wide = f.where((F.col("canonical_key") == INV) & (F.col("figure") > 100000)).select("doc_id", "basis", "period_label")
    relations = wide.select("*", F.array(F.lit(INV), F.lit(REC)).alias("keys"), F.lit("fail").alias("status"), F.when(F.col("doc_id") % 2 == 0, "blocking").otherwise("warning").alias("severity"), F.lit(None).cast("string").alias("section"))
    sections = wide.where("doc_id % 5 = 0").select("*", F.array(F.lit(OCA)).alias("keys"), F.lit("fail").alias("status"), F.lit("section").alias("severity"), F.lit("ca").alias("section"))
    rows = f.select(*values.CELL, F.when(F.col("doc_id") % 3 == 0, 0.4).alias("validation"))
    found = structure.cap_validation(rows, relations.unionByName(sections.withColumn("basis", F.lit("x"))))
    return found.select("doc_id", "canonical_key", "basis", "period_label", "validation", "flags")


_DIO = next(r for r in RATIOS if r[0] == "dio")


@query("ratio_explained", f"with {_BOOK} select doc_id, period_label, 'numerator' as side, 'bs_current_assets__inventories' as key, 1 as sign, bs_current_assets__inventories as figure from book union all select doc_id, period_label, 'denominator', case when pl_expenses__cost_of_goods_sold is null and pl_expenses__total_operating_cost is not null then 'pl_expenses__total_operating_cost' else 'pl_expenses__cost_of_goods_sold' end, -1, coalesce(pl_expenses__cost_of_goods_sold, pl_expenses__total_operating_cost) from book")
def ratio_explained(spark, d):
    return structure.explained(_book(spark, d), "dio", _DIO[3:]).select("doc_id", "period_label", "side", "key", "sign", "figure")


@query("review_cards", "with c as (select o_custkey as doc_id, o_orderpriority as target, o_orderstatus as slot, round(o_totalprice, 2) as difference, o_orderkey from orders) select o_orderkey from c where not exists (select 1 from c a where a.o_orderkey % 4 = 0 and a.doc_id = c.doc_id and a.target = c.target and a.slot = c.slot and a.difference = c.difference)")
def review_cards(spark, d):
    cards = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("slot"), F.col("o_totalprice").alias("difference"), "o_orderkey")
    return structure.review_cards(cards, cards.where("o_orderkey % 4 = 0")).select("o_orderkey")


@query("leftover_lines", f"with {FACTS} select doc_id, ordinal from facts where basis = 'standalone' and canonical_key not in ('{INV}', '{REC}') and page_index <> 4")
def leftover_lines(spark, d):
    rows = facts(spark, d, ordered=True).withColumn("matrix", F.col("page_index") == 4)
    return structure.leftovers(rows, (INV, REC), "standalone").select("doc_id", "ordinal")


# ---- rulebooks -----------------------------------------------------------------------------------------------------

TEMPLATE = {"statements": [
    {"type": "bs", "sections": [{"node_id": "ca", "children": [{"node_id": "inv", "canonical_key": "K_inv", "role": "line"}, {"node_id": "sub", "children": [{"node_id": "x", "canonical_key": "K_x"}]}]}, {"node_id": "top", "canonical_key": "K_top", "role": "total"}]},
    {"type": "cf", "sections": []},
]}


@query("template_walk", told([(0, "bs", "ca", None, None), (1, "bs", "inv", "ca", "K_inv"), (2, "bs", "sub", "ca", None), (3, "bs", "x", "sub", "K_x"), (4, "bs", "top", None, "K_top")], "place, statement, node, parent, key"))
def template_walk(spark, d):
    return frame(spark, [(i, *row[:4]) for i, row in enumerate(rulebooks.walk(TEMPLATE))], "place int, statement string, node string, parent string, key string")


RULEBOOK = {"section_defaults": {"ca": {"statement": "bs", "priority": 3}}, "mappings": [{"canonical_key": "a", "inherits": "ca", "priority": 9}, {"canonical_key": "b", "inherits": "ca"}, {"canonical_key": "c"}]}


@query("resolved_inherits", told([("a", "bs", 9), ("b", "bs", 3), ("c", None, None)], "key, statement, priority"))
def resolved_inherits(spark, d):
    found = rulebooks.resolve_inherits(RULEBOOK)["mappings"]
    return frame(spark, [(c["canonical_key"], c.get("statement"), c.get("priority")) for c in found], "key string, statement string, priority int")


SCHEMA = {"name": "", "mappings": [{"canonical_key": "", "aliases": []}], "validation": {"rules": []}}
GIVEN = {"name": "x", "mapings": [], "mappings": [{"canonical_key": "a", "alias": []}, {"aliases": [], "canonical_key": "b", "inherits": "ca"}], "validation": {"rules": [], "rulez": 1}}


@query("unknown_keys", told([("mapings",), ("mappings[0].alias",), ("mappings[1].inherits",), ("validation.rulez",)], "path"))
def unknown_keys(spark, d):
    return frame(spark, [(p,) for p in rulebooks.unknown_keys(GIVEN, SCHEMA)], "path string")


TERMS = [("net_debt", "debt", "intermediate"), ("net_debt", "cash", "intermediate"), ("capital", "employed", "intermediate"), ("employed", "capital", "intermediate"), ("gearing", "net_debt", "ratio"), ("gearing", "ghost", "ratio"), ("roce", "capital", "ratio")]


@query("kpi_problems", told([("capital", "cycle"), ("employed", "cycle"), ("gearing", "unknown ghost")], "location, problem"))
def kpi_problems(spark, d):
    return rulebooks.kpi_problems(frame(spark, [("debt",), ("cash",)], "key string"), frame(spark, TERMS, "owner string, key string, kind string"))


@query("rulebook_against_template", "select 'mapping:' || p_name as location, 'unknown key' as problem from (select distinct p_name from part) where p_name not like 'red%' union select 'mapping:' || p_name, 'unknown bucket' from part where p_name like '%bolt' union select 'decomposition:d2', 'unknown face key'")
def rulebook_against_template(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("key")).distinct()
    concepts = names.withColumn("bucket", F.when(F.col("key").endswith("bolt"), "bolts").when(F.col("key").endswith("gear"), "equity"))
    some = names.where(F.col("key").startswith("red"))
    return rulebooks.against_template(concepts, frame(spark, [("d1", some.first()["key"]), ("d2", "nothing")], "id string, face_key string"), some)


@query("rulebook_parity", "with l as (select 's' || p_partkey % 2 as source, p_name as key, ['en', 'zh', 'ar', 'fr'][p_size % 4 + 1] as language from part), w as (select key, s || '/' || x as w from (select distinct key from l), (values ('s0'), ('s1')) a(s), (values ('en'), ('zh'), ('ar'), ('fr')) b(x)), m as (select w.key, w from w where not exists (select 1 from l where l.key = w.key and l.source || '/' || l.language = w)) select k.key, count(w) = 0 as at_par, count(w) as lacking from (select distinct key from l) k left join m using (key) group by k.key")
def rulebook_parity(spark, d):
    language = F.element_at(F.array(*map(F.lit, rulebooks.LANGUAGES)), (F.col("p_size") % 4 + 1).cast("int"))
    labels = table(spark, d, "part").select(F.concat(F.lit("s"), (F.col("p_partkey") % 2).cast("string")).alias("source"), F.col("p_name").alias("key"), language.alias("language"), F.lit("label").alias("text"))
    found = rulebooks.parity(labels, ("s0", "s1"))
    return found.select("key", "at_par", F.when(F.col("missing") == "", 0).otherwise(F.size(F.split("missing", ","))).alias("lacking"))


LOCAL = [("a", "fr", "le a"), ("b", "fr", "b"), ("a", "ar", "a"), ("c", "fr", None)]


@query("localized_labels", told(LOCAL, "key, language, label"))
def localized_labels(spark, d):
    rows = frame(spark, [("a", {"en": "a", "fr": "le a"}), ("b", {"en": "b"}), ("c", {})], "key string, labels map<string,string>")
    asked = frame(spark, [x[:2] for x in LOCAL], "key string, language string")
    return asked.join(rows, "key").select("key", "language", rulebooks.localized(F.col("labels"), F.col("language")).alias("label"))


# ---- pages read as a whole -----------------------------------------------------------------------------------------

#: Lines of two pages, each of (x of the first word, words).
FACE_PAGE = [
    [(0.1, "ACME Limited Annual Report 2024")], [(0.5, "Group"), (0.74, "Company")], [(0.4, "Note"), (0.48, "2024"), (0.58, "2023"), (0.7, "2024"), (0.8, "2023")], [(0.5, "RMB'000")], [(0.1, "CURRENT ASSETS")],
    [(0.1, "Inventories"), (0.41, "14"), (0.48, "1,200"), (0.58, "1,100"), (0.7, "900"), (0.8, "800")], [(0.1, "Trade receivables and other")], [(0.1, "amounts"), (0.41, "15"), (0.48, "2,500"), (0.58, "(2,400)"), (0.7, "100"), (0.8, "–")],
    [(0.1, "Cash"), (0.48, "300"), (0.58, "200"), (0.7, "50"), (0.8, "40")], [(0.1, "NON-CURRENT LIABILITIES")], [(0.1, "Bank loans"), (0.41, "20"), (0.48, "5,000"), (0.58, "4,000"), (0.7, "10"), (0.8, "20")],
]
NOTE_PAGE = [[(0.1, "Staff costs:")], [(0.12, "Wages"), (0.6, "100"), (0.8, "90")], [(0.12, "Pensions"), (0.6, "20"), (0.8, "10")], [(0.6, "120"), (0.8, "100")], [(0.1, "Auditors' remuneration"), (0.6, "7"), (0.8, "6")]]
_CA, _NCL, _STAFF = "CURRENT ASSETS", "NON-CURRENT LIABILITIES", "Staff costs:"
_SLOTS4 = (("consolidated", "current"), ("consolidated", "prior"), ("standalone", "current"), ("standalone", "prior"))
#: page, line, caption, section, group, role, components, note, basis, period, value
READ = [
    *((0, o, label, s, "", "line", "", n, b, p, v) for o, label, s, n, vs in (
        (0, "Inventories", _CA, "14", (1200.0, 1100.0, 900.0, 800.0)), (1, "Trade receivables and other amounts", _CA, "15", (2500.0, -2400.0, 100.0, None)), (2, "Cash", _CA, None, (300.0, 200.0, 50.0, 40.0)), (3, "Bank loans", _NCL, "20", (5000.0, 4000.0, 10.0, 20.0)),
    ) for (b, p), v in zip(_SLOTS4, vs, strict=True) if v is not None),
    *((1, o, label, None, _STAFF, role, parts, None, "standalone", p, v) for o, label, role, parts, vs in (
        (0, "Wages", "line", "", (100.0, 90.0)), (1, "Pensions", "line", "", (20.0, 10.0)), (2, "Staff costs", "subtotal", "0,1", (120.0, 100.0)), (3, "Auditors' remuneration", "line", "", (7.0, 6.0)),
    ) for p, v in zip(("current", "prior"), vs, strict=True)),
]


def page_words(lines) -> list[tuple]:
    out = []
    for i, line in enumerate(lines):
        y = 0.05 + i * 0.02
        for x, text in line:
            for w in text.split():
                out.append((x, x + 0.008 * len(w), y, y + 0.012, w))
                x += 0.008 * len(w) + 0.006
    return out


@query("page_facts", "select c_custkey as doc_id, t.* from customer, (" + told(READ, "page_index, ordinal, label, section, group_hint, role, components, note, basis, period_label, value") + ") t")
def page_facts(spark, d):
    """Every customer's document has the same two pages."""
    rows = [(i, *w, on_face, scope) for i, (lines, on_face, scope) in enumerate(((FACE_PAGE, True, None), (NOTE_PAGE, False, "company"))) for w in page_words(lines)]
    words = frame(spark, rows, "page_index int, x0 double, x1 double, y0 double, y1 double, text string, on_face boolean, scope string")
    array = [F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(words.columns, ("int", "double", "double", "double", "double", "string", "boolean", "string"), r, strict=True)]) for r in rows]
    return scan.page_facts(table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("doc_id"), F.inline(F.array(*array))))


# ---- overlays ------------------------------------------------------------------------------------------------------


@query("rate_master", "with c as (select upper(substr(event_type, 1, 3)) as base, case user_id % 4 when 0 then 'USD' when 1 then 'EUR' when 2 then 'eu' else upper(substr(event_type, 1, 3)) end as quote, cast(ts as date) as as_of, value as rate, event_id % 6 = 0 as gone, ts as t, event_id as id from events), ok as (select * from c where gone or length(quote) = 3 and base <> quote and rate > 0), l as (select *, row_number() over w as k, count(*) over (partition by base, quote, as_of) as changes from ok window w as (partition by base, quote, as_of order by t desc, id desc)) select base, quote, as_of::varchar as as_of, rate, changes from l where k = 1 and not gone")
def rate_master(spark, d):
    e = table(spark, d, "events")
    base = F.upper(F.substring("event_type", 1, 3))
    k = F.col("user_id") % 4
    changes = e.select(base.alias("base"), F.when(k == 0, "USD").when(k == 1, "EUR").when(k == 2, "eu").otherwise(base).alias("quote"), F.to_date("ts").alias("as_of"), F.col("value").cast("string").alias("rate"), F.when(F.col("event_id") % 6 == 0, "delete").otherwise("put").alias("action"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return overlays.rate_master(changes).withColumn("as_of", F.col("as_of").cast("string"))


_CHOSEN = "p as (select o_custkey as doc_id, o_orderkey as page_index, case o_orderstatus when 'F' then 'FACE' when 'P' then 'NOTES' else 'OTHER' end as kind from orders), c as (select doc_id, list(page_index) filter (where page_index % 3 = 0) as chosen from p where doc_id % 2 = 0 group by doc_id), s as (select p.*, case when len(chosen) > 0 then list_contains(chosen, page_index) else kind in ('FACE', 'NOTES') end as included from p left join c using (doc_id))"


def _selected(spark, d):
    s = F.col("o_orderstatus")
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_index"), F.when(s == "F", "FACE").when(s == "P", "NOTES").otherwise("OTHER").alias("kind"))
    chosen = p.where("doc_id % 2 = 0").groupBy("doc_id").agg(F.collect_list(F.when(F.col("page_index") % 3 == 0, F.col("page_index"))).alias("chosen"), F.lit(2).alias("at"))
    return overlays.selected_pages(p, chosen.unionByName(chosen.select("doc_id", F.array(F.lit(1)).cast(chosen.schema["chosen"].dataType).alias("chosen"), F.lit(1).alias("at"))))


@query("selected_pages", f"with {_CHOSEN} select doc_id, page_index, included from s")
def selected_pages(spark, d):
    return _selected(spark, d)


@query("selection_counts", f"with {_CHOSEN} select doc_id, count(*) as pages, count(*) filter (where included) as focused, count(*) filter (where not included) as skipped from s group by doc_id")
def selection_counts(spark, d):
    return overlays.scope_counts(_selected(spark, d))


_LINES = f"{FACTS}, l as (select doc_id, ordinal as line, page_index || ':' || (ordinal % 7)::varchar || ':0' as anchor, canonical_key from facts)"


def _anchored(spark, d):
    f = facts(spark, d, ordered=True)
    return f.select("doc_id", F.col("ordinal").alias("line"), overlays.anchor(F.col("page_index"), (F.col("ordinal") % 7) / 100.0 + 0.001, F.lit(0.001)).alias("anchor"), "canonical_key")


@query("refiled_rows", f"with {_LINES}, o as (select distinct doc_id, anchor from l where line % 5 = 0), n as (select *, count(*) over (partition by doc_id, anchor) as n from l) select n.doc_id, line, case when o.doc_id is not null and n = 1 then 'moved' else canonical_key end as canonical_key, case when o.doc_id is not null then case when n = 1 then 'refiled' else 'ambiguous' end end as outcome from n left join o on o.doc_id = n.doc_id and o.anchor = n.anchor")
def refiled_rows(spark, d):
    rows = _anchored(spark, d)
    orders = rows.where("line % 5 = 0").select("doc_id", "anchor", F.lit("moved").alias("to_key"), F.lit(2).alias("at"))
    old = orders.withColumns({"to_key": F.lit("old"), "at": F.lit(1)})
    return overlays.refile(rows, orders.unionByName(old)).drop("anchor")


RANKED = [("open", 3), ("conflict", 1), ("accepted", 4), ("stale", 2), ("other", 0)]


@query("judgement_rank", told(RANKED, "status, place"))
def judgement_rank(spark, d):
    return frame(spark, [(s,) for s, _ in RANKED], "status string").select("status", overlays.rank(F.col("status")).alias("place"))


# ---- exports -------------------------------------------------------------------------------------------------------


@query("contributions", f"with {_keep('value')}, c as (select doc_id, canonical_key, basis, period_label, count(*) as lines, string_agg('  ' || source_label || ' = ' || case when value < 0 then '-' else '' end || format('{{:,}}', cast(round_even(abs(value), 0) as bigint)) || '  [p.' || (page_index + 1) || ']' || case when keep then '' else '  (same fact printed above — not added)' end, chr(10) order by ordinal) as ls, sum(value) filter (where keep) as t from marked group by all having count(*) > 1) "
       "select doc_id, canonical_key, basis, period_label, lines, 'Combined from ' || lines || ' printed lines:' || chr(10) || ls || chr(10) || '  Total = ' || case when t < 0 then '-' else '' end || format('{:,}', cast(round_even(abs(t), 0) as bigint)) as trail from c")
def contributions(spark, d):
    return export.contributions(values.mark_summable(facts(spark, d, ordered=True)))


@query("statement_csv", f"with {GRID}, l as (select doc_id, case when period_label = 'current' then 1 else 2 end as p, cast({CA_T} as varchar) as a, cast({CL_T} as varchar) as b from grid where basis = 'consolidated' and period_label in ('current', 'prior')), w as (select doc_id, max(a) filter (where p = 1) as a1, max(a) filter (where p = 2) as a2, max(b) filter (where p = 1) as b1, max(b) filter (where p = 2) as b2 from l group by doc_id) "
       "select doc_id, 'Statement,Line item,current,prior' || chr(13) || chr(10) || 'balance_sheet,Total current assets,' || coalesce(a1, '') || ',' || coalesce(a2, '') || chr(13) || chr(10) || 'balance_sheet,\"''=Total, liabilities\",' || coalesce(b1, '') || ',' || coalesce(b2, '') as csv from w")
def statement_csv(spark, d):
    g = _grid(spark, d).where("basis = 'consolidated' and period_label in ('current', 'prior')")
    lines = F.array(F.struct(F.lit(1).alias("place"), F.lit("Total current assets").alias("label"), F.col(CA_T).alias("v")), F.struct(F.lit(2).alias("place"), F.lit("=Total, liabilities").alias("label"), F.col(CL_T).alias("v")))
    at = lambda p: F.max(F.when(F.col("period_label") == p, F.col("v").cast("string"))).alias(p)
    rows = g.select("doc_id", "period_label", F.inline(lines)).groupBy("doc_id", "place", "label").agg(at("current"), at("prior"))
    return export.statement_csv(rows.withColumn("statement", F.lit("balance_sheet")), ("current", "prior"))


@query("analysis_sheets", f"with {GRID}, r as ({_ratio_sql()}), n as (select doc_id, note_number, count(*) as k from facts group by all) select doc_id, 'Notes' as sheet, count(*) as rows from n group by doc_id union all select doc_id, 'Ratios', count(*) from r where ratio is not null group by doc_id")
def analysis_sheets(spark, d):
    parts = {"Notes": export.note_index(facts(spark, d)), "Ratios": analytics.ratios(_grid(spark, d), rules.RATIOS).where("ratio is not null"), "Disclosures": frame(spark, [], "doc_id long, family string, page string, snippet string")}
    return export.analysis_rows(parts, ("Notes", "Ratios")).groupBy("doc_id", "sheet").agg(F.count("*").alias("rows"))


