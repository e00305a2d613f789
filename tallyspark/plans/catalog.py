"""All named queries of the fact engine and the SQL that tells their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions import numbers, text
from tallyspark.operators import analytics, asof, checks, export, mapping, ordered, reconcile, rollup, values
from tallyspark.plans import rules
from tallyspark.sources.facts import BASIS_OF_STATUS, CONCEPT_OF_TYPE, PERIOD_OF_FLAG, PRINTED, facts, rates, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

INV, REC, OCA, PAY, BOR, OCL = rules.LEAVES
CA_T, CL_T, NET = rules.ROLLUPS[1][0], rules.ROLLUPS[2][0], "bs_net_current"


def _case(col: str, options: dict) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then '{v}'" for k, v in options.items()) + " end"


_ORDER = ", ".join(PRINTED)
FACTS = (
    "printed as (select *, unnest(case when l_linenumber = 1 and l_quantity >= 40 or l_linenumber = 2 and l_quantity >= 45 then [0, 1] else [0] end) as again, l_linenumber = 3 and l_quantity = 50 as edited from lineitem), "
    f"facts as (select o_custkey as doc_id, row_number() over (partition by o_custkey order by {_ORDER}) as ordinal, p_name as source_label, {_case('p_type', CONCEPT_OF_TYPE)} as canonical_key, "
    f"{_case('l_linestatus', BASIS_OF_STATUS)} as basis, {_case('l_returnflag', PERIOD_OF_FLAG)} as period_label, l_suppkey % 10 + case when l_linenumber = 1 then again else 0 end as page_index, regexp_extract(p_brand, '[0-9]+') as note_number, "
    "l_quantity as quantity, edited, cast(case when l_discount >= 0.095 then -1 else 1 end * case when edited then 1000.5 else cast(l_extendedprice as decimal(28,4)) end as decimal(28,4)) as value "
    "from printed join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey)"
)


def _keep(amount: str) -> str:
    return (
        f"{FACTS}, marked as (select *, row_number() over w = 1 or page_index is null or first_value(page_index) over w = page_index as keep from facts "
        f"window w as (partition by doc_id, canonical_key, basis, period_label, source_label, {amount} order by ordinal))"
    )


#: The figure of every cell: an edited row's, else the sum of the rows that count.
FIGURES = (
    f"{_keep('value')}, figures as (select doc_id, canonical_key, basis, period_label, case when bool_or(edited) then arg_min(value, ordinal) filter (where edited) else sum(value) filter (where keep) end as figure, "
    "count(*) filter (where not keep) as duplicates, bool_or(edited) as edited from marked group by all)"
)
_LEAVES = ", ".join(f"max(figure) filter (where canonical_key = '{k}') as {k}" for k in rules.LEAVES)


def _sum_sql(keys) -> str:
    return f"case when coalesce({', '.join(keys)}) is not null then {' + '.join(f'coalesce({k}, 0)' for k in keys)} end"


GRID = (
    f"{FIGURES}, leaves as (select doc_id, basis, period_label, {_LEAVES} from figures group by all), "
    f"sums as (select *, {_sum_sql(rules.LEAVES[:3])} as {CA_T}, {_sum_sql(rules.LEAVES[3:])} as {CL_T} from leaves), "
    f"grid as (select *, case when coalesce({CA_T}, {CL_T}) is not null then coalesce({CA_T}, 0) - coalesce({CL_T}, 0) end as {NET} from sums)"
)


def query(name: str, sql: str | None = None):
    """Registers a query; sql may use FACTS, GRID as ``with`` parts."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _grid(spark, d):
    return rollup.evaluate(values.concept_grid(facts(spark, d), rules.LEAVES), rules.ROLLUPS)


def _double(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


# ---- facts and values ----------------------------------------------------------------------------------------------


@query("facts_long", f"with {FACTS} select doc_id, ordinal, source_label, canonical_key, basis, period_label, page_index, note_number, quantity, edited, cast(value as double) as value from facts")
def facts_long(spark, d):
    return _double(facts(spark, d, ordered=True).drop("place"), "value")


@query("concept_value", f"with {FIGURES} select doc_id, canonical_key, basis, period_label, cast(figure as double) as figure, duplicates, edited from figures")
def concept_value(spark, d):
    return _double(values.concept_figures(facts(spark, d)), "figure")


@query("duplicate_fact_filter", f"with {_keep('quantity')} select doc_id, canonical_key, basis, period_label, case when bool_or(edited) then arg_min(quantity, ordinal) filter (where edited) else sum(quantity) filter (where keep) end as figure, count(*) filter (where not keep) as duplicates, bool_or(edited) as edited from marked group by all")
def duplicate_fact_filter(spark, d):
    return values.concept_figures(facts(spark, d), "quantity")


@query("duplicate_facts", f"with {_keep('value')} select doc_id, ordinal, source_label, cast(value as double) as value, page_index from marked where not keep")
def duplicate_facts(spark, d):
    return _double(values.mark_summable(facts(spark, d, ordered=True)).where("not keep").select("doc_id", "ordinal", "source_label", "value", "page_index"), "value")


@query("current_prior_pivot", f"with {FIGURES} select doc_id, canonical_key, basis, cast(case when bool_or(period_label in ('current','prior')) then max(figure) filter (where period_label = 'current') else max(figure) filter (where period_label = 'col2') end as double) as current, cast(case when bool_or(period_label in ('current','prior')) then max(figure) filter (where period_label = 'prior') end as double) as prior from figures group by all")
def current_prior_pivot(spark, d):
    return _double(values.current_prior(values.concept_figures(facts(spark, d))), "current", "prior")


@query("bases_present", f"with {FACTS} select doc_id, array_to_string(list_sort(list(distinct basis)), ',') as bases, case when list_contains(list(distinct basis), 'consolidated') then 'consolidated' else min(basis) end as effective from facts group by doc_id")
def bases_present(spark, d):
    return values.bases_present(facts(spark, d)).select("doc_id", F.array_join("bases", ",").alias("bases"), values.effective_basis(F.col("bases"), "consolidated").alias("effective"))


@query("page_scope_counts", f"with {FACTS} select doc_id, count(*) as total, count(*) filter (where page_index < 3) as face, count(*) filter (where page_index between 3 and 6) as notes, count(*) filter (where page_index > 6) as other from facts group by doc_id")
def page_scope_counts(spark, d):
    p = F.col("page_index")
    return facts(spark, d).groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(p < 3).alias("face"), F.count_if(p.between(3, 6)).alias("notes"), F.count_if(p > 6).alias("other"))


# ---- scalars -------------------------------------------------------------------------------------------------------

_CENTS = "cast(round(l_extendedprice * 100) as bigint)"


@query("parse_number_us", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(case when l_tax > 0.04 then -1 else 1 end * {_CENTS} as double) / 100 as parsed from lineitem")
def parse_number_us(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole = F.floor(cents / 100)
    printed = F.concat(F.floor(whole / 1000).cast("string"), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    printed = F.when(F.col("l_tax") > 0.06, F.concat(F.lit("("), printed, F.lit(")"))).when(F.col("l_tax") > 0.04, F.concat(F.lit("−"), printed)).otherwise(F.concat(F.lit("$ "), printed))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", numbers.parse_number(printed).cast("double").alias("parsed"))


@query("parse_number_eu", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast({_CENTS} as double) / 100 as parsed from lineitem")
def parse_number_eu(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    whole = F.floor(cents / 100)
    printed = F.concat(F.floor(whole / 1000).cast("string"), F.lit("."), F.lpad((whole % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", numbers.parse_number(printed, ".", ",").cast("double").alias("parsed"))


@query("normalize_label", "select distinct upper(p_name) || ' (' || p_size || ') (\"x\")' as caption, p_name as label, p_name as key from part")
def normalize_label(spark, d):
    caption = F.concat(F.upper("p_name"), F.lit(" ("), F.col("p_size").cast("string"), F.lit(') ("x")'))
    return table(spark, d, "part").select(caption.alias("caption")).distinct().select("caption", text.normalize_label(F.col("caption")).alias("label"), text.caption_key(F.concat(F.col("caption"), F.lit(" 12 a"))).alias("key"))


@query("detect_locale", f"select doc_id, case when regexp_matches(substr(text, 1, 4000), '[؀-ۿ]') then 'ar' when regexp_matches(substr(text, 1, 4000), '[一-鿿]') then 'zh' when regexp_matches(' ' || lower(substr(text, 1, 4000)) || ' ', '[^\\pL\\pN_]({text.FRENCH_WORDS})[^\\pL\\pN_]') or len(regexp_extract_all(lower(substr(text, 1, 4000)), '{text.FRENCH_MARKS}')) >= 3 then 'fr' else 'en' end as locale from documents")
def detect_locale(spark, d):
    return table(spark, d, "documents").select("doc_id", text.detect_locale(F.col("text")).alias("locale"))


@query("a1_codec", "select p_partkey, cast(p_partkey % 18000 as bigint) as n, cast(p_partkey % 18000 as bigint) as back from part")
def a1_codec(spark, d):
    n = F.col("p_partkey") % 18000
    return table(spark, d, "part").select("p_partkey", n.cast("long").alias("n"), numbers.column_number(numbers.column_letters(n)).cast("long").alias("back"))


@query("formula_eval", "select p_partkey, greatest(p_size, 10) + (p_retailprice - p_size) / nullif(p_size - 5, 0) * -2 as result from part")
def formula_eval(spark, d):
    f = numbers.formula("= MAX(p_size, 10) + (p_retailprice - p_size) / (p_size - 5) * -2")
    return table(spark, d, "part").select("p_partkey", f.alias("result"))


@query("csv_safe", "select p_partkey, case when p_partkey % 3 = 0 then '''=' || p_name when p_partkey % 3 = 1 then '''-' || p_name else p_name end as caption from part")
def csv_safe(spark, d):
    sign = F.when(F.col("p_partkey") % 3 == 0, "=").when(F.col("p_partkey") % 3 == 1, "-").otherwise("")
    return table(spark, d, "part").select("p_partkey", text.csv_safe(F.concat(sign, F.col("p_name"))).alias("caption"))


@query("confidence_overall", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(least(least(1 - l_discount, 1 - l_tax), case when l_returnflag = 'N' then 1.0 else 0.5 end), 4) as weakest from lineitem")
def confidence_overall(spark, d):
    validation = F.when(F.col("l_returnflag") != "N", 0.5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.round(F.least(1 - F.col("l_discount"), 1 - F.col("l_tax"), F.coalesce(validation, F.lit(1.0))), 4).alias("weakest"))


# ---- rollups and structure -----------------------------------------------------------------------------------------

_ALL = (*rules.LEAVES, CA_T, CL_T, NET)
_LONG = " union all ".join(f"select doc_id, basis, period_label, '{k}' as canonical_key, cast({k} as double) as figure from grid where {k} is not null" for k in _ALL)


@query("rollup_levels", f"with {GRID} {_LONG}")
def rollup_levels(spark, d):
    return _double(rollup.long_form(_grid(spark, d), _ALL), "figure")


_LABEL = "case canonical_key " + " ".join(f"when '{k}' then '{v}'" for k, v in rules.LABELS.items()) + " end"


@query("statement_consolidated_current", f"with {GRID}, long as ({_LONG}) select doc_id, canonical_key, {_LABEL} as label, case when canonical_key in ('{CA_T}','{CL_T}','{NET}') then 'computed' else 'printed' end as origin, max(figure) filter (where period_label = 'current') as v_current, max(figure) filter (where period_label = 'prior') as v_prior from long where basis = 'consolidated' and period_label in ('current','prior') group by all")
def statement_consolidated_current(spark, d):
    """The flagship: template rows of the consolidated statement, current beside prior."""
    some = facts(spark, d).where(F.col("basis").eqNullSafe("consolidated") & F.col("period_label").isin("current", "prior") & F.col("canonical_key").isin(*rules.LEAVES))
    figures = values.concept_figures(some)
    at = [F.max(F.when((F.col("canonical_key") == k) & (F.col("period_label") == p), F.col("figure"))).alias(f"{k}@{p}") for k in rules.LEAVES for p in ("current", "prior")]
    wide = figures.groupBy("doc_id").agg(*at)
    return _statement(wide)


def _statement(wide):
    columns = {p: rollup.expressions({k: F.col(f"`{k}@{p}`") for k in rules.LEAVES}, rules.ROLLUPS) for p in ("current", "prior")}
    rows = []
    for k in _ALL:
        current, prior = columns["current"][k], columns["prior"][k]
        origin = "computed" if k in (CA_T, CL_T, NET) else "printed"
        rows.append(F.struct(F.lit(k).alias("canonical_key"), F.lit(rules.LABELS[k]).alias("label"), F.lit(origin).alias("origin"), current.cast("double").alias("v_current"), prior.cast("double").alias("v_prior")))
    return wide.select("doc_id", F.inline(F.array(*rows))).where("v_current is not null or v_prior is not null")


_RELATION = (
    f"{GRID}, rel as (select doc_id, basis, period_label, cast({CA_T} as double) + doc_id % 4 as actual, cast(coalesce({INV}, 0) as double) + cast(coalesce({REC}, 0) as double) + cast(coalesce({OCA}, 0) as double) as expected, "
    f"case when coalesce({INV}, {REC}, {OCA}) is null then 0 else 1 end as parts from grid), "
    "res as (select doc_id, basis, period_label, case when actual is null or parts = 0 then 'skipped' when abs(actual - expected) <= greatest(1.0, abs(expected) * 0.00001) then 'pass' else 'fail' end as status, expected, actual, actual - expected as difference from rel)"
)


def _relation(spark, d):
    grid = _grid(spark, d)
    return checks.check_relation(grid, "current_assets_add_up", F.col(CA_T).cast("double") + F.col("doc_id") % 4, [(INV, 1), (REC, 1), (OCA, 1)], 1.0, 0.00001)


@query("relation_check", f"with {_RELATION} select doc_id, basis, period_label, status, round(expected, 2) as expected, round(actual, 2) as actual, round(difference, 2) + 0 as difference from res")
def relation_check(spark, d):
    return _relation(spark, d).select("doc_id", "basis", "period_label", "status", *[F.round(c, 2).alias(c) for c in ("expected", "actual", "difference")])


@query("coverage_by_statement", f"with {_RELATION}, c as (select basis, count(*) filter (where status = 'pass') as passed, count(*) filter (where status = 'fail') as failed, count(*) filter (where status = 'skipped') as skipped from res group by grouping sets ((basis), ())) select coalesce(basis, '__all__') as scope, passed, failed, skipped, passed / nullif(passed + failed, 0) as validation_rate, (passed + failed) / nullif(passed + failed + skipped, 0) as coverage_rate, case when passed + failed + skipped = 0 then 'ABSENT' when passed + failed = 0 then 'UNVALIDATED' when failed > 0 then 'FAILED' when skipped = 0 then 'PASSED' else 'PARTIAL' end as status from c")
def coverage_by_statement(spark, d):
    return checks.coverage(_relation(spark, d), "basis")


_G = f"select doc_id, basis, period_label, '%s' as guard from grid where %s"


@query("guards", f"with {GRID} " + " union all ".join(_G % x for x in (("sign_expectation", f"{INV} < 0"), ("mutually_exclusive", f"{INV} <> 0 and {REC} <> 0 and {OCA} = 0"), ("equal_values", f"{INV} = {REC} and {INV} <> 0"), ("equal_while_third_non_zero", f"{INV} = {REC} and {OCA} <> 0"), ("consolidation_eliminated", f"basis = 'consolidated' and {PAY} <> 0"))))
def guards(spark, d):
    return checks.guards(_grid(spark, d), INV, REC, OCA, PAY)


@query("unsigned_expense_cohort", f"with {FACTS} select doc_id, basis, count(distinct canonical_key) as concepts from facts where canonical_key in ('{PAY}','{BOR}','{OCL}') and value <> 0 group by doc_id, basis having bool_and(value > 0) and count(distinct canonical_key) >= 3")
def unsigned_expense_cohort(spark, d):
    return checks.unsigned_cohort(facts(spark, d), (PAY, BOR, OCL))


# ---- mapping -------------------------------------------------------------------------------------------------------


@query("map_captions", f"""select p_name as caption, case when p_name = 'red widget' then '{INV}' when p_name in ('hot gear') then '{BOR}' when p_name = 'small ring' then null when p_name like '%gizmo' and p_name like 'cold %' then '{REC}' when p_name like '%gizmo' and p_name not like '%blue%' then '{REC}' when p_name like 'cold %' then '{OCL}' end as canonical_key,
case when p_name in ('red widget','hot gear') then 'exact' when p_name = 'small ring' then 'tie' when p_name like '%gizmo' and p_name not like '%blue%' or p_name like 'cold %' then 'rule' else 'unmapped' end as tier,
case when p_name in ('red widget','hot gear') then 1.0 when p_name = 'small ring' then 0.0 when p_name like '%gizmo' and p_name like 'cold %' then 0.6 when p_name like '%gizmo' and p_name not like '%blue%' or p_name like 'cold %' then 0.95 else 0.0 end as confidence from (select distinct p_name from part)""")
def map_captions(spark, d):
    null = F.lit(None).cast("string")
    captions = table(spark, d, "part").select(F.col("p_name").alias("caption"), null.alias("statement"), null.alias("banner"))
    return mapping.map_captions(captions, rules.CONCEPTS).select("caption", "canonical_key", F.when(F.col("method").isin("exact", "tie", "rule"), F.col("method")).otherwise("unmapped").alias("tier"), "confidence")


@query("map_best_per_key", "select p_type, max_by(p_name, p_retailprice * 1000000 + p_partkey) as p_name from part group by p_type")
def map_best_per_key(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.max_by("p_name", F.struct("p_retailprice", "p_partkey")).alias("p_name"))


# ---- notes ---------------------------------------------------------------------------------------------------------


def _faces(spark, d):
    return facts(spark, d).where(F.col("period_label").isin("current", "prior")).groupBy("doc_id", "basis", "period_label").agg(F.sum("value").cast("double").alias("face"))


_NOTES = (
    f"{FACTS}, face as (select doc_id, basis, period_label, cast(sum(value) as double) as face from facts where period_label in ('current','prior') group by all), "
    "notes as (select doc_id, basis, period_label, page_index % 3 as table_id, cast(sum(value) as double) as total, count(*) as rows from facts where period_label in ('current','prior') group by all)"
)


@query("tie_status", f"with {_NOTES}, j as (select f.*, n.table_id, total, rows, bool_and(abs(face - total) <= greatest(1.0, abs(face) * 0.005)) over t as plus, bool_and(abs(face + total) <= greatest(1.0, abs(face) * 0.005)) over t as minus from face f left join notes n using (doc_id, basis, period_label) window t as (partition by f.doc_id, f.basis, n.table_id)), "
       "o as (select *, case when coalesce(plus, false) then 1 when coalesce(minus, false) then -1 else 1 end as orientation from j), r as (select *, face - coalesce(total, 0) * orientation as residual from o), b as (select *, row_number() over (partition by doc_id, basis, period_label order by abs(residual), table_id nulls last) as k from r) "
       "select doc_id, basis, period_label, table_id, orientation, round(residual, 2) as residual, case when coalesce(rows, 0) = 0 then 'unconfirmed' when abs(residual) <= greatest(1.0, abs(face) * 0.005) then 'tied' when abs(residual) <= abs(face) * 0.05 then 'untied' else 'unconfirmed' end as status from b where k = 1")
def tie_status(spark, d):
    notes = facts(spark, d).where(F.col("period_label").isin("current", "prior")).groupBy("doc_id", "basis", "period_label", (F.col("page_index") % 3).alias("table_id")).agg(F.sum("value").cast("double").alias("total"), F.count("*").alias("rows"))
    return reconcile.reconcile(_faces(spark, d), notes).select("doc_id", "basis", "period_label", "table_id", "orientation", F.round("residual", 2).alias("residual"), "status")


@query("note_index", f"with {FACTS} select doc_id, note_number, min(page_index) as start_page, array_to_string(list_sort(list(distinct page_index)), ',') as pages, count(*) as rows from facts group by all")
def note_index(spark, d):
    return export.note_index(facts(spark, d))


@query("prune_notes", f"with {FACTS} select doc_id, note_number, count(*) as rows from facts f where exists (select 1 from facts c where c.doc_id = f.doc_id and c.note_number = f.note_number and c.quantity >= 49) group by all")
def prune_notes(spark, d):
    f = facts(spark, d)
    return reconcile.prune_notes(f.groupBy("doc_id", "note_number").agg(F.count("*").alias("rows")), f.where("quantity >= 49").select("doc_id", "note_number"))


@query("equivalence_conflict", f"with {FACTS}, g as (select doc_id, basis, period_label, cast(sum(value) filter (where canonical_key = '{INV}') as double) as a, cast(sum(value) filter (where canonical_key = '{REC}') as double) as b from facts group by all) select * from g where abs(a - b) > 1000")
def equivalence_conflict(spark, d):
    return reconcile.conflicts(facts(spark, d), INV, REC, 1000.0)


# ---- analytics -----------------------------------------------------------------------------------------------------


def _ratio_sql() -> str:
    parts = []
    for key, unit, num, den in rules.RATIOS:
        side = lambda terms: " + ".join(f"({s}) * " + (f"coalesce(cast({k} as double), 0)" if o else f"cast({k} as double)") for k, s, o in terms)
        parts.append(f"select doc_id, basis, period_label, '{key}' as ratio_key, ({side(num)}) / nullif({side(den)}, 0) * {unit} as ratio from grid")
    return " union all ".join(parts)


@query("ratios_builtin", f"with {GRID}, r as ({_ratio_sql()}) select doc_id, basis, period_label, ratio_key, round(ratio, 6) + 0 as ratio from r")
def ratios_builtin(spark, d):
    return analytics.ratios(_grid(spark, d), rules.RATIOS).withColumn("ratio", F.round("ratio", 6))


@query("trends", f"with {FIGURES}, cp as (select doc_id, canonical_key, basis, cast(max(figure) filter (where period_label = 'current') as double) as c, cast(max(figure) filter (where period_label = 'prior') as double) as p from figures where period_label <> 'col2' group by all) select doc_id, basis, canonical_key, c - p as change, round(coalesce((c - p) / nullif(p, 0) * 100, 0), 1) as percent, case when c > p then 'up' when c < p then 'down' when c = p then 'flat' else 'unknown' end as direction from cp")
def trends(spark, d):
    return analytics.trends(values.current_prior(values.concept_figures(facts(spark, d).where("period_label <> 'col2'")))).withColumn("percent", F.round("percent", 1))


@query("netting", f"with {GRID} select doc_id, basis, period_label, cast({REC} as double) - coalesce(cast({PAY} as double), 0) as net, '{REC}' || case when {PAY} is not null then ' - {PAY}' else '' end as formula from grid where {REC} is not null")
def netting(spark, d):
    return analytics.netting(_grid(spark, d), REC, (PAY,))


_LEFT = f"{FACTS}, leftovers as (select doc_id, ordinal as pos, quantity as amount from facts where ordinal <= 14), gaps as (select doc_id, sum(amount) filter (where pos in (1, 3)) as gap from leftovers group by doc_id having count(*) >= 3)"


@query("gap_subsets", f"with {_LEFT}, sets as (select a.doc_id, 1 as n, [a.pos] as m, a.amount as total from leftovers a union all select a.doc_id, 2, [a.pos, b.pos], a.amount + b.amount from leftovers a join leftovers b on a.doc_id = b.doc_id and b.pos > a.pos union all select a.doc_id, 3, [a.pos, b.pos, c.pos], a.amount + b.amount + c.amount from leftovers a join leftovers b on a.doc_id = b.doc_id and b.pos > a.pos join leftovers c on c.doc_id = b.doc_id and c.pos > b.pos), "
       "k as (select gaps.doc_id, gap, m, row_number() over (partition by gaps.doc_id order by n, m) as rank from sets join gaps using (doc_id) where abs(total - gap) <= 0.5) select doc_id, gap, array_to_string(m, ',') as members, rank from k where rank <= 8")
def gap_subsets(spark, d):
    left = facts(spark, d, ordered=True).select("doc_id", F.col("ordinal").alias("pos"), F.col("quantity").alias("amount"))
    gaps = left.groupBy("doc_id").agg(F.sum(F.when(F.col("pos").isin(1, 3), F.col("amount"))).alias("gap"), F.count("*").alias("n")).where("n >= 3").drop("n")
    return analytics.gap_subsets(gaps, left)


# ---- as of, overlays, audit ----------------------------------------------------------------------------------------

_RATES = "rates as (select upper(substr(event_type, 1, 3)) as base, 'Q' || user_id % 5 as quote, value as rate, cast(ts as date) as as_of, ts as created_at, event_id as id from events)"
_BEST = "best as (select base, quote, rate, as_of from (select *, row_number() over (partition by base, quote order by as_of desc, created_at desc, id desc) as k from rates where rate > 0) where k = 1)"


@query("fx_latest", f"with {_RATES}, {_BEST} select base, quote, rate, cast(as_of as varchar) as as_of from best")
def fx_latest(spark, d):
    return asof.latest(rates(spark, d).where("rate > 0"), ["base", "quote"], "as_of", "created_at", "id").select("base", "quote", "rate", F.col("as_of").cast("string").alias("as_of"))


@query("fx_resolve", f"with {_RATES}, {_BEST}, w as (select base, quote from best union select quote, base from best union select base, 'NONE' from best) select w.base, w.quote, round(coalesce(a.rate, 1 / b.rate), 9) as rate, cast(coalesce(a.as_of, b.as_of) as varchar) as as_of, case when a.rate is not null then 'direct' when b.rate is not null then 'inverse' else 'missing' end as how from w left join best a on a.base = w.base and a.quote = w.quote left join best b on b.base = w.quote and b.quote = w.base")
def fx_resolve(spark, d):
    r = rates(spark, d)
    pairs = r.where("rate > 0").select("base", "quote").distinct()
    wanted = pairs.union(pairs.select("quote", "base")).union(pairs.select("base", F.lit("NONE"))).distinct()
    return asof.resolve_rates(r, wanted).withColumns({"rate": F.round("rate", 9), "as_of": F.col("as_of").cast("string")})


@query("latest_run", "select o_custkey as doc_id, max_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) as run from orders group by o_custkey")
def latest_run(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderdate", F.col("o_orderkey").alias("run"))
    return asof.latest(rows, ["doc_id"], "o_orderdate", "run").select("doc_id", "run")


def _judgements(spark, d):
    o = table(spark, d, "orders")
    found = o.select(F.col("o_orderkey").alias("subject_key"), asof.digest(F.col("o_orderstatus")).alias("digest"))
    seen = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("subject_key"), asof.digest(F.when(F.col("o_orderkey") % 5 == 0, F.lit("moved")).otherwise(F.col("o_orderstatus"))).alias("judged"))
    twice = found.where("subject_key % 11 = 0").withColumn("digest", asof.digest(F.lit("another")))
    return found.union(twice).where("subject_key % 7 <> 0"), seen


@query("judgement_status", "select o_orderkey as subject_key, case when o_orderkey % 11 = 0 then 'conflict' when o_orderkey % 3 = 0 then 'open' when o_orderkey % 5 = 0 then 'stale' else 'accepted' end as status from orders, (values (0), (1)) t(n) where o_orderkey % 7 <> 0 and (n = 0 or o_orderkey % 11 = 0)")
def judgement_status(spark, d):
    return asof.judgement_status(*_judgements(spark, d)).select("subject_key", "status")


@query("judgement_orphans", "select o_orderkey as subject_key from orders where o_orderkey % 3 <> 0 and o_orderkey % 7 = 0")
def judgement_orphans(spark, d):
    return asof.orphaned(*_judgements(spark, d)).select("subject_key")


@query("edit_overlay", "with e as (select user_id, event_type, ts, event_id, value, event_type = 'signup' as rev, row_number() over (partition by user_id order by ts desc) as k from events) select c_custkey, case when k = 1 and not rev then value else c_acctbal end as figure, coalesce(k = 1 and not rev, false) as edited from customer left join e on c_custkey = user_id and k = 1")
def edit_overlay(spark, d):
    cells = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("figure"))
    edits = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("ts").alias("edited_at"), F.col("value").alias("new_value"), (F.col("event_type") == "signup").alias("revert"))
    return asof.overlay(cells, edits, ["c_custkey"])


@query("audit_totals", "select count(*) as runs, count(*) filter (where event_type <> 'signup') as llm_runs, count(*) filter (where event_type = 'error') as failed, round(sum(case when event_type <> 'signup' then value end), 2) as tokens from events")
def audit_totals(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").agg(F.count("*").alias("runs"), F.count_if(kind != "signup").alias("llm_runs"), F.count_if(kind == "error").alias("failed"), F.round(F.sum(F.when(kind != "signup", F.col("value"))), 2).alias("tokens"))


@query("audit_newest_n", "select event_id, event_type, value from events order by ts desc, event_id desc limit 500")
def audit_newest_n(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id", "event_type", "value")


@query("version_publish_changed", "select p_name as name, 2 as version from (select distinct p_name from part where p_name like 'r%')")
def version_publish_changed(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    stored = names.select("name", F.lit(1).alias("version"), F.concat(F.lit("v1 "), "name").alias("definition"))
    published = names.select("name", F.when(F.col("name").startswith("r"), "new").otherwise(F.concat(F.lit("v1 "), "name")).alias("definition"))
    return asof.next_versions(stored, published).select("name", "version")


# ---- order ---------------------------------------------------------------------------------------------------------


def _page_scores(spark, d):
    c, n = table(spark, d, "conversations"), F.length("text")
    return c.groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_index")).agg(F.max(n).alias("n"), F.max("role").alias("role")).select(
        "doc_id", "page_index", (F.lit(1.0) - (F.col("n") % 3)).alias("PRE"), ((F.col("role") == "user").cast("double") * 4 - F.col("n") % 5).alias("FACE"),
        ((F.col("role") == "assistant").cast("double") * 4 - F.col("n") % 4).alias("NOTES"), F.when(F.col("n") % 7 == 0, 6.0).otherwise(-2.0).alias("POST"))


def _viterbi_sql() -> str:
    e = {"PRE": "1.0 - n % 3", "FACE": "(role = 'user')::int * 4 - n % 5", "NOTES": "(role = 'assistant')::int * 4 - n % 4", "POST": "case when n % 7 = 0 then 6.0 else -2.0 end"}
    step = lambda j, what: (
        f"greatest({', '.join(f'w.v{i} - {ordered.COST[i][j]}' for i in range(4))}) + p.e{j}"
        if what == "v"
        else "case " + " ".join(f"when w.v{i} - {ordered.COST[i][j]} = greatest({', '.join(f'w.v{k} - {ordered.COST[k][j]}' for k in range(4))}) then list_append(w.p{i}, {j})" for i in range(4)) + " end"
    )
    return (
        "with recursive raw as (select conv_id as doc_id, cast(turn as int) as page_index, max(length(text)) as n, max(role) as role from conversations group by all), "
        f"p as (select doc_id, page_index, row_number() over (partition by doc_id order by page_index) as k, {', '.join(f'cast({x} as double) as e{j}' for j, x in enumerate(e.values()))} from raw), "
        f"w as (select doc_id, k, {', '.join(f'e{j} + {ordered.START[j]} as v{j}' for j in range(4))}, {', '.join(f'[{j}] as p{j}' for j in range(4))} from p where k = 1 "
        f"union all select w.doc_id, p.k, {', '.join(step(j, 'v') for j in range(4))}, {', '.join(step(j, 'p') for j in range(4))} from w join p on p.doc_id = w.doc_id and p.k = w.k + 1), "
        "f as (select doc_id, case " + " ".join(f"when v{i} = greatest(v0, v1, v2, v3) then p{i}" for i in range(4)) + " end as path from w where k = (select max(k) from p where p.doc_id = w.doc_id)) "
        "select p.doc_id, page_index, ['PRE','FACE','NOTES','POST'][path[k] + 1] as state from f join p using (doc_id)"
    )


@query("viterbi_pages", _viterbi_sql())
def viterbi_pages(spark, d):
    return ordered.decode_pages(_page_scores(spark, d))


@query("notes_follow_face", "with v as (" + _viterbi_sql() + ") select doc_id, page_index, case when state = 'NOTES' and page_index < min(page_index) filter (where state = 'FACE') over (partition by doc_id) then 'OTHER' else state end as state from v")
def notes_follow_face(spark, d):
    return ordered.notes_follow_face(ordered.decode_pages(_page_scores(spark, d)))


@query("carry_statement", f"with {FACTS}, r as (select doc_id, ordinal, case when quantity > 40 then canonical_key end as section, sum(case when page_index = 9 then 1 else 0 end) over (partition by doc_id order by ordinal) as run from facts) select doc_id, ordinal, last_value(section ignore nulls) over (partition by doc_id, run order by ordinal) as section_carried from r")
def carry_statement(spark, d):
    rows = facts(spark, d, ordered=True).select("doc_id", "ordinal", F.when(F.col("quantity") > 40, F.col("canonical_key")).alias("section"), (F.col("page_index") == 9).alias("reset"))
    return ordered.carry_forward(rows, ["doc_id"], ["ordinal"], "section", "reset").select("doc_id", "ordinal", "section_carried")


@query("gap_cluster_columns", "with p as (select distinct p_brand as band, p_retailprice as x from part), m as (select *, case when x - lag(x) over (partition by band order by x) > 3 then 1 else 0 end as new from p), c as (select band, x, sum(new) over (partition by band order by x) as cluster from m) select band, cluster, min(x) as first, max(x) as last, count(*) as members, median(x) as middle from c group by band, cluster")
def gap_cluster_columns(spark, d):
    points = table(spark, d, "part").select(F.col("p_brand").alias("band"), F.col("p_retailprice").alias("x")).distinct()
    return ordered.gap_clusters(points, ["band"], "x", 3.0)


@query("nearest_band", "select p_partkey, case when least(abs(p_size - 10), abs(p_size - 25), abs(p_size - 40)) > 5 then null when abs(p_size - 10) <= least(abs(p_size - 25), abs(p_size - 40)) then 'left' when abs(p_size - 25) <= abs(p_size - 40) then 'middle' else 'right' end as band from part")
def nearest_band(spark, d):
    return ordered.nearest(table(spark, d, "part"), [("left", 10.0), ("middle", 25.0), ("right", 40.0)], "p_size", 5.0).select("p_partkey", "band")


@query("period_rank", "with h as (select distinct o_orderstatus as basis, year(o_orderdate) as y from orders) select basis, y, case dense_rank() over w when 1 then 'current' when 2 then 'prior' else 'col' || (dense_rank() over w - 1) end as period_label from h window w as (partition by basis order by y desc)")
def period_rank(spark, d):
    h = table(spark, d, "orders").select(F.col("o_orderstatus").alias("basis"), F.year("o_orderdate").alias("y")).distinct()
    return ordered.period_ranks(h, ["basis"], "y")


@query("store_fact_dedup", f"with {FACTS} select doc_id, canonical_key, basis, period_label || case when k > 1 then '#' || k else '' end as slot, quantity from (select *, row_number() over (partition by doc_id, canonical_key, basis, period_label order by o) as k from (select doc_id, canonical_key, basis, period_label, quantity, min(ordinal) as o from facts group by all))")
def store_fact_dedup(spark, d):
    from pyspark.sql import Window

    first = facts(spark, d, ordered=True).groupBy(*values.CELL, "quantity").agg(F.min("ordinal").alias("o"))
    k = F.row_number().over(Window.partitionBy(*values.CELL).orderBy("o"))
    return first.withColumn("k", k).select("doc_id", "canonical_key", "basis", F.concat("period_label", F.when(F.col("k") > 1, F.concat(F.lit("#"), F.col("k").cast("string"))).otherwise("")).alias("slot"), "quantity")


# ---- findings and exports ------------------------------------------------------------------------------------------

_SLOTS = [(b, p) for b in ("consolidated", "standalone") for p in ("current", "prior", "col2")]


@query("csv_wide", f"with {FACTS} select doc_id, ordinal, source_label as caption, canonical_key, " + ", ".join(f"case when basis = '{b}' and period_label = '{p}' then cast(value as double) end as {b}_{p}" for b, p in _SLOTS) + " from facts")
def csv_wide(spark, d):
    return export.wide(facts(spark, d, ordered=True), _SLOTS)


@query("calculated_mismatch", f"with {_RELATION} select doc_id, basis, period_label, round(difference, 2) as difference from res where abs(difference) > 0.5")
def calculated_mismatch(spark, d):
    return _relation(spark, d).where("abs(difference) > 0.5").select("doc_id", "basis", "period_label", F.round("difference", 2).alias("difference"))


@query("review_counts", f"with {_RELATION}, q as (select doc_id, 'structural' as kind from res where status = 'fail' union all select doc_id, 'unclear_period' from facts where period_label = 'col2') select kind, count(*) as findings, count(distinct doc_id) as docs from q group by kind")
def review_counts(spark, d):
    a = _relation(spark, d).where("status = 'fail'").select("doc_id", F.lit("structural").alias("kind"))
    b = facts(spark, d).where("period_label = 'col2'").select("doc_id", F.lit("unclear_period").alias("kind"))
    return a.union(b).groupBy("kind").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("docs"))


@query("lines_with_no_finding", f"with {_RELATION} select count(*) as lines from facts where not exists (select 1 from res where res.doc_id = facts.doc_id and res.basis = facts.basis and res.period_label = facts.period_label and status = 'fail')")
def lines_with_no_finding(spark, d):
    indicted = _relation(spark, d).where("status = 'fail'").select("doc_id", "basis", "period_label")
    return facts(spark, d).join(indicted, ["doc_id", "basis", "period_label"], "left_anti").agg(F.count("*").alias("lines"))


@query("text_search_topk", "select doc_id, instr(lower(text), 'the') as found_at from documents where contains(lower(text), 'the') order by found_at, doc_id limit 80")
def text_search_topk(spark, d):
    low = F.lower("text")
    hits = table(spark, d, "documents").where(low.contains("the")).select("doc_id", F.instr(low, "the").cast("long").alias("found_at"))
    return hits.orderBy("found_at", "doc_id").limit(80)


@query("integrity_findings", "select doc_id, case when coalesce(text, '') = '' then 'NO_PAGES' when n_chars < 50 then 'BLANK_PAGE' when n_chars <> length(text) then 'INCONSISTENT' end as finding from documents where coalesce(text, '') = '' or n_chars < 50 or n_chars <> length(text)")
def integrity_findings(spark, d):
    t, n = F.coalesce("text", F.lit("")), F.col("n_chars")
    finding = F.when(t == "", "NO_PAGES").when(n < 50, "BLANK_PAGE").when(n != F.length("text"), "INCONSISTENT")
    return table(spark, d, "documents").select("doc_id", finding.alias("finding")).where("finding is not null")


@query("upload_dedup", "select min(doc_id) as doc_id, source, sha256(coalesce(text, '')) as content_hash from documents group by source, text")
def upload_dedup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    return rows.groupBy("source", "content_hash").agg(F.min("doc_id").alias("doc_id"))


@query("rows_json", f"""with {FIGURES} select doc_id, canonical_key, '[' || string_agg('{{"basis":"' || basis || '","period_label":"' || period_label || '","figure":"' || figure || '"}}', ',' order by basis, period_label) || ']' as json from figures group by all""")
def rows_json(spark, d):
    return export.json_rows(values.concept_figures(facts(spark, d)))


@query("language_parity", "select source, array_to_string(list_sort(list_filter(['de','en','es','fr'], lambda x: not list_contains(list(distinct lang), x))), ',') as missing from documents group by source")
def language_parity(spark, d):
    have = F.collect_set("lang")
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_except(F.array(*map(F.lit, ("de", "en", "es", "fr"))), have), ",").alias("missing"))
