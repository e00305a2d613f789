"""What is served of stored results: who may see a document, tables of notes, indicators, roles, identities of facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each role may do, the order of categories, and the roles that see every document.
PERMISSIONS = {"viewer": ("read",), "analyst": ("read", "edit", "extract"), "reviewer": ("read", "edit", "extract", "judge"), "admin": ("read", "edit", "extract", "judge", "administer")}
CATEGORIES = ("Liquidity", "Leverage", "Coverage", "Efficiency", "Profitability")
ELEVATED = ("reviewer", "admin")


def visible(documents: DataFrame, owner: str, role: str) -> DataFrame:
    """The documents (owner, created_at, doc_id) that a person may see, newest first: their own; all for an elevated role; none for a role that may not read."""
    if "read" not in PERMISSIONS.get(role, ()):
        return documents.limit(0)
    own = documents if role in ELEVATED else documents.where(F.col("owner") == owner)
    return own.orderBy(F.desc("created_at"), F.desc("doc_id"))


def may(people: DataFrame, action: str) -> DataFrame:
    """people (person, role) with allowed."""
    return people.withColumn("allowed", F.coalesce(F.col("role").isin(*[r for r, acts in PERMISSIONS.items() if action in acts]), F.lit(False)))


def note_views(rows: DataFrame) -> DataFrame:
    """doc_id, note_number, title, pages, cells (JSON in printed order) of the tables of notes; a title that only says it goes on is left out.

    rows: doc_id, note_number, title, page_index, ordinal, caption, period_label, value. A note's rows meet in one row.
    """
    title = F.when(~F.coalesce(F.col("title").rlike(r"(?i)\(continued\)|[(（][續续][)）]"), F.lit(False)), F.col("title"))
    cell = F.struct("ordinal", "caption", "period_label", F.col("value").cast("string").alias("value"))
    made = rows.groupBy("doc_id", "note_number").agg(F.min_by(title, F.when(title.isNotNull(), F.col("ordinal"))).alias("title"), F.array_sort(F.collect_set("page_index")).alias("p"), F.array_sort(F.collect_list(cell)).alias("c"))
    return made.select("doc_id", "note_number", "title", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"), F.to_json(F.transform("c", lambda x: F.struct(x["caption"].alias("caption"), x["period_label"].alias("period"), x["value"].alias("value")))).alias("cells"))


def indicators_view(ratio_rows: DataFrame, category: dict[str, str], unit: dict[str, str]) -> DataFrame:
    """ratio rows with category, its place, unit and what is shown, unavailable ones as a dash."""
    from tallyspark.operators.normalise import display

    of = lambda names: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("ratio_key")]
    rows = ratio_rows.withColumn("category", of(category)).withColumn("unit", of(unit)).withColumn("value", F.round("ratio", 2))
    return rows.withColumn("place", F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))).withColumn("shown", display(F.col("value"), F.col("unit")))


def adopt_roles(lines: DataFrame, roles: DataFrame) -> DataFrame:
    """``lines`` whose plain role takes that of the template's node of their concept, if that is a sum. roles: canonical_key, node_role."""
    rows = lines.join(F.broadcast(roles), "canonical_key", "left")
    sums = (F.col("role") == "line") & F.col("node_role").isin("subtotal", "total")
    return rows.withColumn("role", F.when(sums, F.col("node_role")).otherwise(F.col("role"))).drop("node_role")


def fact_id(*parts: Column) -> Column:
    """The identity of a fact: its parts in the declared order, missing ones as nothing."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def is_heading_with_note(caption: Column, values: Column) -> Column:
    """A heading in capitals whose only figures are as small as a note's number or a year."""
    small = F.forall(values, lambda v: (v == F.floor(v)) & (F.abs(v).between(1, 31) | F.abs(v).between(1990, 2099)))
    return F.coalesce((F.size(values) > 0) & caption.rlike("[A-Z]") & ~caption.rlike("[a-z]") & small, F.lit(False))


def shown_keys(nodes: DataFrame, statement: str) -> DataFrame:
    """The keys that a template puts on a statement's grid, in order, each once. nodes: place, statement, key."""
    return nodes.where((F.col("statement") == statement) & F.col("key").isNotNull()).groupBy("key").agg(F.min("place").alias("place"))


def tail(lines: Column, n: int) -> Column:
    """The last lines of a log."""
    return F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines)


def progress(stages: DataFrame) -> DataFrame:
    """run, done, total, current, percent: where runs are, from records (run, stage, place, status, at), the newest of each stage counting."""
    last = stages.groupBy("run", "stage", "place").agg(F.max_by("status", "at").alias("status"))
    made = last.groupBy("run").agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"), F.min_by("stage", F.when(F.col("status") != "done", F.col("place"))).alias("current"))
    return made.withColumn("percent", F.floor(F.col("done") * 100 / F.col("total")).cast("int"))
