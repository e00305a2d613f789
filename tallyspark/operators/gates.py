"""Predicates and gates: kinds of pages, integrity, concepts that may claim a caption, versions in force, trails and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vocabularies of which a caption and a concept can't name different members.
EXCLUSIVE = (("operating", "investing", "financing"),)
NOT_LINES = ("header", "spacer", "section", "subhead")


def page_kind(chars: Column, text_cover: Column, image_cover: Column) -> Column:
    native = (chars > 100) & (text_cover > 0.02)
    return F.when(native & (image_cover > 0.5), "MIXED").when(native, "NATIVE").when(image_cover > 0.5, "SCANNED").otherwise("NATIVE")


def integrity(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, finding, severity. docs: doc_id, format. pages: doc_id, page_index, kind, chars, rotation, width, height.

    A document without pages, or of an unknown format, is blocked; mixed scans, turned, blank and unequal pages are warnings, once a document.
    """
    scanned = F.count_if(F.col("kind") == "SCANNED")
    sizes = F.count_distinct(F.round("width"), F.round("height"))
    s = pages.groupBy("doc_id").agg(F.count("*").alias("n"), scanned.alias("s"), F.bool_or(F.col("rotation") != 0).alias("turned"), F.bool_or((F.col("chars") == 0) & (F.col("kind") != "SCANNED")).alias("blank"), sizes.alias("sizes"))
    j = docs.select("doc_id", "format").join(s, "doc_id", "left")
    found = F.array_compact(F.array(
        F.when(F.col("format") == "unknown", "UNKNOWN_FORMAT"), F.when(F.col("n").isNull(), "NO_PAGES"), F.when((F.col("s") > 0) & (F.col("s") < F.col("n")), "MIXED_SCAN"),
        F.when(F.col("turned"), "ROTATED_PAGE"), F.when(F.col("blank"), "BLANK_PAGE"), F.when(F.col("sizes") > 1, "INCONSISTENT_DIMENSIONS"),
    ))
    rows = j.select("doc_id", F.explode(found).alias("finding"))
    return rows.withColumn("severity", F.when(F.col("finding").isin("UNKNOWN_FORMAT", "NO_PAGES"), "blocker").otherwise("warning"))


def unblocked(docs: DataFrame, findings: DataFrame) -> DataFrame:
    return docs.join(findings.where("severity = 'blocker'"), "doc_id", "left_anti")


def reclaim_faces(pages: DataFrame) -> DataFrame:
    """A NOTES page between two FACE pages is FACE, unless it has a notes banner or opens as a note (``notes_mark``)."""
    w = Window.partitionBy("doc_id").orderBy("page_index")
    between = (F.lag("state").over(w) == "FACE") & (F.lead("state").over(w) == "FACE") & (F.col("state") == "NOTES") & ~F.col("notes_mark")
    return pages.withColumn("state", F.when(F.coalesce(between, F.lit(False)), "FACE").otherwise(F.col("state")))


def is_statement_line(role: Column) -> Column:
    return ~F.coalesce(F.lower(role).isin(*NOT_LINES), F.lit(False))


def is_date_fragment(v: Column) -> Column:
    return (v == F.floor(v)) & (v.between(1990, 2099) | v.between(1, 31))


def is_noise_row(caption: Column, values: Column, titles: Column) -> Column:
    """A title or period caption all of whose values are parts of dates."""
    return F.coalesce((titles | (F.trim(caption) == "") | caption.rlike("(?i)as at|for the year|ended")) & (F.size(values) > 0) & F.forall(values, is_date_fragment), F.lit(False))


def names_another_class(key: Column, caption: Column) -> Column:
    """Whether a caption names exactly one word of an exclusive vocabulary and the concept another one."""
    clash = F.lit(False)
    for words in EXCLUSIVE:
        of_key = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(key), w))
        of_caption = F.filter(F.array(*map(F.lit, words)), lambda w: F.array_contains(F.split(F.lower(caption), "[^a-z]+"), w))
        clash = clash | ((F.size(of_key) == 1) & (F.size(of_caption) == 1) & (of_key[0] != of_caption[0]))
    return F.coalesce(clash, F.lit(False))


def reroute(answers: DataFrame, families: DataFrame) -> DataFrame:
    """answers (.., canonical_key, banner_section) with routed: the one sibling of the banner's section, where the key's own family has exactly one.

    families: family, key, section. A key outside families, a section of none or several siblings, or of the key itself changes nothing.
    """
    sib = families.groupBy("family", "section").agg(F.min("key").alias("_to"), F.count_distinct("key").alias("_n")).where("_n = 1").drop("_n")
    own = families.select(F.col("key").alias("canonical_key"), "family").distinct()
    rows = answers.join(own, "canonical_key", "left").join(sib.withColumnRenamed("section", "banner_section"), ["family", "banner_section"], "left")
    return rows.withColumn("routed", F.coalesce("_to", "canonical_key")).drop("_to", "family")


def refuse_computed(mapped: DataFrame, computed: DataFrame) -> DataFrame:
    """``mapped`` with the concept taken from captions (norm) that name a computed concept; refused says so. computed: norm."""
    names = computed.select("norm").distinct().withColumn("_c", F.lit(True))
    rows = mapped.join(names, "norm", "left").withColumn("refused", F.coalesce("_c", F.lit(False))).drop("_c")
    return rows.withColumn("canonical_key", F.when(~F.col("refused"), F.col("canonical_key")))


def batch_groups(rows: DataFrame) -> DataFrame:
    """doc_id, statement, slots, rows, first: rows that print the same columns of the same statement, for one request each."""
    per_row = rows.groupBy("doc_id", "statement", "line").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("/", "basis", "period_label"))), ",").alias("slots"))
    return per_row.groupBy("doc_id", "statement", "slots").agg(F.count("*").alias("rows"), F.min("line").alias("first"))


def in_force(pins: DataFrame, versions: DataFrame) -> DataFrame:
    """pins (owner, name, pinned) with version, label: the pinned version (superseded if a newer one exists), missing if it is gone, else the latest.

    versions: name, version. A name without any version takes the engine's default (version null).
    """
    newest = versions.groupBy("name").agg(F.max("version").alias("_new"))
    have = versions.select("name", F.col("version").alias("pinned"), F.lit(True).alias("_have")).distinct()
    j = pins.join(newest, "name", "left").join(have, ["name", "pinned"], "left")
    label = F.when(F.col("pinned").isNotNull() & F.col("_have").isNull(), "missing").when(F.col("pinned") < F.col("_new"), "superseded").when(F.col("pinned").isNotNull(), "pinned").when(F.col("_new").isNotNull(), "in_force").otherwise("engine_default")
    return j.select("owner", "name", F.when(label != "missing", F.coalesce("pinned", "_new")).alias("version"), label.alias("label"))


def declared_statements(sections: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """template, statement, place: known statements that have sections, in the template's order, each once. sections: template, ordinal, statement, n_sections."""
    first = sections.where(F.col("statement").isin(*known) & (F.col("n_sections") > 0)).groupBy("template", "statement").agg(F.min("ordinal").alias("_o"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("template").orderBy("_o", "statement"))).drop("_o")


def self_vetoing(aliases: DataFrame, vetoes: DataFrame) -> DataFrame:
    """key, alias, pattern of concepts whose own alias an exclusion of theirs would refuse."""
    return aliases.join(vetoes, "key").where(F.expr("lower(alias) rlike pattern")).select("key", "alias", "pattern")


def trail(live: DataFrame, seeded: DataFrame) -> DataFrame:
    """Recorded entries with the seeded ones that they don't replace (by entry id), newest first."""
    return live.unionByName(seeded.join(live.select("entry"), "entry", "left_anti")).orderBy(F.desc("at"), F.desc("entry"))


def search(pages: DataFrame, q: str, limit: int = 80) -> DataFrame:
    """doc_id, at, snippet, truncated: the first hits in order of document (the limit, 1 to 300, is the feature); truncated says there are more."""
    from tallyspark.functions.text import snippet

    n = min(max(limit, 1), 300)
    at = F.instr(F.lower("text"), q.lower())
    hits = pages.withColumn("at", at).where("at > 0").orderBy("doc_id").limit(n + 1)
    k = F.row_number().over(Window.orderBy("doc_id"))  # over at most limit + 1 rows
    return hits.withColumn("_k", k).withColumn("truncated", F.max("_k").over(Window.partitionBy()) > n).where(F.col("_k") <= n).select("doc_id", "at", snippet(F.col("text"), F.col("at")).alias("snippet"), "truncated")


def apply_judgements(events: DataFrame) -> DataFrame:
    """subject_key, judged, version: the digest last accepted of each subject, and how many events it has; a withdrawal last leaves none.

    events: subject_key, at, digest, action (accept or withdraw). The history is kept by the caller: events are only ever appended.
    """
    last = events.groupBy("subject_key").agg(F.max_by(F.struct("digest", "action"), F.struct("at", "digest")).alias("e"), F.count("*").alias("version"))
    return last.where("e.action = 'accept'").select("subject_key", F.col("e.digest").alias("judged"), "version")


def adopt_runs(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """requests (request, doc_id, options map) with run, decision: adopt a finished run of the same options, conflict with one in flight, else start.

    runs: run, doc_id, options, status. Options are compared by a digest of their sorted entries.
    """
    mark = lambda c: F.sha2(F.to_json(F.array_sort(F.map_entries(c))), 256)
    r = runs.withColumn("_o", mark("options")).groupBy("doc_id", "_o").agg(F.max(F.when(F.col("status") == "done", F.col("run"))).alias("_done"))
    busy = runs.where("status = 'running'").groupBy("doc_id").agg(F.max("run").alias("_busy"))
    j = requests.withColumn("_o", mark("options")).join(r, ["doc_id", "_o"], "left").join(busy, "doc_id", "left")
    decision = F.when(F.col("_done").isNotNull(), "adopt").when(F.col("_busy").isNotNull(), "conflict").otherwise("start")
    return j.select("request", "doc_id", F.coalesce("_done", "_busy").alias("run"), decision.alias("decision"))
