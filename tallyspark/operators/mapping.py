"""Captions to concepts: exact aliases by priority, ties, hints, vetoes, within the statement and the section where a caption is printed.

A rulebook is data of bounded size: a few hundred concepts. Aliases are joined on the normalised caption; hints and vetoes are patterns and
become expressions, so that a caption meets only those that its place admits.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.documents import section_of_key, section_of_scope, statement_of_key
from tallyspark.functions.text import label_segments, normalize_label, section_of_banner

#: Vocabularies of which a caption can name one member only; spellings of a statement; scores of one hint and of several.
EXCLUSIVE = (("operating", "investing", "financing"),)
SPELLINGS = {"equity_changes": "changes_in_equity"}
STATEMENTS = ("balance_sheet", "profit_and_loss", "cash_flow", "changes_in_equity")
SURE, UNSURE = 0.95, 0.6


@dataclass(frozen=True)
class Concept:
    """mode derive or residual keeps a concept from any caption; scope and statement fall back on the key's name."""

    key: str
    aliases: tuple[str, ...] = ()
    priority: int = 0
    statement: str | None = None
    scope: tuple[str, ...] = ()
    regex: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    confusable: tuple[str, ...] = ()
    family: str | None = None
    mode: str = "extract"


def _resolved(spark, concepts: tuple[Concept, ...]) -> dict[str, tuple[str | None, tuple[str, ...]]]:
    """statement and sections of each concept, as declared or as its key names them: a frame of the rulebook's size."""
    rows = [(c.key, SPELLINGS.get(c.statement, c.statement), list(c.scope)) for c in concepts]
    frame = spark.createDataFrame(rows, "key string, statement string, scope array<string>")
    sections = F.array_compact(F.transform("scope", section_of_scope))
    own = F.array_compact(F.array(section_of_key(F.col("key"))))
    found = frame.select("key", F.coalesce("statement", statement_of_key(F.col("key"))).alias("st"), F.when(F.size("scope") > 0, sections).otherwise(own).alias("sec"))
    return {r["key"]: (r["st"], tuple(r["sec"])) for r in found.collect()}


def _any(tests: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


def _matches(texts: Column, pattern: str) -> Column:
    return F.exists(texts, lambda t: t.rlike(f"(?i){pattern}"))


def _holds(texts: Column, words: tuple[str, ...]) -> Column:
    return F.exists(texts, lambda t: functools.reduce(lambda a, b: a & b, [t.contains(w.lower()) for w in words]))


def _claims(key: str) -> Column:
    return F.exists("claims", lambda x: x["key"] == key)


def _other_class(key: str, sections: tuple[str, ...], caption: Column) -> Column:
    """Whether a caption names exactly one word of an exclusive vocabulary, and the concept another one."""
    out = F.lit(False)
    for words in EXCLUSIVE:
        told = [w for w in words if w in " ".join(sections)] or [w for w in words if w in key]
        if len(told) == 1:
            named = [caption.rlike(rf"(?i)\b{w}\b").cast("int") for w in words]
            out = out | ((functools.reduce(lambda a, b: a + b, named) == 1) & ~caption.rlike(rf"(?i)\b{told[0]}\b"))
    return out


def _admits(c: Concept, place: tuple[str | None, tuple[str, ...]], caption: Column, statement: Column, section: Column) -> Column:
    """Whether a concept may claim a caption here: its statement, its sections, its exclusions and its class."""
    st, sections = place
    ok = F.lit(True) if st is None else (~F.coalesce(statement.isin(*STATEMENTS), F.lit(False)) | (statement == st))
    if sections:
        ok = ok & (section.isNull() | section.isin(*sections))
    veto = _any([F.lower(caption).rlike(f"(?i){p}") for p in c.excludes])
    return ok & ~veto & ~_other_class(c.key, sections, caption)


def _variant(key: str) -> str | None:
    """What a key is about, without its section and the words current and non-current."""
    head, sep, leaf = key.partition("__")
    for prefix in ("non_current_", "non-current_", "noncurrent_", "current_"):
        if leaf.startswith(prefix):
            return leaf.removeprefix(prefix)
    return leaf if sep else None


def map_captions(rows: DataFrame, concepts: tuple[Concept, ...], binding: bool = True) -> DataFrame:
    """caption, statement, banner, canonical_key, method, confidence, needs_review, candidates of the distinct captions and places in ``rows``.

    The caption and, of a bilingual one, each script's part are looked up among the aliases of concepts admitted here. Of several claimants the highest
    priority wins, of equal ones the first in the rulebook; but claimants of one priority that name each other as confusable are a tie, which is unmapped
    with both as candidates (binding). If every claimant is refused and the banner names the one sibling of a claimant's family that is the same
    thing, the sibling is taken. Then hints: a pattern or all keywords; one concept gives 0.95, several 0.6 and the highest priority, for review.
    A caption that is the name of a concept that is only ever computed is refused to the others.
    """
    spark, place = rows.sparkSession, _resolved(rows.sparkSession, concepts)
    able = [c for c in concepts if c.mode in ("extract", "extract_or_derive")]
    at = {c.key: i for i, c in enumerate(concepts)}
    base = rows.select("caption", "statement", "banner").distinct()
    base = base.withColumn("section", section_of_banner(F.col("banner"))).withColumn("st", F.when(F.col("statement") == "equity_changes", "changes_in_equity").otherwise(F.col("statement")))
    base = base.withColumn("segments", F.array_distinct(F.filter(F.transform(label_segments(F.col("caption")), normalize_label), lambda x: x != "")))
    caption, st, section = F.col("caption"), F.col("st"), F.col("section")
    admitted = F.array_compact(F.array(*[F.when(_admits(c, place[c.key], caption, st, section), F.lit(c.key)) for c in able]))
    base = base.withColumn("admitted", admitted)
    alias_rows = [(a, c.key, c.priority, at[c.key]) for c in able for a in c.aliases]
    names = spark.createDataFrame(alias_rows or [("", "", 0, 0)], "name string, key string, priority int, place int")
    names = names.select(normalize_label(F.col("name")).alias("name"), "key", "priority", "place").where("name <> ''").groupBy("name").agg(F.array_sort(F.collect_set(F.struct((-F.col("priority")).alias("p"), "place", "key"))).alias("claims"))
    found = base.select("caption", "statement", "banner", F.posexplode("segments").alias("seg", "name"), "admitted").join(names, "name")
    ok = F.filter("claims", lambda c: F.array_contains("admitted", c["key"]))
    top = F.transform(F.filter(ok, lambda c: c["p"] == ok[0]["p"]), lambda c: c["key"])
    friends = F.create_map(*[x for c in concepts for x in (F.lit(c.key), F.array(*map(F.lit, c.confusable)).cast("array<string>"))])
    mutual = lambda a, b: F.array_contains(F.coalesce(friends[a], F.array().cast("array<string>")), b) & F.array_contains(F.coalesce(friends[b], F.array().cast("array<string>")), a)
    tie = F.filter("top", lambda a: F.exists("top", lambda b: (a != b) & mutual(a, b)))
    per = found.withColumn("ok", ok).withColumn("top", top).withColumn("tie", tie if binding else F.array().cast("array<string>"))
    routed = _reroutes(per, able, place, caption)
    outcome = F.when(F.size("tie") > 1, F.struct("seg", F.lit("tie").alias("how"), F.lit(None).cast("string").alias("key"), F.col("tie").alias("all")))
    outcome = outcome.when(F.size("ok") > 0, F.struct("seg", F.lit("exact").alias("how"), F.col("ok")[0]["key"].alias("key"), F.array().cast("array<string>").alias("all")))
    outcome = outcome.when(F.col("routed").isNotNull(), F.struct("seg", F.lit("rerouted").alias("how"), F.col("routed").alias("key"), F.array().cast("array<string>").alias("all")))
    keys = ["caption", "statement", "banner"]
    first = routed.withColumn("o", outcome).where("o is not null").groupBy(*[F.coalesce(k, F.lit("")).alias(f"_{k}") for k in keys]).agg(F.min("o").alias("o"))
    rows_ = base.join(first, functools.reduce(lambda a, b: a & b, [F.coalesce(base[k], F.lit("")) == first[f"_{k}"] for k in keys]), "left")
    text = F.lower(caption)
    texts = F.concat(F.array(text), F.col("segments"))
    hits = []
    for c in able:
        if c.regex or c.keywords:
            hit = _any([_matches(texts, p) for p in c.regex])
            if c.keywords:
                hit = hit | _holds(texts, c.keywords)
            veto = _any([_matches(texts, p) for p in c.excludes])
            hits.append(F.when(F.array_contains("admitted", F.lit(c.key)) & hit & ~veto, F.struct(F.lit(-c.priority).alias("p"), F.lit(at[c.key]).alias("place"), F.lit(c.key).alias("key"))))
    none = F.array().cast("array<struct<p:int,place:int,key:string>>")
    rows_ = rows_.withColumn("hits", F.array_sort(F.array_compact(F.array(*hits))) if hits else none)
    computed = [a for c in concepts if c.mode == "derive" for a in c.aliases]
    known = spark.createDataFrame([(a,) for a in computed] or [("",)], "name string").select(normalize_label(F.col("name")).alias("name")).distinct()
    refused = [r["name"] for r in known.collect() if r["name"]]
    rows_ = rows_.withColumn("refused", F.exists("segments", lambda s: s.isin(*refused)) if refused else F.lit(False))
    best = F.filter("hits", lambda h: h["p"] == F.col("hits")[0]["p"])
    tied = F.filter(F.transform(best, lambda h: h["key"]), lambda a: F.exists(best, lambda b: (a != b["key"]) & mutual(a, b["key"])))
    n = F.size("hits")
    method = F.when(F.col("o.how") == "tie", "tie").when(F.col("o.how").isNotNull(), F.col("o.how")).when(F.col("refused"), "computed").when((n > 1) & (F.size(tied) > 1) & F.lit(binding), "tie").when(n > 0, "rule").otherwise("unmapped")
    out = rows_.withColumn("method", method)
    key = F.when(F.col("method").isin("exact", "rerouted"), F.col("o.key")).when(F.col("method") == "rule", F.col("hits")[0]["key"])
    score = F.when(F.col("method").isin("exact", "rerouted"), 1.0).when(F.col("method") == "rule", F.when(n == 1, SURE).otherwise(UNSURE)).otherwise(0.0)
    others = F.when(F.col("o.how") == "tie", F.array_sort("o.all")).when(n > 0, F.transform("hits", lambda h: h["key"])).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, key.alias("canonical_key"), "method", score.alias("confidence"), (score < SURE).alias("needs_review"), F.array_join(F.when(F.col("method").isin("exact", "rerouted"), F.array("o.key")).otherwise(others), ",").alias("candidates"))


def _reroutes(per: DataFrame, able: list[Concept], place: dict, caption: Column) -> DataFrame:
    """``per`` with routed: where all claimants are refused, the one sibling of a claimant that the banner's section names and that is the same thing."""
    section = section_of_banner(F.col("banner"))
    out = F.lit(None).cast("string")
    for c in able:
        if not c.family:
            continue
        for target in able:
            if target.family == c.family and target.key != c.key and _variant(target.key) == _variant(c.key) and _variant(c.key) is not None:
                rivals = [s for s in able if s.family == c.family and set(place[s.key][1]) & set(place[target.key][1])]
                if len(rivals) == 1:
                    fits = _claims(c.key) & section.isin(*place[target.key][1]) & F.array_contains("admitted", F.lit(target.key))
                    out = F.when(fits, target.key).otherwise(out)
    return per.withColumn("routed", F.when(F.size("ok") == 0, out))

