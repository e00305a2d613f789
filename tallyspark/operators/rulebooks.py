"""Checks and folding of templates and rulebooks. They are configuration: dictionaries on the driver, or frames of their size."""

from __future__ import annotations

import copy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.documents import BUCKETS

#: The languages that a template and its rulebook have to speak alike, and how many unknown keys are told.
LANGUAGES = ("en", "zh", "ar", "fr")
MOST_UNKNOWN = 40


def resolve_inherits(rulebook: dict) -> dict:
    """A rulebook whose concepts have what the section that they inherit says and they don't; the concept's own word wins. An unknown section is an error."""
    sections, concepts = rulebook.get("section_defaults"), rulebook.get("mappings")
    if not isinstance(sections, dict) or not isinstance(concepts, list):
        return rulebook
    heirs = lambda c: isinstance(c, dict) and "inherits" in c
    lost = [f"{c.get('canonical_key', '?')} inherits {c['inherits']!r}" for c in concepts if heirs(c) and not isinstance(sections.get(c["inherits"]), dict)]
    if lost:
        raise ValueError("no such section: " + "; ".join(lost))
    return rulebook | {"mappings": [copy.deepcopy(sections[c["inherits"]]) | c if heirs(c) else c for c in concepts]}


def unknown_keys(given, known, path: str = "") -> list[str]:
    """Paths of keys that a definition has and its schema, a definition with every key, lacks; the first forty."""
    out: list[str] = []
    if isinstance(given, dict) and isinstance(known, dict):
        for k, v in given.items():
            at = f"{path}.{k}" if path else str(k)
            out += unknown_keys(v, known[k], at) if k in known else [at]
    elif isinstance(given, list) and isinstance(known, list) and known:
        for i, v in enumerate(given):
            out += unknown_keys(v, known[min(i, len(known) - 1)], f"{path}[{i}]")
    return out[:MOST_UNKNOWN]


def walk(template: dict) -> list[tuple[str, str, str | None, str | None, str | None]]:
    """(statement, node, parent, key, role) of all sections and what is below them, in order."""
    out = []
    for statement in template.get("statements", ()):
        waiting = [(s, None) for s in reversed(statement.get("sections", ()))]
        while waiting:
            node, parent = waiting.pop()
            out.append((statement["type"], node["node_id"], parent, node.get("canonical_key"), node.get("role")))
            waiting += [(c, node["node_id"]) for c in reversed(node.get("children", ()))]
    return out


def kpi_problems(keys: DataFrame, terms: DataFrame) -> DataFrame:
    """location, problem: terms of indicators (owner, key, kind: ratio or intermediate) that are neither keys nor intermediates, and intermediates in a circle.

    keys: key. A circle is found by taking away, level by level, the intermediates that rest on nothing waiting; the rest can never be evaluated.
    """
    made = terms.where("kind = 'intermediate'").select(F.col("owner").alias("key")).distinct()
    unknown = terms.join(keys.select("key").union(made), "key", "left_anti").select("owner", "key")
    bad = unknown.select(F.col("owner").alias("location"), F.concat(F.lit("unknown "), "key").alias("problem"))
    edges = [(r["owner"], r["key"]) for r in terms.where("kind = 'intermediate'").join(made, "key", "left_semi").select("owner", "key").collect()]
    waiting = {r["key"] for r in made.collect()}
    while True:
        ready = {k for k in waiting if not any(o == k and x in waiting for o, x in edges)}
        if not ready:
            break
        waiting -= ready
    if not waiting:
        return bad.distinct()
    rows = terms.sparkSession.createDataFrame([(k, "cycle") for k in sorted(waiting)], "location string, problem string")
    return bad.union(rows).distinct()


def against_template(concepts: DataFrame, rules: DataFrame, keys: DataFrame) -> DataFrame:
    """location, problem: concepts (key, bucket) and decompositions (id, face_key) of a rulebook that the template (key) doesn't know, and buckets that don't exist."""
    no_key = concepts.join(keys, "key", "left_anti").select(F.concat(F.lit("mapping:"), "key").alias("location"), F.lit("unknown key").alias("problem"))
    no_bucket = concepts.where((F.col("bucket") != "") & ~F.col("bucket").isin(*BUCKETS)).select(F.concat(F.lit("mapping:"), "key"), F.lit("unknown bucket"))
    no_face = rules.join(keys.withColumnRenamed("key", "face_key"), "face_key", "left_anti").select(F.concat(F.lit("decomposition:"), "id"), F.lit("unknown face key"))
    return no_key.union(no_bucket).union(no_face).distinct()


def parity(labels: DataFrame, sources: tuple[str, ...], languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """key, at_par, missing: whether every source has a label of a key in every language; what lacks, as source/language. labels: source, key, language, text."""
    have = F.collect_set(F.when(F.trim("text") != "", F.concat_ws("/", "source", "language")))
    wanted = F.array(*[F.lit(f"{s}/{x}") for s in sources for x in languages])
    return labels.groupBy("key").agg(F.array_except(wanted, have).alias("m")).select("key", (F.size("m") == 0).alias("at_par"), F.array_join("m", ",").alias("missing"))


def localized(labels, language: str):
    """The label in a language, else in English. labels: a map column."""
    return F.coalesce(F.element_at(labels, language), F.element_at(labels, "en"))
