"""Templates and rulebooks as workbooks and back, without loss, and the statement workbook shaped by a template."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sinks.workbooks import workbook
from tallyspark.sources.files import cells_of

NODE = ("section", "key", "label", "role", "op", "children", "order")
CONCEPT = ("canonical_key", "statement", "section", "match_priority", "aliases", "hints", "exclude_hints")


def template_workbook(nodes: list[dict]) -> bytes:
    """Nodes of a template, a row each; children are joined by commas, what else a node has is kept as JSON."""
    rows = [[*NODE, "more"]]
    for n in nodes:
        more = {k: v for k, v in n.items() if k not in NODE}
        rows.append([n.get("section"), n.get("key"), n.get("label"), n.get("role"), n.get("op"), ",".join(n.get("children") or []) or None, n.get("order"), json.dumps(more, sort_keys=True, ensure_ascii=False) if more else None])
    return workbook({"Template": rows})


def _table(data: bytes, sheet: str) -> list[tuple[int, dict]]:
    """(printed row number, values by column name) of a sheet whose first row names its columns."""
    grid: dict[int, dict[int, object]] = {}
    for name, row, col, text, number, _ in cells_of(data):
        if name == sheet:
            grid.setdefault(row, {})[col] = text if number is None else int(number) if number == int(number) else number
    names = grid.pop(0, {})
    return [(r + 1, {names[c]: v for c, v in sorted(grid[r].items()) if c in names}) for r in sorted(grid)]


def read_template(data: bytes) -> list[dict]:
    """The nodes of a template workbook. All that is wrong is said at once, with row numbers: keys missing or given twice, calculated
    nodes without children, children that aren't there or are the node itself, sections that are taken up again."""
    nodes, wrong, seen, sections = [], [], {}, []
    for r, v in _table(data, "Template"):
        node = {k: v[k] for k in NODE if k in v and k != "children"}
        node["children"] = [c.strip() for c in str(v["children"]).split(",") if c.strip()] if "children" in v else []
        node |= json.loads(v["more"]) if v.get("more") else {}
        key = node.get("key")
        if not key:
            wrong.append(f"row {r}: no key")
        elif key in seen:
            wrong.append(f"row {r}: key {key} is given in row {seen[key]}")
        seen.setdefault(key, r)
        if node.get("op") and not node["children"]:
            wrong.append(f"row {r}: {key} is calculated but has no children")
        if not sections or sections[-1] != node.get("section"):
            if node.get("section") in sections:
                wrong.append(f"row {r}: section {node.get('section')} is taken up again")
            sections.append(node.get("section"))
        nodes.append((r, node))
    for r, node in nodes:
        for c in node["children"]:
            if c == node.get("key"):
                wrong.append(f"row {r}: {c} is its own child")
            elif c not in seen:
                wrong.append(f"row {r}: unknown child {c}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return [n for _, n in nodes]


def rulebook_workbook(concepts: list[dict]) -> bytes:
    """Concepts of a rulebook, a row each: lists as JSON, fields without a column of their own in the last one."""
    dump = lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False) if isinstance(v, (list, dict, bool)) else v
    rows = [[*CONCEPT, "more"]]
    for c in concepts:
        more = {k: v for k, v in c.items() if k not in CONCEPT or v is None}
        rows.append([*(dump(c.get(k)) for k in CONCEPT), dump(more) if more else None])
    return workbook({"Concepts": rows})


def read_rulebook(data: bytes) -> list[dict]:
    lists = ("aliases", "hints", "exclude_hints")
    out = []
    for _, v in _table(data, "Concepts"):
        c = {k: json.loads(v[k]) if k in lists else v[k] for k in CONCEPT if k in v}
        out.append(c | (json.loads(v["more"]) if v.get("more") else {}))
    return out


def skeleton(nodes: list[dict]) -> list[dict]:
    """An empty rulebook for a template: a concept for each node, calculated ones marked as derived."""
    statement = {"bs": "balance_sheet", "pl": "profit_and_loss", "cf": "cash_flow", "eq": "changes_in_equity"}
    return [{"canonical_key": n["key"], "statement": statement.get(n["key"].split("_")[0]), "section": n.get("section"), "match_priority": 0, "aliases": [], "hints": [], "exclude_hints": [], "derive": bool(n.get("op"))} for n in nodes]


def statement_rows(cells: DataFrame, nodes: DataFrame, slots: list[tuple[str, str]]) -> DataFrame:
    """doc_id, place, section, key, label, a column a slot, confidence: every node of a template for each document, in its order.

    cells: doc_id, key, basis, period_label, printed, computed, edited, confidence. A computed figure beats a printed one unless it was
    edited; the confidence of a row is its weakest. nodes: place, section, key, label; a template is small and joined by its size.
    """
    figure = F.when(F.col("edited"), F.col("printed")).otherwise(F.coalesce("computed", "printed"))
    at = lambda b, p: F.max(F.when((F.col("basis") == b) & (F.col("period_label") == p), figure)).cast("double").alias(f"{b}_{p}")
    made = cells.groupBy("doc_id", "key").agg(*[at(b, p) for b, p in slots], F.min("confidence").alias("confidence"))
    keys = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("place", "section", "key", "label")]) for r in nodes.orderBy("place").collect()])
    frame = cells.select("doc_id").distinct().select("doc_id", F.inline(keys))
    return frame.join(made, ["doc_id", "key"], "left").select("doc_id", "place", "section", "key", "label", *[f"{b}_{p}" for b, p in slots], "confidence")
