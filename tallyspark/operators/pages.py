"""Words of a page to columns, phrases, captions and matrices. Coordinates are shares of the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BARE_NOTE = r"^[0-9]{1,2}(\([a-z]\))?$"
MONEY = r"^[(\-−–]?[$€£]?[0-9][0-9,.]*\)?$|^[-–—]$"


def value_bands(words: DataFrame, keys: list[str], x: str, gap: float = 0.035, least: int = 3) -> DataFrame:
    """keys, band, middle, cells of the value columns of a page, from the centres of its money-like words (``row``, ``text``).

    Centres further apart than ``gap`` start a cluster. Clusters of fewer than ``least`` rows go, and those of which 80 percent
    (two at least) are bare note numbers. A page with a single column has none.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    rows = words.where(F.col("text").rlike(MONEY)).withColumn("_new", F.when(F.col(x) - F.lag(x).over(w) > gap, 1).otherwise(0))
    rows = rows.withColumn("_c", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    bare = F.count_if(F.col("text").rlike(BARE_NOTE))
    found = rows.groupBy(*keys, "_c").agg(F.percentile(x, 0.5).alias("middle"), F.count("*").alias("cells"), F.count_distinct("row").alias("_rows"), bare.alias("_bare"))
    found = found.where((F.col("_rows") >= least) & ~(F.col("_bare") >= F.greatest(F.lit(2.0), F.col("cells") * 0.8)))
    page = Window.partitionBy(*keys)
    return found.withColumn("_n", F.count("*").over(page)).where("_n >= 2").withColumn("band", F.row_number().over(page.orderBy("middle"))).select(*keys, "band", "middle", "cells")


def phrases(words: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """keys, place, text, left, right: words of a row (``left``, ``right``, ``text``) joined where the space between is at most ``gap``."""
    w = Window.partitionBy(*keys).orderBy("left", "right", "text")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = words.withColumn("_new", F.when(F.col("left") - reach > gap, 1).otherwise(0)).withColumn("place", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("left", "right", "text")))
    return rows.groupBy(*keys, "place").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("left").alias("left"), F.max("right").alias("right"))


def split_banner(runs: DataFrame, keys: list[str], banner: Column) -> DataFrame:
    """keys, banner, caption of rows of phrases: a first phrase that is a banner by itself is split off the caption behind it."""
    parts = F.array_sort(F.collect_list(F.struct("place", "text", banner.alias("b"))))
    rows = runs.groupBy(*keys).agg(parts.alias("p"))
    split = (F.size("p") > 1) & F.col("p")[0]["b"]
    caption = F.array_join(F.transform(F.when(split, F.slice("p", 2, F.size("p"))).otherwise(F.col("p")), lambda x: x["text"]), " ")
    return rows.select(*keys, F.when(split, F.col("p")[0]["text"]).alias("banner"), caption.alias("caption"))


def wrapped_captions(rows: DataFrame, keys: list[str], order: str, lines: int = 3, tight: tuple[float, float] = (-0.5, 0.6), align: float = 0.06) -> DataFrame:
    """keys, order, caption: captions that run over several lines, folded into the valued row they end at.

    rows: keys, order, text, valued, heading, top, bottom, left. A line without figures folds down if it is no heading, the next row
    is tight below it (in line heights) and aligned with it, and a valued row comes within ``lines`` lines. Lines above the page's
    first figure whose own figure row isn't reached that way stay as they are.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    space = (F.lead("top").over(w) - F.col("bottom")) / (F.col("bottom") - F.col("top"))
    joins = ~F.col("valued") & ~F.col("heading") & space.between(*tight) & (F.abs(F.lead("left").over(w) - F.col("left")) <= align)
    marked = rows.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    marked = marked.withColumn("_run", F.sum(F.when(~F.lag("_joins", 1, False).over(w), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_run")
    marked = marked.withColumn("_up", F.row_number().over(inner.orderBy(F.desc(order))) - 1).withColumn("_ends", F.max(F.when(F.col("valued"), F.col(order))).over(inner))
    target = F.when(F.col("_ends").isNotNull() & (F.col("_up") <= lines), F.col("_ends")).otherwise(F.col(order))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"))))
    return marked.withColumn("_to", target).groupBy(*keys, F.col("_to").alias(order)).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("caption"))


def scan_row(words: Column, apart: float = 0.01) -> Column:
    """struct (label, note, values) of a row's words, an array of structs (left, right, text) in order.

    The first money-like word that isn't the note reference begins the values; other words behind it are dropped. A reference is a
    bare note number before the values that stands ``apart`` from the caption or behind the word Note.
    """
    money = lambda w: w["text"].rlike(MONEY)
    ref = F.array_min(
        F.filter(
            F.transform(words, lambda w, i: F.when(w["text"].rlike(BARE_NOTE) & (i > 0) & ((w["left"] - F.get(words, i - 1)["right"] > apart) | F.lower(F.get(words, i - 1)["text"]).isin("note", "notes")) & F.exists(F.slice(words, i + 2, F.size(words)), money), i)),
            lambda i: i.isNotNull(),
        )
    )
    firsts = F.transform(words, lambda w, i: F.when(money(w), i))
    first = F.array_min(F.filter(firsts, lambda i: i.isNotNull()))
    is_ref = ref.isNotNull() & (ref == first)
    start = F.when(is_ref, F.array_min(F.filter(firsts, lambda i: i > ref))).otherwise(first)
    head = F.slice(words, 1, F.coalesce(F.when(is_ref, ref), start, F.size(words)))
    label = F.array_join(F.transform(F.filter(head, lambda w: ~(is_ref & F.lower(w["text"]).isin("note", "notes"))), lambda w: w["text"]), " ")
    values = F.when(start.isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.filter(F.slice(words, start + 1, F.size(words)), money), lambda w: w["text"]))
    return F.struct(label.alias("label"), F.when(is_ref, F.get(words, ref)["text"]).alias("note"), values.alias("values"))


def note_column(headers: DataFrame, words: DataFrame, keys: list[str], x: str, near: float = 0.03, least: int = 2) -> DataFrame:
    """keys, note_x: the header place (``hx``) with most bare note numbers within ``near``; fewer than ``least`` are none; of equals the left one.

    A page's headers are an array beside its words, so a word is compared within its row.
    """
    places = headers.groupBy(*keys).agg(F.array_sort(F.collect_set("hx")).alias("hs"))
    bare = words.where(F.col("text").rlike(BARE_NOTE)).join(places, keys)
    hits = bare.select(*keys, F.explode(F.filter("hs", lambda h: F.abs(h - F.col(x)) <= near)).alias("hx")).groupBy(*keys, "hx").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return hits.groupBy(*keys).agg(F.max_by("hx", F.struct("n", -F.col("hx"))).alias("note_x"))


def header_region(rows: DataFrame, keys: list[str], order: str, amount: Column, y: str, top: float = 0.4) -> DataFrame:
    """Rows up to and with the first that carries an amount, in the page's top part; a page without amounts keeps its top part."""
    first = F.min(F.when(amount, F.col(order))).over(Window.partitionBy(*keys))
    return rows.withColumn("_first", first).where((F.col("_first").isNull() | (F.col(order) <= F.col("_first"))) & (F.col(y) <= top)).drop("_first")


def dominant_rotation(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rotation: the direction (0, 90, 180, 270) in which most letters run; of equals the smaller."""
    sums = lines.groupBy(*keys, "rotation").agg(F.sum(F.length("text")).alias("n"))
    return sums.groupBy(*keys).agg(F.max_by("rotation", F.struct("n", -F.col("rotation"))).alias("rotation"))


def reading_space(box: Column, rotation: Column) -> Column:
    """A box (x0, y0, x1, y1) turned so that text of this rotation reads from left to right."""
    at = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    x0, y0, x1, y1 = (box[k] for k in ("x0", "y0", "x1", "y1"))
    return F.when(rotation == 90, at(y0, 1 - x1, y1, 1 - x0)).when(rotation == 180, at(1 - x1, 1 - y1, 1 - x0, 1 - y0)).when(rotation == 270, at(1 - y1, x0, 1 - y0, x1)).otherwise(at(x0, y0, x1, y1))


def bases_of_columns(columns: DataFrame, captions: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, x, basis of a page's columns under k captions (cx, basis): equal runs if k divides their number, else the nearest caption made monotone."""
    heads = captions.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cx", "basis"))).alias("h"))
    page = Window.partitionBy(*keys)
    rows = columns.join(heads, keys).withColumn("_n", F.count("*").over(page)).withColumn("_i", F.row_number().over(page.orderBy(x)) - 1).withColumn("_k", F.size("h"))
    nearest = F.array_min(F.transform("h", lambda c, i: F.struct(F.abs(c["cx"] - F.col(x)).alias("d"), i.alias("i"))))["i"]
    monotone = F.max(nearest).over(page.orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    i = F.when(F.col("_n") % F.col("_k") == 0, F.floor(F.col("_i") * F.col("_k") / F.col("_n")).cast("int")).otherwise(monotone)
    return rows.withColumn("_at", i).select(*keys, x, F.get("h", F.col("_at"))["basis"].alias("basis"))


def matrix(cells: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """keys, row, component, place, value: rows with ``least`` named cells or more; components in order of their median column."""
    rows = cells.where("component is not null").withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "row"))).where(F.col("_n") >= least)
    idx = F.array_sort(F.collect_list("column_index"))
    order = rows.groupBy(*keys, "component").agg(F.element_at(idx, F.floor(F.size(idx) / 2).cast("int") + 1).alias("_m"))
    order = order.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("_m", "component"))).drop("_m")
    return rows.join(order, [*keys, "component"]).select(*keys, "row", "component", "place", "value")


def closing_figure(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, closing: the figure of the last row that has one."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(order, value)).alias("closing"))
