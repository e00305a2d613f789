"""Words and cells of pages to rows, columns, headings and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_clusters(words: DataFrame, keys: list[str], y: str, word: str, tol: float) -> DataFrame:
    """keys, row, words: greedy rows of a page. A word joins the row while it lies within tol of the row's mean height.

    The mean moves with each word, so a page is folded in order; a page's words are one array in one row.
    """
    page = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col(word).alias("w")))).alias("ws"))
    fold = (
        "aggregate(ws, struct(cast(array() as array<struct<row:int,w:bigint>>) as found, 0 as row, 0 as n, 0D as total), (s, x) -> "
        f"if(s.n > 0 and abs(x.y - s.total / s.n) <= {tol}D, "
        "struct(concat(s.found, array(struct(s.row as row, cast(x.w as bigint) as w))) as found, s.row as row, s.n + 1 as n, s.total + x.y as total), "
        "struct(concat(s.found, array(struct(s.row + 1 as row, cast(x.w as bigint) as w))) as found, s.row + 1 as row, 1 as n, x.y as total)), s -> s.found)"
    )
    return page.select(*keys, F.inline(F.expr(fold)))


def running_headers(words: DataFrame, doc: str, page: str, caption: str, least: int) -> DataFrame:
    """Captions that stand on at least ``least`` pages of a document."""
    return words.groupBy(doc, caption).agg(F.count_distinct(page).alias("pages")).where(F.col("pages") >= least)


def column_bases(headers: DataFrame, keys: list[str], column: str, marker: str) -> DataFrame:
    """The basis of each column: the last marker at or left of it, for columns left of all markers the first one.

    Both or nothing: a header that names one basis only gives none.
    """
    w = Window.partitionBy(*keys).orderBy(column)
    every = Window.partitionBy(*keys)
    last, first = F.last(marker, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(marker, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = F.size(F.collect_set(marker).over(every)) >= 2
    return headers.withColumn("basis", F.when(both, F.coalesce(last, first)))


def note_sections(rows: DataFrame, keys: list[str], order: str, heading: Column) -> DataFrame:
    """Rows by the heading above them (segment, from 1); rows before the first heading go."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("segment", F.sum(F.when(heading, 1).otherwise(0)).over(w)).where("segment > 0")


def scale_conflicts(rows: DataFrame, keys: list[str], order: str, amount: str, total: Column, factor: float, tol: float = 0.01) -> DataFrame:
    """Printed totals that the running sum since the last total meets only after multiplying by the factor, or dividing."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = rows.withColumn("_total", total).withColumn("_run", F.coalesce(F.sum(F.col("_total").cast("int")).over(before), F.lit(0)))
    inner = Window.partitionBy(*keys, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.withColumn("running", F.sum(amount).over(inner)).where(F.col("_total") & (F.coalesce("running", F.lit(0.0)) != 0))
    ratio = F.abs(F.col(amount) / F.col("running"))
    return sums.where((F.abs(ratio / factor - 1) <= tol) | (F.abs(ratio * factor - 1) <= tol)).drop("_total", "_run")


def cell_context(cells: DataFrame, targets: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Cells within ``radius`` rows and columns of target cells (t_row, t_col). Blocks of rows make it an equi-join."""
    side = radius * 2 + 1
    near = targets.withColumn("_block", F.explode(F.sequence(F.floor((F.col("t_row") - radius) / side), F.floor((F.col("t_row") + radius) / side))))
    joined = cells.withColumn("_block", F.floor(F.col("row") / side)).join(near, [*keys, "_block"])
    return joined.where((F.abs(F.col("row") - F.col("t_row")) <= radius) & (F.abs(F.col("col") - F.col("t_col")) <= radius)).drop("_block")


def bands(points: DataFrame, edges: list[float], x: str) -> DataFrame:
    """The number of the band with left < x <= right, null outside."""
    out = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when((F.col(x) > a) & (F.col(x) <= b), i).otherwise(out)
    return points.withColumn("band", out)


def split_words(items: DataFrame, keys: list[str], text: str, x0: str, x1: str) -> DataFrame:
    """Words of a text item, its box dealt out by their lengths."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = items.withColumn("_ws", words).withColumn("_n", F.aggregate("_ws", F.lit(0), lambda a, w: a + F.length(w)) + F.size("_ws") - 1)
    at = F.expr("transform(_ws, (w, i) -> struct(w as word, aggregate(slice(_ws, 1, i), 0, (a, v) -> a + length(v) + 1) as before))")
    rows = rows.select(*keys, x0, x1, "_n", F.posexplode(at).alias("place", "w"))
    width = (F.col(x1) - F.col(x0)) / F.col("_n")
    return rows.select(*keys, "place", F.col("w.word").alias("word"), (F.col(x0) + width * F.col("w.before")).alias("left"), (F.col(x0) + width * (F.col("w.before") + F.length("w.word"))).alias("right"))


def box_of(polygon: Column, width: Column, height: Column) -> Column:
    """The upright box, in shares of the page, of a polygon x0, y0, x1, y1 ..."""
    xs, ys = F.filter(polygon, lambda v, i: i % 2 == 0), F.filter(polygon, lambda v, i: i % 2 == 1)
    return F.struct((F.array_min(xs) / width).alias("x0"), (F.array_min(ys) / height).alias("y0"), (F.array_max(xs) / width).alias("x1"), (F.array_max(ys) / height).alias("y1"))


def union_box(box: str = "box") -> Column:
    """The box around all boxes of a group."""
    f = F.col
    return F.struct(F.min(f(f"{box}.x0")).alias("x0"), F.min(f(f"{box}.y0")).alias("y0"), F.max(f(f"{box}.x1")).alias("x1"), F.max(f(f"{box}.y1")).alias("y1"))
