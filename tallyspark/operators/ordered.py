"""Operators over an order: page decoding, carrying forward, clustering along a line, ranks of periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of pages, the cost of going from one to another (row to column), and the start's cost.
STATES = ("PRE", "FACE", "NOTES", "POST")
COST = ((0, 0, 1, 6), (8, 0, 0, 4), (10, 3, 0, 0), (10, 6, 6, 0))
START = (0, 0, -2, -2)


def decode_pages(pages: DataFrame, emission: tuple[str, ...] = STATES) -> DataFrame:
    """doc_id, page_index, state: the best path over a document's pages, by one fold a document.

    pages: doc_id, page_index and a score for each state. Of equal paths the state listed first wins. A document's pages
    are an array in one row; documents, not pages, are what the data grow by.
    """
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", F.array(*[F.col(e).cast("double") for e in emission]).alias("e")))).alias("p"))
    steps = ", ".join(
        f"array_max(array({', '.join(f'struct(s.v[{i}] - {COST[i][j]}D as v, {len(STATES) - i} as o)' for i in range(len(STATES)))}))" for j in range(len(STATES))
    )
    start = ", ".join(f"p[0].e[{j}] + {float(START[j])}D" for j in range(len(STATES)))
    n = len(STATES)
    walk = (
        f"aggregate(slice(p, 2, greatest(size(p) - 1, 0)), struct(array({start}) as v, cast(array() as array<array<int>>) as back), "
        f"(s, x) -> aggregate(array(array({steps})), s, (t, b) -> struct(transform(b, (m, j) -> m.v + x.e[j]) as v, concat(t.back, array(transform(b, m -> {n} - m.o))) as back)))"
    )
    last = f"{n} - array_max(transform(w.v, (v, j) -> struct(v, {n} - j as o))).o"
    path = f"aggregate(reverse(w.back), array({last}), (a, b) -> concat(array(b[a[0]]), a))"
    names = "array(" + ", ".join(f"'{s}'" for s in STATES) + ")"
    found = rows.withColumn("w", F.expr(walk)).withColumn("path", F.expr(path))
    return found.select("doc_id", F.explode(F.expr(f"transform(path, (k, i) -> struct(p[i].page_index as page_index, {names}[k] as state))")).alias("x")).select("doc_id", "x.page_index", "x.state")


def notes_follow_face(decoded: DataFrame) -> DataFrame:
    """A NOTES page before the document's first FACE page is OTHER; without any FACE nothing changes."""
    first = F.min(F.when(F.col("state") == "FACE", F.col("page_index"))).over(Window.partitionBy("doc_id"))
    return decoded.withColumn("state", F.when((F.col("state") == "NOTES") & (F.col("page_index") < first), "OTHER").otherwise(F.col("state")))


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: str, reset: str | None = None) -> DataFrame:
    """``value`` filled from the last row that has it; where ``reset`` holds the carrying starts anew."""
    if reset:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_run", F.sum(F.when(F.col(reset), 1).otherwise(0)).over(w))
        keys = [*keys, "_run"]
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"{value}_carried", F.last(value, True).over(w)).drop("_run")


def gap_clusters(points: DataFrame, keys: list[str], x: str, gap: float) -> DataFrame:
    """Islands along x: a gap wider than ``gap`` starts a cluster; first, last, members and median (the mean of the middle two) of each."""
    w = Window.partitionBy(*keys).orderBy(x)
    new = F.when(F.col(x) - F.lag(x).over(w) > gap, 1).otherwise(0)
    marked = points.withColumn("_new", new).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "cluster").agg(
        F.min(x).alias("first"), F.max(x).alias("last"), F.count("*").alias("members"), F.percentile(x, 0.5).alias("middle")
    )


def nearest(points: DataFrame, bands: list[tuple[str, float]], x: str, tol: float) -> DataFrame:
    """``points`` with the nearest band's name, null beyond ``tol``; of equally near ones the first."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.col(x) - F.lit(at)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, at) in enumerate(bands)]))
    return points.withColumn("band", F.when(near["d"] <= tol, near["name"]))


def period_ranks(headings: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Distinct dates of a basis, newest first: current, prior, col2, col3 ..."""
    w = Window.partitionBy(*keys).orderBy(F.desc(date))
    rank = F.dense_rank().over(w)
    return headings.withColumn("period_label", F.when(rank == 1, "current").when(rank == 2, "prior").otherwise(F.concat(F.lit("col"), (rank - 1).cast("string"))))


def column_labels(headers: DataFrame, keys: list[str], date: str, period: str, marked: str, text: str) -> DataFrame:
    """keys, col, period_label of the value columns of a sheet and basis.

    Columns that head a period (or nothing) rank by their dates, newest first, if all are dated and not alike, else by place: current, prior, col2 ...
    Of columns of one rank the first that isn't restated has the label, the others the label with _restated or their own column. A heading that
    is no period is its own label. headers: keys, col, and columns of the date (null: none), period (boolean), restated (boolean), text.
    """
    w = Window.partitionBy(*keys, period)
    dated = (F.count(date).over(w) == F.count("*").over(w)) & (F.min(date).over(w) != F.max(date).over(w))
    rank = F.when(dated, F.dense_rank().over(w.orderBy(F.desc(date)))).otherwise(F.row_number().over(w.orderBy("col"))) - 1
    rows = headers.withColumn("_r", rank)
    base = F.when(F.col("_r") == 0, "current").when(F.col("_r") == 1, "prior").otherwise(F.concat(F.lit("col"), F.col("_r").cast("string")))
    again = F.row_number().over(Window.partitionBy(*keys, period, "_r").orderBy(marked, "col")) > 1
    label = F.when(~again, base).when(F.col(marked), F.concat(base, F.lit("_restated"))).otherwise(F.concat(base, F.lit("_col"), F.col("col").cast("string")))
    return rows.select(*keys, "col", F.when(F.col(period), label).otherwise(F.col(text)).alias("period_label"))
