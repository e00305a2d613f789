"""Adapters from the driver's tables to the engine's frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A part's type stands for a concept, a line's status for a basis, its flag for a period.
CONCEPT_OF_TYPE = {
    "SMALL": "bs_current_assets__inventories",
    "MEDIUM": "bs_current_assets__trade_receivables",
    "LARGE": "bs_current_assets__others",
    "ECONOMY": "bs_current_liabilities__current_trade_payables",
    "STANDARD": "bs_current_liabilities__current_borrowings",
    "PROMO": "bs_current_liabilities__others",
}
BASIS_OF_STATUS = {"F": "consolidated", "O": "standalone"}
PERIOD_OF_FLAG = {"A": "current", "R": "prior", "N": "col2"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(col: Column, options: dict) -> Column:
    out = F.lit(None)
    for k, v in options.items():
        out = F.when(col == k, v).otherwise(out)
    return out


#: The order of a document's rows.
PRINTED = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "again")


def facts(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """The long fact table: a printed figure of a document, its concept, basis and period, whether an analyst typed it, and its place.

    Some rows are printed again: on the next page, which is the same fact, or on their own page, which is another one.
    ``part`` is a dimension: Spark broadcasts it while it is small by its own estimate and sorts it otherwise.
    ordered: adds ``ordinal``, the place of the row in its document as a number.
    """
    line, orders, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    again = F.when((n == 1) & (q >= 40) | (n == 2) & (q >= 45), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    typed = (n == 3) & (q == 50)
    amount = F.when(typed, F.lit("1000.5")).otherwise(F.col("l_extendedprice")).cast("decimal(28,4)")
    rows = line.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        part.select("p_partkey", "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    rows = rows.withColumn("again", F.explode(again))
    if ordered:
        rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*PRINTED)))
    page = (F.col("l_suppkey") % 10 + F.when(n == 1, F.col("again")).otherwise(0)).cast("int")
    return rows.select(
        F.col("o_custkey").alias("doc_id"), *(["ordinal"] if ordered else []), F.col("p_name").alias("source_label"),
        choose(F.col("p_type"), CONCEPT_OF_TYPE).alias("canonical_key"), choose(F.col("l_linestatus"), BASIS_OF_STATUS).alias("basis"),
        choose(F.col("l_returnflag"), PERIOD_OF_FLAG).alias("period_label"), page.alias("page_index"),
        F.regexp_extract("p_brand", "[0-9]+", 0).alias("note_number"), F.col("l_quantity").alias("quantity"), typed.alias("edited"), F.struct(*PRINTED).alias("place"),
        F.when(F.col("l_discount") >= 0.095, -amount).otherwise(amount).cast("decimal(28,4)").alias("value"),
    )


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exchange-rate master out of the events: base, quote, rate, as_of, created_at, id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.upper(F.substring("event_type", 1, 3)).alias("base"), F.concat(F.lit("Q"), (F.col("user_id") % 5).cast("string")).alias("quote"),
        F.col("value").alias("rate"), F.to_date("ts").alias("as_of"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"),
    )


#: What a figure's cell is.
CELL = ("doc_id", "canonical_key", "basis", "period_label")


def store_facts(facts: DataFrame, table_name: str, buckets: int, path: str | None = None) -> DataFrame:
    """The facts as a table bucketed by cell, one file a bucket, so that figures need no shuffle (concept_figures(..., arranged=True)) and grids a small one.

    buckets: as many as keep a bucket within an executor's memory; they are fixed when the table is written.
    """
    writer = facts.repartition(buckets, *CELL).write.bucketBy(buckets, *CELL).sortBy(*CELL).mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table_name)
    return facts.sparkSession.table(table_name)
