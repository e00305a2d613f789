"""Text exports, content-addressed storage and run results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.text import csv_safe


def slot_order(facts: DataFrame) -> DataFrame:
    """doc_id, basis, period_label, place: a document's columns, consolidated first, then as first printed."""
    seen = facts.groupBy("doc_id", "basis", "period_label").agg(F.min("ordinal").alias("_o"))
    w = Window.partitionBy("doc_id").orderBy(F.col("basis") != "consolidated", "_o", "basis", "period_label")
    return seen.withColumn("place", F.row_number().over(w)).drop("_o")


def csv_headers(slots: DataFrame) -> DataFrame:
    """``slots`` with header: "Value" of a single column, else the period, with the basis if the document has both; equal ones get (2), (3)."""
    every = Window.partitionBy("doc_id")
    n, both = F.count("*").over(every), F.min("basis").over(every) != F.max("basis").over(every)
    base = F.when(n <= 1, "Value").when(both, F.concat("period_label", F.lit(" ("), "basis", F.lit(")"))).otherwise(F.col("period_label"))
    rows = slots.withColumn("header", base)
    k = F.row_number().over(Window.partitionBy("doc_id", "header").orderBy("place"))
    return rows.withColumn("_k", k).withColumn("header", F.when(F.col("_k") > 1, F.concat("header", F.lit(" ("), F.col("_k").cast("string"), F.lit(")"))).otherwise(F.col("header"))).drop("_k")


def quoted(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_documents(facts: DataFrame, value: str = "value", scale: float = 1.0) -> DataFrame:
    """doc_id, content: a document's CSV as a spreadsheet takes it (byte order mark, CRLF); one line a printed row, never merged by caption.

    Figures stand as printed if scale is 1, else multiplied and rounded. A file is one row, so a document's rows meet there.
    """
    headers = csv_headers(slot_order(facts))
    head = headers.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "header"))).alias("h"), F.count("*").cast("int").alias("n"))
    figure = F.col(value).cast("string") if scale == 1 else F.round(F.col(value) * scale).cast("long").cast("string")
    line = F.struct("ordinal", quoted(csv_safe(F.col("source_label"))).alias("caption"), "place", F.coalesce(figure, F.lit("")).alias("figure"))
    rows = facts.join(headers, ["doc_id", "basis", "period_label"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(line)).alias("r"))
    text = F.expr("transform(r, x -> concat(x.caption, ',', array_join(transform(sequence(1, n), i -> if(i = x.place, x.figure, '')), ',')))")
    first = F.concat(F.lit("Caption,"), F.array_join(F.transform("h", lambda x: quoted(x["header"])), ","))
    return rows.join(head, "doc_id").select("doc_id", F.concat(F.lit("﻿"), F.array_join(F.concat(F.array(first), text), "\r\n"), F.lit("\r\n")).alias("content"))


def put_objects(files: DataFrame, folder: str) -> None:
    """Adds doc_hash, content of ``files`` to the store at ``folder``: a table by the hash's first byte; what it has isn't written again."""
    spark = files.sparkSession
    new = files.select("doc_hash", "content").dropDuplicates(["doc_hash"]).withColumn("shard", F.substring("doc_hash", 1, 2))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = new.join(spark.read.parquet(folder).select("doc_hash"), "doc_hash", "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(folder)


def get_objects(spark, folder: str, hashes: DataFrame) -> DataFrame:
    """doc_hash, content of the wanted hashes; only their shards are read. A missing one gives null content."""
    wanted = hashes.select("doc_hash").distinct().withColumn("shard", F.substring("doc_hash", 1, 2))
    return wanted.join(spark.read.schema("doc_hash string, content binary, shard string").parquet(folder), ["doc_hash", "shard"], "left").select("doc_hash", "content")


def write_run(frames: dict[str, DataFrame], folder: str, run_id: str) -> dict[str, str]:
    """The results of a run as tables below ``folder``, by name and run; writing a run again replaces it."""
    out = {}
    for name, frame in frames.items():
        out[name] = f"{folder}/{name}/run={run_id}"
        frame.write.mode("overwrite").parquet(out[name])
    return out
