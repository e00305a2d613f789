"""The corpus operators as named queries over the driver's tables, with SQL where SQL can tell the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import exact_dup, html_extract, lang_id, media, near_dup, packing, pii, sp_codec, suffix_dedup, url_filter


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    labels = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("blocked"))
    labelled = pages.select("page_id", "url").join(labels.where("blocked is not null").dropDuplicates(["page_id"]), "page_id").select("url", "blocked")
    return url_filter.judge_urls(pages, labelled)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_read(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.encode(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), percent=85)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_read(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_read(spark, sf_dir, "pages"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dup.exact_duplicates(_read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_read(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_rules, op2_packing, op3_media_columns, op4_sentencepiece, op5_minhash, op6_language, op7_main_text, op8_exact, op9_pii, op10_repeats)}

ORACLE = {
    "op1_url_rules": url_filter.oracle_sql(),
    "op3_media_columns": media.oracle_sql(),
    "op5_minhash": near_dup.oracle_sql(85),
    "op8_exact": (
        "select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, row_number() over (w order by doc_id desc nulls last) = 1 as kept, "
        "sha256(coalesce(text, '')) as text_sha256 from documents window w as (partition by coalesce(text, ''))"
    ),
    "op9_pii": pii.oracle_sql(),
    "op10_repeats": suffix_dedup.ORACLE_SQL,
}
