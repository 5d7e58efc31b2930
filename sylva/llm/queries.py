"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import bpe, chat, decontaminate, html_text, language_id, near_dup, quality, secrets, sharding, topk
from sylva.llm.common import crc32_of_id, pick, table
from sylva.llm.oracle import ORACLE_SQL  # noqa: F401


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    fold = crc32_of_id("doc_id") % 5
    model = language_id.train(docs.where(fold != 0))
    held_out = F.coalesce(crc32_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out")
    return language_id.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), pick(table(spark, sf_dir, "labels"), "doc_id", "quality")
    model = quality.train(docs, labels.where(crc32_of_id("doc_id") % 4 != 2))
    held_out = F.coalesce(crc32_of_id("doc_id") % 4 == 2, F.lit(False)).alias("held_out")
    return quality.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pick(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = pick(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shard(rows, ("doc_id", "size", "text_crc32"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_html_extraction, op3_minhash_near_dedup, op4_decontamination, op5_secret_scan, op6_bpe, op7_quality, op8_exact_top_k, op9_chat_format, op10_sharding)
}
