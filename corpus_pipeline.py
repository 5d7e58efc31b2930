"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return
the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import bpe, decontaminate, near_dup, quality, secrets
from sylva.llm.common import crc32_of_id, cut, pick, table
from sylva.llm.queries import vocabulary_path


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with columns c0, c1, ... whatever their names are, and those names for doc_id and text."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain, [f"c{docs.columns.index(name)}" for name in ("doc_id", "text")]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    plain, (_, text) = _numbered(docs)
    labels = pick(table(spark, sf_dir, "labels"), "doc_id", "quality")
    model = quality.train(docs, labels.where(crc32_of_id("doc_id") % 4 != 2))  # the rest is held out, as in op7
    scored = quality.score(plain, model, text=text, keep=tuple(plain.columns))
    return scored.where("predicted = 1").select(plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document with the smallest id; rows of an id with the same text count as one."""
    plain, (row_id, text) = _numbered(docs)
    found = near_dup.near_duplicates(docs)
    # the smaller side decides: ids that go, and ids with more than one row
    gone = cut(found.where("doc_id is not null and not kept").select(F.col("doc_id").alias(row_id)).distinct())
    repeated = cut(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(row_id)).count().where("count > 1").select(row_id))
    kept = plain.join(gone, row_id, "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, row_id, "left_semi").dropDuplicates([row_id, text])
        kept = kept.join(repeated, row_id, "left_anti").unionByName(once)
    return kept.select(plain.columns).toDF(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents with a benchmark passage, however long they are: n_hit > 0, without the share that makes ``contaminated``."""
    plain, (_, text) = _numbered(docs)
    marked = decontaminate.decontaminate(plain, table(spark, sf_dir, "benchmark"), text=text, keep=tuple(plain.columns))
    return marked.where("n_hit = 0").select(plain.columns).toDF(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in the texts by a mask."""
    plain, (row_id, text) = _numbered(docs)
    clean = secrets.redact(plain.withColumnRenamed(row_id, "id").withColumnRenamed(text, "text"))
    return clean.withColumnRenamed("id", row_id).withColumnRenamed("text", text).select(plain.columns).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the token ids of the text."""
    return bpe.encode(docs, vocabulary_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality_classifier", keep_good),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe_encoding", encode),
]

#: The stages with a trained model and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
