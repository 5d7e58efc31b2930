"""Structured Streaming over growing folders of sequences and event tables.

The batch operators work on streams as they are where they need no other rows (composition of a sequence, complement,
translation, gaps). Counts over a stream are kept as streaming aggregations here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.operators.sequences import BASES, count_of


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(label, seq) of FASTA files as they arrive in a folder."""
    records = spark.readStream.option("lineSep", ">").text(path).where("trim(value) <> ''")
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    return records.select(F.trim(F.translate(F.substring_index("value", "\n", 1), "\r", "")).alias("label"), F.regexp_replace(body, r"\s", "").alias("seq"))


def running_base_counts(seqs: DataFrame) -> DataFrame:
    """(base, n) over all sequences so far: one streaming aggregation of four sums."""
    each = seqs.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), count_of(F.lower("seq"), b).alias("n")) for b in BASES])).alias("x")).select("x.*")
    return each.groupBy("base").agg(F.sum("n").alias("n"))


def running_clade_census(clades: DataFrame) -> DataFrame:
    """(clade, number) over a stream of (tree_id, clade), each clade of a tree arriving once."""
    return clades.groupBy("clade").agg(F.count("*").alias("number"))


def lineages_through_windows(events: DataFrame, time: str, delta: str, width: str, lateness: str) -> DataFrame:
    """(start, end, change): net change of the number of lineages in tumbling windows, with a watermark for late events."""
    w = events.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w")).agg(F.sum(delta).alias("change"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "change")
