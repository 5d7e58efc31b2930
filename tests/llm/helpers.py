"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

WORDS = {
    "en": "the and thing with from that ending hour shore water bright under stone".split(),
    "de": "und der die nicht über schön straße wasser unter stein berg fluß".split(),
    "fr": "le la les élève être avec pour eau pierre sous très château".split(),
}


def sentence(rng: random.Random, n: int, lang: str = "en") -> str:
    return " ".join(rng.choice(WORDS[lang]) + str(rng.randint(0, 40)) * (rng.random() < 0.3) for _ in range(n))


def documents(spark, rows, extra: bool = False):
    """rows: (doc_id, text[, lang]); ``extra`` adds columns whose names clash with those the operators make."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for name in ("score", "kept", "component_id", "spans", "h", "id", "n_words", "TEXT", "slot", "comp"):
            df = df.withColumn(name, F.lit("clash")) if name != "TEXT" else df.toDF(*df.columns).select("*", F.lit("clash").alias("Text"))
    return df
