"""Forms of sequences: codes and letters, alignments as rows or sites, stacking and joining, short descriptions.

A table of sequences has a row a sequence (label, seq). All operators stay in DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Byte codes of bases and of the ambiguity codes; bit 8 marks a known base.
BASE_CODES = {"a": 136, "g": 72, "c": 40, "t": 24, "r": 192, "m": 160, "w": 144, "s": 96, "k": 80, "y": 48, "v": 224, "h": 176, "d": 208, "b": 112, "n": 240, "-": 4, "?": 2}
# Letters of amino acids, the stop, and the unknown one.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY*X-"


def letters(seq: str | Column) -> Column:
    """The letters of a sequence as an array; empty for an empty sequence."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.when(F.length(seq) > 0, F.split(seq, "")).otherwise(F.array().cast("array<string>"))


def to_codes(seqs: DataFrame) -> DataFrame:
    """(label, codes): bytes of the bases in either case (u counts as t); letters that are no base become 0."""
    table = F.create_map(*[x for k, v in BASE_CODES.items() for x in (F.lit(k), F.lit(v))])
    return seqs.select("label", F.transform(letters(F.translate(F.lower("seq"), "u", "t")), lambda c: F.coalesce(table[c], F.lit(0))).alias("codes"))


def from_codes(codes: DataFrame) -> DataFrame:
    """(label, seq) in lower case from bytes."""
    table = F.create_map(*[x for k, v in BASE_CODES.items() for x in (F.lit(v), F.lit(k))])
    return codes.select("label", F.array_join(F.transform("codes", lambda c: F.coalesce(table[c], F.lit("n"))), "").alias("seq"))


def to_amino_acids(seqs: DataFrame) -> DataFrame:
    """(label, seq) in upper case; letters that are no amino acid become X."""
    return seqs.select("label", F.regexp_replace(F.upper("seq"), f"[^{AMINO_ACIDS.replace('*', '').replace('-', '')}*-]", "X").alias("seq"))


def to_rows(sites: DataFrame) -> DataFrame:
    """(label, seq) from one row a letter (label, pos, letter)."""
    run = F.array_sort(F.collect_list(F.struct("pos", "letter")))
    return sites.groupBy("label").agg(F.array_join(F.transform(run, lambda x: x["letter"]), "").alias("seq"))


def to_sites(seqs: DataFrame) -> DataFrame:
    """(label, pos, letter), positions from 1."""
    at = seqs.select("label", F.posexplode(letters("seq")).alias("pos", "letter"))
    return at.select("label", (F.col("pos") + 1).alias("pos"), "letter")


def to_matrix(seqs: DataFrame) -> DataFrame:
    """The sequences, if all have the same length; else reading the result fails."""
    lengths = seqs.agg(F.min(F.length("seq")).alias("lo"), F.max(F.length("seq")).alias("hi"))
    checked = lengths.select(F.when(F.col("lo") < F.col("hi"), F.raise_error(F.lit("the sequences differ in length"))).alias("bad"))
    return seqs.crossJoin(F.broadcast(checked)).where("bad is null").drop("bad")  # one row of checks


def stack(*frames: DataFrame, aligned: bool = True) -> DataFrame:
    """All sequences of some tables; of alignments (``aligned``) only if all have the same length."""
    out = None
    for x in frames:
        own = x.select("label", "seq")
        out = own if out is None else out.unionByName(own)
    return to_matrix(out) if aligned else out


def describe(seqs: DataFrame) -> DataFrame:
    """One row: number of sequences, shortest, longest and mean length, and the share of each base among the known ones."""
    n = {b: F.sum(F.length("seq") - F.length(F.replace(F.lower("seq"), F.lit(b), F.lit("")))) for b in "acgt"}
    total = n["a"] + n["c"] + n["g"] + n["t"]
    return seqs.agg(F.count("*").alias("n"), F.min(F.length("seq")).cast("long").alias("shortest"), F.max(F.length("seq")).cast("long").alias("longest"), F.avg(F.length("seq")).alias("mean_length"), *[(n[b] / F.nullif(total, F.lit(0))).alias(b) for b in "acgt"])
