"""Distances of sequences by blocks of pairs: against the joint counts of each pair."""

import random

import pytest
from pyspark.sql import functions as F

from sylva.operators import distances as D
from sylva.operators import pairs as Q

MODELS = ["jc69", "tn93", "f81", "f84", "k80", "k81", "ts", "raw", "logdet"]


@pytest.mark.parametrize("model", MODELS)
def test_distances_by_blocks(spark, model):
    for n, whole in ((20, False), (150, True)):  # few sites: values by combinations of counts; many: more than one word
        draw = random.Random(n)
        seqs = [(k, "".join(draw.choice("acgt") if draw.random() < 0.9 else "-" for _ in range(n))) for k in range(12)] + [(12, "-" * n), (13, None), (14, "ac")]
        table = spark.createDataFrame(seqs if not whole else seqs[:12], "label long, seq string")
        out = D.dist_dna(table, model, pairwise_deletion=not whole, digits=6)
        assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
        freq = {b: sum((s or "").count(b) for _, s in seqs[: table.count()]) for b in "acgt"}
        known = D.joint_counts(table, pairwise_deletion=not whole).select("*", *[F.expr(f"cast({e} as double)").alias(k) for k, e in D.COUNTS.items()]).where("L > 0")
        for b, k in freq.items():
            known = known.withColumn(f"p{b}", F.lit(k / sum(freq.values())))
        want = {(r.i, r.j): r.d for r in known.selectExpr("i", "j", f"round(cast({D.formula(model)} as double), 6) as d").collect()}
        got = {(r.i, r.j): r.d for r in out.collect()}
        assert got.keys() == want.keys() and len(want) >= 66
        assert all((got[k] is None) == (want[k] is None) and abs((got[k] or 0) - (want[k] or 0)) < 2e-6 for k in want)


@pytest.mark.parametrize("model", ["f81", "f84", "k80", "k81", "tn93", "ts", "logdet"])
def test_pairs_are_made_batch_by_batch(spark, model):
    table = spark.createDataFrame([(k, "acgtacgtaacc"[k:] + "acgtacgtaacc"[:k]) for k in range(12)], "label long, seq string")
    plan = D.dist_dna(table, model, pairwise_deletion=True, digits=6)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # and no task holds the pairs of two blocks, nor their counts as rows
    assert "f_aa" not in plan


@pytest.mark.parametrize("model", ["f81", "f84", "k81", "tn93", "ts"])
def test_pairs_become_rows_outside_of_python(spark, model, monkeypatch):
    monkeypatch.setattr(Q.block_pairs, "__defaults__", (5,))  # several blocks, so pairs of one block and of two
    draw = random.Random(5)
    seqs = [(f"s{k:02}", "".join(draw.choice("acgt--") for _ in range(12))) for k in range(16)] + [("t0", "a" * 6 + "-" * 6), ("t1", "-" * 6 + "a" * 6), ("t2", "a" * 6 + "-" * 6), ("t3", "g" * 6 + "-" * 6)]
    out = D.dist_dna(spark.createDataFrame(seqs, "label string, seq string"), model, pairwise_deletion=True, digits=6)
    assert "posexplode" in out._jdf.queryExecution().executedPlan().toString()  # a row of Python holds the values of many pairs
    rows = out.collect()
    got = {(r.i, r.j): r.d for r in rows}
    known = D.joint_counts(spark.createDataFrame(seqs, "label string, seq string"), pairwise_deletion=True).select("*", *[F.expr(f"cast({e} as double)").alias(k) for k, e in D.COUNTS.items()]).where("L > 0")
    total = sum(b in "acgt" for _, s in seqs for b in s)
    for b in "acgt":
        known = known.withColumn(f"p{b}", F.lit(sum(s.count(b) for _, s in seqs) / total))
    want = {(r.i, r.j): r.d for r in known.selectExpr("i", "j", f"round(cast({D.formula(model)} as double), 6) as d").collect()}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert ("t0", "t1") not in got and got["t0", "t2"] == 0  # no site known in both; the same sequence
    assert model == "ts" or None in got.values()  # undefined distances stay, as null
    assert all((got[k] is None) == (want[k] is None) and abs((got[k] or 0) - (want[k] or 0)) < 2e-6 for k in want)
