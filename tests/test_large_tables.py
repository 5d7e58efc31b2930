"""Findings on tables that are larger than the test tables: each test failed before the change it belongs to."""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from sylva.operators import clades as C
from sylva.operators import distances as D
from sylva.operators import topology_counts as N
from sylva.operators import tree_tables as T
from sylva.sources import writers as W


@contextmanager
def settings(spark, **values):
    """Settings of the session with dots for double underscores, put back afterwards."""
    names = {k: "spark.sql." + k.replace("__", ".") for k in values}
    old = {k: spark.conf.get(n) for k, n in names.items()}
    try:
        for k, n in names.items():
            spark.conf.set(n, values[k])
        yield
    finally:
        for k, n in names.items():
            spark.conf.set(n, old[k])


def test_trees_stay_whole_above_a_union(spark, tmp_path):
    small = {"shuffle__partitions": "16", "autoBroadcastJoinThreshold": "-1", "adaptive__advisoryPartitionSizeInBytes": "24k", "adaptive__coalescePartitions__parallelismFirst": "false", "adaptive__coalescePartitions__minPartitionSize": "1k"}
    with settings(spark, **small):
        spark.range(3000).select(F.col("id").alias("tree_id")).write.parquet(f"{tmp_path}/trees")
        trees = spark.read.parquet(f"{tmp_path}/trees")
        nodes = trees.select("tree_id", F.explode(F.sequence(F.lit(1), F.lit(9)).cast("array<long>")).alias("node"))
        nodes = nodes.select("tree_id", "node", F.when(F.col("node") > 1, F.floor(F.col("node") / 2)).alias("parent"), F.lit(1.0).alias("length"), F.sha2(F.col("node").cast("string"), 512).alias("label"))
        links = trees.select("tree_id", F.lit(3).cast("long").alias("src"), F.lit(4).cast("long").alias("dst"))
        texts = W.to_newick(N.network_nodes(nodes, links)).collect()
    assert sorted(r.tree_id for r in texts) == list(range(3000))
    assert len({r.newick for r in texts}) == 1


def star(spark, n):
    return spark.range(n + 1).select(F.lit(1).cast("long").alias("tree_id"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.lit(0).cast("long")).alias("parent"), F.when(F.col("id") > 0, F.lit(1.0)).alias("length"), F.col("id").cast("string").alias("label"))


def test_tips_of_one_ancestor_meet_in_several_places(spark):
    out = T.tip_pairs(star(spark, 30))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__p" in plan and "__q" in plan
    assert sorted((r.a, r.b, r.mrca, r.shared, r.dist) for r in out.collect()) == [(a, b, 0, 0.0, 2.0) for a in range(1, 31) for b in range(a + 1, 31)]


def test_path_lengths_do_not_shuffle_the_pairs(spark):
    out = T.cophenetic(star(spark, 12))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "__p" in plan.split("SortMergeJoin")[1]  # the topmost join is that of the blocks
    assert sorted((r.a, r.b, r.dist) for r in out.collect()) == [(a, b, 2.0) for a in range(1, 13) for b in range(a + 1, 13)]


def test_pairs_of_trees_look_up_the_distance_of_their_topologies(spark):
    trees = spark.createDataFrame([(k,) for k in range(7)], "tree_id long")  # 0 is a star; two topologies share one split
    splits = spark.createDataFrame([(k, s) for k in range(1, 7) for s in (["b", "c"], ["d", "e"] if k % 2 else ["a", "b"])], "tree_id long, split array<string>")
    out = C.topology_distance(splits, trees)
    assert "BroadcastHashJoin [r1" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.t1, r.t2, r.d) for r in out.collect()) == [(a, b, 2 if a == 0 else 2 * ((a + b) % 2)) for a in range(7) for b in range(a + 1, 7)]


def test_joint_counts_of_short_and_long_sequences(spark):
    for n, plain in ((100, True), (400, False)):
        draw = random.Random(n)
        seqs = {k: "".join(draw.choice("acgt-") for _ in range(n)) for k in range(4)}
        out = D.joint_counts(spark.createDataFrame(list(seqs.items()), "label long, seq string"), pairwise_deletion=True)
        if plain:  # the pairs are left to generated code
            assert "lambda" not in out._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[0]
            assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        got = {(r.i, r.j): [r[f"f_{x}{y}"] for x in "acgt" for y in "acgt"] for r in out.collect()}
        want = {(i, j): [sum(p == x and q == y for p, q in zip(seqs[i], seqs[j])) for x in "acgt" for y in "acgt"] for i in range(4) for j in range(i + 1, 4)}
        assert got == want
