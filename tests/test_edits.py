"""Edits of trees and forms of sequences where the queries with SQL do not reach: errors, other paths to the same result, many trees a batch."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sylva.functions.phylo import parse_newick
from sylva.operators import clades as C
from sylva.operators import comparative as K
from sylva.operators import edits as E
from sylva.operators import inference as I
from sylva.operators import pairs as B
from sylva.operators import seq_types as Q
from sylva.operators import simulation as M
from sylva.operators import spatial as P
from sylva.operators import tree_tables as T
from sylva.sources import readers as R
from sylva.sources import writers as W


def table(spark, *texts):
    rows = [(k, *r) for k, text in enumerate(texts) for r in R.tree_rows(parse_newick(text)[1])]
    return spark.createDataFrame(rows, "tree_id long, node long, parent long, length double, label string")


def newicks(nodes):
    return {r.tree_id: r.newick for r in W.to_newick(nodes).collect()}


def test_rooting(spark):
    nodes = table(spark, "((a:1,b:2):1,(c:3,d:4):1);", "(a:1,b:2,(c:3,d:4):2);")
    rooted = E.clade_lengths(E.root(nodes, ["a"])).where("clade = 'a' or clade = 'b,c,d'").collect()
    assert sorted((r.tree_id, r.clade, r.length) for r in rooted) == [(k, c, 0.5) for k in (0, 1) for c in ("a", "b,c,d")]
    assert {r.tree_id: r.n for r in E.root(nodes, ["a"], resolve=False).where("parent is null").join(E.root(nodes, ["a"], resolve=False).select("tree_id", F.col("parent").alias("node")), ["tree_id", "node"]).groupBy("tree_id").agg(F.count("*").alias("n")).collect()} == {0: 3, 1: 3}
    with pytest.raises(PySparkException, match="not monophyletic"):
        E.root(nodes, ["a", "c"]).count()


def test_grafts_at_tips_and_missing_partners(spark):
    nodes, others = table(spark, "(a:1,b:1);", "(a:1,b:1);"), table(spark, "(x:1,y:1);")
    got = newicks(E.bind(nodes, others, where="a"))
    assert sorted(got[0].replace("(", "").replace(")", "").rstrip(";").split(",")) == sorted("x:1,y:1:1,b:1".split(",")) and got[1] == "(a:1,b:1);"


def test_many_trees_go_through_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        nodes = M.random_trees(spark, 60, 9, "rtree")
        trees = newicks(nodes)
        back = R.parse_trees(W.to_newick(nodes)).drop("name")
        assert len(trees) == 60 and newicks(back) == trees
        assert E.edge_ranks(nodes).groupBy("tree_id").agg(F.max("rank").alias("m")).where("m <> 16").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_sets_of_trees(spark):
    none = table(spark, "(a:1,b:1);").limit(0)
    assert E.unroot(none).count() == E.clade_lengths(none).count() == E.node_distances(none).count() == 0


def test_kernels_and_closures_agree(spark):
    nodes = M.random_trees(spark, 20, 12, "rtree")
    reach = T.closure(nodes)
    key = lambda df, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("tree_id", *c).collect())
    assert key(T.root_paths(nodes), "node", "level", "depth") == key(T.root_paths(nodes, reach), "node", "level", "depth")
    for method in (1, 2):
        assert key(T.node_depth(nodes, method), "node", "depth") == key(T.node_depth(nodes, method, reach), "node", "depth")
    assert key(C.clade_table(nodes), "node", "clade") == key(C.clade_table(nodes, reach), "node", "clade")
    drop = ["t1", "t5", "t7"]
    rows = lambda df: sorted((r.tree_id, r.node, r.parent or 0, round(r.length or 0, 9)) for r in df.collect())
    assert rows(T.drop_tips(nodes, drop)) == rows(T.drop_tips(nodes, drop, reach))


def test_group_weights_match_pairs(spark):
    x = spark.createDataFrame([(i, i % 4 if i != 9 else 77, float((i * 37) % 11)) for i in range(23)], "k long, g long, x double")
    a, b = P.moran_i_groups(x, "g", "x").first(), P.moran_i(x, P.weight_taxo(x, "k", "g"), "k", "x").first()
    assert a.n == b.n and all(abs(a[c] - b[c]) < 1e-9 for c in ("observed", "expected", "sd"))


def test_bit_masks_refuse_more_than_63_labels(spark):
    tips = spark.range(64).select(F.col("id").cast("string").alias("label"))
    splits = spark.createDataFrame([(1, ["0", "1"])], "tree_id long, split array<string>")
    assert C.bitsplits(splits, tips.limit(63)).count() == 1
    with pytest.raises(PySparkException, match="63 labels"):
        C.bitsplits(splits, tips).count()


def test_sequences_of_unequal_length_make_no_matrix(spark):
    seqs = spark.createDataFrame([("a", "acg"), ("b", "ac")], "label string, seq string")
    with pytest.raises(PySparkException, match="differ in length"):
        Q.to_matrix(seqs).collect()
    assert Q.stack(seqs, seqs, aligned=False).count() == 4
    codes = Q.to_codes(spark.createDataFrame([("a", "ACGU-?nz"), ("b", "")], "label string, seq string"))
    assert {r.label: list(r.codes) for r in codes.collect()} == {"a": [136, 40, 72, 24, 4, 2, 240, 0], "b": []}
    assert {r.label: r.seq for r in Q.from_codes(codes).collect()} == {"a": "acgt-?nn", "b": ""}


def test_contrasts_of_a_known_tree(spark):
    """The five primates of the literature: body mass contrasts."""
    nodes = table(spark, "((((Homo:0.21,Pongo:0.21):0.28,Macaca:0.49):0.13,Ateles:0.62):0.38,Galago:1.00);")
    traits = spark.createDataFrame([("Homo", 4.09434), ("Pongo", 3.61092), ("Macaca", 2.37024), ("Ateles", 2.02815), ("Galago", -1.46968)], "label string, x double")
    got = sorted(round(abs(r.contrast), 4) for r in K.pic(nodes, traits).collect())
    assert got == [0.7459, 1.1929, 1.5847, 3.3583]


def test_all_pairs_meet_once(spark):
    a, b = spark.range(37).toDF("i"), spark.range(41).toDF("j")
    for blocks in (1, 3, 8):
        got = [tuple(r) for r in B.pairs_below(a, b, "i", "j", blocks).collect()]
        assert sorted(got) == [(i, j) for i in range(37) for j in range(41) if i < j]
    assert B.pairs_below(a.limit(0), b, "i", "j").count() == 0


def test_what_a_task_holds_is_bounded(spark):
    d = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 3, 2.5)], "i long, j long, d double")
    assert B.held_whole(d, 3, "it").count() == 3
    with pytest.raises(ValueError, match="more than 2 rows"):
        B.held_whole(d, 2, "it")


def _distances(spark, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    rows = [(1, i, j, float(np.sqrt(((x[i] - x[j]) ** 2).sum()))) for i in range(n) for j in range(i + 1, n)]
    return rows, spark.createDataFrame(rows, "matrix_id long, i long, j long, d double")


def test_spanning_tree_matches_brute_force(spark):
    rows, d = _distances(spark, 40, 3)
    parent = list(range(40))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    want = set()
    for _, i, j, x in sorted(rows, key=lambda r: r[3]):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            want.add((i, j))
    assert {(min(r.i, r.j), max(r.i, r.j)) for r in I.spanning_trees(d).collect()} == want


def test_neighbour_joining_matches_a_plain_one(spark):
    """Path lengths between the tips of the tree, against the textbook's steps on dictionaries."""
    rows, table = _distances(spark, 14, 4)
    d = {}
    for _, i, j, x in rows:
        d[i, j] = d[j, i] = x
    edges, alive, new = [], list(range(14)), 14
    while len(alive) > 3:
        total = {a: sum(d[a, b] for b in alive if b != a) for a in alive}
        n = len(alive)
        i, j = min(((a, b) for a in alive for b in alive if a < b), key=lambda p: (n - 2) * d[p] - total[p[0]] - total[p[1]])
        li = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        edges += [(new, i, li), (new, j, d[i, j] - li)]
        for k in alive:
            if k not in (i, j):
                d[new, k] = d[k, new] = (d[i, k] + d[j, k] - d[i, j]) / 2
        alive = [k for k in alive if k not in (i, j)] + [new]
        new += 1
    a, b, c = alive
    edges += [(new, a, (d[a, b] + d[a, c] - d[b, c]) / 2), (new, b, (d[a, b] + d[b, c] - d[a, c]) / 2), (new, c, (d[a, c] + d[b, c] - d[a, b]) / 2)]
    far = np.full((new + 1, new + 1), np.inf)
    np.fill_diagonal(far, 0)
    for u, v, x in edges:
        far[u, v] = far[v, u] = x
    for k in range(new + 1):
        far = np.minimum(far, far[:, [k]] + far[[k], :])
    tree = parse_newick(I.trees_from_distances(table, "nj").first().newick)[1]
    at = {int(tree.label[v]): v for v in tree.tips()}
    got = tree.patristic()
    assert all(abs(got[at[i], at[j]] - far[i, j]) < 1e-6 for i in range(14) for j in range(i))
