"""Operators without a registered query, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylva.functions.phylo import parse_newick, write_newick
from sylva.operators import clades as C
from sylva.operators import distances as D
from sylva.operators import labels as L
from sylva.operators import resampling as B
from sylva.operators import sequences as S
from sylva.operators import spatial as P
from sylva.operators import time_tables as TT
from sylva.operators import topology_counts as N
from sylva.operators import tree_tables as T
from sylva.operators.simulation import coalescent_tree
from sylva.sources.readers import parse_trees


def nodes_of(spark, *newicks):
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(newicks)], "tree_id long, newick string")
    return parse_trees(df).drop("name").cache()


def seqs(spark, *rows):
    return spark.createDataFrame(list(rows), "label string, seq string")


def test_tree_queries(spark):
    n = nodes_of(spark, "(((a:1,b:1):1,c:2):1,(d:1,e:1):2);")
    labels = {r.node: r.label for r in n.collect()}
    assert T.is_monophyletic(n, ["a", "b"]).first().is_monophyletic and not T.is_monophyletic(n, ["a", "c"]).first().is_monophyletic
    edges = T.which_edge(n, ["a", "c"]).collect()
    assert len(edges) == 3 and {"a", "c"} <= {labels[r.node] for r in edges}
    kept = T.drop_tips(n, ["b"])
    assert kept.where("label = 'a'").first().length == pytest.approx(2)
    assert T.validate(n).count() == 0
    single = nodes_of(spark, "((a:1,b:1):2);")
    assert [r.message for r in T.validate(single).collect()] == ["a node has a single child"]


def test_clades_and_consensus(spark):
    n = nodes_of(spark, "((a,b),(c,d));", "((a,b),(c,d));", "((a,c),(b,d));")
    census = C.prop_part(C.clade_table(n))
    assert {tuple(r.clade): r.number for r in census.collect()}[("a", "b")] == 2
    tree = C.clades_to_tree(C.consensus_clades(census, 3), n.where("label is not null").select("label"))
    assert {r.node: r.parent for r in tree.collect()}["a"] == "a,b"
    d = {(r.t1, r.t2): r.d for r in C.topology_distance(C.split_table(n), n).collect()}
    assert d == {(1, 2): 0, (1, 3): 2, (2, 3): 2}
    both = C.compare_trees(C.clade_table(n.where("tree_id = 1")), C.clade_table(n.where("tree_id = 3")))
    assert both.where("in_x and in_y").count() == 1
    assert write_newick(B.majority_tree(["((a,b),(c,d));", "((a,b),(c,d));", "((a,c),(b,d));"])).count("(") == 3


def test_sequences(spark):
    s = seqs(spark, ("x", "ATGAAATAR"), ("y", "--ac-gt--"))
    assert [r.seq for r in S.translate(s.where("label = 'x'")).collect()] == ["MK*"]
    assert [r.seq for r in S.complement(s.where("label = 'x'")).collect()] == ["ytatttcat"]
    assert [r.seq for r in S.end_gaps_to_n(s.where("label = 'y'")).collect()] == ["nnac-gtnn"]
    a = seqs(spark, ("x", "acgtn-a"), ("y", "aagtaca"), ("z", "argt-ca"))
    assert sorted(r.pos for r in S.seg_sites(a).collect()) == [2, 5, 6]
    assert sorted(r.pos for r in S.seg_sites(a, strict=True).collect()) == [2, 5, 6]
    assert sorted(r.pos for r in S.aa_polymorphic_sites(seqs(spark, ("p", "MXK"), ("q", "MLR"))).collect()) == [3]
    assert {r.label: r.seq for r in S.solve_ambiguous(a).collect()}["z"] == "aagt-ca"
    assert {r.label: r.seq for r in S.bind_columns(a, seqs(spark, ("x", "tt")), True).collect()}["y"] == "aagtaca--"
    assert S.compare_alignments(a, a).count() == 0
    assert [r.seq for r in S.alignment_view(seqs(spark, ("a", "acg"), ("b", "atg"))).orderBy("label").collect()] == ["acg", ".t."]
    r = S.random_sequences(spark, 4, 200, (0.7, 0.1, 0.1, 0.1))
    assert r.count() == 4 and r.where("length(seq) = 200").count() == 4


def test_distances_by_hand(spark):
    a = seqs(spark, ("x", "acgtacgtac" * 10), ("y", "acgtacgtaa" * 10), ("z", "gcgtacgtac" * 10))
    d = {(r.i, r.j): r for r in D.dist_dna(a, "jc69", with_variance=True).collect()}
    assert d["x", "y"].d == pytest.approx(-0.75 * np.log(1 - 4 * 0.1 / 3))
    assert d["x", "y"].variance == pytest.approx(0.1 * 0.9 / ((1 - 0.4 / 3) ** 2 * 100))
    k = {(r.i, r.j): r.d for r in D.dist_dna(a, "k80").collect()}
    assert k["x", "z"] == pytest.approx(-0.5 * np.log((1 - 0.2) * 1.0)) and k["x", "y"] == pytest.approx(-0.5 * np.log(0.9 * np.sqrt(0.8)))
    gamma = {(r.i, r.j): r.d for r in D.dist_dna(a, "jc69", gamma=2.0).collect()}
    assert gamma["x", "y"] == pytest.approx(0.75 * 2 * ((1 - 0.4 / 3) ** -0.5 - 1))
    g = seqs(spark, ("x", "ac-gn"), ("y", "aaagt"), ("z", "acagt"))
    assert {(r.i, r.j): r.d for r in D.dist_dna(g, "n").collect()} == {("x", "y"): 1, ("x", "z"): 0, ("y", "z"): 1}
    assert {(r.i, r.j): r.d for r in D.dist_indel_blocks(seqs(spark, ("x", "a--c"), ("y", "aa-c"))).collect()} == {("x", "y"): 2}
    assert {(r.i, r.j): r.d for r in D.dist_aa(seqs(spark, ("x", "MKX"), ("y", "MRL")), scaled=True).collect()} == {("x", "y"): 0.5}


def test_labels(spark):
    df = spark.createDataFrame([(1, " (Homo sapiens) "), (2, "Homo_sapiens_neander"), (3, "a,b:c;d"), (4, "x"), (5, "x")], "k long, label string")
    assert [r[0] for r in df.select(L.clean_label(F.col("label"))).collect()] == ["Homo_sapiens", "Homo_sapiens_neander", "a-b-c-d", "x", "x"]
    made = L.make_label(df.withColumn("t", F.lit(1)), "label", ["t"], length=6, order=["k"])
    assert len({r.label for r in made.collect()}) == 5 and all(len(r.label) <= 6 for r in made.collect())
    one = df.where("k = 2")
    assert tuple(one.select(*L.label_table(F.col("label"))).first()) == ("Homo", "sapiens", "neander")
    assert one.select(L.strip_label(F.col("label"))).first()[0] == "Homo_sapiens"
    assert one.select(L.abbreviate_genus(F.col("label"))).first()[0] == "H._sapiens_neander"
    m = spark.createDataFrame([("x", "y")], "old string, new string")
    assert L.update_label(df, "label", m).where("label = 'y'").count() == 2
    assert L.update_label(df, "label", spark.createDataFrame([("Homo", "Pan")], "old string, new string"), exact=False).where("label = 'Pan'").count() == 2
    assert one.select(L.assign(F.col("label"), {"^Homo": "ape"}, "other", True)).first()[0] == "ape"
    n = L.node_labels(nodes_of(spark, "((a,b),c);"))
    assert n.where("label like 'Node%'").count() == 2
    assert L.node_labels(nodes_of(spark, "((a,b),c);"), "md5").where("length(label) = 32").count() == 2


def test_counts_of_topologies():
    assert [N.how_many_trees(n) for n in (2, 3, 4, 5)] == [1, 3, 15, 105]
    assert [N.how_many_trees(n, rooted=False) for n in (3, 4, 5)] == [1, 3, 15]
    assert [N.how_many_trees(n, binary=False) for n in (2, 3, 4, 5)] == [1, 4, 26, 236]
    assert [N.how_many_trees(n, labelled=False) for n in range(1, 9)] == [1, 1, 1, 2, 3, 6, 11, 23]
    assert len(N.regular_tree(8, "balanced").tips()) == 8 and N.regular_tree(5, "left").is_binary()
    assert write_newick(N.regular_tree(3, "right")) == "(t1,(t2,t3));"


def test_conversions(spark):
    t = coalescent_tree(8, np.random.default_rng(2))
    labels = [t.label[v] for v in t.tips()]
    again = N.tree_from_merges(N.merge_table(t), labels)
    assert {frozenset(c) for c in again.clades()} == {frozenset(c) for c in t.clades()} and again.depths().max() == pytest.approx(t.depths().max())
    s = t.splits()
    back = N.tree_from_splits([(k, v) for k, v in s.items()], labels)
    assert set(back.splits()) == set(s)
    n = nodes_of(spark, "((a,b),c);")
    pairs = N.matching(n)
    assert N.from_matching(pairs).count() == n.count()
    kept, edges = N.network(nodes_of(spark, "((a,#H1),((b)#H1,c));"))
    assert edges.count() == 1 and N.network_edges(kept, edges).where("kind = 'reticulation'").count() == 1
    d = np.array([[0, 2, 4.0], [2, 0, 4], [4, 4, 0]])
    mean, var, names = N.super_distances([(d, ["a", "b", "c"]), (d * 2, ["a", "b", "c"])], [1.0, 1.0])
    off = ~np.eye(3, dtype=bool)
    assert names == ["a", "b", "c"] and var[off].max() < 1e-6


def test_bootstrap_and_dnds(spark):
    a = seqs(spark, ("a", "aaaaacccccggggg" * 4), ("b", "aaaaacccccggggt" * 4), ("c", "ttttacctccggggg" * 4), ("d", "ttttacctccgggga" * 4))
    trees = B.bootstrap_trees(a, 20)
    got = {r.split: r.support for r in B.split_support(trees).collect()}
    assert got == {"c,d": 20}
    dn, ds = B.dn_ds("atggctaaa", "atggctaaa")
    assert dn == 0 and ds == 0
    dn, ds = B.dn_ds("atg" + "gct" * 20, "atg" + "gct" * 18 + "gcc" * 2)
    assert ds > 0 and dn == pytest.approx(0)


def test_statistics(spark):
    d = spark.createDataFrame([(1, i, j, float(abs(i - j))) for i in range(6) for j in range(i + 1, 6)], "matrix_id long, i long, j long, d double")
    r = P.mantel_test(d, d, n_perm=199).first()
    assert r.p < 0.05 and r.z == pytest.approx(sum(abs(i - j) ** 2 for i in range(6) for j in range(i + 1, 6)))
    q = {r.node: r.delta for r in P.quartet_deltas(d).collect()}
    assert set(q) == {str(i) for i in range(6)} and all(x == pytest.approx(0) for x in q.values())
    same = P.cadm(d.unionByName(d.withColumn("matrix_id", F.lit(2).cast("long")))).first()
    assert same.w == pytest.approx(1)
    w = spark.createDataFrame([(1, k, float(x)) for k, x in enumerate([1, 1, 5, 1, 1])], "t long, k long, w double")
    c = TT.collapse_intervals(TT.intervals_from_widths(w, "t", "k", "w"), 1.5)
    assert [r.grp for r in c.orderBy("k").collect()] == [1, 1, 2, 3, 3]
    assert TT.skyline_groups(c).count() == 3
