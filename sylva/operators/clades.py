"""Operators on sets of trees: clade census, splits, distances between trees, consensus, support.

A clade is the sorted array of the labels below a node; a split is the side of an edge without the tree's first label.
Both are plain keys, so censuses are group-bys and comparisons of trees are joins on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.phylo import Phylo
from sylva.operators.comparative import rows_per_tree
from sylva.operators.pairs import pairs_below
from sylva.operators.tree_tables import settled, with_children

#: Rows of a table of distances between topologies that is sent to each task.
MOST_LOOKED_UP = 100_000


def _clades(tree: Phylo) -> list[tuple]:
    below = tree.clades()
    return [(tree.ids[v], sorted(below[v])) for v in tree.internal()]


def clade_table(nodes: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(tree_id, node, clade) of the internal nodes: from a closure if there is one, else by one kernel a tree."""
    if reach is None:
        return rows_per_tree(nodes, _clades, f"node {nodes.schema['node'].dataType.simpleString()}, clade array<string>")
    tips = with_children(nodes).where("is_tip").select("tree_id", "node", "label")
    return reach.where("hops > 0").join(tips, ["tree_id", "node"]).groupBy("tree_id", F.col("ancestor").alias("node")).agg(F.array_sort(F.collect_list("label")).alias("clade"))


def prop_part(clades: DataFrame) -> DataFrame:
    """(clade, number): in how many trees each clade occurs."""
    return clades.select("tree_id", "clade").distinct().groupBy("clade").agg(F.count("*").alias("number"))


def split_table(nodes: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(tree_id, split, length): the non-trivial splits of the unrooted trees, once each."""
    clades = clade_table(nodes, reach).join(nodes.select("tree_id", "node", "parent", "length"), ["tree_id", "node"])
    whole = clades.where("parent is null").select("tree_id", F.col("clade").alias("whole"))
    both = clades.where("parent is not null").join(whole, "tree_id")
    side = F.when(F.array_contains("clade", F.element_at("whole", 1)), F.array_except("whole", "clade")).otherwise(F.col("clade"))
    kept = both.select("tree_id", side.alias("split"), "length", F.size("whole").alias("n")).where((F.size("split") > 1) & (F.size("split") < F.col("n") - 1))
    return kept.groupBy("tree_id", "split").agg(F.sum("length").alias("length"))


def bitsplits(splits: DataFrame, tips: DataFrame) -> DataFrame:
    """(mask, freq): splits as bit masks over the sorted labels of ``tips`` (label), for up to 63 labels; with more, reading the result fails."""
    rank = tips.select("label").distinct().withColumn("k", F.row_number().over(Window.orderBy("label")))
    too_many = F.raise_error(F.lit("bit masks hold up to 63 labels")).cast("long")
    rank = rank.select("label", F.when(F.col("k") > 63, too_many).otherwise(F.expr("shiftleft(1L, cast(k - 1 as int))")).alias("bit"))
    bits = splits.select("tree_id", "split", F.explode("split").alias("label")).join(F.broadcast(rank), "label")
    return bits.groupBy("tree_id", "split").agg(F.sum("bit").alias("mask")).groupBy("mask").agg(F.count("*").alias("freq"))


def splits_of(masks: DataFrame, tips: DataFrame) -> DataFrame:
    """(split, freq): the labels of bit masks over the sorted labels of ``tips``."""
    labels = tips.agg(F.array_sort(F.collect_set("label")).alias("labels"))  # the labels of one set of tips
    both = masks.crossJoin(F.broadcast(labels))
    return both.select(F.filter("labels", lambda x, i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0).alias("split"), "freq")


def are_compatible(masks: DataFrame, n: int) -> DataFrame:
    """(a, b, compatible) for pairs of masks a < b over n tips: one of the four intersections is empty."""
    full = (1 << n) - 1
    a, b = masks.select(F.col("mask").alias("a")), masks.select(F.col("mask").alias("b"))
    both = pairs_below(a, b, "a", "b")
    parts = [F.col("a").bitwiseAND(F.col("b")), F.col("a").bitwiseAND(F.lit(full).bitwiseXOR(F.col("b"))), F.col("b").bitwiseAND(F.lit(full).bitwiseXOR(F.col("a"))), F.lit(full).bitwiseXOR(F.col("a").bitwiseOR(F.col("b")))]
    ok = parts[0] == 0
    for p in parts[1:]:
        ok = ok | (p == 0)
    return both.select("a", "b", ok.alias("compatible"))


def topology_distance(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """(t1, t2, d) for all pairs of trees t1 < t2: splits in one tree only.

    Trees of one topology are at the same distance from every other, so the splits are compared between the first trees of each
    topology, and the pairs of trees look their distance up.
    """
    keys = splits.groupBy("tree_id").agg(F.array_sort(F.collect_list("split")).alias("k"))
    every = settled(trees.select("tree_id").distinct().join(keys, "tree_id", "left").select("tree_id", F.coalesce("k", F.array().cast("array<array<string>>")).alias("k")))
    first = settled(every.groupBy("k").agg(F.min("tree_id").alias("r")))
    kinds = first.select("r", F.size("k").alias("m"))
    each = first.select("r", F.explode("k").alias("split"))
    shared = each.withColumnRenamed("r", "r1").join(each.withColumnRenamed("r", "r2"), "split").where("r1 < r2").groupBy("r1", "r2").agg(F.count("*").alias("s"))
    two = pairs_below(kinds.toDF("r1", "m1"), kinds.toDF("r2", "m2"), "r1", "r2").join(shared, ["r1", "r2"], "left").select("r1", "r2", (F.col("m1") + F.col("m2") - 2 * F.coalesce("s", F.lit(0))).cast("long").alias("d"))
    if first.count() == every.count():
        return two.toDF("t1", "t2", "d")
    two = settled(two.unionByName(two.select(F.col("r1").alias("r2"), F.col("r2").alias("r1"), "d")).unionByName(kinds.select(F.col("r").alias("r1"), F.col("r").alias("r2"), F.lit(0).cast("long").alias("d"))))
    kind = every.join(first, "k").select("tree_id", "r")
    pairs = pairs_below(kind.toDF("t1", "r1"), kind.toDF("t2", "r2"), "t1", "t2")
    return pairs.join(F.broadcast(two) if two.count() <= MOST_LOOKED_UP else two, ["r1", "r2"]).select("t1", "t2", "d")


def branch_score(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """(t1, t2, d) for all pairs t1 < t2: root of the summed squares of differences of internal lengths.

    sum (l1 - l2)^2 = sum l1^2 + sum l2^2 - 2 sum over shared splits of l1 l2, so no outer join of pairs is needed.
    """
    sq = trees.select("tree_id").distinct().join(splits.groupBy("tree_id").agg(F.sum(F.col("length") * F.col("length")).alias("q")), "tree_id", "left").select("tree_id", F.coalesce("q", F.lit(0.0)).alias("q"))
    a, b = splits.select(F.col("tree_id").alias("t1"), "split", F.col("length").alias("l1")), splits.select(F.col("tree_id").alias("t2"), "split", F.col("length").alias("l2"))
    shared = a.join(b, "split").where("t1 < t2").groupBy("t1", "t2").agg(F.sum(F.col("l1") * F.col("l2")).alias("p"))
    pairs = pairs_below(sq.toDF("t1", "q1"), sq.toDF("t2", "q2"), "t1", "t2")
    total = F.col("q1") + F.col("q2") - 2 * F.coalesce("p", F.lit(0.0))
    return pairs.join(shared, ["t1", "t2"], "left").select("t1", "t2", F.sqrt(F.greatest(total, F.lit(0.0))).alias("d"))


def topology_hash(splits: DataFrame, trees: DataFrame) -> DataFrame:
    """(tree_id, topo_hash): digest of the sorted splits."""
    keys = splits.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.concat_ws(",", "split"))).alias("k"))
    return trees.select("tree_id").distinct().join(keys, "tree_id", "left").select("tree_id", F.md5(F.concat_ws("|", F.coalesce("k", F.array().cast("array<string>")))).alias("topo_hash"))


def unique_trees(hashes: DataFrame) -> DataFrame:
    """(tree_id, first): of each tree the first tree of the same topology."""
    return hashes.select("tree_id", F.min("tree_id").over(Window.partitionBy("topo_hash")).alias("first"))


def consensus_clades(census: DataFrame, n_trees: int, p: float = 0.5) -> DataFrame:
    """(clade, support): the clades in at least p of the trees; p = 0.5 asks for more than half."""
    p = 0.5000001 if p == 0.5 else p
    return census.where(F.col("number") >= p * n_trees).select("clade", (F.col("number") / n_trees).alias("support"))


def clades_to_tree(clades: DataFrame, labels: DataFrame, tree_id: int = 0) -> DataFrame:
    """A table of nodes from nested clades: each hangs under the smallest clade that holds it."""
    whole = labels.agg(F.array_sort(F.collect_set("label")).alias("clade"))
    inner = clades.select("clade").unionByName(whole).distinct()
    tips = labels.select("label").distinct().select(F.array("label").alias("clade"))
    every = inner.unionByName(tips)
    child, above = every.toDF("c"), inner.toDF("p")
    held = child.join(above, (F.size("p") > F.size("c")) & (F.size(F.array_except("c", "p")) == 0), "left")
    up = held.groupBy("c").agg(F.min_by("p", F.struct(F.size("p"), F.concat_ws(",", "p"))).alias("p"))
    key = lambda c: F.concat_ws(",", c)
    return up.select(
        F.lit(tree_id).cast("long").alias("tree_id"), key("c").alias("node"), F.when(F.col("p").isNotNull(), key("p")).alias("parent"), F.lit(None).cast("double").alias("length"), F.when(F.size("c") == 1, F.element_at("c", 1)).alias("label")
    )


def clade_support(reference: DataFrame, census: DataFrame) -> DataFrame:
    """(node, clade, support) of a reference tree's clades; null where no tree has the clade."""
    return reference.select("node", "clade").join(census, "clade", "left").select("node", "clade", F.col("number").alias("support"))


def count_splits(reference: DataFrame, splits: DataFrame) -> DataFrame:
    """(split, freq): how many trees have each of the reference splits, 0 where none has."""
    freq = splits.groupBy("split").agg(F.countDistinct("tree_id").alias("freq"))
    return reference.select("split").distinct().join(freq, "split", "left").select("split", F.coalesce("freq", F.lit(0)).alias("freq"))


def compare_trees(x: DataFrame, y: DataFrame) -> DataFrame:
    """(clade, in_x, in_y) of two tables of clades."""
    a = x.select("clade").distinct().withColumn("in_x", F.lit(True))
    b = y.select("clade").distinct().withColumn("in_y", F.lit(True))
    return a.join(b, "clade", "full").select("clade", F.coalesce("in_x", F.lit(False)).alias("in_x"), F.coalesce("in_y", F.lit(False)).alias("in_y"))
