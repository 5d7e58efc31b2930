"""Numbers of tree topologies, deterministic trees, matchings, networks and trees from splits or clusterings."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.phylo import Phylo


def how_many_trees(n: int, rooted: bool = True, binary: bool = True, labelled: bool = True) -> int:
    """Exact number of topologies with n tips; multifurcating ones are counted for labelled tips, unlabelled ones for rooted binary trees."""
    if labelled and binary:
        k = n if rooted else n - 1
        return math.prod(range(1, 2 * k - 2, 2)) if k > 1 else 1
    if labelled:
        return sum(multifurcating(n if rooted else n - 1))
    if not rooted or not binary:
        raise ValueError("unlabelled topologies are counted for rooted binary trees")
    return wedderburn_etherington(n)


def multifurcating(n: int) -> list[int]:
    """Rooted labelled topologies with n tips by their number of internal nodes, from 1."""
    row = [1]
    for k in range(3, n + 1):
        # the new tip joins an internal node (m places) or splits an edge (k - 1 + m - 1 edges and one above the root)
        new = [0] * (k - 1)
        for m, count in enumerate(row, 1):
            new[m - 1] += m * count
            if m < k - 1:
                new[m] += (k + m - 1) * count
        row = new
    return row if n > 1 else [1]


@lru_cache(maxsize=None)
def wedderburn_etherington(n: int) -> int:
    if n < 2:
        return n
    total = sum(wedderburn_etherington(i) * wedderburn_etherington(n - i) for i in range(1, (n + 1) // 2))
    if n % 2 == 0:
        x = wedderburn_etherington(n // 2)
        total += x * (x + 1) // 2
    return total


def regular_tree(n: int, kind: str = "star", labels: list[str] | None = None) -> Phylo:
    """A star, a balanced tree (n a power of 2), or a caterpillar with the cherry on the left or the right."""
    names = labels or [f"t{i + 1}" for i in range(n)]
    if kind == "star":
        return Phylo([-1, *[0] * n], None, [None, *names])
    if kind == "balanced":
        if n & (n - 1):
            raise ValueError("a balanced tree needs a power of 2")
        size = 2 * n - 1
        return Phylo([-1, *[(i - 1) // 2 for i in range(1, size)]], None, [None] * (n - 1) + names)
    inner = n - 1
    children: dict[int, list[int]] = {}
    for i in range(inner):
        node, rest = n + i, (n + i + 1 if i < inner - 1 else None)
        tip = n - 1 - i if kind == "left" else i
        other = rest if rest is not None else (0 if kind == "left" else n - 1)
        children[node] = [other, tip] if kind == "left" else [tip, other]
    return Phylo.build(children, n, {}, dict(enumerate(names)))


def matching(nodes: DataFrame) -> DataFrame:
    """(tree_id, a, b, parent): the pairs of siblings of a binary tree."""
    return nodes.where("parent is not null").groupBy("tree_id", "parent").agg(F.min("node").alias("a"), F.max("node").alias("b")).select("tree_id", "a", "b", "parent")


def from_matching(pairs: DataFrame) -> DataFrame:
    """A table of nodes from pairs of siblings."""
    kids = pairs.select("tree_id", F.explode(F.array("a", "b")).alias("node"), "parent")
    root = pairs.select("tree_id", F.col("parent").alias("node")).join(kids, ["tree_id", "node"], "left_anti").select("tree_id", "node", F.lit(None).cast(pairs.schema["parent"].dataType).alias("parent"))
    return kids.unionByName(root).select("tree_id", "node", "parent", F.lit(None).cast("double").alias("length"), F.lit(None).cast("string").alias("label"))


def merge_table(tree: Phylo) -> list[tuple[int, int, float]]:
    """The merges of an ultrametric binary tree by height: negative numbers are tips, positive ones earlier merges."""
    depth = tree.depths()
    top = depth.max()
    tip = {v: -(i + 1) for i, v in enumerate(tree.tips())}
    code, out = dict(tip), []
    for v in sorted(tree.internal(), key=lambda v: (top - depth[v], -v)):
        a, b = sorted(code[c] for c in tree.children[v])
        out.append((a, b, float(2 * (top - depth[v]))))
        code[v] = len(out)
    return out


def merges(nodes: DataFrame) -> DataFrame:
    """(tree_id, k, a, b, height): the merges of each ultrametric binary tree, see ``merge_table``."""
    from sylva.operators.comparative import rows_per_tree

    return rows_per_tree(nodes, lambda t: [(k, a, b, h) for k, (a, b, h) in enumerate(merge_table(t), 1)], "k int, a int, b int, height double")


def from_merges(table: DataFrame, labels: DataFrame) -> DataFrame:
    """A table of nodes from merges and the labels of the tips (tree_id, tip from 1, label)."""
    from sylva.sources.readers import NODES, tree_rows

    def run(key, rows, names):
        tree = tree_from_merges(list(rows.sort_values("k")[["a", "b", "height"]].itertuples(index=False, name=None)), list(names.sort_values("tip")["label"]))
        out = pd.DataFrame(tree_rows(tree), columns=["node", "parent", "length", "label"]).astype({"parent": "Int64"})
        out.insert(0, "tree_id", key[0])
        return out

    return table.groupBy("tree_id").cogroup(labels.groupBy("tree_id")).applyInPandas(run, f"tree_id long, {NODES}")


def tree_from_merges(merges: list[tuple[int, int, float]], labels: list[str]) -> Phylo:
    """The tree of a table of merges; heights are halved into node ages."""
    n = len(labels)
    node = lambda k: -k - 1 if k < 0 else n + k - 1
    age = {i: 0.0 for i in range(n)}
    children, length = {}, {}
    for k, (a, b, h) in enumerate(merges, 1):
        v = node(k)
        age[v], children[v] = h / 2, [node(a), node(b)]
        for c in children[v]:
            length[c] = age[v] - age[c]
    return Phylo.build(children, node(len(merges)), length, dict(enumerate(labels)))


def tree_from_splits(splits: list[tuple[frozenset[str], float]], labels: list[str]) -> Phylo:
    """A tree from compatible weighted splits: each cuts the first node whose tips hold it, largest first."""
    first = min(labels)
    whole = frozenset(labels)
    sides = {(whole - s if first in s else s): w for s, w in splits}
    order = sorted(sides, key=lambda s: (-len(s), sorted(s)))
    holds: list[tuple[frozenset[str], int]] = [(whole, 0)]
    children: dict[int, list[int]] = {0: []}
    length: dict[int, float] = {}
    label: dict[int, str | None] = {}
    nxt = 1
    for s in order:
        if len(s) < 2:
            continue
        up = min((h for h in holds if s < h[0]), key=lambda h: len(h[0]))[1]
        children[up].append(nxt)
        children[nxt], length[nxt] = [], sides[s]
        holds.append((s, nxt))
        nxt += 1
    for x in sorted(labels):
        up = min((h for h in holds if x in h[0]), key=lambda h: len(h[0]))[1]
        children[up].append(nxt)
        length[nxt], label[nxt] = sides.get(frozenset([x]), 0.0), x
        nxt += 1
    return Phylo.build(children, 0, length, label)


def species_tree_distances(gene_distances: DataFrame, how: str = "min") -> DataFrame:
    """(matrix_id, i, j, d): least or summed distances over all gene trees, for a tree by single linkage."""
    f = {"min": F.min, "sum": F.sum}[how]
    return gene_distances.groupBy("i", "j").agg(f("d").alias("d")).select(F.lit(0).cast("long").alias("matrix_id"), "i", "j", "d")


def network(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tree nodes and reticulations (tree_id, src, dst) from a tree whose hybrids are tips and nodes with the same ``#`` label.

    The tip with the label goes; an edge from its parent to the node of the same label takes its place.
    """
    from sylva.operators.tree_tables import with_children

    own = with_children(nodes)
    hybrid = own.where(F.col("label").startswith("#"))
    tips, targets = hybrid.where("is_tip"), hybrid.where("not is_tip")
    both = tips.alias("t").join(targets.alias("n"), (F.col("t.tree_id") == F.col("n.tree_id")) & (F.col("t.label") == F.col("n.label")))
    edges = both.select("t.tree_id", F.col("t.parent").alias("src"), F.col("n.node").alias("dst"))
    kept = nodes.join(both.select("t.tree_id", "t.node"), ["tree_id", "node"], "left_anti")
    return kept, edges


def network_edges(nodes: DataFrame, reticulations: DataFrame) -> DataFrame:
    """(tree_id, src, dst, kind) of all edges, as graph libraries take them."""
    tree = nodes.where("parent is not null").select("tree_id", F.col("parent").alias("src"), F.col("node").alias("dst"), F.lit("tree").alias("kind"))
    return tree.unionByName(reticulations.select("tree_id", "src", "dst", F.lit("reticulation").alias("kind")))


def super_distances(matrices: list[tuple[np.ndarray, list[str]]], weights: list[float]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Weighted mean and variance of overlapping distance matrices after scaling each to the others.

    Scale factors a_p (their sum is the number of matrices) and shifts of taxa within matrices are the least-squares solution of
    sum w_p (a_p d_p(i, j) + s_p(i) + s_p(j) - mean(i, j))^2.
    """
    labels = sorted({x for _, ls in matrices for x in ls})
    at = {x: i for i, x in enumerate(labels)}
    n, k = len(labels), len(matrices)
    cells: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for p, (d, ls) in enumerate(matrices):
        for a in range(len(ls)):
            for b in range(a):
                key = tuple(sorted((at[ls[a]], at[ls[b]])))
                cells.setdefault(key, []).append((p, float(d[a, b])))
    size = k + k * n
    h = np.zeros((size, size))
    for (i, j), seen in cells.items():
        total = sum(weights[p] for p, _ in seen)
        rows = []
        for p, x in seen:
            r = np.zeros(size)
            r[p], r[k + p * n + i], r[k + p * n + j] = x, 1.0, 1.0
            rows.append((weights[p], r))
        mean = sum(w * r for w, r in rows) / total
        for w, r in rows:
            h += w * np.outer(r - mean, r - mean)
    h += 1e-9 * np.eye(size)
    c = np.zeros(size)
    c[:k] = 1.0
    full = np.block([[h, c[:, None]], [c[None, :], np.zeros((1, 1))]])
    sol = np.linalg.lstsq(full, np.append(np.zeros(size), float(k)), rcond=None)[0][:size]
    mean, var = np.full((n, n), np.nan), np.full((n, n), np.nan)
    np.fill_diagonal(mean, 0.0)
    np.fill_diagonal(var, 0.0)
    for (i, j), seen in cells.items():
        w = np.array([weights[p] for p, _ in seen])
        x = np.array([sol[p] * v + sol[k + p * n + i] + sol[k + p * n + j] for p, v in seen])
        m = (w * x).sum() / w.sum()
        mean[i, j] = mean[j, i] = m
        var[i, j] = var[j, i] = (w * (x - m) ** 2).sum() / w.sum()
    return mean, var, labels


def network_nodes(nodes: DataFrame, reticulations: DataFrame, label: str = "#H") -> DataFrame:
    """The tree that stands for a network in Newick: each reticulation is a tip under its source, with the label of its target; targets
    without a label get one from their id. ``network`` takes it back."""
    named = reticulations.select("tree_id", F.col("dst").alias("node")).distinct().withColumn("hybrid", F.concat(F.lit(label), F.col("node").cast("string")))
    own = nodes.select("tree_id", "node", "parent", "length", "label").join(named, ["tree_id", "node"], "left").withColumn("label", F.when(F.col("label").startswith("#"), F.col("label")).otherwise(F.coalesce("hybrid", "label"))).drop("hybrid")
    top = nodes.groupBy("tree_id").agg(F.max("node").alias("top"))
    order = Window.partitionBy("tree_id").orderBy("src", "dst")
    names = own.select("tree_id", F.col("node").alias("dst"), "label")
    tips = reticulations.withColumn("k", F.row_number().over(order)).join(top, "tree_id").join(names, ["tree_id", "dst"])
    return own.unionByName(tips.select("tree_id", (F.col("top") + F.col("k")).cast(nodes.schema["node"].dataType).alias("node"), F.col("src").alias("parent"), F.lit(None).cast("double").alias("length"), "label"))


def network_degree(nodes: DataFrame, reticulations: DataFrame) -> DataFrame:
    """(tree_id, node, degree): edges of the tree and reticulations at each node."""
    edges = network_edges(nodes, reticulations)
    ends = edges.select("tree_id", F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("tree_id", "node").agg(F.count("*").alias("degree"))
