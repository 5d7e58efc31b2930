"""Edits of tables of trees: rooting, pruning, grafting, polytomies, orders of nodes, sets of trees.

An edit that rearranges a tree runs as one kernel a tree, many trees in parallel; it numbers the nodes anew, tips first.
Edits of sets of trees and of single rows stay in DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.phylo import Phylo
from sylva.operators import tree_tables as T
from sylva.operators.comparative import rows_per_tree, tree_of
from sylva.sources.readers import NODES, tree_rows

_COLUMNS = ("tree_id", "node", "parent", "length", "label")


def _table(key: int, tree: Phylo) -> pd.DataFrame:
    out = pd.DataFrame(tree_rows(tree), columns=list(_COLUMNS[1:])).astype({"parent": "Int64"})
    out.insert(0, "tree_id", key)
    return out


def edited(nodes: DataFrame, f: Callable[[Phylo], Phylo]) -> DataFrame:
    """The trees that ``f`` makes of each tree, as a table of nodes."""
    return rows_per_tree(nodes, lambda tree: tree_rows(f(tree)), NODES)


# -- rooting --------------------------------------------------------------------------------------------
def unroot(nodes: DataFrame) -> DataFrame:
    """Roots with two children become roots with three or more; the two edges at the root are joined."""
    return edited(nodes, Phylo.unroot)


def at_node(tree: Phylo, v: int) -> Phylo:
    """The tree with a node as its root: the edges between it and the old root are turned."""
    ch, ln, lb = {x: list(c) for x, c in enumerate(tree.children)}, dict(enumerate(tree.length)), dict(enumerate(tree.label))
    path = tree.ancestors(v, include=True)
    lengths = [ln[x] for x in path]
    for k in range(len(path) - 1):
        below, above = path[k], path[k + 1]
        ch[above].remove(below)
        ch[below].append(above)
        ln[above] = lengths[k]
    ln[v] = None
    return Phylo.build(ch, v, ln, lb).collapse_singles()


def root(nodes: DataFrame, outgroup: list[str] | None = None, node: int | None = None, resolve: bool = True) -> DataFrame:
    """Roots each tree on the edge above an outgroup, half of its length on each side (``resolve``) or without a root of two children,
    or at a node, which becomes the root of an unrooted tree."""
    if outgroup is None:
        return edited(nodes, lambda t: at_node(t, t.ids.index(node)))
    return edited(nodes, lambda t: t.reroot(outgroup, resolve))


# -- pruning and grafting -------------------------------------------------------------------------------
def keep_tips(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """The trees of the tips with the labels; nodes left with one child are joined with it."""
    kept = set(labels)
    return edited(nodes, lambda t: t.keep_tips(kept))


def drop_fossils(nodes: DataFrame, tol: float = 1e-8) -> DataFrame:
    """The trees of the tips no more than ``tol`` nearer to the root than the farthest one."""

    def living(t: Phylo) -> Phylo:
        depth, tips = t.depths(), t.tips()
        last = max(depth[v] for v in tips)
        return t.keep_tips([t.label[v] for v in tips if depth[v] >= last - tol])

    return edited(nodes, living)


def collapse_singles(nodes: DataFrame, root_edge: bool = False) -> DataFrame:
    """Nodes with one child are joined with it, lengths are added."""
    return edited(nodes, lambda t: t.collapse_singles(root_edge))


def bind(nodes: DataFrame, others: DataFrame, where: str | None = None, position: float = 0.0) -> DataFrame:
    """Grafts the tree of ``others`` with the same id on each tree: at the root, or on the tip or node with a label, or on the edge
    above it at a distance."""

    def run(key, left, right):
        if not len(left) or not len(right):
            return _table(key[0], tree_of(left if len(left) else right))
        tree = tree_of(left)
        return _table(key[0], tree.bind(tree_of(right), None if where is None else tree.label.index(where), position))

    both = nodes.select(*_COLUMNS).groupBy("tree_id").cogroup(others.select(*_COLUMNS).groupBy("tree_id"))
    return both.applyInPandas(run, f"tree_id long, {NODES}")


# -- polytomies and lengths -----------------------------------------------------------------------------
def to_polytomies(nodes: DataFrame, tol: float = 1e-8) -> DataFrame:
    """Inner edges shorter than ``tol`` go."""
    return edited(nodes, lambda t: t.to_polytomies(tol))


def to_binary(nodes: DataFrame, seed: int | None = None) -> DataFrame:
    """Polytomies are resolved by edges of length 0, in order, or at random with a seed (the same at every run)."""
    return edited(nodes, lambda t: t.to_binary(None if seed is None else np.random.default_rng([seed, len(t)])))


def lengths_from_ages(nodes: DataFrame, ages: DataFrame) -> DataFrame:
    """The nodes with lengths from the ages (tree_id, node, age) of the two ends of each edge."""
    own, up = ages.select("tree_id", "node", F.col("age").alias("below")), ages.select("tree_id", F.col("node").alias("parent"), F.col("age").alias("above"))
    met = nodes.drop("length").join(own, ["tree_id", "node"]).join(up, ["tree_id", "parent"], "left")
    return met.select("tree_id", "node", "parent", (F.col("above") - F.col("below")).alias("length"), "label")


# -- orders and coordinates -----------------------------------------------------------------------------
def sorted_children(tree: Phylo, how: str | None, right: bool = True, node: int | None = None, swap: tuple[int, int] = (0, 1), constraint: list[str] | None = None) -> list[list[int]]:
    """Child lists in a wanted order: by clade size (``ladderize``), with two children of a node swapped (``rotate``), or by the first place
    of their tips in a constraint (``constraint``)."""
    out = [list(c) for c in tree.children]
    if how == "ladderize":
        n = tree.tip_counts()
        for c in out:
            c.sort(key=lambda v: n[v] if right else -n[v])
    elif how == "rotate":
        i, j = swap
        c = out[tree.ids.index(node)]
        c[i], c[j] = c[j], c[i]
    elif how == "constraint":
        place = {x: i for i, x in enumerate(constraint)}
        first = np.full(len(tree), len(place), float)
        for v in tree.postorder():
            first[v] = place.get(tree.label[v], len(place)) if tree.is_tip(v) else min(first[c] for c in tree.children[v])
        for c in out:
            c.sort(key=first.__getitem__)
    return out


def edge_order(children: list[list[int]], root: int, order: str = "cladewise") -> list[int]:
    """The lower ends of the edges: ``cladewise`` from the root, each before those below it; ``postorder`` with the edges of a node
    together, after all below them, those of the first child nearest."""
    out, stack = [], [root]
    while stack:
        v = stack.pop()
        if order == "cladewise":
            if v != root:
                out.append(v)
        else:
            out.extend(reversed(children[v]))
        stack.extend(reversed(children[v]))
    return out if order == "cladewise" else out[::-1]


def edge_ranks(nodes: DataFrame, order: str = "cladewise", siblings: str | None = None, **options) -> DataFrame:
    """(tree_id, node, rank): the place from 1 of the edge above each node, with siblings in the order of their ids or another one (see
    ``sorted_children``)."""

    def run(tree):
        found = edge_order(sorted_children(tree, siblings, **options), tree.root, order)
        return [(tree.ids[v], k) for k, v in enumerate(found, 1)]

    return rows_per_tree(nodes, run, f"node {nodes.schema['node'].dataType.simpleString()}, rank long")


def node_heights(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, height): tips are numbered cladewise, inner nodes stand at the mean of their children."""
    kind = nodes.schema["node"].dataType.simpleString()
    return rows_per_tree(nodes, lambda t: zip(t.ids, t.node_heights().tolist()), f"node {kind}, height double")


def to_polar(x: Column, y: Column) -> tuple[Column, Column]:
    """Radius and angle of a point."""
    return F.sqrt(x * x + y * y).alias("r"), F.atan2(y, x).alias("angle")


def to_cartesian(r: Column, angle: Column) -> tuple[Column, Column]:
    """x and y of a point."""
    return (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y")


def layout(nodes: DataFrame, kind: str = "phylogram") -> DataFrame:
    """(tree_id, node, x, y): where a drawing has the nodes: depth and height of a phylogram, level and height of a cladogram without
    lengths, or depth and angle of a fan turned into points."""
    at = T.root_paths(nodes).join(node_heights(nodes), ["tree_id", "node"])
    depth, height = F.col("level" if kind == "cladogram" else "depth").cast("double"), F.col("height")
    if kind != "fan":
        return at.select("tree_id", "node", depth.alias("x"), height.alias("y"))
    tips = T.with_children(nodes).groupBy("tree_id").agg(F.count_if("is_tip").alias("n"))
    return at.join(tips, "tree_id").select("tree_id", "node", *to_cartesian(depth, 2 * math.pi * (height - 1) / F.col("n")))


def node_distances(nodes: DataFrame) -> DataFrame:
    """(tree_id, a, b, dist): path length between all pairs of nodes a <= b of each tree."""
    kind = nodes.schema["node"].dataType.simpleString()

    def run(tree):
        d = tree.patristic()
        for i, a in enumerate(tree.ids):
            yield from zip([a] * (len(tree) - i), tree.ids[i:], d[i, i:].tolist())

    return rows_per_tree(nodes, run, f"a {kind}, b {kind}, dist double")


def clade_lengths(nodes: DataFrame) -> DataFrame:
    """(tree_id, clade, length): the sorted labels below each node, joined by commas, and the length above it; the same for trees that
    differ in the numbers of their nodes only."""

    def run(tree):
        clades = tree.clades()
        return [(",".join(sorted(x or "" for x in clades[v])), tree.length[v]) for v in range(len(tree))]

    return rows_per_tree(nodes, run, "clade string, length double")


# -- sets of trees ----------------------------------------------------------------------------------------
def concat_trees(*frames: DataFrame) -> DataFrame:
    """The trees of all tables, numbered tree_id * number of tables + place of the table."""
    out = None
    for k, nodes in enumerate(frames):
        own = nodes.select((F.col("tree_id") * len(frames) + k).alias("tree_id"), *_COLUMNS[1:])
        out = own if out is None else out.unionByName(own)
    return out


def get_trees(nodes: DataFrame, ids: list[int] | DataFrame) -> DataFrame:
    """The trees with the ids (a list, or a table with tree_id)."""
    return nodes.join(ids.select("tree_id"), "tree_id", "left_semi") if isinstance(ids, DataFrame) else nodes.where(F.col("tree_id").isin(*ids))


def assign_trees(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """The set with the trees of ``values`` in place of those with the same id, or added to it."""
    return nodes.select(*_COLUMNS).join(values.select("tree_id").distinct(), "tree_id", "left_anti").unionByName(values.select(*_COLUMNS))


def compress_labels(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tip_id, label), one row for each label of a tip of any tree (numbered in one task, as trees of a set share their labels), and the
    nodes with tip_id in place of the tips' labels."""
    own = T.with_children(nodes.select(*_COLUMNS))
    tips = own.where("is_tip and label is not null").select(F.col("label").alias("tip_label")).distinct().withColumn("tip_id", F.row_number().over(Window.orderBy("tip_label")).cast("long"))
    met = own.join(tips, F.col("is_tip") & (F.col("label") == F.col("tip_label")), "left")
    return tips.select("tip_id", F.col("tip_label").alias("label")), met.select("tree_id", "node", "parent", "length", F.when(~F.col("is_tip"), F.col("label")).alias("label"), "tip_id")


def uncompress_labels(tips: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with the labels of their tips again."""
    met = nodes.join(tips.withColumnRenamed("label", "tip_label"), "tip_id", "left")
    return met.select("tree_id", "node", "parent", "length", F.coalesce("tip_label", "label").alias("label"))


def one_wise(clade: str | Column, whole: str | Column) -> Column:
    """The side of a split (sorted labels) that holds the first of all labels."""
    clade, whole = (F.col(x) if isinstance(x, str) else x for x in (clade, whole))
    return F.when(F.array_contains(clade, F.element_at(whole, 1)), clade).otherwise(F.array_except(whole, clade))


def short_wise(clade: str | Column, whole: str | Column) -> Column:
    """The smaller side of a split (sorted labels); of two equal sides that with the first of all labels."""
    clade, whole = (F.col(x) if isinstance(x, str) else x for x in (clade, whole))
    twice = 2 * F.size(clade) - F.size(whole)
    return F.when(twice < 0, clade).when(twice > 0, F.array_except(whole, clade)).otherwise(one_wise(clade, whole))
