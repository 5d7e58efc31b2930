"""Seeded generators of random trees and traits; replicates run in parallel and do not depend on the partitioning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sylva.functions.phylo import Phylo
from sylva.operators.comparative import matrix_exponential, rate_index, rate_matrix
from sylva.sources.readers import NODES, tree_rows


def _labels(n: int, labels: list[str] | None) -> list[str]:
    return list(labels) if labels else [f"t{i + 1}" for i in range(n)]


def random_split_tree(n: int, rng: np.random.Generator, rooted: bool = True, labels: list[str] | None = None, branch=None) -> Phylo:
    """A topology by random splitting: a clade of k tips is cut into i and k - i, i uniform."""
    parent, tips = [-1], []
    stack = [(0, n)]
    while stack:
        v, k = stack.pop()
        if k == 1:
            tips.append(v)
            continue
        i = int(rng.integers(1, k))
        for size in (i, k - i):
            parent.append(v)
            stack.append((len(parent) - 1, size))
    names = [_labels(n, labels)[i] for i in rng.permutation(n)]
    label: list[str | None] = [None] * len(parent)
    for v, x in zip(tips, names):
        label[v] = x
    draw = branch or (lambda size: rng.random(size))
    lengths = draw(len(parent))
    tree = Phylo(parent, [None if p < 0 else float(x) for p, x in zip(parent, lengths)], label)
    return tree if rooted else tree.unroot()


def random_topology(n: int, rng: np.random.Generator, labels: list[str] | None = None, branch=None) -> Phylo:
    """A rooted topology, all equally likely, by adding tips to uniformly chosen edges."""
    children, parent = {0: [1, 2]}, {0: -1, 1: 0, 2: 0}
    tips = [1, 2]
    if n == 1:
        return Phylo([-1, 0], [None, 1.0], [None, _labels(1, labels)[0]])
    for _ in range(2, n):
        nodes = list(parent)
        v = nodes[int(rng.integers(0, len(nodes)))]
        mid, tip = len(parent), len(parent) + 1
        p = parent[v]
        children[mid], parent[mid], parent[tip], parent[v] = [v, tip], p, mid, mid
        if p >= 0:
            children[p] = [mid if c == v else c for c in children[p]]
        tips.append(tip)
    root = next(v for v, p in parent.items() if p < 0)
    names = dict(zip(tips, [_labels(n, labels)[i] for i in rng.permutation(n)]))
    draw = branch or (lambda size: rng.random(size))
    lengths = dict(zip(parent, map(float, draw(len(parent)))))
    lengths[root] = None
    return Phylo.build(children, root, lengths, names)


def coalescent_tree(n: int, rng: np.random.Generator, labels: list[str] | None = None) -> Phylo:
    """A coalescent tree: lineages merge at random, with exponential times of rate k (k - 1) / 2."""
    children, age = {}, dict.fromkeys(range(n), 0.0)
    alive, t, nxt = list(range(n)), 0.0, n
    length = {}
    while len(alive) > 1:
        k = len(alive)
        t += rng.exponential(2 / (k * (k - 1)))
        i, j = sorted(rng.choice(k, 2, replace=False))
        a, b = alive[i], alive[j]
        children[nxt], age[nxt] = [a, b], t
        length[a], length[b] = t - age[a], t - age[b]
        alive = [x for x in alive if x not in (a, b)] + [nxt]
        nxt += 1
    return Phylo.build(children, alive[0], length, dict(enumerate(_labels(n, labels))))


def birth_death_tree(birth: float, death: float, t_max: float, rng: np.random.Generator, extinct: bool = True, limit: int = 100_000) -> Phylo | None:
    """Two lineages at time 0 that split and die at constant rates until ``t_max``; without ``extinct``, only what survives (None if nothing does)."""
    children: dict[int, list[int]] = {0: [1, 2]}
    start = {0: 0.0, 1: 0.0, 2: 0.0}
    length: dict[int, float | None] = {0: None}
    alive, nxt, t = [1, 2], 3, 0.0
    dead = set()
    while alive:
        t += rng.exponential(1 / (len(alive) * (birth + death))) if birth + death > 0 else math.inf
        if t >= t_max or nxt > limit:
            break
        k = int(rng.integers(0, len(alive)))
        v = alive.pop(k)
        length[v] = t - start[v]
        if rng.random() < birth / (birth + death):
            children[v] = [nxt, nxt + 1]
            start[nxt] = start[nxt + 1] = t
            alive += [nxt, nxt + 1]
            nxt += 2
        else:
            dead.add(v)
    for v in alive:
        length[v] = t_max - start[v]
    tips = [v for v in start if v not in children]
    label = {v: f"t{i + 1}" for i, v in enumerate(tips)}
    tree = Phylo.build(children, 0, length, label)
    if extinct:
        return tree
    kept = [label[v] for v in alive]
    return tree.keep_tips(kept) if len(kept) > 1 else None


def species_tree(n: int, birth: float, death: float, rng: np.random.Generator) -> Phylo:
    """A birth-death tree with n living species, simulated back from the present."""
    alive, children, age, length = list(range(n)), {}, dict.fromkeys(range(n), 0.0), {}
    t, nxt, fossil = 0.0, n, set()
    while len(alive) > 1:
        k = len(alive)
        t += rng.exponential(1 / (k * (birth + death)))
        if rng.random() < birth / (birth + death) or death == 0:
            i, j = rng.choice(k, 2, replace=False)
            a, b = alive[i], alive[j]
            children[nxt], age[nxt] = [a, b], t
            length[a], length[b] = t - age[a], t - age[b]
            alive = [x for x in alive if x not in (a, b)] + [nxt]
        else:
            age[nxt] = t
            fossil.add(nxt)
            alive.append(nxt)
        nxt += 1
    labels = {v: f"t{v + 1}" for v in range(n)} | {v: f"x{v}" for v in fossil}
    return Phylo.build(children, alive[0], length, labels).drop_tips([labels[v] for v in fossil])


def continuous_trait(tree: Phylo, rng: np.random.Generator, model: str = "BM", sigma: float = 0.1, alpha: float = 1.0, theta: float = 0.0, root: float = 0.0) -> np.ndarray:
    """Values of all nodes under Brownian (BM) or Ornstein-Uhlenbeck (OU) evolution."""
    x, edge = np.zeros(len(tree)), tree.lengths()
    x[tree.root] = root
    for v in tree.preorder():
        if v == tree.root:
            continue
        p, t = x[tree.parent[v]], edge[v]
        if model == "OU" and alpha > 0:
            e = math.exp(-alpha * t)
            x[v] = p * e + theta * (1 - e) + rng.normal() * sigma * math.sqrt((1 - e * e) / (2 * alpha))
        else:
            x[v] = p + rng.normal() * sigma * math.sqrt(max(0.0, t))
    return x


def discrete_trait(tree: Phylo, rng: np.random.Generator, model: str = "ER", k: int = 2, rates=0.1, root: int = 0) -> np.ndarray:
    """States (from 0) of all nodes under a Markov model."""
    index = rate_index(model, k)
    q = rate_matrix(np.resize(np.atleast_1d(np.asarray(rates, float)), int(index.max())), index)
    s, edge = np.zeros(len(tree), int), tree.lengths()
    s[tree.root] = root
    for v in tree.preorder():
        if v != tree.root:
            p = np.maximum(matrix_exponential(q * edge[v])[s[tree.parent[v]]], 0)
            s[v] = rng.choice(k, p=p / p.sum())
    return s


GENERATORS = {"rtree": random_split_tree, "rtopology": random_topology, "rcoal": coalescent_tree}


def random_trees(spark: SparkSession, n_trees: int, n_tips: int, kind: str = "rtree", seed: int = 1) -> DataFrame:
    """A table of nodes of seeded random trees."""
    make = GENERATORS[kind]

    def run(batches):
        for pdf in batches:
            rows = [(int(i), *r) for i in pdf["id"] for r in tree_rows(make(n_tips, np.random.default_rng([seed, int(i)])))]
            yield pd.DataFrame(rows, columns=["tree_id", "node", "parent", "length", "label"]).astype({"parent": "Int64"})

    return spark.range(n_trees).mapInPandas(run, f"tree_id long, {NODES}")
