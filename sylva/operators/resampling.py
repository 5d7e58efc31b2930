"""Bootstrap of alignments, and dN/dS."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.phylo import Phylo, parse_newick, write_newick
from sylva.operators.inference import BUILDERS
from sylva.operators.sequences import codon_map


#: Letters of an alignment that each task of a bootstrap holds.
MOST_BASES = 100_000_000


def simple_distances(x: np.ndarray, model: str = "raw") -> np.ndarray:
    """Distances between the rows of an array of base codes; sites unknown (-1) in either row are left out."""
    n = len(x)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            ok = (x[i] >= 0) & (x[j] >= 0)
            p = float((x[i][ok] != x[j][ok]).mean()) if ok.any() else 0.0
            d[i, j] = d[j, i] = p if model == "raw" else -0.75 * np.log(max(1e-12, 1 - 4 * p / 3))
    return d


def codes_of(seqs: list[str]) -> np.ndarray:
    table = np.full(256, -1)
    for k, b in enumerate("acgt"):
        table[ord(b)] = table[ord(b.upper())] = k
    return np.array([table[np.frombuffer(s.encode("ascii", "replace"), np.uint8)] for s in seqs])


def bootstrap_trees(seqs: DataFrame, n: int = 100, method: str = "nj", model: str = "raw", block: int = 1, seed: int = 1) -> DataFrame:
    """(replicate, newick): trees of alignments with resampled blocks of sites; replicate 0 is the alignment itself.

    Replicate ids are rows, spread over tasks; the alignment is held by each task, so it has ``MOST_BASES`` letters at most.
    """
    spark = seqs.sparkSession
    size = seqs.agg(F.sum(F.length("seq"))).first()[0] or 0
    if size > MOST_BASES:
        raise ValueError(f"an alignment of {size} letters is more than a task can hold whole ({MOST_BASES})")
    rows = sorted((str(r.label), r.seq) for r in seqs.select("label", "seq").toLocalIterator())
    held = spark.sparkContext.broadcast((codes_of([s for _, s in rows]), [x for x, _ in rows]))

    def run(batches):
        x, labels = held.value
        groups = x.shape[1] // block
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                y = x
                if k:
                    pick = np.random.default_rng([seed, int(k)]).integers(0, groups, groups)
                    y = x[:, (pick[:, None] * block + np.arange(block)).ravel()]
                out.append(write_newick(BUILDERS[method](simple_distances(y, model), labels)))
            yield pd.DataFrame({"replicate": pdf["id"], "newick": out})

    return spark.range(n + 1).repartition(min(n + 1, 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, "replicate long, newick string")


def split_support(trees: DataFrame) -> DataFrame:
    """(split, support): how many replicates have each split of replicate 0."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([(int(k), ",".join(sorted(s))) for k, t in zip(pdf["replicate"], pdf["newick"]) for s in parse_newick(t)[1].splits()], columns=["replicate", "split"])

    splits = trees.mapInPandas(run, "replicate long, split string")
    freq = splits.where("replicate > 0").groupBy("split").agg(F.count("*").alias("support"))
    return splits.where("replicate = 0").select("split").join(freq, "split", "left").select("split", F.coalesce("support", F.lit(0)).alias("support"))


def degeneracy(code: int = 1) -> dict[str, tuple[int, int, int]]:
    """Of each codon the degeneracy class of its sites: 0 (every change matters), 2, or 4 (none does); three-fold sites count as 4, rarer ones as 2."""
    table = codon_map(code)
    out = {}
    for c, aa in table.items():
        row = []
        for k in range(3):
            same = sum(table[c[:k] + b + c[k + 1 :]] == aa for b in "acgt")
            row.append({1: 0, 2: 2, 3: 4, 4: 4}[same])
        out[c] = tuple(row)
    return out


def dn_ds(a: str, b: str, code: int = 1) -> tuple[float, float]:
    """dN and dS of two aligned coding sequences by Li's method; nan where a logarithm is undefined."""
    classes = degeneracy(code)
    n = {0: 0.0, 2: 0.0, 4: 0.0}
    ts, tv = Counter(), Counter()
    pair = {frozenset("ag"), frozenset("ct")}
    for i in range(0, min(len(a), len(b)) - 2, 3):
        x, y = a[i : i + 3].lower(), b[i : i + 3].lower()
        if x not in classes or y not in classes:
            continue
        for k in range(3):
            for c in (classes[x][k], classes[y][k]):
                n[c] += 0.5
                if x[k] != y[k]:
                    (ts if frozenset((x[k], y[k])) in pair else tv)[c] += 0.5

    def ab(c: int) -> tuple[float, float]:
        if not n[c]:
            return 0.0, 0.0
        p, q = ts[c] / n[c], tv[c] / n[c]
        u, w = 1 - 2 * p - q, 1 - 2 * q
        if u <= 0 or w <= 0:
            return float("nan"), float("nan")
        return -np.log(u) / 2 + np.log(w) / 4, -np.log(w) / 2

    (a0, b0), (a2, b2), (a4, b4) = ab(0), ab(2), ab(4)
    ds = (n[2] * a2 + n[4] * a4) / (n[2] + n[4]) + b4 if n[2] + n[4] else float("nan")
    dn = a0 + (n[0] * b0 + n[2] * b2) / (n[0] + n[2]) if n[0] + n[2] else float("nan")
    return dn, ds


def majority_tree(newicks: list[str], p: float = 0.5) -> Phylo:
    """Consensus of rooted trees with the same tips."""
    trees = [parse_newick(t)[1] for t in newicks]
    count = Counter(c for t in trees for c in {t.clades()[v] for v in t.internal()})
    from sylva.operators.topology_counts import tree_from_splits

    labels = sorted(trees[0].clades()[trees[0].root])
    need = (0.5000001 if p == 0.5 else p) * len(trees)
    kept = [c for c, k in count.items() if k >= need and 1 < len(c) < len(labels)]
    outside = "\0root"
    out = tree_from_splits([(c, 1.0) for c in kept], [*labels, outside]).drop_tips([outside])
    out.length = [None] * len(out)
    return out
