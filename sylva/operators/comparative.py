"""Comparative methods on traits: contrasts, ancestral states, covariance models, regressions.

Folds over one tree are sequential, so a tree and its traits go to one grouped kernel; trees run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sylva.functions.phylo import Phylo

#: Rows of a batch that a kernel hands on.
ROWS_OUT = 10_000


def tree_of(rows: pd.DataFrame) -> Phylo:
    """A tree from the rows of a table of nodes; children stand in the order of their node ids."""
    rows = rows.sort_values("node")
    number = {v: i for i, v in enumerate(rows["node"])}
    parent = [-1 if pd.isna(p) else number[p] for p in rows["parent"]]
    length = [None if pd.isna(x) else float(x) for x in rows["length"]]
    label = [None if x is None or (isinstance(x, float) and math.isnan(x)) else x for x in rows["label"]]
    tree = Phylo(parent, length, label)
    tree.ids = list(rows["node"])
    return tree


def trees_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Phylo]]:
    """(tree_id, tree) from batches of (tree_id, node, parent, length, label and any others, which become ``extra``), sorted by the first
    two; a tree may go over several batches."""
    key, rows = None, []

    def build() -> Phylo:
        ids, parents, lengths, labels, *extra = zip(*rows)
        number = {v: i for i, v in enumerate(ids)}
        tree = Phylo([-1 if p is None else number[p] for p in parents], list(lengths), list(labels))
        tree.ids, tree.extra = list(ids), extra
        return tree

    for batch in batches:
        for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and k != key:
                yield key, build()
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, build()


def rows_per_tree(nodes: DataFrame, f: Callable[[Phylo], Iterable[tuple]], schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Applies a kernel that returns rows to each tree; ``tree_id`` is put before them. One shuffle brings the trees together, and
    each task works through its trees one by one, so each tree has to fit into a task. Columns named in ``extra`` come along.

    The trees are dealt out by a hash of their own: a shuffle by ``tree_id`` is left out above a union whose sides are dealt out by it
    already, and adaptive execution may then cut the two sides at different places."""
    kind = StructType.fromDDL(f"tree_id long, {schema}")
    own = nodes.select("tree_id", "node", "parent", "length", "label", *extra).repartition(F.xxhash64("tree_id")).sortWithinPartitions("tree_id", "node")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = to_arrow_schema(kind)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type, from_pandas=True) for c, t in zip(zip(*rows), types)], schema=types)

    def run(batches):
        rows: list[tuple] = []
        for key, tree in trees_in(batches):
            rows.extend((key, *r) for r in f(tree))
            if len(rows) >= ROWS_OUT:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return own.mapInArrow(run, kind)


def per_tree(nodes: DataFrame, f: Callable[[Phylo], pd.DataFrame], schema: str) -> DataFrame:
    """Applies a kernel that returns a table to each tree; ``tree_id`` is put before its rows."""
    return rows_per_tree(nodes, lambda tree: f(tree).itertuples(index=False, name=None), schema)


def contrasts(tree: Phylo, x: dict[str, float], scaled: bool = True) -> tuple[dict[int, float], dict[int, float], np.ndarray, np.ndarray]:
    """Contrast and its variance at each internal node, node values and rescaled lengths."""
    if not tree.is_binary():
        raise ValueError("the tree is not rooted and binary")
    edge = tree.lengths().copy()
    value = np.zeros(len(tree))
    c, var = {}, {}
    for v in tree.postorder():
        if tree.is_tip(v):
            value[v] = x[tree.label[v]]
            continue
        a, b = tree.children[v]
        total = edge[a] + edge[b]
        c[v] = (value[a] - value[b]) / (math.sqrt(total) if scaled and total > 0 else 1.0)
        var[v] = total
        value[v] = (value[a] * edge[b] + value[b] * edge[a]) / total if total else (value[a] + value[b]) / 2
        edge[v] += edge[a] * edge[b] / total if total else 0.0
    return c, var, value, edge


def _with_trait(nodes: DataFrame, traits: DataFrame) -> DataFrame:
    return nodes.join(traits.select("label", "x"), "label", "left")


def pic(nodes: DataFrame, traits: DataFrame, scaled: bool = True) -> DataFrame:
    """(tree_id, node, contrast, variance, value) of each internal node; traits: (label, x)."""

    def run(tree):
        c, var, value, _ = contrasts(tree, dict(zip(tree.label, tree.extra[0])), scaled)
        return [(tree.ids[v], float(c[v]), float(var[v]), float(value[v])) for v in c]

    return rows_per_tree(_with_trait(nodes, traits), run, f"node {nodes.schema['node'].dataType.simpleString()}, contrast double, variance double, value double", ("x",))


# -- covariance models ----------------------------------------------------------------------------------
def covariance(tree: Phylo, model: str = "brownian", value: float = 1.0, corr: bool = False) -> tuple[np.ndarray, list[str]]:
    """Covariance of the tips under brownian, martins (exp(-value d)), pagel (off-diagonal times value), blomberg (lengths of a
    transformed depth) or grafen (heights to a power) evolution."""
    names = [tree.label[v] for v in tree.tips()]
    if model == "grafen":
        v = tree.grafen(value).shared_length()
    elif model == "martins":
        tips = tree.tips()
        v = np.exp(-value * tree.patristic()[np.ix_(tips, tips)])
    elif model == "blomberg":
        depth = tree.depths()
        moved = tree.copy()
        age = np.array([(d ** (1 / value)) if value > 0 else 0.0 for d in depth])
        moved.length = [None if p < 0 else float(age[i] - age[p]) for i, p in enumerate(tree.parent)]
        v = moved.shared_length()
    else:
        v = tree.shared_length()
        if model == "pagel":
            v = np.where(np.eye(len(v), dtype=bool), v, value * v)
        elif model != "brownian":
            raise ValueError(f"no model {model!r}")
    if corr:
        s = np.sqrt(np.diag(v))
        v = v / s[:, None] / s[None, :]
    return v, names


def covariances(nodes: DataFrame, model: str = "brownian", value: float = 1.0, corr: bool = False) -> DataFrame:
    """(tree_id, a, b, v): covariances of the tips (by label, a <= b) of each tree under a model of ``covariance``."""

    def run(tree):
        v, names = covariance(tree, model, value, corr)
        order = np.argsort(names)
        names, v = np.array(names)[order], v[np.ix_(order, order)]
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({"a": names[i], "b": names[j], "v": v[i, j]})

    return per_tree(nodes, run, "a string, b string, v double")


def ancestral_values(nodes: DataFrame, traits: DataFrame, method: str = "PIC") -> DataFrame:
    """(tree_id, node, value, lower, upper, rate) of the internal nodes by ``ace_continuous``; traits: (label, x)."""

    def run(tree):
        value, rate, spread = ace_continuous(tree, dict(zip(tree.label, tree.extra[0])), method)
        return [(tree.ids[v], value[v], *spread[v], rate) for v in value]

    kind = nodes.schema["node"].dataType.simpleString()
    return rows_per_tree(_with_trait(nodes, traits), run, f"node {kind}, value double, lower double, upper double, rate double", ("x",))


def gls(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Generalised least squares: coefficients, their covariance and the residual variance."""
    inv = np.linalg.inv(v)
    cov = np.linalg.inv(x.T @ inv @ x)
    beta = cov @ x.T @ inv @ y
    r = y - x @ beta
    s2 = float(r @ inv @ r / max(1, len(y) - x.shape[1]))
    return beta, cov * s2, s2


def gls_fits(nodes: DataFrame, traits: DataFrame, predictors: list[str], response: str = "y", model: str = "brownian", value: float = 1.0) -> DataFrame:
    """(tree_id, term, estimate, se, variance): generalised least squares over the tips of each tree under a covariance model;
    traits: (label, response, predictors)."""
    columns = (response, *predictors)
    met = nodes.join(traits.select("label", *columns), "label", "left")

    def run(tree):
        v, names = covariance(tree, model, value)
        rows = {x: [c[k] for c in tree.extra] for k, x in enumerate(tree.label) if tree.is_tip(k)}
        data = np.array([rows[x] for x in names], float)
        beta, cov, s2 = gls(data[:, 0], np.column_stack([np.ones(len(data)), data[:, 1:]]), v)
        return [(term, float(b), float(np.sqrt(c)), s2) for term, b, c in zip(["intercept", *predictors], beta, np.diag(cov))]

    return rows_per_tree(met, run, "term string, estimate double, se double, variance double", columns)


# -- optimisers -----------------------------------------------------------------------------------------
def golden(f: Callable[[float], float], lo: float, hi: float, tol: float = 1e-9) -> float:
    """Minimum of a function of one variable by golden sections."""
    g = (math.sqrt(5) - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while abs(b - a) > tol * max(1.0, abs(a) + abs(b)):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def nelder_mead(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.5, tol: float = 1e-10, steps: int = 4000) -> np.ndarray:
    """Minimum of a function of several variables by the simplex method."""
    n = len(start)
    s = [np.array(start, float)] + [np.array(start, float) + np.eye(n)[i] * (step if not start[i] else step * abs(start[i])) for i in range(n)]
    y = [f(x) for x in s]
    for _ in range(steps):
        order = np.argsort(y)
        s, y = [s[i] for i in order], [y[i] for i in order]
        if abs(y[-1] - y[0]) <= tol * (abs(y[0]) + tol):
            break
        mid = np.mean(s[:-1], axis=0)
        r = 2 * mid - s[-1]
        fr = f(r)
        if fr < y[0]:
            e = 3 * mid - 2 * s[-1]
            fe = f(e)
            s[-1], y[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < y[-2]:
            s[-1], y[-1] = r, fr
        else:
            c = (mid + (r if fr < y[-1] else s[-1])) / 2
            fc = f(c)
            if fc < min(fr, y[-1]):
                s[-1], y[-1] = c, fc
            else:
                s = [s[0]] + [(x + s[0]) / 2 for x in s[1:]]
                y = [y[0]] + [f(x) for x in s[1:]]
    return s[int(np.argmin(y))]


# -- ancestral states -----------------------------------------------------------------------------------
def ace_continuous(tree: Phylo, x: dict[str, float], method: str = "REML") -> tuple[dict[int, float], float, dict[int, tuple[float, float]]]:
    """Node values, the rate and 95 % intervals: PIC gives local estimates, ML, REML and GLS joint ones under Brownian motion."""
    tips, inner = tree.tips(), tree.internal()
    y = np.array([x[tree.label[v]] for v in tips])
    if method == "PIC":
        c, var, value, edge = contrasts(tree, x)
        rate = float(np.mean(np.square(list(c.values()))))
        out = {v: float(value[v]) for v in inner}
        half = {v: 1.959963984540054 * math.sqrt(edge[v] - tree.lengths()[v]) for v in inner}
        return out, rate, {v: (out[v] - half[v], out[v] + half[v]) for v in inner}
    full = tree.patristic()
    depth = tree.depths()
    shared = (depth[:, None] + depth[None, :] - full) / 2
    vt = shared[np.ix_(tips, tips)]
    inv = np.linalg.inv(vt)
    one = np.ones(len(tips))
    info = one @ inv @ one
    root = float(one @ inv @ y / info)
    r = y - root
    rate = float(r @ inv @ r / (len(tips) if method == "ML" else len(tips) - 1))
    cross = shared[np.ix_(inner, tips)]
    est = root + cross @ inv @ r
    spread = np.diag(shared)[inner] - np.einsum("ij,jk,ik->i", cross, inv, cross) + (1 - cross @ inv @ one) ** 2 / info
    half = 1.959963984540054 * np.sqrt(np.maximum(rate * spread, 0))
    return {v: float(e) for v, e in zip(inner, est)}, rate, {v: (float(e - h), float(e + h)) for v, e, h in zip(inner, est, half)}


def rate_matrix(rates: np.ndarray, index: np.ndarray) -> np.ndarray:
    q = np.where(index > 0, np.concatenate([[0.0], rates])[index], 0.0)
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q


def rate_index(model: str, k: int) -> np.ndarray:
    """Which rate each change has, from 1: ER one for all, SYM one a pair, ARD one a direction."""
    index = np.zeros((k, k), int)
    if model == "ER":
        index[:] = 1
    else:
        n = 0
        for j in range(k):
            for i in range(k):
                if i != j and (model == "ARD" or i > j):
                    n += 1
                    index[i, j] = n
                    if model == "SYM":
                        index[j, i] = n
    np.fill_diagonal(index, 0)
    return index


def matrix_exponential(a: np.ndarray) -> np.ndarray:
    """exp of a matrix by its eigenvalues, or by scaling and squaring where these are defective."""
    w, u = np.linalg.eig(a)
    if np.linalg.cond(u) < 1e10:
        return ((u * np.exp(w)) @ np.linalg.inv(u)).real
    k = max(0, int(np.ceil(np.log2(max(1e-16, np.abs(a).sum(axis=1).max())))) + 4)
    x, term, out = a / 2**k, np.eye(len(a)), np.eye(len(a))
    for i in range(1, 20):
        term = term @ x / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def discrete_likelihood(tree: Phylo, states: dict[str, int], q: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """Log-likelihood by pruning, and the scaled conditional likelihoods of each node."""
    edge = tree.lengths()
    like = np.ones((len(tree), k))
    total = 0.0
    for v in tree.postorder():
        if tree.is_tip(v):
            s = states.get(tree.label[v])
            if s is not None:
                like[v] = 0.0
                like[v, s] = 1.0
            continue
        for c in tree.children[v]:
            like[v] *= matrix_exponential(q * edge[c]) @ like[c]
        scale = like[v].sum()
        total += math.log(scale) if scale > 0 else -1e300
        like[v] /= scale or 1.0
    return total, like


def ace_discrete(tree: Phylo, states: dict[str, str], model: str = "ER") -> tuple[np.ndarray, float, list[str], dict[int, np.ndarray], np.ndarray]:
    """Rates, log-likelihood, states and the scaled likelihoods of the internal nodes (joint: rescaled by a pass from the root)."""
    names = sorted({s for s in states.values() if s is not None})
    code = {t: names.index(s) for t, s in states.items() if s is not None}
    k = len(names)
    if k < 2:
        raise ValueError("all tips are in one state")
    index = rate_index(model, k)
    n = int(index.max())

    def loss(log_rates: np.ndarray) -> float:
        return -discrete_likelihood(tree, code, rate_matrix(np.exp(np.clip(log_rates, -15, 10)), index), k)[0]

    start = math.log(max(1e-6, n / max(1e-9, tree.lengths().sum())))
    best = np.array([golden(lambda r: loss(np.array([r])), -12, 8, 1e-7)]) if n == 1 else nelder_mead(loss, np.full(n, start))
    rates = np.exp(np.clip(best, -15, 10))
    q = rate_matrix(rates, index)
    ll, like = discrete_likelihood(tree, code, q, k)
    edge = tree.lengths()
    joint = like.copy()
    for v in tree.preorder():
        if v == tree.root or tree.is_tip(v):
            continue
        p = matrix_exponential(q * edge[v])
        down = p @ like[v]
        up = joint[tree.parent[v]] / np.where(down > 0, down, 1)
        joint[v] = like[v] * (up @ p)
        joint[v] /= joint[v].sum()
    return rates, ll, names, {v: joint[v] for v in tree.internal()}, q


def most_parsimonious(tree: Phylo, x: dict[str, float]) -> dict[int, tuple[float, float]]:
    """Intervals of the most parsimonious values of each internal node of a binary tree."""
    lo, hi = np.zeros(len(tree)), np.zeros(len(tree))

    def median(values: list[float]) -> tuple[float, float]:
        s = sorted(values)
        m = len(s) // 2
        return (s[m - 1], s[m])

    for v in tree.postorder():
        if tree.is_tip(v):
            lo[v] = hi[v] = x[tree.label[v]]
        else:
            lo[v], hi[v] = median([w for c in tree.children[v] for w in (lo[c], hi[c])])
    out: dict[int, tuple[float, float]] = {}
    for v in tree.preorder():
        if tree.is_tip(v):
            continue
        if v == tree.root:
            out[v] = (lo[v], hi[v])
        else:
            p = out[tree.parent[v]]
            kids = [w for c in tree.children[v] for w in (lo[c], hi[c])]
            a, b = (sorted([*kids, e, e])[len(kids) // 2 : len(kids) // 2 + 2] for e in p)
            out[v] = (min(a[0], b[0]), max(a[1], b[1]))
    return out


# -- regressions ----------------------------------------------------------------------------------------
def lynch(y: np.ndarray, g: np.ndarray, eps: float = 1e-4, steps: int = 10_000) -> tuple[float, float, float]:
    """Phylogenetic mixed model of one trait by EM: mean, heritable and residual variance."""
    n = len(y)
    va = vr = float(np.var(y) / 2)
    mean = float(y.mean())
    for _ in range(steps):
        inv = np.linalg.inv(va * g + vr * np.eye(n))
        one = np.ones(n)
        mean = float(one @ inv @ y / (one @ inv @ one))
        r = y - mean
        na = va + va * va * (r @ inv @ g @ inv @ r - np.trace(inv @ g)) / n
        nr = vr + vr * vr * (r @ inv @ inv @ r - np.trace(inv)) / n
        done = abs(na - va) < eps * max(va, 1e-12) and abs(nr - vr) < eps * max(vr, 1e-12)
        va, vr = max(float(na), 1e-12), max(float(nr), 1e-12)
        if done:
            break
    return mean, va, vr


def cheverud(y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Phylogenetic autoregression y = rho W y + e with rows of W normalised: rho and the share of variance explained."""
    rows = w.sum(axis=1, keepdims=True)
    w = w / np.where(rows == 0, 1, rows)
    y = (y - y.mean()) / y.std(ddof=1)
    values = np.linalg.eigvals(w).real
    low, high = values.min(), values.max()
    n = len(y)

    def loss(rho: float) -> float:
        r = y - rho * (w @ y)
        det = np.log(np.abs(1 - rho * values) + 1e-300).sum()
        return math.log(r @ r / n) - 2 * det / n

    a, b = (1 / low if low < 0 else -1.0) + 1e-6, (1 / high if high > 0 else 1.0) - 1e-6
    rho = golden(loss, a, b)
    r = y - rho * (w @ y)
    return rho, float(1 - r.var() / y.var())


def ou_fit(tree: Phylo, x: dict[str, float], alpha: float | None = None) -> tuple[float, float, float, float]:
    """Ornstein-Uhlenbeck fit on an ultrametric tree: alpha, sigma2, theta, -2 log-likelihood."""
    tips = tree.tips()
    d = tree.patristic()[np.ix_(tips, tips)]
    y = np.array([x[tree.label[v]] for v in tips])
    top = tree.depths()[tips].max()
    n, one = len(y), np.ones(len(tips))

    def fit(a: float) -> tuple[float, float, float]:
        v = np.exp(-a * d) * (1 - np.exp(-2 * a * (top - d / 2))) / (2 * a) if a > 1e-9 else top - d / 2
        sign, det = np.linalg.slogdet(v)
        inv = np.linalg.inv(v)
        theta = float(one @ inv @ y / (one @ inv @ one))
        s2 = float((y - theta) @ inv @ (y - theta) / n)
        return n * math.log(2 * math.pi * s2) + det + n, s2, theta

    if alpha is None:
        alpha = math.exp(golden(lambda la: fit(math.exp(la))[0], math.log(1e-4), math.log(100.0), 1e-7))
    dev, s2, theta = fit(alpha)
    return alpha, s2, theta, dev


def gee(y: np.ndarray, x: np.ndarray, r: np.ndarray, family: str = "gaussian", steps: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Generalised estimating equations with a fixed working correlation: coefficients, their covariance, scale."""
    beta = np.linalg.lstsq(x, y if family == "gaussian" else np.log(y + 0.5) if family == "poisson" else np.log((y + 0.5) / (1.5 - y)), rcond=None)[0]
    for _ in range(steps):
        eta = x @ beta
        if family == "gaussian":
            mu, dmu, var = eta, np.ones_like(eta), np.ones_like(eta)
        elif family == "poisson":
            mu = np.exp(np.clip(eta, -30, 30))
            dmu = var = mu
        else:
            mu = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
            dmu = var = mu * (1 - mu)
        s = np.sqrt(var)
        inv = np.linalg.inv(r * s[:, None] * s[None, :])
        d = x * dmu[:, None]
        a = d.T @ inv @ d
        step = np.linalg.solve(a, d.T @ inv @ (y - mu))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    scale = float((((y - mu) ** 2 / var).sum()) / max(1, len(y) - x.shape[1]))
    return beta, np.linalg.inv(a) * scale, scale


def lm_origin(y: np.ndarray, x: np.ndarray, origin: bool = True, n_perm: int = 999, seed: int = 1) -> tuple[np.ndarray, float, float]:
    """Regression (through the origin): coefficients, F and its permutation p-value; the response is permuted, with random signs through the origin."""
    rng = np.random.default_rng(seed)
    if not origin:
        x = np.column_stack([np.ones(len(y)), x])
    p = x.shape[1] - (not origin)

    def f(y: np.ndarray) -> tuple[np.ndarray, float]:
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        r = y - x @ b
        total = (y @ y) if origin else ((y - y.mean()) ** 2).sum()
        rest = float(r @ r / (len(y) - x.shape[1]))
        return b, float((total - r @ r) / p) / rest if rest else math.inf

    b, obs = f(y)
    hits = 1
    for _ in range(n_perm):
        z = y[rng.permutation(len(y))] * (rng.choice([-1, 1], len(y)) if origin else 1)
        hits += f(z)[1] >= obs - 1e-12
    return b, obs, hits / (n_perm + 1)


def parafit(host: np.ndarray, para: np.ndarray, links: np.ndarray, n_perm: int = 999, seed: int = 1) -> tuple[float, float]:
    """Global fit of host and parasite distances over their links: the trace statistic and its permutation p-value."""
    from sylva.operators.spatial import principal_coordinates

    _, b = principal_coordinates(para)
    _, c = principal_coordinates(host)

    def trace(a: np.ndarray) -> float:
        d = b.T @ a.T @ c
        return float((d * d).sum())

    obs = trace(links)
    rng = np.random.default_rng(seed)
    hits = 1 + sum(trace(np.column_stack([rng.permutation(col) for col in links.T])) >= obs - 1e-12 for _ in range(n_perm))
    return obs, hits / (n_perm + 1)


def variance_components(values: DataFrame, levels: list[str], value: str) -> DataFrame:
    """(level, mean_square_between): sums of squares between the groups of each nested level, upper levels first."""
    from pyspark.sql import functions as F

    out = None
    for k, level in enumerate(levels):
        upper = values.groupBy(*levels[:k]).agg(F.avg(value).alias("up")) if k else values.agg(F.avg(value).alias("up"))
        own = values.groupBy(*levels[: k + 1]).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
        both = own.join(upper, levels[:k]) if k else own.crossJoin(upper)
        row = both.agg(F.lit(level).alias("level"), F.sum(F.col("n") * F.pow(F.col("mean") - F.col("up"), F.lit(2))).alias("sum_of_squares"), F.count("*").alias("groups"))
        out = row if out is None else out.unionByName(row)
    return out
