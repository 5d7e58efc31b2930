"""Node dating and diversification models: one tree a task, with the optimisers of ``comparative``."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sylva.functions.phylo import Phylo
from sylva.operators.comparative import golden, nelder_mead, per_tree


def mean_path_lengths(tree: Phylo) -> tuple[Phylo, dict[int, float], dict[int, float]]:
    """Dates by mean path lengths of a rooted binary tree: the dated tree, standard errors and p-values of the clock tests at the nodes."""
    if not tree.is_binary():
        raise ValueError("the tree is not rooted and binary")
    edge, n = tree.lengths(), tree.tip_counts()
    total = np.zeros(len(tree))  # summed path lengths to the tips below
    squares = np.zeros(len(tree))  # lengths below, each times the squared number of tips it carries
    age = np.zeros(len(tree))
    for v in tree.postorder():
        for c in tree.children[v]:
            total[v] += total[c] + n[c] * edge[c]
            squares[v] += squares[c] + n[c] ** 2 * edge[c]
        if tree.children[v]:
            age[v] = total[v] / n[v]
    se, p = {}, {}
    for v in tree.internal():
        se[v] = math.sqrt(squares[v]) / n[v]
        a, b = tree.children[v]
        gap = abs((age[a] + edge[a]) - (age[b] + edge[b]))
        var = (squares[a] + n[a] ** 2 * edge[a]) / n[a] ** 2 + (squares[b] + n[b] ** 2 * edge[b]) / n[b] ** 2
        p[v] = math.erfc(gap / math.sqrt(2 * var)) if var > 0 else 1.0
    return tree.with_ages(age), se, p


def chrono_mpl(nodes: DataFrame) -> DataFrame:
    """(tree_id, node, age, se, p) of the internal nodes of each tree."""

    def f(tree: Phylo) -> pd.DataFrame:
        dated, se, p = mean_path_lengths(tree)
        top = dated.depths()
        deepest = top.max()
        return pd.DataFrame([(int(tree.ids[v]), deepest - top[v], se[v], p[v]) for v in tree.internal()], columns=["node", "age", "se", "p"])

    return per_tree(nodes, f, "node long, age double, se double, p double")


def penalised_dates(tree: Phylo, smoothing: float = 1.0, root_age: float = 1.0, bounds: dict[int, tuple[float, float]] | None = None, steps: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Penalised-likelihood dating with correlated rates: ages, rates and the penalised log-likelihood.

    Edge lengths count as Poisson with mean rate times duration; the penalty is the squared change of rate along the tree plus
    the variance of the rates at the root, both subtracted. Rates and dates are improved in turn.
    """
    edge = tree.lengths()
    inner = [v for v in tree.internal() if v != tree.root]
    n = tree.tip_counts()
    age = np.where(n > 1, np.log(np.maximum(n, 1)) / math.log(max(2, n[tree.root])), 0.0) * root_age
    bounds = bounds or {}
    for v in tree.preorder():
        if v in bounds:
            age[v] = min(max(age[v], bounds[v][0]), bounds[v][1])
        if v != tree.root and tree.children[v]:
            age[v] = min(age[v], age[tree.parent[v]] * 0.999)
    below = [v for v in tree.preorder() if v != tree.root]
    rate = np.full(len(tree), edge[below].sum() / max(1e-12, sum(age[tree.parent[v]] - age[v] for v in below)))

    def loss(age: np.ndarray, rate: np.ndarray) -> float:
        out = 0.0
        for v in below:
            t = age[tree.parent[v]] - age[v]
            m = rate[v] * t
            if t < 0 or m <= 0:
                return 1e100
            out += m - edge[v] * math.log(m) + math.lgamma(edge[v] + 1)
            p = tree.parent[v]
            if p != tree.root:
                out += smoothing * (rate[v] - rate[p]) ** 2
        base = [rate[c] for c in tree.children[tree.root]]
        return out + smoothing * float(np.var(base, ddof=1) if len(base) > 1 else 0.0)

    def local(v: int, age: np.ndarray, rate: np.ndarray) -> float:
        """The part of the loss that the date of a node enters."""
        out = 0.0
        for e in [*tree.children[v], *([v] if v != tree.root else [])]:
            m = rate[e] * (age[tree.parent[e]] - age[e])
            if m <= 0:
                return 1e100
            out += m - edge[e] * math.log(m)
        return out

    now = loss(age, rate)
    for _ in range(steps):
        for v in below:
            t = age[tree.parent[v]] - age[v]
            p = tree.parent[v]
            near = [rate[c] for c in tree.children[v]] + ([rate[p]] if p != tree.root else [rate[c] for c in tree.children[p] if c != v])
            s, k = smoothing * sum(near), smoothing * len(near)
            # t - x / r + 2 (k r - s) = 0 is quadratic in r
            b = t - 2 * s
            rate[v] = max(1e-12, (-b + math.sqrt(b * b + 8 * k * edge[v])) / (4 * k)) if k > 0 else max(1e-12, edge[v] / max(t, 1e-12))
        for v in inner:
            lo = max([age[c] for c in tree.children[v]] + [bounds.get(v, (0, 0))[0]]) + 1e-12
            hi = min(age[tree.parent[v]] - 1e-12, bounds.get(v, (0, math.inf))[1])
            if hi > lo:

                def g(x: float, v: int = v) -> float:
                    old, age[v] = age[v], x
                    y = local(v, age, rate)
                    age[v] = old
                    return y

                x = golden(g, lo, hi, 1e-9)
                if g(x) < g(age[v]):
                    age[v] = x
        new = loss(age, rate)
        if now - new < 1e-9 * (1 + abs(now)):
            break
        now = new
    return age, rate, -now


def chronos(nodes: DataFrame, smoothing: float = 1.0, root_age: float = 1.0) -> DataFrame:
    """(tree_id, node, age, rate) of all nodes of each tree."""

    def f(tree: Phylo) -> pd.DataFrame:
        age, rate, _ = penalised_dates(tree, smoothing, root_age)
        return pd.DataFrame([(int(tree.ids[v]), age[v], None if v == tree.root else rate[v]) for v in range(len(tree))], columns=["node", "age", "rate"])

    return per_tree(nodes, f, "node long, age double, rate double")


def root_to_tip(tree: Phylo, dates: dict[str, float], objective: str = "correlation") -> tuple[int, float, float]:
    """The edge (its lower node), the place on it (share from the lower end) and the value of the best root for tips of known dates."""
    base = tree.unroot()
    tips = base.tips()
    full = base.patristic()
    y = np.array([dates[base.label[v]] for v in tips])
    below = {v: set() for v in range(len(base))}
    for v in base.postorder():
        below[v] = {v} if base.is_tip(v) else set().union(*(below[c] for c in base.children[v]))

    def value(x: np.ndarray) -> float:
        if np.ptp(x) == 0 or np.ptp(y) == 0:
            return -math.inf
        r = float(np.corrcoef(y, x)[0, 1])
        if objective == "correlation":
            return r
        slope, intercept = np.polyfit(y, x, 1)
        return r * r if objective == "rsquared" else -float(np.mean((x - slope * y - intercept) ** 2))

    best = (-1, 0.0, -math.inf)
    for v in range(len(base)):
        if v == base.root:
            continue
        p, length = base.parent[v], base.lengths()[v]
        down = np.array([t in below[v] for t in tips])

        def at(share: float, v=v, p=p, length=length, down=down) -> np.ndarray:
            return np.where(down, full[v, tips] + share * length, full[p, tips] + (1 - share) * length)

        share = golden(lambda s: -value(at(s)), 0.0, 1.0, 1e-8)
        got = max((value(at(s)), s) for s in (0.0, share, 1.0))
        if got[0] > best[2]:
            best = (v, got[1], got[0])
    return best


def estimate_dates(tree: Phylo, dates: dict[str, float], rate: float, steps: int = 1000, tol: float = 1e-10) -> np.ndarray:
    """Dates of the nodes that maximise the Poisson likelihood of the edge lengths at a given rate, with the tips' dates known."""
    edge, date = tree.lengths(), np.zeros(len(tree))
    for v in tree.postorder():
        date[v] = dates[tree.label[v]] if tree.is_tip(v) else min(date[c] - max(edge[c] / rate, 1e-6) for c in tree.children[v])
    for _ in range(steps):
        moved = 0.0
        for v in tree.internal():
            hi = min(date[c] for c in tree.children[v])
            lo = date[tree.parent[v]] if v != tree.root else hi - 2 * max(1e-6, max(edge[c] for c in tree.children[v]) / rate + hi - date[v])

            def g(x: float, v: int = v) -> float:
                ends = [(date[c] - x, edge[c]) for c in tree.children[v]] + ([(x - date[tree.parent[v]], edge[v])] if v != tree.root else [])
                return sum(rate * t - e * math.log(max(rate * t, 1e-300)) for t, e in ends)

            x = golden(g, lo, hi, 1e-12)
            moved = max(moved, abs(x - date[v]))
            date[v] = x
        if moved < tol * (1 + np.abs(date).max()):
            break
    return date


# -- diversification --------------------------------------------------------------------------------------
def birth_death_fit(times: np.ndarray) -> tuple[float, float, float]:
    """Birth and death rates from branching times (oldest first), and the deviance: maximum likelihood over r = b - d and a = d / b."""
    x = np.sort(times)[::-1]
    n = len(x) + 1

    def deviance(p: np.ndarray) -> float:
        a, r = p
        if r <= 0 or not 0 <= a < 1:
            return 1e100
        return -2 * (math.lgamma(n) + (n - 2) * math.log(r) + r * x[1:].sum() + n * math.log(1 - a) - 2 * np.log(np.exp(r * x) - a).sum())

    best = nelder_mead(deviance, np.array([0.2, max(1e-3, (n - 2) / max(1e-9, x.sum()))]), tol=1e-12)
    edge = golden(lambda r: deviance(np.array([0.0, r])), 1e-9, 50 / x[0], 1e-10)
    if deviance(np.array([0.0, edge])) <= deviance(best):
        best = np.array([0.0, edge])
    a, r = best
    return r / (1 - a), a * r / (1 - a), float(deviance(best))


def log_yule(x: np.ndarray, rate: float, t: float) -> np.ndarray:
    """Log-probability of x species after time t of pure birth."""
    return -rate * t + (x - 1) * np.log(-np.expm1(-rate * t))


def log_birth_death(x: np.ndarray, birth: float, death: float, t: float, conditional: bool = False) -> np.ndarray:
    """Log-probability of x species after time t; ``conditional`` on survival. x = 0 is extinction."""
    x = np.asarray(x, float)
    if abs(birth - death) < 1e-12:
        alpha = beta = birth * t / (1 + birth * t)
    else:
        e = math.exp((birth - death) * t)
        alpha = death * (e - 1) / (birth * e - death)
        beta = birth * (e - 1) / (birth * e - death)
    alive = np.log1p(-beta) + (x - 1) * (np.log(beta) if beta > 0 else 0.0)
    if conditional:
        return np.where(x > 0, alive, -np.inf)
    return np.where(x > 0, np.log1p(-alpha) + alive, math.log(alpha) if alpha > 0 else -np.inf)


def yule_time(times: np.ndarray, birth: Callable[[np.ndarray, np.ndarray], np.ndarray], start: np.ndarray, grid: int = 200) -> tuple[np.ndarray, float]:
    """Fit of a pure-birth model whose rate is a function of time: parameters and log-likelihood."""
    x = np.sort(times)[::-1]
    top = x[0]
    t = np.linspace(0, top, grid + 1)

    def loss(p: np.ndarray) -> float:
        rate = birth(t, p)
        if np.any(rate <= 0):
            return 1e100
        total = np.concatenate([[0], np.cumsum((rate[1:] + rate[:-1]) / 2 * np.diff(t))])
        at = top - x
        lineages = np.arange(2, len(x) + 2)
        ends = np.append(at[1:], top)
        used = np.interp(ends, t, total) - np.interp(at, t, total)
        ll = -(lineages * used).sum() + np.log(lineages[:-1] * np.interp(at[1:], t, rate)).sum()
        return -ll

    best = nelder_mead(loss, np.atleast_1d(np.asarray(start, float)))
    return best, -loss(best)


def richness_yule(n1: np.ndarray, n2: np.ndarray, t: np.ndarray) -> float:
    """Chi-square (1 df) of two rates for the clades of two sets against one, given ages; rates lie between 0 and 1."""
    nll = lambda n, t, r: -float((-r * t + (n - 1) * np.log(-np.expm1(-r * t))).sum())
    fit = lambda n, t: nll(n, t, golden(lambda r: nll(n, t, r), 1e-9, 1.0, 1e-10))
    return 2 * (fit(np.concatenate([n1, n2]), np.concatenate([t, t])) - fit(n1, t) - fit(n2, t))


def survival_models(times: np.ndarray) -> tuple[float, tuple[float, float], float]:
    """Model A (constant rate) and model B (rate falling or rising as a power of age): rate, (alpha, beta) and their likelihood-ratio chi-square."""
    x = np.asarray(times, float)
    n = len(x)
    delta = n / x.sum()

    def slope(b: float) -> float:
        return -float(n * math.log(b) + n * math.log(n / (x**b).sum()) + (b - 1) * np.log(x).sum() - n)

    beta = golden(slope, 1e-3, 20.0, 1e-10)
    alpha = (n / (x**beta).sum()) ** (1 / beta)
    return delta, (alpha, beta), 2 * (-slope(beta) - (n * math.log(delta) - n))


def birth_death_table(nodes: DataFrame) -> DataFrame:
    """(tree_id, birth, death, deviance) of each ultrametric tree."""

    def f(tree: Phylo) -> pd.DataFrame:
        d = tree.depths()
        b, m, dev = birth_death_fit(d.max() - d[tree.internal()])
        return pd.DataFrame({"birth": [b], "death": [m], "deviance": [dev]})

    return per_tree(nodes, f, "birth double, death double, deviance double")
