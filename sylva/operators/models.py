"""Larger fitted models: one tree and its data a call, from published formulas, with the package's own optimisers."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from sylva.functions.phylo import Phylo
from sylva.operators.comparative import golden, nelder_mead
from sylva.operators.dating import log_birth_death
from sylva.operators.spatial import chi_square_tail


# -- diversification over time ----------------------------------------------------------------------------
def speciation_cdf(birth: Callable, death: Callable, t_max: float, x: np.ndarray, grid: int = 400) -> np.ndarray:
    """Distribution of the speciation times of a tree of age t_max under rates that are functions of time.

    Density 2 b(t) exp(-rho(0, t)) / (1 + I(t))^2 with rho the integral of death - birth and I that of exp(rho) times death, normalised over
    [0, t_max].
    """
    t = np.linspace(0, t_max, grid + 1)
    b, d = np.broadcast_to(birth(t), t.shape), np.broadcast_to(death(t), t.shape)
    h = t_max / grid
    rho = np.concatenate([[0], np.cumsum((d - b)[1:] + (d - b)[:-1]) * h / 2])
    tail = np.zeros(grid + 1)  # integral from t to t_max of exp(rho(t, s)) d(s)
    for i in range(grid + 1):
        y = np.exp(rho[i:] - rho[i]) * d[i:]
        tail[i] = ((y[1:] + y[:-1]) * h / 2).sum()
    density = 2 * b * np.exp(-rho) / (1 + tail) ** 2
    cum = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) * h / 2)])
    return np.interp(x, t, cum / cum[-1])


def birth_death_in_time(times: np.ndarray, birth: Callable, death: Callable, start: np.ndarray, grid: int = 200) -> tuple[np.ndarray, float]:
    """Least-squares fit of rates b(t, p) and d(t, p) to the empirical distribution of branching times: parameters and sum of squares."""
    top = times.max()
    x = np.sort(top - times)
    want = np.arange(1, len(x) + 1) / len(x)

    def loss(p: np.ndarray) -> float:
        b, d = (lambda t: birth(t, p)), (lambda t: death(t, p))
        probe = np.linspace(0, top, 50)
        if np.any(b(probe) < 0) or np.any(d(probe) < 0):
            return 1e100
        return float(((speciation_cdf(b, d, top, x, grid) - want) ** 2).sum())

    best = nelder_mead(loss, np.asarray(start, float), steps=600)
    return best, loss(best)


def expected_lineages(birth: float, death: float, t_max: float, t: np.ndarray, n: int, level: float = 0.95) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected lineages through time of a birth-death process that ends with n species, with a prediction interval from the
    binomial number of branching times before t."""
    share = speciation_cdf(lambda s: np.full_like(s, birth), lambda s: np.full_like(s, death), t_max, t)
    mean = 2 + (n - 2) * share
    lo, hi = [], []
    for p in share:
        k = np.arange(n - 1)
        logs = [math.lgamma(n - 1) - math.lgamma(i + 1) - math.lgamma(n - 1 - i) + i * math.log(max(p, 1e-300)) + (n - 2 - i) * math.log(max(1 - p, 1e-300)) for i in k]
        cum = np.cumsum(np.exp(logs))
        lo.append(2 + int(np.searchsorted(cum, (1 - level) / 2)))
        hi.append(2 + int(np.searchsorted(cum, 1 - (1 - level) / 2)))
    return mean, np.array(lo), np.array(hi)


def richness_birth_death(tree: Phylo, richness: dict[str, int]) -> tuple[float, float, float]:
    """Birth and death rates from a tree whose tips stand for clades of known size, and the deviance."""
    depth = tree.depths()
    age = depth.max() - depth
    x = np.sort([age[v] for v in tree.internal()])[::-1]
    stem = np.array([tree.lengths()[v] for v in tree.tips()])
    size = np.array([richness[tree.label[v]] for v in tree.tips()], float)
    n = len(stem)

    def deviance(p: np.ndarray) -> float:
        a, r = p
        if r <= 0 or not 0 <= a < 1:
            return 1e100
        backbone = math.lgamma(n) + (n - 2) * math.log(r) + r * x[1:].sum() + n * math.log(1 - a) - 2 * np.log(np.exp(r * x) - a).sum()
        b = r / (1 - a)
        clades = sum(float(log_birth_death(np.array([s]), b, a * b, t, True)[0]) for s, t in zip(size, stem))
        return -2 * (backbone + clades)

    best = nelder_mead(deviance, np.array([0.1, 0.2]))
    flat = golden(lambda r: deviance(np.array([0.0, r])), 1e-9, 50 / x[0], 1e-10)
    if deviance(np.array([0.0, flat])) <= deviance(best):
        best = np.array([0.0, flat])
    a, r = best
    return r / (1 - a), a * r / (1 - a), deviance(best)


def yule_covariates(tree: Phylo, x: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Speciation rates 1 / (1 + exp(-(b0 + b x))) of the edges from covariates of the nodes (rows as the nodes): coefficients, deviance,
    the deviance without covariates, and the p-value of their ratio."""
    edge = tree.lengths()
    design = np.column_stack([np.ones(len(tree)), x])
    edges = [v for v in range(len(tree)) if v != tree.root]
    inner = [v for v in tree.internal() if v != tree.root]

    def deviance(b: np.ndarray) -> float:
        eta = design @ b
        mean = np.array([(eta[v] + eta[tree.parent[v]]) / 2 for v in edges])
        rate = 1 / (1 + np.exp(-np.clip(mean, -30, 30)))
        at = 1 / (1 + np.exp(-np.clip(eta[inner], -30, 30)))
        return -2 * float(np.log(at).sum() - (rate * edge[edges]).sum())

    best = nelder_mead(deviance, np.concatenate([[-1.0], np.zeros(design.shape[1] - 1)]))
    rate = min(0.999999, len(inner) / edge[edges].sum())
    null = -2 * (len(inner) * math.log(rate) - rate * edge[edges].sum())
    dev = deviance(best)
    return best, dev, null, chi_square_tail(max(0.0, null - dev), design.shape[1] - 1)


# -- traits -------------------------------------------------------------------------------------------------
def correlated_traits(tree: Phylo, traits: np.ndarray, errors: np.ndarray | None = None, reml: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """Correlations of traits that evolve with selection strengths of their own (an Ornstein-Uhlenbeck process for each), with measurement errors.

    Rows of ``traits`` follow ``tree.tips()``. Returns the correlation matrix, the strengths d (1 is Brownian motion) and the log-likelihood.
    """
    v = tree.shared_length()
    v = v / v.max()
    n, p = traits.shape
    x = (traits - traits.mean(axis=0)) / traits.std(axis=0, ddof=1)
    m = np.zeros_like(x) if errors is None else errors / traits.std(axis=0, ddof=1)
    y = x.T.ravel()
    design = np.kron(np.eye(p), np.ones((n, 1)))
    tips = 1 - v

    def covariance(par: np.ndarray) -> np.ndarray:
        low = np.zeros((p, p))
        low[np.tril_indices(p)] = par[: p * (p + 1) // 2]
        r = low @ low.T
        d = np.exp(np.clip(par[p * (p + 1) // 2 :], -3, 2))
        out = np.zeros((n * p, n * p))
        for i in range(p):
            for j in range(p):
                a = d[i] * d[j]
                base = v if abs(a - 1) < 1e-9 else (d[i] ** tips) * (d[j] ** tips.T) * (1 - a**v) / (1 - a)
                out[i * n : (i + 1) * n, j * n : (j + 1) * n] = r[i, j] * base
        return out + np.diag((m.T.ravel()) ** 2)

    def nll(par: np.ndarray) -> float:
        c = covariance(par)
        sign, det = np.linalg.slogdet(c)
        if sign <= 0 or not np.isfinite(det):
            return 1e100
        inv = np.linalg.inv(c)
        a = design.T @ inv @ design
        r = y - design @ np.linalg.solve(a, design.T @ inv @ y)
        out = 0.5 * (det + r @ inv @ r + (n * p - (p if reml else 0)) * math.log(2 * math.pi))
        return out + (0.5 * np.linalg.slogdet(a)[1] if reml else 0.0)

    start = np.concatenate([np.linalg.cholesky(np.cov(x.T).reshape(p, p) + 1e-6 * np.eye(p))[np.tril_indices(p)], np.zeros(p)])
    best = nelder_mead(nll, start, step=0.2, steps=3000)
    low = np.zeros((p, p))
    low[np.tril_indices(p)] = best[: p * (p + 1) // 2]
    r = low @ low.T
    s = np.sqrt(np.diag(r))
    return r / s[:, None] / s[None, :], np.exp(np.clip(best[p * (p + 1) // 2 :], -3, 2)), -nll(best)


def binary_mixed_model(y: np.ndarray, x: np.ndarray, v: np.ndarray, steps: int = 200, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic mixed model with phylogenetic covariance s2 V, by penalised quasi-likelihood and REML: coefficients, their standard errors and s2."""
    n = len(y)
    v = v / np.exp(np.linalg.slogdet(v)[1] / n)
    beta, b, s2 = np.zeros(x.shape[1]), np.zeros(n), 0.1
    beta[0] = math.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) if np.allclose(x[:, 0], 1) else 0.0
    for _ in range(steps):
        old = np.append(beta, s2)
        for _ in range(20):
            mu = 1 / (1 + np.exp(-np.clip(x @ beta + b, -20, 20)))
            w = mu * (1 - mu)
            z = x @ beta + b + (y - mu) / w
            inv = np.linalg.inv(np.diag(1 / w) + s2 * v)
            new = np.linalg.solve(x.T @ inv @ x, x.T @ inv @ z)
            b = s2 * v @ inv @ (z - x @ new)
            done = np.abs(new - beta).max() < tol
            beta = new
            if done:
                break
        mu = 1 / (1 + np.exp(-np.clip(x @ beta + b, -20, 20)))
        w = mu * (1 - mu)
        z = x @ beta + b + (y - mu) / w

        def reml(log_s: float, w=w, z=z) -> float:
            c = np.diag(1 / w) + math.exp(log_s) * v
            inv = np.linalg.inv(c)
            a = x.T @ inv @ x
            r = z - x @ np.linalg.solve(a, x.T @ inv @ z)
            return 0.5 * (np.linalg.slogdet(c)[1] + r @ inv @ r + np.linalg.slogdet(a)[1])

        s2 = math.exp(golden(reml, -12.0, 5.0, 1e-6))
        if np.abs(np.append(beta, s2) - old).max() < tol:
            break
    inv = np.linalg.inv(np.diag(1 / w) + s2 * v)
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ inv @ x))), s2


def simulate_binary(x: np.ndarray, beta: np.ndarray, v: np.ndarray, s2: float, rng: np.random.Generator) -> np.ndarray:
    """Draws of the binary mixed model."""
    v = v / np.exp(np.linalg.slogdet(v)[1] / len(v))
    b = np.linalg.cholesky(s2 * v + 1e-12 * np.eye(len(v))) @ rng.normal(size=len(v))
    return (rng.random(len(v)) < 1 / (1 + np.exp(-(x @ beta + b)))).astype(int)


def multivariate_trait(tree: Phylo, step: Callable[[np.ndarray, float, np.random.Generator], np.ndarray], root: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Values of all nodes, each drawn from its parent's values and the edge length by a function of the caller."""
    out, edge = np.zeros((len(tree), len(root))), tree.lengths()
    out[tree.root] = root
    for v in tree.preorder():
        if v != tree.root:
            out[v] = step(out[tree.parent[v]], edge[v], rng)
    return out


# -- concordance ----------------------------------------------------------------------------------------------
def concordance_tests(ranks: np.ndarray, n: int, n_perm: int = 99, seed: int = 1) -> list[tuple[float, float, float, float]]:
    """A posteriori tests of distance matrices (rows of ranks, pairs i < j in row order, n objects): for each matrix its mean Spearman
    correlation with the others, the W without permutation, the permutation p-value and Holm's."""
    rng = np.random.default_rng(seed)
    k = len(ranks)
    iu = np.triu_indices(n, 1)

    def mean_correlation(r: np.ndarray, p: int) -> float:
        c = np.corrcoef(r)
        return float((c[p].sum() - 1) / (k - 1))

    obs = [mean_correlation(ranks, p) for p in range(k)]
    hits = np.ones(k)
    for p in range(k):
        full = np.zeros((n, n))
        full[iu] = ranks[p]
        full = full + full.T
        for _ in range(n_perm):
            o = rng.permutation(n)
            moved = ranks.copy()
            moved[p] = full[np.ix_(o, o)][iu]
            hits[p] += mean_correlation(moved, p) >= obs[p] - 1e-12
    prob = hits / (n_perm + 1)
    order, holm, top = np.argsort(prob), np.zeros(k), 0.0
    for i, p in enumerate(order):
        top = max(top, min(1.0, float(prob[p]) * (k - i)))
        holm[p] = top
    return [(obs[p], (obs[p] * (k - 1) + 1) / k, float(prob[p]), float(holm[p])) for p in range(k)]


# -- population sizes -------------------------------------------------------------------------------------------
def population_chain(lineages: np.ndarray, widths: np.ndarray, steps: int, rng: np.random.Generator, mean_changes: float = 1.0, limit: int = 30, thinning: int = 1, burn_in: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Reversible-jump chain over piecewise-linear log population sizes: sampled (change times, log sizes).

    Moves: shift a change time, change a size, add or drop a change point (Poisson prior on their number, uniform prior on their times,
    normal prior on the jumps of the log size).
    """
    ends = np.cumsum(widths)
    top = ends[-1]
    starts = np.concatenate([[0], ends[:-1]])
    c = lineages * (lineages - 1) / 2
    guess = math.log(max(1e-300, float(np.mean(c * widths))))
    times, sizes = np.array([0.0, top]), np.array([guess, guess])

    def loglik(t: np.ndarray, s: np.ndarray) -> float:
        mid = (starts + ends) / 2
        inv = np.exp(-np.interp(np.stack([starts, mid, ends]), t, s))
        area = widths * (inv[0] + 4 * inv[1] + inv[2]) / 6
        return float((np.log(c) - np.interp(ends, t, s) - c * area).sum())

    def prior(t: np.ndarray, s: np.ndarray) -> float:
        k = len(t) - 2
        return k * math.log(mean_changes / top) - 0.5 * float((np.diff(s) ** 2).sum())

    now = loglik(times, sizes) + prior(times, sizes)
    out = []
    for i in range(steps):
        t, s, ratio = times.copy(), sizes.copy(), 0.0
        kind = rng.integers(0, 4)
        k = len(t) - 2
        if kind == 0:
            j = rng.integers(0, len(s))
            s[j] += rng.normal() * 0.5
        elif kind == 1 and k:
            j = rng.integers(1, k + 1)
            t[j] = rng.uniform(t[j - 1], t[j + 1])
        elif kind == 2 and k < limit:
            at = rng.uniform(0, top)
            e = rng.normal() * 0.5
            j = int(np.searchsorted(t, at))
            s = np.insert(s, j, np.interp(at, t, s) + e)
            t = np.insert(t, j, at)
            ratio = math.log(top / (k + 1)) + e * e / (2 * 0.25) + math.log(0.5 * math.sqrt(2 * math.pi))
        elif kind == 3 and k:
            j = rng.integers(1, k + 1)
            at, old = t[j], s[j]
            t, s = np.delete(t, j), np.delete(s, j)
            e = old - np.interp(at, t, s)
            ratio = -(math.log(top / k) + e * e / (2 * 0.25) + math.log(0.5 * math.sqrt(2 * math.pi)))
        new = loglik(t, s) + prior(t, s)
        if math.log(max(rng.random(), 1e-300)) < new - now + ratio:
            times, sizes, now = t, s, new
        if i >= burn_in and (i - burn_in) % thinning == 0:
            out.append((times.copy(), sizes.copy()))
    return out


def population_summary(chain: list[tuple[np.ndarray, np.ndarray]], t: np.ndarray, level: float = 0.95) -> np.ndarray:
    """Columns: time, mean, median, lower and upper bound of the sampled population sizes."""
    x = np.array([np.exp(np.interp(t, a, b)) for a, b in chain])
    lo, mid, hi = np.percentile(x, [50 * (1 - level), 50, 100 - 50 * (1 - level)], axis=0)
    return np.column_stack([t, x.mean(axis=0), mid, lo, hi])
