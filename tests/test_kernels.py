"""Kernels against brute force, known values and identities."""

import math

import numpy as np
import pandas as pd
import pytest

from sylva.functions.phylo import parse_newick
from sylva.operators import comparative as K
from sylva.operators import dating as G
from sylva.operators import inference as I
from sylva.operators import spatial as P
from sylva.operators.simulation import birth_death_tree, coalescent_tree, continuous_trait, discrete_trait, random_split_tree, species_tree

PRIMATES = parse_newick("((((Homo:0.21,Pongo:0.21):0.28,Macaca:0.49):0.13,Ateles:0.62):0.38,Galago:1.00);")[1]
BODY = {"Homo": 4.09434, "Pongo": 3.61092, "Macaca": 2.37024, "Ateles": 2.02815, "Galago": -1.46968}


def additive(n, seed):
    t = random_split_tree(n, np.random.default_rng(seed), branch=lambda k: np.random.default_rng(seed).random(k) + 0.1)
    tips = t.tips()
    return t, t.patristic()[np.ix_(tips, tips)], [t.label[v] for v in tips]


def same_tree(a, b, tol=1e-6):
    x, y = a.unroot(), b.unroot()
    d = lambda t: {frozenset((t.label[i], t.label[j])): t.patristic()[i, j] for i in t.tips() for j in t.tips() if i < j}
    dx, dy = d(x), d(y)
    return set(x.splits()) == set(y.splits()) and all(abs(dx[k] - dy[k]) < tol for k in dx)


@pytest.mark.parametrize("method,tol", [("nj", 1e-9), ("bionj", 1e-3), ("mvr", 1e-9), ("fastme_bal", 1e-9), ("fastme_ols", 1e-9), ("triangle", 1e-9)])
def test_additive_distances_give_their_tree(method, tol):
    for seed in range(3):
        t, d, labels = additive(9, seed)
        assert same_tree(I.BUILDERS[method](d, labels), t, tol)


def test_incomplete_matrices():
    t, d, labels = additive(8, 4)
    d[0, 5] = d[5, 0] = np.nan
    assert set(I.nj_incomplete(d, labels).unroot().splits()) == set(t.unroot().splits())
    u = coalescent_tree(7, np.random.default_rng(2))
    tips = u.tips()
    e = u.patristic()[np.ix_(tips, tips)]
    h = e.copy()
    h[1, 4] = h[4, 1] = np.nan
    assert np.isfinite(I.ultrametric_fill(h)).all()


def test_linkages_and_spanning_tree():
    u = coalescent_tree(9, np.random.default_rng(3))
    tips = u.tips()
    d, labels = u.patristic()[np.ix_(tips, tips)], [u.label[v] for v in tips]
    for f in (I.upgma, I.single_linkage, I.complete_linkage):
        assert same_tree(f(d, labels), u)
    rng = np.random.default_rng(1)
    x = rng.random((12, 2))
    m = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = sum(m[a, b] for a, b in I.minimum_spanning_tree(m))
    edges, comp, want = sorted((m[i, j], i, j) for i in range(12) for j in range(i)), list(range(12)), 0.0
    for w, i, j in edges:  # Kruskal
        if comp[i] != comp[j]:
            want += w
            comp = [comp[i] if c == comp[j] else c for c in comp]
    assert got == pytest.approx(want)


def test_covariance_and_back():
    v, names = K.covariance(PRIMATES)
    assert same_tree(I.tree_from_covariance(v, names), PRIMATES)
    assert K.covariance(PRIMATES, corr=True)[0].diagonal() == pytest.approx(np.ones(5))
    assert K.covariance(PRIMATES, "pagel", 0.0)[0] == pytest.approx(np.diag(np.diag(v)))
    assert K.covariance(PRIMATES, "martins", 2.0)[0][0, 1] == pytest.approx(math.exp(-2 * 0.42))


def test_contrasts_of_the_primates():
    c, var, value, _ = K.contrasts(PRIMATES, BODY)
    got = sorted(abs(x) for x in c.values())
    assert got == pytest.approx(sorted([0.7459333, 1.1929263, 1.5847416, 3.3583189]), abs=1e-6)
    # the root's value is the generalised least-squares mean, and the contrasts carry the whole quadratic form
    v, names = K.covariance(PRIMATES)
    y = np.array([BODY[n] for n in names])
    beta, _, s2 = K.gls(y, np.ones((5, 1)), v)
    assert value[PRIMATES.root] == pytest.approx(beta[0])
    assert np.mean(np.square(list(c.values()))) == pytest.approx(s2)


def test_ancestral_states():
    est, rate, ci = K.ace_continuous(PRIMATES, BODY)
    pic, _, _ = K.ace_continuous(PRIMATES, BODY, "PIC")
    assert est[PRIMATES.root] == pytest.approx(pic[PRIMATES.root])
    assert all(a < est[v] < b for v, (a, b) in ci.items())
    t = coalescent_tree(60, np.random.default_rng(1))
    s = discrete_trait(t, np.random.default_rng(2), rates=1.0)
    rates, ll, names, like, q = K.ace_discrete(t, {t.label[v]: "AB"[s[v]] for v in t.tips()})
    assert rates[0] > 0 and all(abs(x.sum() - 1) < 1e-9 for x in like.values())
    hit = np.mean([like[v].argmax() == names.index("AB"[s[v]]) for v in t.internal()])
    assert hit > 0.7
    code = {t.label[v]: int(s[v]) for v in t.tips()}
    assert K.discrete_likelihood(t, code, q, 2)[0] == pytest.approx(ll)


def test_pruning_matches_enumeration():
    t = parse_newick("((a:0.3,b:0.7):0.2,c:1);")[1]
    q = K.rate_matrix(np.array([0.4, 0.9]), K.rate_index("ARD", 2))
    states = {"a": 0, "b": 1, "c": 1}
    p = {v: K.matrix_exponential(q * t.lengths()[v]) for v in range(len(t))}
    inner = [v for v in t.internal() if v != t.root][0]
    a, b, c = (next(v for v in t.tips() if t.label[v] == x) for x in "abc")
    want = sum(p[inner][r, k] * p[a][k, 0] * p[b][k, 1] * p[c][r, 1] for r in range(2) for k in range(2))
    assert K.discrete_likelihood(t, states, q, 2)[0] == pytest.approx(math.log(want))


def test_matrix_exponential():
    a = np.array([[0.0, 1.0], [0.0, 0.0]])
    assert K.matrix_exponential(a) == pytest.approx(np.array([[1, 1], [0, 1]]))
    assert K.matrix_exponential(np.diag([1.0, 2.0])) == pytest.approx(np.diag(np.exp([1, 2])))


def test_parsimony_intervals():
    t = parse_newick("((a,b),(c,d));")[1]
    got = K.most_parsimonious(t, {"a": 1, "b": 3, "c": 2, "d": 6})
    assert got[t.root] == (2, 3)


def test_regressions():
    t = coalescent_tree(40, np.random.default_rng(5))
    y = continuous_trait(t, np.random.default_rng(6), sigma=1.0)[t.tips()]
    v, _ = K.covariance(t)
    mean, va, vr = K.lynch(y, v / v.max())
    assert va > 0 and vr > 0
    rho, r2 = K.cheverud(y, v - np.diag(np.diag(v)))
    assert r2 > 0
    x = {t.label[n]: float(z) for n, z in zip(t.tips(), y)}
    alpha, s2, theta, dev = K.ou_fit(t, x)
    assert dev <= K.ou_fit(t, x, 5.0)[3] + 1e-6
    z = np.column_stack([np.ones(40), np.arange(40.0)])
    b, _, _ = K.gee(z @ np.array([1.0, 2.0]), z, np.eye(40))
    assert b == pytest.approx([1, 2])
    coef, f, p = K.lm_origin(3 * np.arange(1.0, 21), np.arange(1.0, 21)[:, None], n_perm=99)
    assert coef == pytest.approx([3]) and p == pytest.approx(0.01)


def test_principal_coordinates():
    rng = np.random.default_rng(1)
    x = rng.random((10, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    values, scores = P.principal_coordinates(d)
    again = np.sqrt(((scores[:, None] - scores[None]) ** 2).sum(-1))
    assert len(values) == 3 and again == pytest.approx(d)
    odd = d.copy()
    odd[0, 1] = odd[1, 0] = 5.0
    for kind in ("lingoes", "cailliez"):
        values, scores = P.principal_coordinates(odd, kind)
        again = np.sqrt(((scores[:, None] - scores[None]) ** 2).sum(-1))
        off = ~np.eye(10, dtype=bool)
        gap = again[off] - odd[off] if kind == "cailliez" else again[off] ** 2 - odd[off] ** 2
        assert np.ptp(gap) < 1e-6 and gap.mean() > 0


def test_parafit_sees_a_perfect_match():
    t, d, _ = additive(10, 3)
    stat, p = K.parafit(d, d, np.eye(10), n_perm=99)
    assert p < 0.05


def test_tails():
    assert P.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert P.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)


def test_dating():
    t = coalescent_tree(12, np.random.default_rng(8))
    dated, se, p = G.mean_path_lengths(t)
    assert dated.patristic() == pytest.approx(t.patristic())
    age, rate, ll = G.penalised_dates(t.grafen(), 1.0)
    assert all(age[t.parent[v]] > age[v] for v in range(len(t)) if v != t.root)
    depth = t.depths()
    dates = {t.label[v]: 0.0 for v in t.tips()}
    mu = 2.0
    s = t.copy()
    s.length = [None if x is None else x * mu for x in t.length]
    found = G.estimate_dates(s, dates, mu)
    assert found == pytest.approx(depth - depth.max(), abs=1e-4)
    shift = parse_newick("((a:1,b:2):1,(c:3,d:4):1);")[1]
    v, share, r = G.root_to_tip(shift, {"a": 0, "b": 1, "c": 2, "d": 3})
    assert r == pytest.approx(1.0)


def test_diversification():
    times = []
    for i in range(30):
        t = species_tree(60, 1.0, 0.0, np.random.default_rng(i))
        d = t.depths()
        times.append(G.birth_death_fit(d.max() - d[t.internal()])[:2])
    assert abs(np.mean([b for b, _ in times]) - 1) < 0.25
    x = np.arange(1, 400)
    assert np.exp(G.log_birth_death(x, 0.5, 0.2, 3.0)).sum() + np.exp(G.log_birth_death([0], 0.5, 0.2, 3.0))[0] == pytest.approx(1)
    assert np.exp(G.log_yule(x, 0.5, 3.0)).sum() == pytest.approx(1)
    assert G.richness_yule(np.array([10.0, 12]), np.array([10.0, 12]), np.array([5.0, 5])) == pytest.approx(0, abs=1e-6)
    rate, (a, b), chi = G.survival_models(np.random.default_rng(1).exponential(2.0, 500))
    assert abs(rate - 0.5) < 0.08 and abs(b - 1) < 0.12 and chi < 8
    assert birth_death_tree(1.0, 0.2, 3.0, np.random.default_rng(2)) is not None
    yt = coalescent_tree(15, np.random.default_rng(3))
    d = yt.depths()
    p, _ = G.yule_time(d.max() - d[yt.internal()], lambda t, p: np.full_like(t, p[0]), np.array([0.5]))
    assert p[0] == pytest.approx((yt.lengths().sum() and (len(yt.internal()) - 1) / yt.lengths().sum()), rel=0.02)


def test_matrix_of_rows():
    m, labels = I.matrix_of(pd.DataFrame({"i": [1, 1], "j": [2, 3], "d": [0.5, 1.0]}))
    assert labels == ["1", "2", "3"] and m[0, 2] == 1.0 and np.isnan(m[1, 2])
