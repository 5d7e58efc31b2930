"""Fitted models on simulated data with known parameters."""

import numpy as np
import pytest

from sylva.operators import models as M
from sylva.operators.comparative import covariance
from sylva.operators.simulation import coalescent_tree, continuous_trait, species_tree


def test_speciation_times():
    x = np.linspace(0, 10, 11)
    f = M.speciation_cdf(lambda t: np.full_like(t, 0.3), lambda t: np.zeros_like(t), 10.0, x, 2000)
    assert f == pytest.approx((np.exp(0.3 * x) - 1) / (np.exp(3.0) - 1), abs=1e-4)
    mean, lo, hi = M.expected_lineages(0.3, 0.0, 10.0, x, 40)
    assert mean[0] == 2 and mean[-1] == 40 and (lo <= mean + 1).all() and (mean <= hi + 1).all()
    t = species_tree(150, 1.0, 0.0, np.random.default_rng(1))
    d = t.depths()
    p, _ = M.birth_death_in_time(d.max() - d[t.internal()], lambda s, p: np.full_like(s, p[0]), lambda s, p: np.zeros_like(s), np.array([0.5]))
    assert 0.6 < p[0] < 1.5


def test_richness_and_covariates():
    t = species_tree(40, 1.0, 0.0, np.random.default_rng(2))
    b, d, dev = M.richness_birth_death(t, {t.label[v]: 1 for v in t.tips()})
    assert 0.2 < b < 2 and d >= 0
    best, dev, null, p = M.yule_covariates(t, np.random.default_rng(1).normal(size=len(t)))
    assert dev <= null + 1e-6 and 0 <= p <= 1


def test_trait_models():
    t = coalescent_tree(30, np.random.default_rng(3))
    tips = t.tips()
    a = continuous_trait(t, np.random.default_rng(4), sigma=1.0)[tips]
    b = a + 0.3 * continuous_trait(t, np.random.default_rng(5), sigma=1.0)[tips]
    r, d, ll = M.correlated_traits(t, np.column_stack([a, b]))
    assert r[0, 1] > 0.7 and np.isfinite(ll)
    v, _ = covariance(t)
    x = np.column_stack([np.ones(30), np.random.default_rng(6).normal(size=30)])
    y = M.simulate_binary(x, np.array([0.0, 3.0]), v, 0.1, np.random.default_rng(7))
    beta, se, s2 = M.binary_mixed_model(y, x, v)
    assert beta[1] > 0.5 and s2 > 0 and (se > 0).all()
    m = M.multivariate_trait(t, lambda p, length, rng: p + length, np.zeros(2), np.random.default_rng(1))
    assert m[tips, 0] == pytest.approx(t.depths()[tips])


def test_concordance_and_population_sizes():
    rng = np.random.default_rng(1)
    base = rng.random(45)
    ranks = np.array([np.argsort(np.argsort(z)) for z in (base, base + rng.random(45) * 0.1, rng.random(45))], float)
    out = M.concordance_tests(ranks, 10)
    assert out[0][2] < out[2][2] and out[0][3] >= out[0][2]
    t = coalescent_tree(40, np.random.default_rng(2))
    d = t.depths()
    age = np.sort(d.max() - d[t.internal()])
    widths = np.diff(np.concatenate([[0], age]))
    chain = M.population_chain(np.arange(40, 1, -1.0), widths, 3000, np.random.default_rng(3), burn_in=500, thinning=5)
    s = M.population_summary(chain, np.linspace(0, age[-1] / 2, 5))
    assert s.shape == (5, 5) and 0.4 < np.median(s[:, 2]) < 2.5
