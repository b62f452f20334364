"""Optimisers against what defines them."""

import numpy as np

from alphaloom.operators import adaptive, risk

RNG = np.random.default_rng(3)
X = RNG.normal(size=(200, 5)) @ np.array([[1, 0.5, 0, 0, 0], [0, 1, 0, 0, 0], [0, 0, 1, 0.3, 0], [0, 0, 0, 1, 0], [0, 0, 0, 0, 2.0]])
S = np.cov(X.T)


def test_weights_sum_to_one_and_beat_equal_ones():
    equal, mu = np.full(5, 0.2), np.array([0.01, 0.02, 0.03, 0.02, 0.01])
    sharpe = lambda w: mu @ w / np.sqrt(w @ S @ w)
    best = risk.max_sharpe(mu, S)
    for w in (best, risk.max_diversification(S), risk.hierarchical_parity(S), risk.mean_variance(mu, S)):
        assert abs(w.sum() - 1) < 1e-6 and w.min() >= 0
    assert sharpe(best) >= sharpe(equal)


def test_simplex_and_module_weights():
    assert np.allclose(adaptive.simplex(np.array([0.5, 0.5, -3.0])), [0.5, 0.5, 0])
    w = adaptive.module_weights({"expectation": 0.1}, {"flow_confirm": 0.1})
    assert abs(sum(w.values()) - 1) < 1e-9 and max(w.values()) < 0.5
