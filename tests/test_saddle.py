"""The game of constrained learning against brute force on small mixtures."""

import numpy as np
import pytest

from fairaudit.operators.saddle import Game


def game(seed, h, k):
    rng = np.random.default_rng(seed)
    g = Game(0.05, 20.0)
    for _ in range(h):
        g.add(float(rng.uniform(0, 0.5)), rng.uniform(-0.4, 0.4, k))
    return g


@pytest.mark.parametrize("seed", range(25))
def test_best_mixture_is_a_saddle_point(seed):
    g = game(seed, 2 + seed % 7, 1 + seed % 5)
    w, m = g.best_mixture()
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and (m >= 0).all() and m.sum() <= g.bound + 1e-6
    assert g.gap(w, m) < 1e-7            # no better mixture, no better multipliers


@pytest.mark.parametrize("seed", range(5))
def test_best_mixture_of_two_by_grid(seed):
    g = game(seed, 2, 2)
    w, _ = g.best_mixture()
    def price(x):
        e, c = g.mixture(np.array([x, 1 - x]))
        return e + g.bound * max(0.0, (c - g.eps).max())
    assert price(w[0]) <= min(price(x) for x in np.linspace(0, 1, 2001)) + 1e-9


def test_gap_is_never_negative_and_shrinks_with_the_saddle():
    g = game(3, 6, 3)
    rng = np.random.default_rng(0)
    best = g.gap(*g.best_mixture())
    for _ in range(50):
        w = rng.dirichlet(np.ones(6))
        m = rng.uniform(0, 3, 6)
        assert g.gap(w, m) >= best - 1e-9 and g.gap(w, m) >= -1e-12
