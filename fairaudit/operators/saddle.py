"""The small game behind fairness-constrained learning, on the driver.

Hypotheses are known by two things: their error and, for every constraint cell,
how far their rate in the cell is from the rate over the cell's event (``gamma``).
Both are linear in a mixture, so any mixture is measured without another pass over
the rows. Nothing here grows with the data: arrays are hypotheses x constraints.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Game:
    """min over mixtures of the error, subject to gamma <= eps, with multipliers of at most ``bound``."""
    eps: float
    bound: float
    errors: list[float] = field(default_factory=list)
    gammas: list[np.ndarray] = field(default_factory=list)      # both signs of each cell's difference

    def add(self, error: float, gamma: np.ndarray) -> int:
        self.errors.append(error)
        self.gammas.append(np.concatenate([gamma, -gamma]))
        return len(self.errors) - 1

    def mixture(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        k = len(weights)
        return float(np.dot(weights, self.errors[:k])), weights @ np.array(self.gammas[:k])

    def violation(self, weights: np.ndarray) -> float:
        return float(self.mixture(weights)[1].max(initial=0.0))

    def lagrangian(self, error, gamma, multipliers: np.ndarray):
        return error + (gamma - self.eps) @ multipliers

    def gap(self, weights: np.ndarray, multipliers: np.ndarray) -> float:
        """Primal-dual gap of a mixture and multipliers, against all multipliers
        and the hypotheses known so far."""
        error, gamma = self.mixture(weights)
        at = self.lagrangian(error, gamma, multipliers)
        high = error + self.bound * max(0.0, float((gamma - self.eps).max(initial=0.0)))
        low = float(self.lagrangian(np.array(self.errors), np.array(self.gammas), multipliers).min())
        return max(at - low, high - at)

    def best_mixture(self, steps: int = 2000) -> tuple[np.ndarray, np.ndarray]:
        """Weights and multipliers of the best mixture of the known hypotheses: the
        linear program min error . w + bound * excess, gamma . w - excess <= eps,
        solved by the simplex method (Bland's rule) on its dense matrix."""
        h, k = len(self.errors), len(self.gammas[0])
        # columns: weights, one excess, slacks; rows: constraints, then the sum of weights
        a = np.zeros((k + 1, h + 1 + k))
        a[:k, :h] = np.array(self.gammas).T
        a[:k, h] = -1.0
        a[:k, h + 1:] = np.eye(k)
        a[k, :h] = 1.0
        b = np.concatenate([np.full(k, self.eps), [1.0]])
        cost = np.concatenate([self.errors, [self.bound], np.zeros(k)])
        start = self.gammas[0] - self.eps
        basis = list(range(h + 1, h + 1 + k)) + [0]
        if start.max(initial=0.0) > 0:
            basis[int(np.argmax(start))] = h          # the excess pays for the first hypothesis
        x, price = np.zeros(a.shape[1]), np.zeros(k + 1)
        for _ in range(steps):
            square = a[:, basis]
            values = np.linalg.solve(square, b)
            price = np.linalg.solve(square.T, cost[basis])
            reduced = cost - price @ a
            reduced[basis] = 0.0
            enter = np.flatnonzero(reduced < -1e-10)
            if not len(enter):
                break
            j = int(enter[0])
            direction = np.linalg.solve(square, a[:, j])
            rows = np.flatnonzero(direction > 1e-12)
            if not len(rows):
                break
            ratio = values[rows] / direction[rows]
            tied = rows[ratio <= ratio.min() + 1e-12]
            basis[min(tied, key=lambda r: basis[r])] = j
        x[basis] = np.linalg.solve(a[:, basis], b)
        weights = np.clip(x[:h], 0.0, None)
        return weights / weights.sum(), np.clip(-price[:k], 0.0, None)
