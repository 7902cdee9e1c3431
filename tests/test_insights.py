"""Largest differences of group means against all pairs."""

import itertools
import random

import pytest

from fairaudit.operators import explain as E


@pytest.mark.parametrize("seed", range(60))
def test_largest_differences(seed):
    rnd = random.Random(seed)
    names = [f"{rnd.choice('gGhH')}{i // 2}" for i in range(rnd.randrange(0, 14))]
    names = list(dict.fromkeys(names))
    means = [rnd.choice([0.0, 0.1, 0.25, -0.3, rnd.randrange(-4, 5) / 8]) for _ in names]
    k, least = rnd.randrange(1, 6), rnd.choice([0, 0.05, 0.25])
    at = dict(zip(names, means))
    brute = sorted((-abs(at[a] - at[b]), min(a, b), max(a, b)) for a, b in itertools.combinations(names, 2) if abs(at[a] - at[b]) >= least)
    want, texts = [], set()
    for d, a, b in brute:
        if (a.lower(), b.lower()) not in texts:
            texts.add((a.lower(), b.lower()))
            want.append((d, a, b))
    got, texts = [], set()
    found = E.largest_differences(names, means, k, least)
    for a, b, va, vb, d in sorted(found, key=lambda r: (-r[4], r[0], r[1])):
        assert (va, vb) == (at[a], at[b]) and d == abs(va - vb)
        if (a.lower(), b.lower()) not in texts:
            texts.add((a.lower(), b.lower()))
            got.append((-d, a, b))
    assert got[:k] == want[:k]


def test_many_groups_give_few_candidates():
    n = 5000
    found = E.largest_differences([f"g{i:04}" for i in range(n)], [((i * 7919) % n) / n for i in range(n)], 10, 0.0)
    assert 10 <= len(found) <= n + 10
