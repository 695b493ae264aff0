import itertools

import numpy as np
import pytest

from seriesloom.operators import decoders, models


def sums_of(x, y):
    n = x.shape[1]
    return {f"g{i}_{j}": float(x[:, i] @ x[:, j]) for i in range(n) for j in range(i, n)} | {f"b{i}": float(x[:, i] @ y) for i in range(n)}


def best_of_all_sets(x, y, ridge):
    """The least penalised error over every set of weights that are not zero."""
    n = x.shape[1]
    found = (float(y @ y), np.zeros(n))
    for size in range(1, n + 1):
        for free in map(list, itertools.combinations(range(n), size)):
            w = np.zeros(n)
            w[free] = np.linalg.solve(x[:, free].T @ x[:, free] + ridge * np.eye(size), x[:, free].T @ y)
            if (w >= 0).all():
                found = min(found, (float(((x @ w - y) ** 2).sum() + ridge * w @ w), w), key=lambda f: f[0])
    return found


@pytest.mark.parametrize("seed", range(30))
def test_weights_are_the_best_of_all_sets(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 6))
    common = rng.normal(size=200) * 100
    x = common[:, None] * (seed % 3 > 0) + rng.normal(size=(200, n)) * 10.0 ** rng.integers(-2, 2, n)  # two thirds of them nearly alike
    y = common * (seed % 2) + x @ rng.normal(size=n) + rng.normal(size=200)
    ridge = 1e-3
    error, _ = best_of_all_sets(x, y, ridge)
    w = np.array(models._non_negative(sums_of(x, y), n, ridge))
    assert (w >= 0).all() and ((x @ w - y) ** 2).sum() + ridge * w @ w <= error * (1 + 1e-6) + 1e-6


def test_candidates_that_are_equal_or_useless():
    x, y = np.ones((10, 2)), np.ones(10)
    assert abs(sum(models._non_negative(sums_of(x, y), 2, 1e-6)) - 1) < 1e-4
    assert models._non_negative(sums_of(x, -y), 2, 1e-3) == [0.0, 0.0]
    assert models._non_negative(dict.fromkeys(sums_of(x, y)), 2, 1e-3) == [0.5, 0.5]


def test_a_line_over_equal_values_keeps_its_slope():
    x = np.full(7, 0.1 + 0.2)
    assert decoders.huber_line(x, np.array([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])) == (1.0, pytest.approx(3.7))
