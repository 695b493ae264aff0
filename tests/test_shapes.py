import itertools

import numpy as np
import pytest

from seriesloom.operators import joins, shapes


def test_corridor_equals_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(10):
        grid = rng.random((5, 4))
        got, path = shapes.corridor(grid, 1, 2)
        ok = [p for p in itertools.product(range(4), repeat=5) if p[0] == 1 and p[-1] == 2 and all(abs(a - b) <= 1 for a, b in itertools.pairwise(p))]
        assert np.isclose(got, min(max(grid[i, c] for i, c in enumerate(p)) for p in ok)) and tuple(path) in ok
        assert np.isclose(got, max(grid[i, c] for i, c in enumerate(path)))


def test_trends():
    x = np.arange(40.0)
    bent = np.where(x < 20, x, 40 - x)
    assert np.abs(shapes.l1_trend(bent + np.random.default_rng(1).normal(0, 0.1, 40), 1.0, 500) - bent).max() < 1.0
    wave = 3 + np.sin(2 * np.pi * x / 8)
    assert np.allclose(shapes.notch(wave, 1.0, 6, 10, 1), 3, atol=1e-9)
    y = 1 + x - 0.01 * x**2
    y[7] = 1e4
    assert np.abs(np.delete(shapes.robust_polynomial(x, y) - (1 + x - 0.01 * x**2), 7)).max() < 1e-6


def test_medoids_are_members_of_each_cluster():
    rng = np.random.default_rng(2)
    paths = np.concatenate([c + rng.normal(0, 0.1, (10, 6)) for c in (0, 5, 9)])
    assert sorted(i // 10 for i in shapes.medoids(paths, 3)) == [0, 1, 2]


def test_huber_plane_ignores_outliers(spark):
    rng = np.random.default_rng(3)
    rows = [("g", float(x), float(y), float(2 + 3 * x - y)) for x, y in rng.normal(size=(200, 2))]
    rows = [(g, x, y, v + (1000 if i % 20 == 0 else 0)) for i, (g, x, y, v) in enumerate(rows)]
    got = shapes.huber_plane(spark.createDataFrame(rows, "g string, x double, y double, v double"), ["g"], "x", "y", "v", rounds=12).first()
    assert np.allclose([got.a, got.b, got.c], [2, 3, -1], atol=0.05)


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("compared", [4, 256])
def test_nearest_rows_of_groups_apart_small_groups_and_an_outlier(spark, monkeypatch, same, compared):
    monkeypatch.setattr(joins, "COMPARED", compared)
    monkeypatch.setattr(joins, "AT_ONCE", 0 if compared == 4 else 30_000)
    rng = np.random.default_rng(8)
    rows = [(i, 100.0 * (i % 2) + float(rng.normal()), float(rng.normal()), "ab"[i % 2]) for i in range(160)]
    rows += [(200 + i, float(rng.uniform(-1, 101)), 0.0, f"s{i // 2}") for i in range(20)]  # groups of fewer than k + 1 rows
    rows += [(300, 1e7, -1e7, "far"), (301, 0.5, 0.5, "one"), (302, None, 1.0, "a"), (303, float("inf"), 1.0, "a"), (304, 0.0, 0.0, None)] + [(400 + i, 3.0, 3.0, "abc"[i % 3]) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, x double, y double, g string")
    got = {}
    for r in joins.nearest_rows(df, df, ["x", "y"], "id", "g", 6, same_group=same).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    good = [r for r in rows if r[1] is not None and np.isfinite(r[1]) and r[3] is not None]
    for i, x, y, g in good:
        near = sorted((np.sqrt((x - a) ** 2 + (y - b) ** 2), j) for j, a, b, h in good if j != i and (h == g) == same)[:6]
        assert [n for _, n in sorted(got.get(i, []))] == [j for _, j in near]
    assert set(got) <= {r[0] for r in good}


def test_trends_side_by_side_equal_single_ones():
    rng = np.random.default_rng(3)
    series = [np.cumsum(rng.normal(0, 3, n)) for n in (1, 2, 3, 4, 30, 31, 7)]
    together = shapes.l1_trends(series, 5.0, 60)
    for y, x in zip(series, together, strict=True):
        n = len(y)
        d = np.diff(np.eye(n), 2, axis=0) if n > 2 else np.zeros((0, n))
        z = u = np.zeros(max(n - 2, 0))
        want = y
        for _ in range(60 if n > 2 else 0):
            want = np.linalg.solve(np.eye(n) + d.T @ d, y + d.T @ (z - u))
            r = d @ want + u
            z = np.sign(r) * np.maximum(np.abs(r) - 5.0, 0)
            u = r - z
        assert np.allclose(x, want)
    assert shapes.l1_trends([], 1.0) == []


def test_corridors_of_groups(spark):
    """Each group's path has the least bottleneck of all paths; nulls can't be passed."""
    rng = np.random.default_rng(3)
    grids = {k: rng.integers(0, 9, (n, 4)).astype(float) for k, n in ((1, 5), (2, 6), (3, 1))}
    rows = [(k, i, [float(v) for v in row]) for k, g in grids.items() for i, row in enumerate(g)]
    rows += [(4, 0, [1.0, None, 1.0, 1.0]), (4, 1, [None, None, 1.0, 1.0])]
    got = {}
    for r in shapes.corridors(spark.createDataFrame(rows, "k long, i long, b array<double>"), "k", "i", "b", 1, 1).orderBy("k", "i").collect():
        got.setdefault(r.k, []).append((r.column, r.bottleneck))
    for k, g in grids.items():
        every = [p for p in itertools.product(range(4), repeat=len(g)) if p[0] == p[-1] == 1 and all(abs(a - b) <= 1 for a, b in zip(p, p[1:]))]
        least = min(max(g[i, c] for i, c in enumerate(p)) for p in every)
        path = tuple(c for c, _ in got[k])
        assert {b for _, b in got[k]} == {least} and path in every and max(g[i, c] for i, c in enumerate(path)) == least
    assert {b for _, b in got[4]} == {float("inf")}
