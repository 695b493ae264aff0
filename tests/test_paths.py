import itertools

import numpy as np
import pytest

from seriesloom.operators import overlaps, paths
from seriesloom.plans import path_queries
from seriesloom.plans import registry


def all_paths(seen, values, start, moves, move_cost, scale):
    """(cost, cells) of every path, cheapest first."""
    out = []
    for way in itertools.product(moves, repeat=len(seen)):
        out.append(way)
    ways = np.array(out)
    cells = start + np.cumsum(ways, axis=1)
    good = (cells.min(axis=1) >= 0) & (cells.max(axis=1) < len(values))
    ways, cells = ways[good], cells[good]
    miss = np.where(np.isfinite(seen), (seen - values[cells]) ** 2 / scale, 0.0)
    cost = np.abs(ways).sum(axis=1) * move_cost + miss.sum(axis=1)
    return [(cost[i], tuple(cells[i])) for i in np.argsort(cost, kind="stable")[:100]]


@pytest.mark.parametrize("seed", range(3))
def test_top_paths_are_the_cheapest_of_all(seed):
    rng = np.random.default_rng(seed)
    values = np.cumsum(rng.normal(0, 30, 12))
    seen = rng.normal(0, 40, 8)
    seen[3] = np.nan
    moves = np.array([0, -1, 1, -2, 2])
    cells, costs = paths.cheapest_paths(seen, values, 4, moves, k=8, width=99, move_cost=7.3)
    every = all_paths(seen, values, 4, moves, 7.3, 100.0)
    want = every[:8]
    assert np.allclose(costs, [c for c, _ in want])
    assert len({tuple(c) for c in cells}) == 8 and cells[0].tolist() == list(want[0][1])
    for c, path in zip(costs, cells, strict=True):  # each costs what it says
        assert any(np.isclose(c, x) and tuple(path) == y for x, y in every[:40])
    for t in (1.0, 8.0):
        w = np.exp(-(costs - costs.min()) / t)
        assert np.allclose(paths.path_posterior(cells.astype(float), costs, (t,))[f"blend_{t:g}"], (w[:, None] * cells).sum(axis=0) / w.sum())


def test_few_paths_and_missing_observations():
    cells, costs = paths.cheapest_paths(np.array([np.nan]), np.zeros(2), 0, np.array([0, -1, 1]), k=8)
    assert cells.tolist() == [[0], [1]] and costs.tolist() == [0.0, 15.0]
    got = paths.path_posterior(np.array([[3.0]]), np.array([2.0]), (1.0,))
    assert np.isnan(got["gap"]).all() and got["entropy_1"].tolist() == [0.0] and got["spread"].tolist() == [0.0]
    assert np.allclose(paths.running_mean(np.array([1.0, np.nan, 4.0, 10.0]), 1), [1.0, np.nan, 7.0, 7.0], equal_nan=True)


def test_narrow_beam_keeps_cheap_cells():
    rng = np.random.default_rng(4)
    values, seen = np.linspace(0, 100, 60), rng.uniform(0, 100, 40)
    wide, narrow = (paths.cheapest_paths(seen, values, 30, np.array([0, -1, 1]), 8, w)[1] for w in (99, 6))
    assert narrow[0] >= wide[0] - 1e-9 and len(narrow) == 8 and (np.diff(narrow) >= 0).all()


def test_series_side_by_side_have_the_paths_of_each_alone(monkeypatch):
    rng = np.random.default_rng(5)
    for moves in (np.array([0, -1, 1, -2, 2]), np.array([-3, 0, 2])):
        seen = [np.where(rng.random(n) < 0.3, np.nan, rng.integers(0, 9, n)) for n in (7, 1, 12, 7, 3)]
        values, starts = [rng.integers(0, 9, 20).astype(float) for _ in seen], [0, 19, 10, 4, 7]
        alone = [paths.cheapest_paths(x, v, s, moves, 4, 6) for x, v, s in zip(seen, values, starts)]
        for x, v, s, (cells, costs) in zip(seen, values, starts, alone):
            way = np.diff(np.concatenate((np.full((len(cells), 1), s), cells), axis=1), axis=1)
            paid = np.abs(way).sum(axis=1) * 15.0 + np.where(np.isfinite(x), (x - v[cells]) ** 2 / 100, 0.0).sum(axis=1)
            assert np.isin(way, moves).all() and np.allclose(paid, costs)
        for rows in (20_000, 13):
            monkeypatch.setattr(paths, "ROWS_TOGETHER", rows)
            got = paths.cheapest_paths_each(seen, values, starts, moves, 4, 6)
            assert all(np.array_equal(a, b) for x, y in zip(got, alone) for a, b in zip(x, y))


def test_query_has_every_tail_row(spark, sf):
    got = path_queries.beam_top_paths(spark, sf).toPandas()
    want = registry.QUERIES["beam_decode"](spark, sf).count()
    assert len(got) == want and got.drop(columns=[c for c in got if c.endswith("_gap")]).notna().all().all()
    for name in path_queries.VARIANTS:
        assert (got[f"{name}_gap"] >= 0).all() and got[f"{name}_entropy_16"].between(0, np.log(8) + 1e-9).all()
        assert (abs(got[f"{name}_blend_1"] - got[f"{name}_top"]) <= got[f"{name}_spread"] + 1e-9).all()


def plain_overlaps(series, k):
    """Overlaps by comparing all windows with all."""
    places = [(key, at) for key, codes in sorted(series.items()) for at in range(len(codes) - k + 1)]
    gram = {(key, at): tuple(series[key][at : at + k]) for key, at in places}
    rep = {}
    for p in places:
        rep.setdefault(gram[p], p)
    out = set()
    for key, at in places:
        rk, ra = rep[gram[key, at]]
        if (rk, ra) == (key, at):
            continue
        a, b, n = ra, at, k
        while a > 0 and b > 0 and series[rk][a - 1] == series[key][b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        while a + n < len(series[rk]) and b + n < len(series[key]) and series[rk][a + n] == series[key][b + n]:
            n += 1
        out.add((rk, a, key, b, n))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_overlaps_equal_plain_ones(spark, monkeypatch, hot):
    if hot:
        from seriesloom.functions import keyed

        monkeypatch.setattr(keyed, "HOT_ROWS", 3)
        monkeypatch.setattr(keyed, "HOT_KEYS", 50)
    rng = np.random.default_rng(6)
    series = {i: rng.choice(list("ab"), rng.integers(0, 40)).tolist() for i in range(30)}
    series |= {40: ["a"] * 30, 41: ["a"] * 12 + ["b"] + ["a"] * 12, 42: [None, "a", None, None] * 5, 43: series[3] + series[4]}
    rows = spark.createDataFrame([(k, i, c) for k, codes in series.items() for i, c in enumerate(codes)], "k long, i long, code string").repartition(4)
    got = {tuple(r) for r in overlaps.verified_overlaps(rows, "k", "i", "code", 5).collect()}
    assert got == plain_overlaps(series, 5)
    members = overlaps.window_classes(rows, "k", "i", "code", 5).collect()
    assert len({(r.key, r.place) for r in members}) == len(members)
    assert overlaps.verified_overlaps(rows.limit(0), "k", "i", "code", 5).count() == 0
