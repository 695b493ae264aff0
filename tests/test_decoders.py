import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import stable_seed
from seriesloom.operators import decoders
from seriesloom.plans import registry

CX, CY = np.arange(0.0, 21.0), np.sin(np.arange(21.0)) * 10


def test_switching_path_is_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(20):
        cost = rng.random((5, 3))
        best = min(itertools.product(range(3), repeat=5), key=lambda p: sum(cost[i, c] for i, c in enumerate(p)) + 0.3 * sum(a != b for a, b in itertools.pairwise(p)))
        assert tuple(decoders.switching_path(cost, 0.3)) == best


def test_beam_is_exact_when_wide():
    moves, step, seen = np.array([-1.0, 0.0, 1.0]), np.ones(4), np.array([3.0, np.nan, -2.0, 5.0])
    path = decoders.beam(step, seen, CX, CY, 10.0, moves, width=1000, move_cost=1.0, scale=4.0)
    cost = lambda ms: sum(abs(m) for m in ms) + sum((s - np.interp(x, CX, CY)) ** 2 / 4 for s, x in zip(seen, 10 + np.cumsum(ms), strict=True) if np.isfinite(s))
    assert np.isclose(cost(np.diff(np.append(10.0, path))), min(cost(np.array(m)) for m in itertools.product(moves, repeat=4)))


def test_dtw_equals_full_table_and_identity():
    rng = np.random.default_rng(2)
    a, b = rng.random(12), rng.random(12)
    assert decoders.dtw(a, a) == 0 and decoders.dtw(a, b, 1.0) <= np.abs(a - b).sum()
    full = np.full((13, 13), np.inf)
    full[0, 0] = 0
    for i, j in itertools.product(range(1, 13), repeat=2):
        full[i, j] = abs(a[i - 1] - b[j - 1]) + min(full[i - 1, j], full[i, j - 1], full[i - 1, j - 1])
    assert np.isclose(decoders.dtw(a, b, 1.0), full[12, 12])


def dense_move(grid, rates, noise, step, shift, pull, center):
    """Chances from (position, rate) to position, by plain loops."""
    cell, out = grid[1] - grid[0], np.zeros((len(grid), len(rates), len(grid)))
    for (i, x), (j, r) in itertools.product(enumerate(grid), enumerate(rates)):
        end = center + pull * (x - center) + r * step + shift
        near = int(np.rint((end - grid[0]) / cell))
        for k in range(near - 2, near + 3):
            if 0 <= k < len(grid):
                out[i, j, k] = np.exp(-0.5 * ((grid[0] + k * cell - end) / max(noise, cell / 2)) ** 2)
        if out[i, j].sum():
            out[i, j] /= out[i, j].sum()
    return out


@pytest.mark.parametrize("modes", [1, 2])
def test_hmm_posterior_equals_dense_products(modes):
    rng = np.random.default_rng(modes)
    grid, rates, n = np.arange(9) * 0.35 + 10, np.linspace(-0.5, 0.5, 4), 7
    step, shift, pull = rng.uniform(0.5, 1.5, n), rng.normal(0, 0.2, n), rng.uniform(0.8, 1.0, n)
    em = rng.normal(size=(modes, n, 9))
    switch = np.array([[0.9, 0.1], [0.3, 0.7]])[:modes, :modes] if modes == 2 else np.eye(1)
    got = decoders.hmm(step, em, grid, rates, 11.0, 0.1, shift, pull, 11.0, switch, 0.5, 0.3, 0.2, 0.02, 0.9)
    mix = decoders.rate_mixing(rates, 0.9, 0.2)
    assert np.allclose(mix[1] / mix[1, 1], np.exp(-0.5 * (((rates - 0.9 * rates[1]) / 0.2) ** 2 - ((rates[1] - 0.9 * rates[1]) / 0.2) ** 2)))
    a = np.zeros((modes, 9, 4))
    a[0] = np.exp(-0.5 * ((grid - 11) / 0.5) ** 2)[:, None] * np.exp(-0.5 * ((rates - 0.1) / 0.3) ** 2)
    a, states, ts = a / a.sum(), [], []
    for i in range(n):
        m = dense_move(grid, rates, 0.02, step[i], shift[i], pull[i], 11.0)
        t = np.einsum("kl,rs,psq->kprlqs", switch, mix, m) * np.exp(em[:, i])[None, None, None, :, :, None]
        ts.append(t)
        a = np.einsum("kpr,kprlqs->lqs", a, t)
        states.append(a)
    b = np.ones_like(a)
    for i in reversed(range(n)):
        post = (states[i] * b / (states[i] * b).sum())
        assert np.allclose(got["mean"][i], (post.sum(axis=(0, 2)) * grid).sum()) and np.allclose(got["first_mode"][i], post[0].sum())
        b = np.einsum("kprlqs,lqs->kpr", ts[i], b)
    assert np.allclose(got["loglik"], np.log(states[-1].sum())) and (got["sd"] >= 0).all()


def plain_posterior(step, em, grid, rates, start, rate, shift, pull, center, switch, start_sd):
    """Means, chances of the first mode and the log-likelihood by dense products."""
    modes, n, p = em.shape
    a, states, ts = np.zeros((modes, p, len(rates))), [], []
    a[0] = np.exp(-0.5 * (((grid - start) / start_sd)[:, None] ** 2 + ((rates - rate) / 0.01)[None, :] ** 2))
    a, mix = a / a.sum(), decoders.rate_mixing(rates, 0.998, 0.002)
    for i in range(n):
        m = dense_move(grid, rates, 0.02, step[i], shift[i], pull[i], center)
        ts.append(np.einsum("kl,rs,psq->kprlqs", switch, mix, m) * np.exp(em[:, i])[None, None, None, :, :, None])
        a = np.einsum("kpr,kprlqs->lqs", a, ts[-1])
        states.append(a)
    b, out = np.ones_like(a), np.empty((n, 2))
    for i in reversed(range(n)):
        post = states[i] * b / (states[i] * b).sum()
        out[i] = (post.sum(axis=(0, 2)) * grid).sum(), post[0].sum()
        b = np.einsum("kprlqs,lqs->kpr", ts[i], b)
    return out, np.log(states[-1].sum())


@pytest.mark.parametrize("kept", [64_000_000, 0])
@pytest.mark.parametrize("strength", [None, 0.9, 0.3, -0.5])
def test_series_side_by_side_equal_dense_products(monkeypatch, strength, kept):
    monkeypatch.setattr(decoders, "KEPT_BYTES", kept)
    rng = np.random.default_rng(3)
    grid, rates, sizes = np.arange(13) * 0.35 - 2, np.linspace(-0.4, 0.4, 5), (4, 9, 1, 6)
    switch = np.array([[0.9, 0.1], [0.3, 0.7]]) if strength else np.eye(1)
    step, shift = ([rng.uniform(-1.0, 2.0, n) for n in sizes] for _ in range(2))
    pull = [np.full(n, strength or 1.0) for n in sizes]
    em = [rng.normal(size=(len(switch), n, 13)) for n in sizes]
    start, rate, center = ([float(x) for x in rng.uniform(-0.02, 0.02, 4)] for _ in range(3))
    got = decoders.hmm_each(step, em, grid, rates, start, rate, shift, pull, center, switch, start_sd=1.0)
    for i, n in enumerate(sizes):
        want, total = plain_posterior(step[i], em[i], grid, rates, start[i], rate[i], shift[i], pull[i], center[i], switch, 1.0)
        assert np.allclose(np.stack((got[i]["mean"], got[i]["first_mode"]), axis=1), want) and np.allclose(got[i]["loglik"], total) and len(got[i]["sd"]) == n


def test_lattices_do_each_row_once(monkeypatch):
    """States of a short series are kept: no row is computed twice, and series of small lattices share a row's sums."""
    calls, every = [], decoders.Lattices.moves
    monkeypatch.setattr(decoders.Lattices, "moves", lambda self, step, *a: (calls.append(len(step)), every(self, step, *a))[1])
    decoders.hmm_each([np.ones(30)] * 40, [np.zeros((30, 25))] * 40, np.arange(25.0), np.linspace(-1, 1, 5), [12.0] * 40, [0.0] * 40)
    assert calls == [40] * 30


def test_a_missing_observation_changes_nothing_but_the_spread():
    grid, rates = np.arange(-20, 21) * 0.35, np.linspace(-0.1, 0.1, 41)
    got = decoders.hmm(np.ones(2), np.zeros((2, 41)), grid, rates, 0.0, 0.0)
    assert np.allclose(got["mean"], 0, atol=1e-9) and abs(got["loglik"][0]) < 1e-9 and got["sd"][1] > got["sd"][0]


@pytest.mark.parametrize("step", [0.0, 1.0, -7.0, 400.0])
def test_even_moves_equal_plain_loops(step):
    rng = np.random.default_rng(1)
    grid, rates = np.arange(11) * 0.35 - 2, np.linspace(-0.4, 0.5, 5)
    even = decoders.Lattice(grid, rates, 0.02).moves(step, 0.3)
    m = dense_move(grid, rates, 0.02, step, 0.3, 1.0, 0.0)
    a = rng.random((2, 11, 5))
    assert isinstance(even, decoders.EvenMoves)
    assert np.allclose(even.ahead(a), np.einsum("kpr,prq->kqr", a, m)) and np.allclose(even.back(a), np.einsum("kqr,prq->kpr", a, m))


def test_second_peak():
    grid = np.arange(10.0)
    mass = np.array([0, 1, 0, 0, 4, 3, 0, 0, 2, 0.0])
    assert decoders.second_peak(mass, grid, 2.0) == 0.5 and decoders.second_peak(mass, grid, 4.5) == 0 and decoders.second_peak(np.eye(10)[3], grid, 1) == 0


def test_gaussian_moments_against_a_plain_sum():
    got = decoders.gaussian_moments(0.35, 0.2, 3)
    for phase, bias, variance in got:
        w = [np.exp(-0.5 * ((k * 0.35 - phase * 0.35) / 0.2) ** 2) for k in range(-2, 3)]
        mean = sum(x * k * 0.35 for x, k in zip(w, range(-2, 3), strict=True)) / sum(w)
        assert np.isclose(bias, mean - phase * 0.35) and np.isclose(variance, sum(x * (k * 0.35) ** 2 for x, k in zip(w, range(-2, 3), strict=True)) / sum(w) - mean**2)


@pytest.mark.parametrize("options", [{}, {"outlier": 0.1, "wide": (0.3, 3.0), "lag": 5}])
def test_a_bank_of_seeds_is_each_seed_alone(options):
    rng = np.random.default_rng(0)
    step, seen = rng.uniform(0.5, 1.5, 70), np.where(rng.random(70) < 0.2, np.nan, rng.normal(0, 5, 70))
    bank, lls = decoders.particle_bank(step, seen, CX, CY, [3, 7, 11], 5.0, 0.1, 2.0, n=80, **options)
    for i, seed in enumerate((3, 7, 11)):
        path, ll = decoders.particle_bank(step, seen, CX, CY, [seed], 5.0, 0.1, 2.0, n=80, **options)
        assert np.array_equal(path[0], bank[i]) and ll[0] == lls[i]
    assert np.isfinite(bank).all() and not np.array_equal(bank[0], bank[1])


def test_later_rows_help_with_a_lag():
    truth = 5 + np.cumsum(np.where(np.arange(100) < 40, 0.02, 0.08))
    seen = np.interp(truth, CX, CY)
    seen[40:60] = np.nan
    plain, _ = decoders.particle_bank(np.ones(100), seen, CX, CY, list(range(8)), 5.0, 0.02, 1.0, noise=(0.05, 0.02))
    late, _ = decoders.particle_bank(np.ones(100), seen, CX, CY, list(range(8)), 5.0, 0.02, 1.0, noise=(0.05, 0.02), lag=30)
    error = lambda p: np.sqrt(((p.mean(axis=0) - truth)[45:60] ** 2).mean())
    assert error(late) < error(plain)


def test_blends_weigh_seeds_by_likelihood(spark):
    df = spark.createDataFrame([([1.0, 3.0], [0.0, -6.0])], "p array<double>, l array<double>")
    got = df.select(*(c.alias(n) for n, c in decoders.blends(F.col("p"), F.col("l"), (3.0, 12.0), F.lit(0.0), F.lit(1.5)).items())).first()
    w = np.exp(-2.0)
    assert got["mean"] == 1.5 and np.isclose(got["scale_3"], (1 + 3 * w) / (1 + w)) and got["scale_12"] == 1.5


def test_seeds_are_those_of_the_stable_rule(spark):
    got = spark.range(1).select(stable_seed(F.lit("pf::7::1"))).first()[0]
    assert decoders.seeds_of(7, 2, "pf")[1] == got


def test_particle_filter_is_seeded_and_follows():
    rows = pd.DataFrame({"step": np.ones(60), "observed": np.interp(5 + 0.1 * np.arange(1, 61), CX, CY)})
    a, ll = decoders.particle_filter(rows, CX, CY, 7, 5.0, 0.1, 1.0)
    b, _ = decoders.particle_filter(rows, CX, CY, 7, 5.0, 0.1, 1.0)
    assert np.array_equal(a, b) and np.isfinite(ll) and abs(a[-1] - 11) < 0.5


def test_rts_recovers_a_line():
    t = np.arange(30.0)
    seen = 2 + 0.5 * t
    seen[10:15] = np.nan
    got = decoders.rts(t, seen, 0.01, 1e-6)
    assert np.allclose(got["level"], 2 + 0.5 * t, atol=0.05) and (got["variance"] > 0).all()


def test_huber_line_shrugs_off_outliers():
    x = np.arange(50.0)
    y = 3 * x + 1
    y[::10] += 500
    a, b = decoders.huber_line(x, y, 50)
    assert abs(a - 3) < 0.05 and abs(b - 1) < 2


def test_registered_decoders_give_a_value_for_each_row(spark, sf):
    for name in ("hmm_decode", "hmm_reverting_sticky", "beam_decode", "particle_filter", "particle_filter_robust"):
        got = registry.QUERIES[name](spark, sf).toPandas()
        assert len(got) and not got.isna().any().any() and not got.duplicated(["user_id", "row_idx"]).any()


def test_series_of_a_hot_curve_are_dealt_and_give_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(s, i, float(i + s), "hot" if s < 20 else f"c{s}") for s in range(23) for i in range(5)] + [(99, 0, 1.0, None), (98, 0, 1.0, "none")], "series long, at long, value double, curve string")
    curve = spark.createDataFrame([(c, float(x), float(x * k)) for k, c in enumerate(("hot", "c20", "c21", "c22"), 1) for x in range(8)], "curve string, cx double, cy double")
    kernel = lambda part, cx, cy: {"read": np.interp(part["value"], cx, cy), "first": np.full(len(part), float(part["at"][0]))}
    run = lambda: decoders.decode(rows, curve, "series", "curve", "at", kernel, "read double, first double", "cx", "cy")
    want = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(decoders, "CURVE_POINTS", 0)
    monkeypatch.setattr(decoders, "CURVE_SERIES", 4)
    got = run()
    assert len(want) == 23 * 5 and sorted(map(tuple, got.collect())) == want
    assert "__salt" in got._jdf.queryExecution().toString()


def test_series_are_dealt_to_all_tasks(spark):
    """They lie by their key already and are few bytes: dealt by the key again they stayed together."""
    rows = spark.createDataFrame([(s, i) for s in range(200) for i in range(3)], "series long, at long").withColumn("last", F.max("at").over(Window.partitionBy("series"))).withColumn("curve", F.lit("c"))
    curve = spark.createDataFrame([("c", 0.0, 1.0), ("c", 1.0, 2.0)], "curve string, cx double, cy double")
    kernel = lambda part, cx, cy: {"task": np.full(len(part), TaskContext.get().partitionId())}
    got = decoders.decode(rows, curve, "series", "curve", "at", kernel, "task int", "cx", "cy").collect()
    assert len(got) == 600 and len({r.task for r in got}) == 8


def test_positions_follow_their_descent():
    rng, s, n = np.random.default_rng(2), 3, 5
    for lag in (1, 2, 4, 7, 30):
        kept, past = decoders.Lagged(s, n, lag), []
        for _ in range(17):
            x = rng.random((s, n)).astype(np.float32)
            kept.add(x)
            past.append(x.copy())
            if len(past) > lag:
                assert np.array_equal(kept.oldest(), past.pop(0))
            few = np.flatnonzero(rng.random(s) < 0.5)
            if len(few):
                at = np.sort(rng.integers(0, n, (len(few), n)), axis=1) + few[:, None] * n
                kept.draw(few, at)
                for old in past:
                    old[few] = old.take(at)
        assert all(map(np.array_equal, kept.rest(), past)) and len(kept.rest()) == len(past)


def test_seeds_side_by_side_are_those_alone():
    rng = np.random.default_rng(3)
    seen = np.where(rng.random(30) < 0.2, np.nan, rng.random(30) * 5)
    for options in ({}, {"lag": 3}, {"lag": 192, "outlier": 0.05, "wide": (0.25, 4.0)}):
        paths, total = decoders.particle_bank(np.ones(30), seen, CX, CY, list(range(1, 41)), 5.0, 0.1, 1.0, **options)
        for k in (0, 31, 32, 39):
            path, ll = decoders.particle_bank(np.ones(30), seen, CX, CY, [k + 1], 5.0, 0.1, 1.0, **options)
            assert np.array_equal(path[0], paths[k]) and ll[0] == total[k]


def test_blends_of_arrays_are_those_of_columns(spark):
    rng = np.random.default_rng(4)
    paths, ll = rng.random((6, 3)) * 3, rng.random(6) * 9
    df = spark.createDataFrame([(i, paths[:, i].tolist(), ll.tolist()) for i in range(3)], "i long, p array<double>, l array<double>")
    want = df.select("i", *(c.alias(n) for n, c in decoders.blends(F.col("p"), F.col("l"), (3.0, 12.0), F.lit(0.5), F.lit(1.5)).items())).orderBy("i").toPandas()
    got = decoders.blended(paths, ll, (3.0, 12.0), 0.5, 1.5)
    assert list(got) == list(want)[1:] and all(np.allclose(got[n], want[n], rtol=1e-12) for n in got)


def filtered_in_double(step, seen, seed, start, rate, sigma, outlier=0.0, wide=(0.0, 1.0), lag=0, n=500):
    """`particle_bank` of one seed with the same draws by plain sums in double precision; `lag` is 0 or longer than the series."""
    rows = len(step)
    g, u, z = np.random.default_rng(seed), np.random.default_rng([seed, 1]).random(rows), np.empty((rows, 2, n), np.float32)
    for i in range(0, rows, 4):
        g.standard_normal(dtype=np.float32, out=z[i : i + 4])
    spread = np.where(np.arange(n) < n - int(wide[0] * n), 0.01, 0.01 * wide[1])
    x, v, w, total, held, path = np.full(n, start), np.full(n, rate), np.full(n, 1 / n), 0.0, [], []
    for i in range(rows):
        v = 0.998 * v + 0.002 * rate + 0.002 * z[i, 0]
        x = x + v * step[i] + spread * z[i, 1]
        if np.isfinite(seen[i]):
            like = (1 - outlier) * np.exp(-0.5 * np.minimum(((seen[i] - np.interp(x, CX, CY)) / sigma) ** 2, 600)) + outlier * np.exp(-8.0)
            total, w = total + np.log((w * like).sum()), w * like / (w * like).sum()
        held.append(x)
        path.append(w @ x)
        if (w * w).sum() > 2 / n:
            ends = np.clip(np.floor(np.cumsum(w) * n - u[i]) + 1, 0, n).astype(int)
            ends[-1] = n
            at = np.bincount(ends, minlength=n + 1)[:n].cumsum()
            v, held, w = v[at], [h[at] for h in held], np.full(n, 1 / n)
            x = held[-1]
    return np.array([w @ h for h in held] if lag else path), total


@pytest.mark.parametrize("options", [{}, {"outlier": 0.05, "wide": (0.25, 4.0), "lag": 192}])
def test_single_precision_loses_nothing_far_from_zero(options):
    """Sums in single precision were off by some 1e-4 where a series starts far out or moves fast."""
    rng = np.random.default_rng(5)
    step, seen = rng.exponential(10.0, 40), np.where(rng.random(40) < 0.2, np.nan, rng.normal(0, 9, 40))
    for start, rate in ((288.0, 0.0), (-150.0, 3.0), (10.0, 0.01)):
        paths, total = decoders.particle_bank(step, seen, CX, CY, [3, 4], start, rate, 9.0, **options)
        for k, seed in enumerate((3, 4)):
            path, ll = filtered_in_double(step, seen, seed, start, rate, 9.0, **options)
            assert np.abs(paths[k] - path).max() < 2e-5 and np.isclose(total[k], ll, rtol=1e-5, atol=1e-4)


def test_series_of_a_fine_lattice_share_a_row_s_sums(monkeypatch):
    """Two modes of a fine lattice filled a block alone, so that every row of every series was a pass of its own."""
    rng, calls, every = np.random.default_rng(6), [], decoders.Lattices.moves
    grid, rates, switch = np.arange(-50.0, 50.175, 0.35), np.linspace(-0.1, 0.1, 41), np.array([[0.98, 0.02], [0.1, 0.9]])
    step, em = [rng.exponential(10.0, 5) for _ in range(4)], [rng.normal(size=(2, 5, len(grid))) * 3 for _ in range(4)]
    start, shift, pull = [-30.0, 0.0, 10.0, 288.0], [np.full(5, -0.01)] * 4, [np.full(5, 0.98)] * 4
    monkeypatch.setattr(decoders.Lattices, "moves", lambda self, step, *a: (calls.append(len(step)), every(self, step, *a))[1])
    got = decoders.hmm_each(step, em, grid, rates, start, [0.0, 0.05, -0.1, 0.7], shift, pull, start, switch, start_sd=10.0)
    assert calls == [4] * 5
    for i, r in enumerate((0.0, 0.05, -0.1, 0.7)):
        one = decoders.hmm(step[i], em[i], grid, rates, start[i], r, shift[i], pull[i], start[i], switch, 10.0)
        assert all(np.allclose(got[i][c], one[c], rtol=1e-10, atol=1e-10) for c in one)


def test_an_uneven_curve_of_the_same_values_gives_the_same_paths():
    rng, more = np.random.default_rng(8), np.array([0.5, 3.25, 17.75])
    step, seen, at = rng.uniform(0.5, 1.5, 30), rng.normal(0, 5, 30), np.sort(np.concatenate((CX, more)))
    even, total = decoders.particle_bank(step, seen, CX, CY, [3, 7], 5.0, 0.1, 2.0)
    uneven, other = decoders.particle_bank(step, seen, at, np.interp(at, CX, CY), [3, 7], 5.0, 0.1, 2.0)
    assert np.abs(even - uneven).max() < 1e-4 and np.allclose(total, other, rtol=1e-5)
