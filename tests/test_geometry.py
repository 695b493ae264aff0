import numpy as np

from seriesloom.operators import geometry
from seriesloom.plans import geometry_queries


def plain_spline(points, knots=16, bend=0.1, ridge=1e-6):
    """Weights by the rule, with the whole design matrix of one series."""
    rows = [(u, y) for u, y in points if u is not None and y is not None and 0 <= u <= 1 and not np.isnan(y)]
    design = np.zeros((len(rows), knots))
    for i, (u, _) in enumerate(rows):
        c = min(int(u * (knots - 1)), knots - 2)
        design[i, c], design[i, c + 1] = 1 - (u * (knots - 1) - c), u * (knots - 1) - c
    a = design.T @ design + ridge * np.eye(knots)
    for i in range(1, knots - 1):
        d = np.zeros(knots)
        d[i - 1 : i + 2] = 1, -2, 1
        a += bend * np.outer(d, d)
    return np.linalg.solve(a, design.T @ np.array([y for _, y in rows]))


def at_place(w, u):
    c = min(int(u * (len(w) - 1)), len(w) - 2)
    t = u * (len(w) - 1) - c
    return w[c] * (1 - t) + w[c + 1] * t


def series(rng, n=12):
    out = {}
    for s in range(n):
        size = int(rng.integers(1, 60))
        out[s] = [(float(u), float(v)) for u, v in zip(np.sort(rng.uniform(0, 1, size)), np.cumsum(rng.normal(0, 5, size)) + 50, strict=True)]
    return out


def test_splines_equal_plain_ones(spark):
    data = series(np.random.default_rng(1))
    data[0] += [(None, 1.0), (0.5, None), (0.5, float("nan")), (1.5, 3.0), (1.0, 60.0), (0.0, 40.0)]
    data[99] = [(None, 1.0)]
    rows = spark.createDataFrame([(k, u, v) for k, points in data.items() for u, v in points], "k long, u double, v double").repartition(4)
    got = {r.k: np.array(r.weights) for r in geometry.spline_weights(rows, "k", "u", "v").collect()}
    assert set(got) == set(data) - {99}
    for k, w in got.items():
        assert np.allclose(w, plain_spline(data[k]), atol=1e-6)


def test_blend_equals_plain_loops(spark):
    rng = np.random.default_rng(2)
    data = series(rng, 20)
    weights = {k: plain_spline(p) for k, p in data.items()}
    spots = {k: (k % 3, float(rng.uniform(0, 4)), float(rng.uniform(0, 4)), float(rng.uniform(0.3, 0.7)), float(rng.uniform(0, 100))) for k in data}
    spots[5] = (0, *spots[4][1:3], 0.5, 1.0)
    df = spark.createDataFrame([(k, *s, weights[k].tolist()) for k, s in spots.items()], "k long, fold int, x double, y double, anchor double, start double, weights array<double>")
    others = geometry.neighbour_weights(df.drop("weights"), df, "k", "fold", ["x", "y"], "anchor", "weights", k=4)
    rows = spark.createDataFrame([(k, u, spots[k][3], spots[k][4]) for k in data for u in (0.75, 0.9, 1.0)], "k long, u double, anchor double, start double")
    got = geometry.blended_path(rows, df.select("k", "weights"), others, "k", "u", "anchor", "start", 2.0).collect()
    assert len(got) == 60
    for r in got:
        fold, x, y, anchor, start = spots[r.k]
        near = sorted((np.hypot(x - s[1], y - s[2]), j) for j, s in spots.items() if s[0] != fold)[:4]
        h = near[-1][0] or 1.0
        w = [np.exp(-0.5 * (d / h) ** 2) for d, _ in near]
        mean = sum(a * (at_place(weights[j], r.u) - at_place(weights[j], anchor)) for a, (_, j) in zip(w, near, strict=True)) / sum(w)
        own = at_place(weights[r.k], r.u) - at_place(weights[r.k], anchor)
        kappa = near[-1][0] / (near[-1][0] + 2.0)
        assert np.allclose([r.spline, r.neighbours, r.kappa, r.path], [start + own, start + mean, kappa, start + kappa * own + (1 - kappa) * mean])


def test_a_series_without_donors_follows_its_own_spline(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5, 3.0, [float(i) for i in range(16)])], "k long, fold int, x double, y double, anchor double, start double, weights array<double>")
    others = geometry.neighbour_weights(df.drop("weights"), df, "k", "fold", ["x", "y"], "anchor", "weights")
    r = geometry.blended_path(df.select("k", "anchor", "start").withColumn("u", df["anchor"] * 2), df.select("k", "weights"), others, "k", "u", "anchor", "start", 1.0).first()
    assert (r.neighbours, r.kappa, r.path) == (None, 1.0, 10.5)


def test_query_covers_the_tail(spark, sf):
    tail, *_ = geometry_queries.geometry_parts(spark, sf)
    got = geometry_queries.spline_kernel_path(spark, sf).toPandas()
    assert len(got) == tail.count() and got["path"].notna().all() and got["kappa"].between(0, 1).all()
