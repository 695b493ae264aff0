"""Filling by a chain, clipping to a reference, runs of matches, standardised places and moves along a surface, on small rows."""

import math

import numpy as np
import pytest

from seriesloom.operators import candidates, decoders, joins, series, splits


def test_fill_chain(spark):
    rows = [(1, 0, 0.0, None, "a"), (1, 1, 1.0, 2.0, "a"), (1, 2, 4.0, None, "a"), (1, 3, 5.0, 10.0, "a"), (1, 4, 9.0, None, "a"), (2, 0, 0.0, None, "a"), (3, 0, 0.0, None, "b"), (4, 0, 0.0, None, None)]
    df = spark.createDataFrame(rows, "k long, i long, x double, v double, kind string")
    more = spark.createDataFrame([("a", 3.0, 7.0), ("a", 5.0, None), ("b", None, 1.0)], "kind string, mean_of double, x double")
    got = {(r.k, r.i): r.out for r in series.fill_chain(df, "k", "i", "v", "x", "out", more, "kind", "mean_of").collect()}
    assert got == {(1, 0): 2.0, (1, 1): 2.0, (1, 2): 8.0, (1, 3): 10.0, (1, 4): 10.0, (2, 0): 4.0, (3, 0): None, (4, 0): None}
    assert series.fill_chain(df.limit(0), "k", "i", "v", "x", "out", more, "kind", "mean_of").count() == 0


def test_clip_to_reference(spark):
    df = spark.createDataFrame([(1, 5.0), (1, -5.0), (1, 1.5), (1, None), (2, 9.0), (None, 4.0)], "k long, v double")
    reference = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, None)], "k long, v double")
    got = [(r.k, r.v, r.c) for r in candidates.clip_to_reference(df, "k", "v", reference, "v", "c").collect()]
    assert sorted(got, key=str) == sorted([(1, 5.0, 2.0), (1, -5.0, 1.0), (1, 1.5, 1.5), (1, None, None), (2, 9.0, 9.0), (None, 4.0, 4.0)], key=str)


def test_run_segments(spark):
    rows = [(10, 3, "forward"), (11, 4, "forward"), (12, 5, "forward"), (13, 5, "reversed"), (14, 4, "reversed"), (16, 3, "reversed"), (17, None, "reversed"), (18, 1, "reversed"), (19, 2, "reversed")]
    df = spark.createDataFrame([(1, *r) for r in rows], "k long, at long, donor long, way string")
    got = sorted(tuple(r) for r in series.run_segments(df, "k", "at", "donor", "way", 2).collect())
    assert got == [(1, 0, 10, 12, 3, 5, "forward", 3, True), (1, 1, 13, 14, 5, 4, "reversed", 2, True), (1, 2, 16, 16, 3, 3, "reversed", 1, False), (1, 3, 18, 18, 1, 1, "reversed", 1, False), (1, 4, 19, 19, 2, 2, "reversed", 1, False)]
    wide = df.selectExpr("k", "at * 3 AS at", "donor * 3 AS donor", "way")
    assert [r.rows for r in series.run_segments(wide, "k", "at", "donor", "way", 2, 3).orderBy("segment").collect()] == [3, 2, 1, 1, 1]


def test_standardised(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    assert sorted([tuple(r)[2:] for r in joins.standardised(df, ["a", "b"]).collect()], key=str) == sorted([(-1.0, 0.0), (1.0, 0.0), (None, 0.0)], key=str)


def test_slopes_of_a_plane_and_moves_along_it(spark):
    """On an exact plane the fitted slopes are its own, and moves add up to the difference of heights."""
    rng = np.random.default_rng(5)
    places = [(i, i // 10, float(x), float(y), float(2 * x - 3 * y + 1)) for i, (x, y) in enumerate(rng.uniform(0, 1, (60, 2)))]
    e = spark.createDataFrame(places, "id long, track long, x double, y double, z double").selectExpr("*", "x AS px", "y AS py")
    near = joins.nearest_rows(e, e, ["x", "y"], "id", "track", 20, payload=("px", "py", "z"))
    slopes = joins.local_plane(near, e, "id", "px", "py", "z", 0.5, ridge=0.0)
    assert all(math.isclose(r.slope_x, 2, abs_tol=1e-6) and math.isclose(r.slope_y, -3, abs_tol=1e-6) for r in slopes.collect())
    rows = joins.surface_moves(e.join(slopes, "id"), "track", "id", "x", "y", "slope_x", "slope_y").collect()
    for track in range(6):
        mine = sorted((r for r in rows if r.track == track), key=lambda r: r.id)
        assert mine[0].move == 0 and sum(r.move for r in mine) == pytest.approx(mine[-1].z - mine[0].z, abs=1e-5)
    none = spark.createDataFrame([(1, 1, 0.0, 0.0, None, 1.0), (1, 2, 1.0, None, 1.0, 1.0), (1, 3, 1.0, 1.0, 1.0, 1.0)], "t long, i long, x double, y double, gx double, gy double")
    assert [r.move for r in joins.surface_moves(none, "t", "i", "x", "y", "gx", "gy").collect()] == [0.0, 0.0, 0.0]


def test_a_lattice_follows_the_surface():
    """Without observations or rates, a position moves by what the surface rises."""
    moves = np.array([0.0, 2.0, -1.0, 3.0])
    grid = np.arange(-20.0, 20.5, 0.5)
    got = decoders.hmm(np.ones(4), np.zeros((4, len(grid))), grid, np.array([0.0]), 0.0, 0.0, shift=moves, start_sd=0.3, noise=0.01)
    assert got["mean"] == pytest.approx(np.cumsum(moves), abs=0.02)


def test_shuffled_labels_keep_their_numbers(spark):
    rows = [(i, None if i % 5 == 4 else "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, label string")
    got = {r.k: (r.label, r.out) for r in splits.shuffled_labels(df, "k", "label", "out").collect()}
    assert {k: v[0] for k, v in got.items()} == dict(rows)
    assert sorted(str(v[1]) for v in got.values()) == sorted(str(x) for _, x in rows) and any(a != b for a, b in got.values())
    assert got != {r.k: (r.label, r.out) for r in splits.shuffled_labels(df, "k", "label", "out", "other").collect()}
    assert splits.shuffled_labels(df.limit(0), "k", "label", "out").count() == 0
