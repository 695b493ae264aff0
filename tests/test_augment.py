import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import augment, decoders
from seriesloom.plans import augment_queries, decoder_queries


def plain_savgol(y, window, degree, least):
    n = len(y)
    w = min(window, n)
    w -= w % 2 == 0
    if w < least:
        return list(y)
    out = []
    for i in range(n):
        s = max(0, min(i - w // 2, n - w))
        x = np.arange(w)
        out.append(np.polyval(np.polyfit(x, y[s : s + w], degree), i - s))
    return out


def test_savgol_equals_fitted_polynomials(spark):
    rng = np.random.default_rng(1)
    data = {k: rng.normal(0, 10, n).tolist() for k, n in enumerate((1, 3, 4, 5, 6, 9, 16, 17, 18, 40))}
    rows = spark.createDataFrame([(k, i, v) for k, y in data.items() for i, v in enumerate(y)] + [(99, i, None if i == 3 else 1.0) for i in range(40)], "k long, i long, v double").repartition(3)
    got = {(r.k, r.i): r.smooth for r in decoders.savgol_groups(rows, "k", "i", "v").collect()}
    for k, y in data.items():
        assert np.allclose([got[k, i] for i in range(len(y))], plain_savgol(np.array(y), 17, 3, 5))
    assert [i for i in range(40) if got[99, i] is None] == list(range(12)) and math.isclose(got[99, 30], 1.0)


@pytest.fixture()
def well(spark):
    """Two series over an axis, known up to 10; the second has a single row."""
    rows = [("a", float(i), float(i), 2.0 * i, math.sin(i), 10.0, 40.0) for i in range(41)] + [("b", 5.0, 1.0, 1.0, 0.5, 10.0, 10.0)]
    return spark.createDataFrame(rows, "k string, axis double, x double, y double, gr double, anchor double, last double")


def test_exact_changes_turn_back(well):
    turned = well.withColumns(augment.rotated("x", "y", 30.0)).withColumns(augment.rotated("x", "y", -30.0))
    back = turned.withColumns(augment.reflected("gr", 3.0)).withColumns(augment.reflected("gr", 3.0)).withColumns(augment.translated({"axis": 7.0})).withColumns(augment.translated({"axis": -7.0}))
    a, b = (np.array([tuple(r)[1:] for r in d.orderBy("k", "axis").collect()]) for d in (well, back))
    assert np.allclose(a, b)


def test_what_is_known_stays_and_order_is_kept(well):
    warped = augment.warped_tail(well, "k", "axis", "anchor", "last", 0.49, "moved").orderBy("k", "axis").collect()
    a = [r for r in warped if r.k == "a"]
    assert all(r.moved == r.axis for r in a if r.axis <= 10) and any(abs(r.moved - r.axis) > 0.1 for r in a)
    assert (np.diff([r.moved for r in a]) > 0).all() and [r.moved for r in warped if r.k == "b"] == [5.0]
    assert max(abs(r.moved - r.axis) for r in a) <= 0.49 * 6
    with pytest.raises(ValueError):
        augment.warped_tail(well, "k", "axis", "anchor", "last", 0.5, "moved")
    moved = {r.axis: r for r in augment.perturbed_tail(well, "k", "axis", "anchor", "last", {"x": 2.0, "y": 3.0}).where("k = 'a'").collect()}
    dx, dy = (np.array([moved[float(i)][c] - f * i for i in range(41)]) for c, f in (("x", 1), ("y", 2)))
    assert (dx[:11] == 0).all() and (dy[:11] == 0).all() and 0 < abs(dx).max() <= 2 and 0 < abs(dy).max() <= 3 and not np.allclose(dx / 2, dy / 3)
    assert np.abs(np.diff(dx, 2)).max() < 2.0  # straight but for a few bends
    stretched = augment.stretched_tail(augment.sheared_tail(well, "axis", "anchor", "y", 0.5), "axis", "anchor", 1.2).where("k = 'a'").orderBy("x").collect()
    assert [r.axis for r in stretched[:11]] == [float(i) for i in range(11)] and math.isclose(stretched[20].axis, 22.0)
    assert [r.y for r in stretched[:11]] == [2.0 * i for i in range(11)] and math.isclose(stretched[20].y, 45.0)


def test_a_signal_is_read_at_moved_places(well):
    moved = augment.warped_tail(well, "k", "axis", "anchor", "last", 0.3, "moved")
    got = augment.resampled(moved, "k", "axis", "moved", "gr", "gr_moved").where("k = 'a'").orderBy("axis").collect()
    assert np.allclose([r.gr_moved for r in got], np.interp([r.moved for r in got], range(41), np.sin(range(41))))
    assert all(r.gr_moved == r.gr for r in got if r.axis <= 10)


def test_second_modes_that_last(spark, sf):
    rows = sorted((r.user_id, r.row_idx, r.second_peak) for r in decoder_queries.hmm_decode(spark, sf).select("user_id", "row_idx", "second_peak").collect())
    runs, open_ = [], []
    for u, i, p in [*rows, (None, None, 0.0)]:
        if open_ and (u != open_[-1][0] or p < 0.2):
            runs.append(open_)
            open_ = []
        if p >= 0.2:
            open_.append((u, i, p))
    want = sorted((r[0][0], r[0][1], r[-1][1], len(r), round(max(x[2] for x in r), 5)) for r in runs if len(r) >= 3)
    got = augment_queries.mode_persistence(spark, sf).collect()
    assert sorted((r.user_id, r.first, r.last, r.rows, r.height) for r in got) == want


def test_bends_depend_on_the_key_alone(spark):
    a = spark.range(20).select("id", augment.bends("id", F.lit(0.5), "s").alias("v"))
    assert {r.id: r.v for r in a.collect()} == {r.id: r.v for r in a.repartition(5).collect()} and len({r.v for r in a.collect()}) > 10
