"""Nothing of the input is left out: what the test tables are too small to show."""

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from seriesloom.operators import decoders, joins, selection, shapes, splits, stats
from seriesloom.plans import base, registry
from seriesloom.streaming import series


def events(spark, path, users, n):
    """A folder whose `events` hold the same n event types for each user."""
    types = ["click", "view", "error"]
    at = datetime.datetime(2024, 1, 1)
    rows = [(u * 1000 + i, at + datetime.timedelta(minutes=i), u, types[i % 3], float(10 + i % 5)) for u in range(users) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_kgram_pairs_keep_windows_that_many_groups_hold(spark, tmp_path):
    got = registry.QUERIES["kgram_pairs"](spark, events(spark, tmp_path, 60, 8)).collect()
    assert sorted((r.left_key, r.right_key, r.shared) for r in got) == [(a, b, 2) for a in range(60) for b in range(a + 1, 60)]


def test_kgram_pairs_in_blocks(spark):
    rows = spark.createDataFrame([(u, i, (i + u % 2) % 3) for u in range(23) for i in range(4)], "k long, i long, c long")
    whole, cut = (sorted(map(tuple, joins.kgram_pairs(rows, "k", "i", "c", 3, block).collect())) for block in (500, 4))
    assert whole == cut and len(whole) == 23 * 22 // 2


def test_kgram_pairs_shuffle_no_pairs(spark):
    """Holders of a window are as many as groups here, so pairs are many times the rows."""
    rows = spark.range(300).select(F.concat(F.lit("k"), "id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).withColumn("c", F.col("i") % 2)
    rows = rows.union(spark.createDataFrame([(None, i, i % 2) for i in range(4)], "k string, i int, c int"))
    for together in (None, 5000):
        got = joins.kgram_pairs(rows, "k", "i", "c", 3, together)
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().partition("FlatMapGroupsInPandas")[0]
        found = got.collect()
        assert len(found) == 300 * 299 // 2 == len({(r.left_key, r.right_key) for r in found}) and all(r.left_key < r.right_key and r.shared == 2 for r in found)
        assert "FlatMapGroupsInPandas" in got._jdf.queryExecution().optimizedPlan().toString()
    assert joins.kgram_pairs(rows.where("k = 'k1'"), "k", "i", "c", 3).count() == 0


def test_dtw_each_equals_dtw():
    rng = np.random.default_rng(0)
    for n, m, band in ((12, 12, 0.12), (30, 30, 0.12), (9, 14, 0.2), (14, 9, 1.0), (1, 1, 0.12), (40, 40, 0.05)):
        a, bs = rng.random(n), rng.random((3, m))
        assert np.array_equal(decoders.dtw_each(a, bs, band), [decoders.dtw(a, b, band) for b in bs])


def test_dtw_to_reference_counts_late_rows(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    value = lambda u, i: 1000.0 if u == 0 and i >= 90 else float(i % 7)
    rows = [(u * 1000 + i, at + datetime.timedelta(minutes=i), u, "view", value(u, i)) for u in range(4) for i in range(100)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: r.distance for r in registry.QUERIES["dtw_to_reference"](spark, str(tmp_path)).collect()}
    assert got[0] > got[1] + 100 and got[1] == got[2] == got[3]


def test_particle_filter_starts_where_the_known_part_ends(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(u * 1000 + i, at + datetime.timedelta(minutes=i), u, "view", 50.0 + (-1) ** u * 30 + i % 2) for u in range(4) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["particle_filter"](spark, str(tmp_path)).where("row_idx = 18").collect()
    assert len(got) == 4 and all(abs(r["mean"] - (-1) ** r.user_id * 30) < 3 for r in got)


def test_trend_needs_no_matrix(monkeypatch):
    rng = np.random.default_rng(1)
    for n in (3, 4, 5, 30):
        d, b = np.diff(np.eye(n), 2, axis=0), rng.random(n)
        assert np.allclose(shapes._trend_solver(n, 0.7)(b), np.linalg.solve(np.eye(n) + 0.7 * d.T @ d, b))
    monkeypatch.setattr(np, "eye", None)
    assert np.abs(shapes.l1_trend(np.arange(30_000.0), 50.0, 3) - np.arange(30_000.0)).max() < 1e-6


def test_path_medoids_stand_for_every_user(spark, tmp_path):
    folder = events(spark, tmp_path, 6, 10)  # tails of 4 rows
    got = registry.QUERIES["path_medoids"](spark, folder).collect()
    assert sorted(r.user_id for r in got) == [u for u in range(6) for _ in range(2)] and len({r.seed_key for r in got}) == 12


def test_no_paths_of_all_seeds_leave_the_filter(spark, sf):
    for name in ("path_medoids", "particle_filter", "particle_filter_robust"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInPandas" in plan and "array<double>" not in registry.QUERIES[name](spark, sf).schema.simpleString()
        assert "Aggregate" not in plan.partition("MapInPandas")[0] and "paths#" not in plan


def test_self_matches_in_blocks(spark, sf):
    rows = base.base(spark, sf)
    whole, cut = (sorted(map(tuple, shapes.self_matches(rows, "user_id", "row_idx", "value", "known", 8, block).collect())) for block in (4096, 16))
    assert whole == cut and whole


def test_group_kfold_is_greedy_without_collecting_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sizes = [int(x) for x in rng.integers(1, 9, 400)] + [70, 33]
    loads = [0] * 5
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, n long")
    seen, every = [], DataFrame.toLocalIterator
    monkeypatch.setattr(type(df), "toLocalIterator", lambda d, *a: (seen.append(r) or r for r in every(d, *a)))
    got = splits.group_kfold(df, "k", "n", 5)
    assert len(seen) == len(set(sizes))
    fold = {r.k: r.fold for r in got.collect()}
    assert len(fold) == 402 == got.count() and [sum(s for i, s in enumerate(sizes) if fold[i] == f) for f in range(5)] == loads
    taken = [0, 5, 12]
    for n in (1, 2, 7, 40):
        one, want = list(taken), [0, 0, 0]
        for _ in range(n):
            at = one.index(min(one))
            one[at] += 3
            want[at] += 1
        assert splits._dealt(taken, 3, n) == want


def test_curve_joins_deal_a_hot_key_to_many_sorts(spark, monkeypatch):
    rows = spark.createDataFrame([("a" if i % 5 else None if i % 2 else "b", i, float(i % 37) / 3) for i in range(400)], "k string, i long, x double")
    curve = spark.createDataFrame([(k, float(x), float(x * x)) for k in ("a", "b", "c", None) for x in range(1, 11)], "k string, cx double, cy double")
    ways = {
        "clamped": lambda: joins.interpolate_join(rows, curve, ["k"], "x", "cx", "cy", "y"),
        "inside": lambda: joins.interpolate_join(rows, curve, ["k"], "x", "cx", "cy", "y", clamp=False),
        "nearest": lambda: joins.asof_join(rows, curve, ["k"], "x", "cx", ["cy"], "nearest"),
    }
    want = {n: sorted(f().collect(), key=lambda r: r.i) for n, f in ways.items()}
    monkeypatch.setattr(joins, "HOT_ROWS", 20)
    for n, f in ways.items():
        assert sorted(f().collect(), key=lambda r: r.i) == want[n] and len(want[n]) == 400
    sizes, every = [], joins._dealt
    monkeypatch.setattr(joins, "_dealt", lambda *a: (sizes.append(got := every(*a)), got)[1])
    ways["clamped"]().collect()
    dealt, key = sizes[0]
    assert dealt.groupBy(*key).count().agg({"count": "max"}).first()[0] < 60


def test_lift_finds_its_edges_without_all_values_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, float(v), bool(v > 50)) for i, v in enumerate(rng.integers(0, 100, 503))] + [(999, None, False)], "i long, v double, hit boolean")
    shares = [0.0, 0.2, 0.4, 0.61, 1.0]
    want = rows.agg(F.percentile("v", F.array(*(F.lit(s) for s in shares)))).first()[0]
    assert stats.exact_quantiles(rows, "v", shares) == want
    monkeypatch.setattr(selection, "ONE_TASK", 10)
    assert stats.exact_quantiles(rows, "v", shares) == want and stats.exact_quantiles(rows.where("v is null"), "v", [0.5]) == [None]
    got = stats.lift_by_bucket(rows.where("v is not null"), "v", "i", "hit", 5)
    assert "percentile" not in got._jdf.queryExecution().toString() and sum(r.rows for r in got.collect()) == 503


def test_rts_of_many_series_makes_no_frame_a_group(spark, sf, monkeypatch):
    """Series travel packed; those that share times (no inverse there) are done like the others."""
    got = registry.QUERIES["rts_smooth"](spark, sf)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString() and got.count() == spark.read.parquet(f"{sf}/events.parquet").count()
    same = decoders.rts(np.array([0.0, 0.0, 1.0, 1.0]), np.array([1.0, 3.0, np.nan, 5.0]), 0.1, 0.0)
    assert np.isfinite(same["level"]).all() and np.isfinite(same["variance"]).all()


def test_stream_states_take_a_key_s_rows_without_new_frames(monkeypatch):
    first, later = pd.DataFrame({"o": [1, 2, 2], "x": [5.0, np.nan, 7.0]}), pd.DataFrame({"o": [2, 0], "x": [8.0, 9.0]})
    orders, values = series.columns_of(iter([first, later]), "o", "x")
    assert orders == [0, 1, 2, 2, 2] and values[:2] == [9.0, 5.0] and values[3:] == [7.0, 8.0] and values[2] != values[2]
    monkeypatch.setattr(series.pd, "concat", None)
    assert series.columns_of(iter([first]), "o", "x")[0] == [1, 2, 2]
