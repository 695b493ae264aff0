"""Series, join and statistics operators against literal pairs and pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import scalars
from seriesloom.operators import aggregates, augment, branches, candidates, joins, selection, series, splits, stats


def frame(spark, columns, rows, kinds):
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(columns, kinds, strict=True)))


def line(spark, values, name="v"):
    return frame(spark, ["g", "i", name], [("a", i, v) for i, v in enumerate(values)], ["string", "long", "double"])


def column(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_robust_location_and_scale(spark):
    got = aggregates.robust_location_scale(line(spark, [1.0, 1.0, 2.0, 3.0, 100.0]), ["g"], "v").first()
    assert (got.location, round(got.scale, 4)) == (2.0, 1.4826)


def test_refractory(spark):
    df = line(spark, [1.0 if i in (1, 3, 6, 7, 13) else 0.0 for i in range(15)])
    assert sorted(r.i for r in series.refractory(df, "g", "i", F.col("v") == 1, 5).collect()) == [1, 6, 13]


def test_forward_mean(spark):
    df = line(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]).withColumn("m", series.forward_mean("g", "i", "v", 3))
    assert column(df, "m") == [2, 3, 4, 5, None, None]


def test_emission_and_fade(spark):
    df = spark.range(1)
    e = df.select(scalars.gaussian_log_emission(F.lit(10.0), F.lit(10.0), 10).alias("a"), scalars.gaussian_log_emission(F.lit(20.0), F.lit(10.0), 10).alias("b"), scalars.gaussian_log_emission(F.lit(None).cast("double"), F.lit(10.0), 10).alias("c")).first()
    assert tuple(e) == (0, -0.5, 0)
    f = df.select(*(scalars.fade(F.lit(x), 85).alias(f"f{i}") for i, x in enumerate((0.0, 85.0, 170.0))), scalars.fade(F.lit(5.0), 0).alias("z")).first()
    assert np.allclose(list(f), [0, 1 - math.exp(-1), 1 - math.exp(-2), 1])
    with pytest.raises(Exception, match="negative distance"):
        df.select(scalars.fade(F.lit(-1.0), 85)).collect()


def test_curve_without_extrapolation(spark):
    raw = frame(spark, ["k", "x", "y"], [("k", x, y) for x, y in zip((0.0, 1.0, 1.0, 2.0), (10.0, 20.0, 24.0, 30.0), strict=True)], ["string", "double", "double"])
    curve = joins.collapse_curve(raw, ["k"], "x", "y")
    q = frame(spark, ["k", "i", "q"], [("k", i, x) for i, x in enumerate((-1.0, 0.5, 2.0, 3.0))], ["string", "long", "double"])
    assert column(joins.interpolate_join(q, curve, ["k"], "q", "x", "y", "v", clamp=False), "v") == [None, 16, 30, None]
    assert column(joins.interpolate_join(q, curve, ["k"], "q", "x", "y", "v"), "v") == [10, 16, 30, 30]


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(4)
    x, y, q = np.unique(rng.integers(0, 100, 30)).astype(float), None, rng.uniform(-10, 110, 200)
    y = rng.normal(size=len(x))
    curve = spark.createDataFrame(pd.DataFrame({"k": "k", "x": x, "y": y}))
    rows = spark.createDataFrame(pd.DataFrame({"k": "k", "i": range(200), "q": q}))
    assert np.allclose(column(joins.interpolate_join(rows, curve, ["k"], "q", "x", "y", "v"), "v"), np.interp(q, x, y))


def test_asof_nearest_takes_the_earlier_on_a_tie(spark):
    right = frame(spark, ["k", "x", "p"], [("k", 0.0, 1), ("k", 5.0, 2)], ["string", "double", "int"])
    left = frame(spark, ["k", "i", "q"], [("k", 0, 2.5), ("k", 1, 2.6), ("k", 2, -1.0), ("k", 3, 0.0)], ["string", "long", "double"])
    assert column(joins.asof_join(left, right, ["k"], "q", "x", ["p"], "nearest"), "p") == [1, 2, 1, 1]
    assert column(joins.asof_join(left, right, ["k"], "q", "x", ["p"]), "p") == [1, 1, None, 1]
    assert column(joins.asof_join(left, right, ["k"], "q", "x", ["p"], "nearest", tolerance=0.5), "p") == [None, None, None, 1]


def test_weighted_median(spark):
    df = frame(spark, ["g", "v", "w"], [("a", 1.0, 1.0), ("a", 2.0, 4.0), ("a", 100.0, 1.0)], ["string", "double", "double"])
    assert aggregates.weighted_quantiles(df, ["g"], "v", "w", [0.5]).first().q50 == 2.0


def test_block_statistics(spark):
    got = aggregates.block_statistics(line(spark, [1.0, 3.0, 5.0]), ["g"], "i", "v").first()
    assert np.allclose((got.valid, got["mean"], got["std"], got.p10, got.p50, got.p90, got["min"], got["max"], got.change), (1, 3, math.sqrt(8 / 3), 1.4, 3, 4.6, 1, 5, 4))
    none = aggregates.block_statistics(line(spark, [None, float("nan")]), ["g"], "i", "v").first()
    assert none.valid == 0 and none["mean"] is None and none.change is None


def test_empirical_percentile(spark):
    ref = line(spark, [0.0, 1.0, 1.0, 3.0])
    assert column(stats.empirical_percentile(line(spark, [-1.0, 1.0, 2.0, 4.0]), ref, ["g"], "v", "p"), "p") == [0, 0.5, 0.75, 1]


@pytest.mark.parametrize(("n", "full", "want"), [(700, False, [512, 444, 188]), (1024, True, [512, 512, 512])])
def test_blocks(spark, n, full, want):
    df = spark.range(n).withColumn("n", F.lit(n))
    got = series.blocks(df, "id", 512, 256, "n" if full else None).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in got] == want


def test_local_maxima_and_tie_order(spark):
    df = line(spark, [float(x) for x in (-6, 4, -4, -3, -2, -1, 0, -1, -2, -3, 5, -5, 3)])
    assert sorted(r.i for r in candidates.local_maxima(df, "g", "i", "v").collect()) == [1, 6, 10, 12]
    assert sorted(r.i for r in candidates.local_maxima(df, "g", "i", "v", F.col("i") != 6).collect()) == [1, 10, 12]


def test_episode(spark):
    df = line(spark, [11.0] * 127 + [0.0] + [-12.0] * 128 + [0.0] * 5)
    got = series.episodes(df, "g", "i", "v", 10, 128).collect()
    assert len(got) == 1 and (got[0].rows, got[0].median_error, got[0].sign_share) == (128, -12, 1)


@pytest.mark.parametrize(("labels", "scores", "want"), [([0, 0, 1, 1], [0.0, 0.0, 1.0, 1.0], 1.0), ([0, 0, 1, 1], [1.0] * 4, 0.5), ([1, 1], [0.0, 1.0], None)])
def test_auc(spark, labels, scores, want):
    df = frame(spark, ["g", "y", "s"], [("a", y, s) for y, s in zip(labels, scores, strict=True)], ["string", "int", "double"])
    assert stats.auc(df, ["g"], "y", "s").first().auc == want


def test_oracle_scopes(spark):
    df = frame(spark, ["w", "i", "t", "a", "b"], [("w", i, t, 0.0, 10.0) for i, t in enumerate((0.0, 0.0, 10.0, 10.0))], ["string", "long", "double", "double", "double"]).withColumn("blk", F.floor(F.col("i") / 2))
    assert column(candidates.oracle(df, ["w", "i"], "t", ["a", "b"]), "oracle") == [0, 0, 10, 10] == column(candidates.oracle(df, ["w", "blk"], "t", ["a", "b"]), "oracle")
    assert column(candidates.oracle(df, ["w"], "t", ["a", "b"]), "oracle") == [0, 0, 0, 0]


def test_truth_from_errors(spark):
    rows = [(0, 90.0, 105.0, 120.0, 10.0, 5.0, 20.0), (1, -50.5, -40.0, -70.0, 0.5, 10.0, 20.0)]
    df = frame(spark, ["i", "a", "b", "c", "ea", "eb", "ec"], rows, ["long", *["double"] * 6])
    truth, residual = candidates.truth_from_errors(["a", "b", "c"], ["ea", "eb", "ec"])
    assert [tuple(r) for r in df.select(truth, residual).collect()] == [(100, 0), (-50, 0)]


def test_truth_is_the_better_mean_fit_and_the_upper_one_at_ties(spark):
    df = frame(spark, ["a", "e"], [(10.0, 1.0), (5.0, 0.0)], ["double", "double"])
    truth, _ = candidates.truth_from_errors(["a"], ["e"])
    assert [r[0] for r in df.orderBy("a").select(truth).collect()] == [5, 11]
    wrong = frame(spark, ["a", "b", "ea", "eb"], [(10.0, 20.0, 1.0, 1.0)], ["double"] * 4)
    with pytest.raises(Exception, match="agree on a truth"):
        wrong.select(candidates.truth_from_errors(["a", "b"], ["ea", "eb"])[0]).collect()
    assert wrong.select(*candidates.truth_from_errors(["a", "b"], ["ea", "eb"], None)).first()[1] == 8
    # the lower truth fits better on average, the upper one in its largest misfit
    mixed = frame(spark, [*"abcde", *(f"e{x}" for x in "abcde")], [(0.0, 0.5, 0.5, 0.5, -3.0, 1.0, 1.5, 1.5, 1.5, 4.5)], ["double"] * 10)
    assert mixed.select(*candidates.truth_from_errors([*"abcde"], [f"e{x}" for x in "abcde"], None)).first() == (-1, 2.5)


def test_nudge_refuses_bad_domains_and_values(spark):
    rows = frame(spark, ["a", "b", "sa", "sb", "ra", "rb"], [(1.0, 2.0, 0.5, 0.5, 1.0, 1.0)], ["double"] * 6)
    scores, prior = {"a": "sa", "b": "sb"}, {"a": "ra", "b": "rb"}
    for domain in ([], ["a", "a"], ["a", "x"]):
        with pytest.raises(ValueError):
            candidates.bounded_nudge(rows, scores, prior, domain=domain)
    with pytest.raises(ValueError):
        candidates.bounded_nudge(rows, scores, prior, weight=1.5)
    assert candidates.bounded_nudge(rows, scores, prior, domain=["b", "a"]).first().policy == 2
    for bad in ({"sa": F.lit(float("nan"))}, {"b": F.lit(None).cast("double")}, {"rb": F.lit(0.0)}, {"ra": F.lit(None).cast("double")}):
        with pytest.raises(Exception, match="valid number"):
            candidates.bounded_nudge(rows.withColumns(bad), scores, prior).collect()


def test_interval_mass(spark):
    df = spark.range(1).select(F.array(*(F.lit(float(x)) for x in range(4))).alias("g"), F.array(*(F.lit(x) for x in (0.2, 0.3, 0.2, 0.1))).alias("m"))
    got = df.select(candidates.interval_mass("g", "m", 1.5, 0.6), candidates.interval_mass("g", "m", 2.5, 0.6)).first()
    assert np.allclose(list(got), [0.5, 0.3])


def test_segments_and_relative_position(spark):
    df = spark.range(10).withColumn("n", F.lit(10)).withColumn("s", series.equal_segments("id", "n", 4))
    assert column(df, "s", "id") == [0, 0, 1, 1, 1, 2, 2, 3, 3, 3]
    rows = frame(spark, ["g", "i"], [("a", 0), ("a", 1), ("a", 2), ("b", 0)], ["string", "long"]).withColumn("r", series.relative_position(["g"], "i"))
    assert sorted((r.g, r.r) for r in rows.collect()) == [("a", 0), ("a", 0.5), ("a", 1), ("b", 0)]


def test_rolling_equals_pandas(spark):
    v = [3.0, None, 5.0, 1.0, 9.0, None, 2.0, 8.0]
    s = pd.Series(v, dtype=float)
    df = line(spark, v).withColumns({"m": series.trailing_mean("g", "i", "v", 3), "c": series.centred_mean("g", "i", "v", 5), "p": series.percent_rank_average("g", "v"), "md": series.rolling_median("g", "i", "v", 3)})
    same = lambda a, b: np.allclose(np.array(a, float), b, equal_nan=True)
    assert same(column(df, "m"), s.rolling(3, min_periods=1).mean()) and same(column(df, "c"), s.rolling(5, center=True, min_periods=1).mean())
    assert same(column(df, "p"), s.rank(pct=True)) and same(column(df, "md"), s.rolling(3, center=True, min_periods=1).median())
    filled = series.fill_linear(line(spark, v), "g", "i", "v", "i", "f")
    assert same(column(filled, "f"), s.interpolate(limit_direction="both"))


def test_validated_joins_fail_closed(spark):
    a, b = frame(spark, ["k"], [(1,), (2,)], ["int"]), frame(spark, ["k", "v"], [(1, 1), (1, 2)], ["int", "int"])
    with pytest.raises(ValueError, match="repeat"):
        joins.validated_join(a, b, ["k"])
    with pytest.raises(ValueError, match="without a partner"):
        joins.validated_join(a, b.where("v = 1"), ["k"], complete=True)
    with pytest.raises(ValueError, match="don't match"):
        candidates.restore_order(a, b.where("v = 1"), "k", "v")


def test_folds_and_samples(spark):
    g = spark.range(23).select(F.col("id").cast("string").alias("k"))
    sizes = splits.sha_folds(g, "k", 5, "x").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [4, 4, 5, 5, 5]
    assert splits.stable_sample(g, "k", 0.5, "x").count() == 12 and splits.stable_sample(g.limit(5), "k", 0.5, "x").count() == 2
    assert spark.range(1).select(scalars.stable_seed(F.lit("likpf::train::well-a"))).first()[0] == 1473708404


def test_transforms_invert(spark):
    df = spark.range(1).select(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    back = df.withColumns(augment.rotated("x", "y", 30)).withColumns(augment.rotated("x", "y", -30)).withColumns(augment.reflected("x", 1.0)).withColumns(augment.reflected("x", 1.0)).withColumns(augment.translated({"y": 2})).withColumns(augment.translated({"y": -2}))
    assert np.allclose(list(back.first()), [3, 4])


def test_knn_with_cells_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "g": rng.integers(0, 5, 300), "x": rng.random(300), "y": rng.random(300)}))
    key = lambda d: sorted((r.id, r.neighbour, r["rank"]) for r in d.collect())
    assert key(joins.nearest_rows(df, df, ["x", "y"], "id", "g", 3)) == key(joins.nearest_rows(df, df, ["x", "y"], "id", "g", 3, cell=0.3))


@pytest.mark.parametrize("at_once", [0, 20_000_000])
def test_nearest_rows_are_exact_among_clusters_copies_and_gaps(spark, monkeypatch, at_once):
    monkeypatch.setattr(joins, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    places = np.concatenate([rng.normal(0, 0.01, (60, 2)), rng.normal(50, 5, (60, 2)), np.full((60, 2), 7.0), [[1e6, -1e6]]])
    rows = [(i, i % 3, float(x), float(y)) for i, (x, y) in enumerate(places)] + [(900, 0, None, 1.0), (901, 1, math.nan, 1.0)]
    df = frame(spark, ["id", "g", "x", "y"], rows, ["long", "long", "double", "double"])
    want = {}
    for i, g, x, y in rows[:181]:
        far = sorted((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, h, u, v in rows[:181] if h != g and j != i)
        want[i] = [j for _, j in far[:4]]
    got = {}
    for r in joins.nearest_rows(df, df, ["x", "y"], "id", "g", 4).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == want
    few = joins.nearest_rows(df.limit(5), df.limit(5), ["x", "y"], "id", "g", 10)
    assert few.count() == sum(sum(b[1] != a[1] for b in rows[:5]) for a in rows[:5]) and joins.nearest_rows(df.limit(0), df, ["x", "y"], "id", "g", 3).count() == 0


def test_cover_then_fill_equals_a_plain_loop(spark):
    rng = np.random.default_rng(6)
    rows = [(f"c{rng.integers(4)}", int(rng.integers(9)), i, float(rng.integers(1, 30))) for i in range(120)]
    df = frame(spark, ["cause", "owner", "id", "score"], rows, ["string", "long", "long", "double"])
    for most in (2, 6, 20):
        totals = {}
        for c, _, _, s in rows:
            totals[c] = totals.get(c, 0) + s
        ranked = sorted(rows, key=lambda r: (-r[3], r[2]))
        want, taken = [], set()
        for c in sorted(totals, key=lambda c: (-totals[c], c)):
            if (best := next((r for r in ranked if r[0] == c and r[1] not in taken), None)) and len(want) < most:
                taken.add(best[1])
                want.append((best[1], best[2], "cover"))
        for r in ranked:
            if r[1] not in taken and len(want) < most:
                taken.add(r[1])
                want.append((r[1], r[2], "fill"))
        got = selection.cover_then_fill(df, "cause", "owner", "id", "score", most).orderBy("selection_order").collect()
        assert [(r.owner, r.id, r.phase) for r in got] == want


def test_branches_hold_jumps_and_keep_their_order(spark):
    df = frame(spark, ["k", "i", "p"], [("w", i, 98.0) for i in range(6)], ["string", "long", "double"])
    got = branches.reset_branches(df, "k", "i", "p", [("base", 0.0, 0), ("up", 6.3, 3)], 0, 100).orderBy("branch", "i").collect()
    assert [r.path for r in got] == [98.0] * 6 + [100.0] * 3 + [98.0] * 3
    specs = branches.branch_specs()
    assert [s[0] for s in specs[:4]] == ["base", "jump_m6p3_h128", "jump_m6p3_h256", "jump_m6p3_h512"] and len(specs) == 13 and specs[-1] == ("jump_p12p6_h512", 12.6, 512)
    df = spark.range(1, 601).select(F.lit("w").alias("k"), "id", F.col("id").cast("double").alias("md"), F.lit(0.0).alias("z"), F.lit(1000.0).alias("last"), F.lit(0.0).alias("rate"))
    ends = {r.sign: r.path for r in branches.signed_paths(df, "k", "id", "md", "z", "z", "z", "last", "rate", low=0, high=2000).where("id = 600").collect()}
    rate = place = 0.0
    for _ in range(600):
        rate = 0.998 * rate + 0.005 / 512
        place += rate
    assert ends[0] == 1000 and abs(ends[1] - 1000 - place) < 1e-9 and abs(ends[-1] - 1000 + place) < 1e-9


def test_choice_is_safe_at_ties_and_labels_are_all_best(spark):
    rows = [("w", c, i, 1.0, True) for i, c in enumerate("abc")] + [("v", c, i, float(i), i < 2) for i, c in enumerate("abc")] + [("u", "a", 0, 1.0, False)]
    df = frame(spark, ["k", "candidate", "position", "composite", "eligible"], rows, ["string", "string", "long", "double", "boolean"])
    assert {r.k: r.selected for r in branches.target_free_choice(df, ["k"], "c").collect()} == {"w": "c", "v": "b", "u": "c"}
    assert column(branches.best_labels(df.where("k = 'w'"), ["k"], "candidate", "composite"), "best", "candidate") == [True] * 3


def test_scores_that_are_no_numbers_come_last(spark):
    df = frame(spark, ["s"], [("1.5",), ("n/a",), (" 20 ",), (None,), ("NaN",), ("-3e2",)], ["string"])
    assert [r.s for r in df.orderBy(F.desc(selection.score_key("s")), F.desc("s")).collect()][:3] == [" 20 ", "1.5", "-3e2"]


def test_q_values_of_one_family_in_blocks(spark):
    rng = np.random.default_rng(8)
    ps = np.round(rng.random(200) ** 3, 3).tolist()
    df = frame(spark, ["i", "p"], list(enumerate(ps)), ["long", "double"])
    order = sorted(range(200), key=lambda i: (ps[i], i))
    want, least = {}, 1.0
    for rank in range(200, 0, -1):
        least = min(least, ps[order[rank - 1]] * 200 / rank)
        want[order[rank - 1]] = least
    for block in (7, 65_536):
        got = {r.i: r.q for r in stats._whole_benjamini_hochberg(df, "p", "i", block).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)
