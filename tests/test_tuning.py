import itertools
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import models, tuning
from seriesloom.plans import model_queries, registry


@pytest.fixture(scope="module")
def wavy(spark):
    """Groups whose truth bends in x and jumps in a flag; a tenth of the values are missing."""
    rng = np.random.default_rng(5)
    x, flag = rng.uniform(-3, 3, 1200), rng.integers(0, 2, 1200)
    y = np.sin(2 * x) * 5 + flag * 4 + rng.normal(0, 0.3, 1200)
    rows = [(i // 30, i, float(a) if i % 10 else None, float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, flag, y, strict=True))]
    return spark.createDataFrame(rows, "grp int, row int, x double, flag double, y double").withColumn("fold", (F.col("grp") % 3).cast("int")).cache()


def test_boosting_stops_early_out_of_fold(wavy):
    got = tuning.boosted_out_of_fold(wavy, ["x", "flag"], "y", "fold", 3, "grp", trees=30)
    rows = got.rows.toPandas()
    assert sorted(rows["row"]) == list(range(1200)) and rows["prediction"].notna().all()
    linear = models.out_of_fold(wavy, "fold", 3, lambda d: models.linear(["x", "flag"], "y").fit(d)).toPandas()
    error = lambda d: np.sqrt(((d["prediction"] - d["y"]) ** 2).mean())
    assert error(rows) < 0.7 * error(linear)
    assert len(got.trees) == 3 and all(1 <= t <= 30 for t in got.trees)
    few = tuning.boosted_out_of_fold(wavy, ["x", "flag"], "y", "fold", 3, "grp", trees=30, tolerance=0.5)
    assert max(few.trees) < 30  # a stricter rule stops sooner
    unseen = wavy.where("fold = 0").drop("fold")
    mean = tuning.fold_mean(got.models, unseen).toPandas().sort_values("row")["prediction"]
    each = [m.transform(wavy.where("fold = 0")).toPandas().sort_values("row")["prediction"] for m in got.models]
    assert np.allclose(mean.to_numpy(), np.mean([e.to_numpy() for e in each], axis=0))
    names = tuning.mean_importances(got, ["x", "flag"])
    assert names[0][0] == "x" and abs(sum(v for _, v in names) - 1) < 1e-6


def test_a_fold_is_predicted_without_its_own_labels(wavy):
    changed = wavy.withColumn("y", F.when(F.col("fold") == 1, F.lit(None).cast("double")).otherwise(F.col("y")))
    one, two = (tuning.boosted_out_of_fold(d, ["x", "flag"], "y", "fold", 3, "grp", trees=5).rows.where("fold = 1").toPandas().sort_values("row") for d in (wavy, changed))
    assert np.allclose(one["prediction"], two["prediction"])


def test_positive_weights_are_the_best(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(0, 1, (3, 300))
    y = 0.7 * a + 0.4 * b - 0.5 * c + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(i % 3, *map(float, r)) for i, r in enumerate(zip(a, b, c, y, strict=True))] + [(0, None, 1.0, 1.0, 1.0)], "fold int, a double, b double, c double, y double")
    x = np.stack([a, b, c], axis=1)

    def best(x, y):
        """By trying every set of weights that are not 0."""
        found = []
        for k in range(4):
            for use in itertools.combinations(range(3), k):
                w = np.zeros(3)
                if use:
                    w[list(use)] = np.linalg.lstsq(x[:, use], y, rcond=None)[0]
                if (w >= 0).all():
                    found.append((((x @ w - y) ** 2).sum(), w))
        return min(found, key=lambda f: f[0])[1]

    assert np.allclose(list(models.positive_stack(df, ["a", "b", "c"], "y", ridge=0).values()), best(x, y), atol=1e-6)
    weights = models.stack_weights(df, "fold", ["a", "b", "c"], "y", ridge=0)
    fold = np.arange(300) % 3
    for r in weights.collect():
        assert np.allclose([r.w_a, r.w_b, r.w_c], best(x[fold != r.fold], y[fold != r.fold]), atol=1e-6)
    got = models.stacked(df, weights, "fold", ["a", "b", "c"])
    assert got.columns == [*df.columns, "stacked"] and got.count() == 301


def test_search_finds_the_grid_s_loss_in_fewer_trials():
    space = {"x": tuning.Range(0.0, 1.0), "y": tuning.Range(1e-3, 1e3, log=True), "z": tuning.Range(1, 9, whole=True)}
    calls = []

    def loss(v):
        calls.append(threading.get_ident())
        return (v["x"] - 0.3) ** 2 + 0.05 * (np.log10(v["y"]) - 1) ** 2 + 0.01 * (v["z"] - 4) ** 2

    trials = tuning.searched_by_model(space, loss, rounds=8, batch=4)
    grid = [loss({"x": x, "y": y, "z": z}) for x in np.linspace(0, 1, 6) for y in np.logspace(-3, 3, 6) for z in (1, 3, 5, 7, 9)]
    assert min(t.loss for t in trials) <= min(grid) and len(trials) == 38 < len(grid) / 4
    assert trials == tuning.searched_by_model(space, loss, rounds=8, batch=4) and len(set(calls)) > 1
    assert all(isinstance(t.values["z"], int) and 1 <= t.values["z"] <= 9 and 1e-3 <= t.values["y"] <= 1e3 for t in trials)
    bad = tuning.searched_by_model({"x": tuning.Range(0, 1)}, lambda v: float("nan") if v["x"] > 0.5 else v["x"], rounds=2, batch=2, first=3)
    assert len(bad) == 7 and min(t.loss for t in bad if t.loss == t.loss) < 0.3


def test_queries(spark, sf):
    trials = model_queries.searched_linear(spark, sf).collect()
    assert len(trials) == 18 and min(r.rmse for r in trials if r.round) <= min(r.rmse for r in trials if not r.round) + 1e-9
    boosted = model_queries.boosted_out_of_fold(spark, sf).collect()
    rows = registry.QUERIES["out_of_fold_linear"](spark, sf).collect()
    assert {(r.fold, r.rows) for r in boosted} == {(r.fold, r.rows) for r in rows} and all(1 <= r.trees <= 20 for r in boosted)
    stacked = model_queries.stacked_out_of_fold(spark, sf).collect()
    assert all(r.w_last_anchor >= 0 and r.w_recent_linear >= 0 for r in stacked)
    path = model_queries.switching_path(spark, sf).toPandas()
    assert len(path) == sum(r.rows for r in rows) and path["candidate"].isin([0, 1]).all()
