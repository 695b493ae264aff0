"""Models tuned on data that they don't learn from: boosting that stops early, fold by fold, and search led by a model of the loss."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.scalars import stable_bucket
from seriesloom.operators.models import assembled


def at_once(tasks: list[Callable[[], object]], most: int) -> list:
    """What `tasks` return, in order; up to `most` run at a time, each with its own Spark jobs."""
    with ThreadPoolExecutor(max(1, min(most, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(t)) for t in tasks]]


class Boosted(NamedTuple):
    rows: DataFrame  # every row once, with `prediction` by the model that didn't see its fold
    models: list[PipelineModel]  # by fold
    trees: list[int]  # that each model keeps


def boosted_out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, k: int, group: str, trees: int = 40, depth: int = 3, step: float = 0.3, tolerance: float = 0.01, held: int = 5, seed: int = 7, most: int = 4) -> Boosted:
    """Gradient boosted trees for each of k folds, fitted on the other folds.

    Of the groups that a fold's model may see, one in `held` (by a hash of its key) is left for validation: no tree is
    added once its loss there improves by less than `tolerance` of itself (Spark's rule), and trees after the best are dropped.
    Rows of a group are never on both sides. Missing features are filled by the median of the rows that are fitted; rows
    without a label are predicted, but not fitted. Folds are fitted `most` at a time.
    """
    rows = df.withColumn("__held", stable_bucket(F.concat(F.lit("boost::"), F.col(group).cast("string")), held) == 0)

    def fit(i: int) -> PipelineModel:
        boost = GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, validationIndicatorCol="__held", validationTol=tolerance)
        known = rows.where((F.col(fold) != i) & F.col(label).isNotNull())
        fill = Pipeline(stages=assembled(features, None)).fit(known.where(~F.col("__held")))
        return PipelineModel([*fill.stages, boost.fit(fill.transform(known))])

    models = at_once([lambda i=i: fit(i) for i in range(k)], most)
    parts = [m.transform(df.where(F.col(fold) == i)).select(*df.columns, "prediction") for i, m in enumerate(models)]
    return Boosted(reduce(lambda a, b: a.unionByName(b), parts), models, [m.stages[-1].getNumTrees for m in models])


def fold_mean(models: list[PipelineModel], unseen: DataFrame, out: str = "prediction") -> DataFrame:
    """`unseen` groups with the mean of what all folds' models predict, in one pass over the rows."""
    rows = unseen
    for i, m in enumerate(models):
        rows = m.transform(rows).withColumnRenamed("prediction", f"__p{i}").select(*unseen.columns, *(f"__p{j}" for j in range(i + 1)))
    return rows.withColumn(out, sum((F.col(f"__p{i}") for i in range(len(models))), F.lit(0.0)) / len(models)).select(*unseen.columns, out)


def mean_importances(boosted: Boosted, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance), the mean over folds, largest first."""
    values = np.mean([m.stages[-1].featureImportances.toArray() for m in boosted.models], axis=0)
    return sorted(zip(features, values.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


class Range(NamedTuple):
    """Values of a parameter: from `low` to `high`, evenly by value or by logarithm, whole numbers if `whole`."""

    low: float
    high: float
    log: bool = False
    whole: bool = False

    def value(self, unit: float) -> float:
        x = math.exp(math.log(self.low) + unit * (math.log(self.high) - math.log(self.low))) if self.log else self.low + unit * (self.high - self.low)
        return int(round(x)) if self.whole else float(x)


class Trial(NamedTuple):
    round: int
    values: dict[str, float]
    loss: float


def _expected_gain(seen: np.ndarray, losses: np.ndarray, asked: np.ndarray, noise: float = 1e-4) -> np.ndarray:
    """How much below the least loss each asked point is expected to come, by a Gaussian process over those seen.

    Its length scale is that of a few under which the losses are likeliest.
    """
    mean, sd = losses.mean(), losses.std() or 1.0
    y = (losses - mean) / sd
    square = lambda a, b: ((a[:, None] - b[None]) ** 2).sum(axis=2)
    best = None
    for length in (0.1, 0.2, 0.4, 0.8):
        factor = np.linalg.cholesky(np.exp(-0.5 * square(seen, seen) / length**2) + noise * np.eye(len(seen)))
        z = np.linalg.solve(factor, y)
        fit = -0.5 * z @ z - np.log(np.diag(factor)).sum()
        if best is None or fit > best[0]:
            best = (fit, length, factor, z)
    _, length, factor, z = best
    v = np.linalg.solve(factor, np.exp(-0.5 * square(seen, asked) / length**2))
    spread = np.sqrt(np.maximum(1 - (v * v).sum(axis=0), 1e-12))
    below = (y.min() - v.T @ z) / spread
    density = np.exp(-0.5 * below**2) / math.sqrt(2 * math.pi)
    share = 0.5 * (1 + np.vectorize(math.erf)(below / math.sqrt(2)))
    return spread * (below * share + density)


def searched_by_model(space: dict[str, Range], loss: Callable[[dict], float], rounds: int = 5, batch: int = 4, first: int = 6, asked: int = 2000, seed: int = 7) -> list[Trial]:
    """Trials of parameters, in order: `first` spread over the space, then `rounds` of `batch` where the loss should fall most.

    `loss` may run Spark jobs: the trials of a round run at once. Points of a round are chosen one after another, each as if those before had
    come out as bad as the worst seen, so they keep apart. Depends on the seed and the losses alone, not on which trial ends first.
    A trial whose loss isn't finite counts as the worst so far.
    """
    rng = np.random.default_rng(seed)
    names = sorted(space)
    points = (np.stack([rng.permutation(first) for _ in names], axis=1) + rng.random((first, len(names)))) / first  # a Latin square
    seen, trials = np.zeros((0, len(names))), []
    for r in range(rounds + 1):
        values = [{n: space[n].value(float(u)) for n, u in zip(names, p, strict=True)} for p in points]
        got = at_once([lambda v=v: float(loss(v)) for v in values], len(values))
        trials += [Trial(r, v, x) for v, x in zip(values, got, strict=True)]
        seen = np.concatenate((seen, points))
        losses = np.array([t.loss for t in trials])
        losses = np.where(np.isfinite(losses), losses, losses[np.isfinite(losses)].max(initial=0.0))
        points, known, lies = np.zeros((0, len(names))), seen, losses
        for _ in range(batch):
            near = np.clip(seen[losses.argmin()] + rng.normal(0, 0.1, (asked // 4, len(names))), 0, 1)
            pool = np.concatenate((rng.random((asked, len(names))), near))
            point = pool[_expected_gain(known, lies, pool).argmax()][None]
            points, known, lies = np.concatenate((points, point)), np.concatenate((known, point)), np.append(lies, losses.max())
    return trials
