"""Models fitted on some groups and applied to others, on Spark ML."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apart(train: DataFrame, test: DataFrame, key: str) -> None:
    """Fails if a group is on both sides."""
    if train.select(key).distinct().join(test.select(key), key, "left_semi").limit(1).count():
        raise ValueError(f"groups of {key} are in train and test")


def out_of_fold(df: DataFrame, fold: str, k: int, fit: Callable[[DataFrame], object], prediction: str = "prediction") -> DataFrame:
    """Every row predicted by a model fitted on the other folds."""
    parts = []
    for f in range(k):
        model = fit(df.where(F.col(fold) != f))
        parts.append(model.transform(df.where(F.col(fold) == f)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def assembled(features: list[str], scale: str | None = "standard") -> list:
    """Stages that fill nulls by the median and scale; fitted with the model, on its rows alone."""
    filled = [f"{f}__filled" for f in features]
    stages = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__raw" if scale else "features", handleInvalid="keep")]
    if scale:
        kind = StandardScaler if scale == "standard" else RobustScaler
        stages.append(kind(inputCol="__raw", outputCol="features"))
    return stages


def with_missing_flags(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f"{f}__missing": F.col(f).isNull().cast("double") for f in features})


def logistic(features: list[str], label: str, penalty: float = 0.01) -> Pipeline:
    return Pipeline(stages=[*assembled(features), LogisticRegression(labelCol=label, regParam=penalty, maxIter=50)])


def linear(features: list[str], label: str, penalty: float = 0.0) -> Pipeline:
    return Pipeline(stages=[*assembled(features), LinearRegression(labelCol=label, regParam=penalty)])


def boosted(features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 7) -> Pipeline:
    return Pipeline(stages=[*assembled(features, None), GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)])


def clusters(features: list[str], k: int, seed: int = 7) -> Pipeline:
    return Pipeline(stages=[*assembled(features), KMeans(k=k, seed=seed)])


def first_axis(fit: DataFrame, df: DataFrame, features: list[str], out: str) -> DataFrame:
    """`df` with its place on the first principal axis of `fit`, turned so that the largest loading is positive."""
    model = Pipeline(stages=[*assembled(features), PCA(k=1, inputCol="features", outputCol="__pc")]).fit(fit)
    loads = model.stages[-1].pc.toArray()[:, 0]
    sign = 1.0 if loads[abs(loads).argmax()] >= 0 else -1.0
    return model.transform(df).withColumn(out, sign * vector_to_array("__pc")[0]).select(*df.columns, out)


def importances(model, features: list[str]) -> DataFrame:
    """(feature, importance) of a fitted `boosted` pipeline."""
    from pyspark.sql import SparkSession

    values = model.stages[-1].featureImportances.toArray()
    return SparkSession.getActiveSession().createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, importance double")


def searched(pipeline: Pipeline, grid: dict, label: str, folds: int = 3, seed: int = 7) -> CrossValidator:
    """A grid of the last stage's parameters, by cross-validated RMSE."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(pipeline.getStages()[-1].getParam(name), values)
    return CrossValidator(estimator=pipeline, estimatorParamMaps=builder.build(), evaluator=RegressionEvaluator(labelCol=label), numFolds=folds, seed=seed)


def _sums(candidates: list[str], truth: str) -> list[Column]:
    """The normal equations of a stack as sums: products of candidates, and of each with the truth."""
    products = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(candidates) for j, b in enumerate(candidates) if j >= i]
    return [*products, *(F.sum(F.col(a) * F.col(truth)).alias(f"b{i}") for i, a in enumerate(candidates))]


def _non_negative(sums: dict, n: int, ridge: float) -> list[float]:
    """Non-negative weights of least squared error from its normal equations, by an active set: exact, however alike the candidates are.

    The weight whose growth lowers the error most is freed; where the free ones' best values fall below zero, the way there ends at the
    first that reaches zero, which is bound again.
    """
    if sums["b0"] is None:
        return [1.0 / n] * n
    g = np.array([[float(sums[f"g{min(i, j)}_{max(i, j)}"]) for j in range(n)] for i in range(n)]) + ridge * np.eye(n)
    b = np.array([float(sums[f"b{i}"]) for i in range(n)])
    w, free, least = np.zeros(n), np.zeros(n, bool), 1e-12 * max(1.0, float(np.abs(b).max()))
    for _ in range(10 * n):  # each round lowers the error, so no set of free weights comes twice
        growth = np.where(free, -np.inf, b - g @ w)
        if growth.max() <= least:
            break
        free[int(growth.argmax())] = True
        while free.any():
            best = np.zeros(n)
            best[free] = np.linalg.solve(g[np.ix_(free, free)], b[free])
            if (best[free] > 0).all():
                w = best
                break
            down = free & (best <= 0)
            part = float((w[down] / np.maximum(w[down] - best[down], 1e-300)).min())
            w = w + part * (best - w)
            free &= ~(down & (w <= 1e-15 * max(1.0, float(w.max()))))
            w[~free] = 0.0
    return w.tolist()


def positive_stack(df: DataFrame, candidates: list[str], truth: str, ridge: float = 1e-3) -> dict[str, float]:
    """Non-negative weights of candidates: one row of sums reaches the driver. Rows with a missing value are left out; without rows weights are equal."""
    rows = df.dropna(subset=[*candidates, truth])
    return dict(zip(candidates, _non_negative(rows.agg(*_sums(candidates, truth)).first().asDict(), len(candidates), ridge), strict=True))


def stack_weights(df: DataFrame, fold: str, candidates: list[str], truth: str, ridge: float = 1e-3) -> DataFrame:
    """(fold, w_<candidate>...): for each fold the `positive_stack` of all others, from one pass; a row of sums a fold reaches the driver."""
    got = df.dropna(subset=[*candidates, truth]).groupBy(fold).agg(*_sums(candidates, truth)).collect()
    names = [c for c in (got[0].asDict() if got else {}) if c != fold]
    out = []
    for r in got:
        rest = {c: (sum(x[c] for x in got) - r[c]) if len(got) > 1 else None for c in names}
        out.append((r[fold], *_non_negative(rest, len(candidates), ridge)))
    return df.sparkSession.createDataFrame(out, f"{fold} {df.schema[fold].dataType.simpleString()}, " + ", ".join(f"w_{c} double" for c in candidates))


def stacked(df: DataFrame, weights: DataFrame, fold: str, candidates: list[str]) -> DataFrame:
    """`df` with `stacked`, the candidates weighted by its fold's weights."""
    rows = df.join(F.broadcast(weights), fold)  # a row for each fold
    return rows.withColumn("stacked", sum((F.col(c) * F.col(f"w_{c}") for c in candidates), F.lit(0.0))).select(*df.columns, "stacked")
