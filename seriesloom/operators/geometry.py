"""Paths from splines and from neighbours: a series' own spline, and how series like it went on."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.operators.joins import nearest_rows

#: Knots of a spline.
KNOTS = 16


def spline_weights(rows: DataFrame, key: str, at: str, value: str, knots: int = KNOTS, bend: float = 0.1, ridge: float = 1e-6) -> DataFrame:
    """(key, weights): the values at `knots` evenly spaced places from 0 to 1 of each series' penalised linear spline.

    The weights w make sum (value - s(at))^2 + bend * sum (w[i-1] - 2 w[i] + w[i+1])^2 + ridge * sum w[i]^2 least, where s(at) lies on the line
    between the two knots around it. A row counts for these two knots only, so five sums for each of a series' stretches between
    knots hold all that is needed: they are added up where the rows are, and the knots x knots systems are solved many at a time.
    Rows with a missing place or value, or a place not between 0 and 1, are left out; a series without rows is.
    """
    steps = knots - 1
    good = rows.where(F.col(at).between(0, 1) & ~F.isnan(F.col(value).cast("double")) & F.col(value).isNotNull())
    cell = F.least(F.floor(F.col(at) * steps), F.lit(steps - 1)).cast("int")
    t, y = F.col(at) * steps - cell, F.col(value).cast("double")
    sums = good.groupBy(key, cell.alias("cell")).agg(F.sum((1 - t) * (1 - t)).alias("aa"), F.sum((1 - t) * t).alias("ab"), F.sum(t * t).alias("bb"), F.sum((1 - t) * y).alias("ay"), F.sum(t * y).alias("by"))
    packed = sums.groupBy(key).agg(F.collect_list(F.struct("cell", "aa", "ab", "bb", "ay", "by")).alias("s"))  # at most knots - 1 entries
    second = np.zeros((knots - 2, knots))
    for i in range(knots - 2):
        second[i, i : i + 3] = 1, -2, 1
    fixed = bend * second.T @ second + ridge * np.eye(knots)

    @F.pandas_udf("array<double>")
    def solved(parts: pd.Series) -> pd.Series:
        n = len(parts)
        a, b = np.repeat(fixed[None], n, axis=0), np.zeros((n, knots))
        for i, part in enumerate(parts):
            for s in part:
                c = s["cell"]
                a[i, c, c] += s["aa"]
                a[i, c + 1, c + 1] += s["bb"]
                a[i, c, c + 1] += s["ab"]
                a[i, c + 1, c] += s["ab"]
                b[i, c] += s["ay"]
                b[i, c + 1] += s["by"]
        return pd.Series(list(np.linalg.solve(a, b[:, :, None])[:, :, 0])) if n else pd.Series([], dtype=object)

    return packed.select(key, solved("s").alias("weights"))


def on_spline(weights: Column, at: Column, knots: int = KNOTS) -> Column:
    """The spline's value at a place from 0 to 1."""
    cell = F.least(F.floor(at * (knots - 1)), F.lit(knots - 2)).cast("int")
    t = at * (knots - 1) - cell
    return F.element_at(weights, cell + 1) * (1 - t) + F.element_at(weights, cell + 2) * t


def neighbour_weights(series: DataFrame, donors: DataFrame, key: str, group: str, coords: list[str], anchor: str, weights: str, k: int = 8, knots: int = KNOTS) -> DataFrame:
    """(key, near, far, weights): a kernel mean of how the k nearest donors of other groups went on.

    Each donor's spline counts from its own value at the series' `anchor` place. Donors weigh exp(-(d / h)^2 / 2), where d is their
    distance in `coords` and the bandwidth h that of the k-th (1 if all are at distance 0): the sparser the donors, the wider the kernel.
    `near` and `far` are the distances of the first and the last donor. A series without donors has no row.
    """
    found = nearest_rows(series, donors, coords, key, group, k, payload=(weights,))
    far = found.groupBy(key).agg(F.max("distance").alias("far"), F.min("distance").alias("near"))
    found = found.join(far, key).join(series.select(key, anchor), key)
    w = F.exp(-0.5 * F.pow(F.col("distance") / F.when(F.col("far") > 0, F.col("far")).otherwise(1.0), 2))
    start = on_spline(F.col(weights), F.col(anchor), knots)
    parts = [F.sum(w * (F.element_at(weights, i + 1) - start)).alias(f"__w{i}") for i in range(knots)]
    sums = found.groupBy(key, "near", "far").agg(F.sum(w).alias("__w"), *parts)
    return sums.select(key, "near", "far", F.array(*(F.col(f"__w{i}") / F.col("__w") for i in range(knots))).alias("weights"))


def blended_path(rows: DataFrame, own: DataFrame, others: DataFrame, key: str, at: str, anchor: str, anchor_value: str, scale: float, knots: int = KNOTS) -> DataFrame:
    """`rows` with `spline`, `neighbours`, `kappa` and `path` = kappa * spline + (1 - kappa) * neighbours.

    Both paths start at the anchor's value and add how far the own spline, or the donors' mean one, has moved from the anchor's place on.
    kappa = far / (far + scale): the farther a series' donors, the more its own spline counts; it is 1 without donors.
    """
    a, b = own.select(key, F.col("weights").alias("__own")), others.select(key, "far", F.col("weights").alias("__others"))
    both = reduce(lambda x, y: x.join(y, key, "left"), (rows, a, b))
    moved = lambda w: F.col(anchor_value) + on_spline(F.col(w), F.col(at), knots) - on_spline(F.col(w), F.col(anchor), knots)
    both = both.withColumns({"spline": moved("__own"), "neighbours": moved("__others"), "kappa": F.coalesce(F.col("far") / (F.col("far") + scale), F.lit(1.0))})
    path = F.when(F.col("neighbours").isNull(), F.col("spline")).otherwise(F.col("kappa") * F.col("spline") + (1 - F.col("kappa")) * F.col("neighbours"))
    return both.withColumn("path", path).drop("__own", "__others", "far")
