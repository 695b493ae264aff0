"""Shapes in series: matches of a series with itself, robust planes and trends, corridors and medoids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged


def self_matches(df: DataFrame, key: str, order: str, value: str, known: str, size: int, block: int = 4096) -> DataFrame:
    """(key, receiver, donor, orientation, ncc): for each window of the tail, the window of the known prefix it resembles most.

    Windows are arrays of `size` rows, scaled to mean 0 and length 1, all of the tail against all
    of the prefix, forward and reversed; the earliest donor wins ties. Windows with gaps or without variation take no part.
    Both sides are cut into blocks of `block` rows, and each pair of blocks is a join key of its own, so that no task pairs a whole long series.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, size - 1)
    rows = df.select(key, order, F.collect_list(value).over(w).alias("a"), (F.count(known).over(w) == size).alias("donor"), (F.count(known).over(w) == 0).alias("tail"))
    rows = rows.where(F.size("a") == size)
    mean = F.aggregate("a", F.lit(0.0), lambda s, x: s + x) / size
    rows = rows.withColumn("a", F.transform("a", lambda x: x - mean))
    rows = rows.withColumn("len", F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x))).where("len > 1e-9")
    rows = rows.withColumn("a", F.transform("a", lambda x: x / F.col("len")))
    receivers = rows.where("tail").select(key, F.col(order).alias("receiver"), F.col("a").alias("r"))
    donors = rows.where("donor").select(key, F.col(order).alias("donor"), F.explode(F.map_from_arrays(F.array(F.lit("forward"), F.lit("reversed")), F.array("a", F.reverse("a")))).alias("orientation", "d"))
    dot = F.aggregate(F.zip_with("r", "d", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    number = lambda c: F.floor(F.col(c) / block)
    blocks = df.groupBy(key).agg(F.max(number(order)).alias("last"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    receivers = receivers.join(blocks, key).select(key, "receiver", "r", number("receiver").alias("i"), every.alias("j"))
    donors = donors.join(blocks, key).select(key, "donor", "orientation", "d", number("donor").alias("j"), every.alias("i"))
    pairs = receivers.join(donors, [key, "i", "j"]).select(key, "receiver", "donor", "orientation", F.round(dot, 9).alias("ncc"))
    return pairs.groupBy(key, "receiver").agg(F.max_by(F.struct("donor", "orientation", "ncc"), F.struct("ncc", F.negate("donor").alias("n"), (F.col("orientation") == "forward").alias("f"))).alias("b")).select(key, "receiver", "b.donor", "b.orientation", "b.ncc")


def huber_plane(df: DataFrame, key: list[str], x: str, y: str, value: str, rounds: int = 5, delta: float = 1.345) -> DataFrame:
    """(key, a, b, c, rows): value ~ a + b x + c y by a fixed number of reweighted least squares, each one sum a group.

    x and y are measured from the group's means; where they don't span a plane, b and c are 0.
    """
    middle = df.groupBy(key).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    rows = df.where(F.col(value).isNotNull()).join(middle, key).withColumns({"__x": F.col(x) - F.col("mx"), "__y": F.col(y) - F.col("my"), "__v": F.col(value)}).select(*key, "__x", "__y", "__v")
    rows = staged(rows, "plane")
    weighted = rows.withColumn("__w", F.lit(1.0))
    for i in range(rounds):
        w, p, q, v = (F.col(c) for c in ("__w", "__x", "__y", "__v"))
        m = weighted.groupBy(key).agg(*(F.sum(w * e).alias(n) for n, e in {"s": F.lit(1.0), "sx": p, "sy": q, "sxx": p * p, "sxy": p * q, "syy": q * q, "sv": v, "sxv": p * v, "syv": q * v}.items()), F.count("*").alias("rows"))
        cxx, cxy, cyy = F.col("sxx") - F.col("sx") ** 2 / F.col("s"), F.col("sxy") - F.col("sx") * F.col("sy") / F.col("s"), F.col("syy") - F.col("sy") ** 2 / F.col("s")
        cxv, cyv = F.col("sxv") - F.col("sx") * F.col("sv") / F.col("s"), F.col("syv") - F.col("sy") * F.col("sv") / F.col("s")
        det = cxx * cyy - cxy * cxy
        ok = det > 1e-9 * cxx * cyy
        b, c = F.when(ok, (cxv * cyy - cyv * cxy) / det).otherwise(0.0), F.when(ok, (cyv * cxx - cxv * cxy) / det).otherwise(0.0)
        fit = m.withColumns({"b": b, "c": c}).withColumn("a", (F.col("sv") - F.col("b") * F.col("sx") - F.col("c") * F.col("sy")) / F.col("s")).select(*key, "a", "b", "c", "rows")
        if i < rounds - 1:
            e = rows.join(fit, key).withColumn("__e", F.abs(F.col("__v") - F.col("a") - F.col("b") * F.col("__x") - F.col("c") * F.col("__y")))
            scale = e.groupBy(key).agg((1.4826 * F.median("__e")).alias("__s"))
            weighted = staged(e.join(scale, key).withColumn("__w", F.when(F.col("__s") <= 0, 1.0).otherwise(F.least(F.lit(1.0), delta * F.col("__s") / F.greatest("__e", F.lit(1e-12))))).select(*key, "__x", "__y", "__v", "__w"), "weighted")
    return fit.join(middle, key).select(*key, (F.col("a") - F.col("b") * F.col("mx") - F.col("c") * F.col("my")).alias("a"), "b", "c", "rows")


def _trend_solvers(sizes: np.ndarray, rho: float):
    """Solves (I + rho D'D) x = b, D the second differences, for many series at once, by LDL' factors of the five bands.

    Series are columns, padded to the longest; a padded row stands for itself alone.
    """
    n, row = int(sizes.max()), np.arange(int(sizes.max()))[:, None]
    a, b, c = np.ones((n, len(sizes))), np.zeros((n, len(sizes))), np.zeros((n, len(sizes)))
    inner = row < sizes - 2  # a second difference begins here
    for k, w in enumerate((1, -2, 1)):
        a[k:] += rho * w * w * inner[: n - k]
    b += -2 * rho * inner
    b[1:] += -2 * rho * inner[:-1]
    c += rho * inner
    d, e, f = np.ones_like(a), np.zeros_like(a), np.zeros_like(a)  # pivots, and the two bands below them
    for i in range(n):
        d[i] = a[i] - (e[i - 1] ** 2 * d[i - 1] if i else 0.0) - (f[i - 2] ** 2 * d[i - 2] if i > 1 else 0.0)
        e[i] = (b[i] - (e[i - 1] * f[i - 1] * d[i - 1] if i else 0.0)) / d[i]
        f[i] = c[i] / d[i]

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.copy()
        for i in range(1, n):
            x[i] -= e[i - 1] * x[i - 1]
            if i > 1:
                x[i] -= f[i - 2] * x[i - 2]
        x /= d
        for i in range(n - 2, -1, -1):
            x[i] -= e[i] * x[i + 1]
            if i < n - 2:
                x[i] -= f[i] * x[i + 2]
        return x

    return solve


def _trend_solver(n: int, rho: float):
    """`_trend_solvers` for one series."""
    solve = _trend_solvers(np.array([n]), rho)
    return lambda right: solve(np.asarray(right, float)[:, None])[:, 0]


def l1_trends(series: list[np.ndarray], strength: float, rounds: int = 200, rho: float = 1.0) -> list[np.ndarray]:
    """Piecewise linear trends: half the squared error plus strength times the absolute second differences, by ADMM, of all series side by side."""
    sizes = np.array([len(y) for y in series])
    if not len(sizes) or sizes.max() < 3:
        return [np.asarray(y, float) for y in series]
    n = int(sizes.max())
    y = np.zeros((n, len(series)))
    for j, values in enumerate(series):
        y[: len(values), j] = values
    inner = np.arange(n - 2)[:, None] < sizes - 2
    solve = _trend_solvers(sizes, rho)

    def unbend(v: np.ndarray) -> np.ndarray:
        out = np.zeros((n, len(series)))
        out[:-2] += v
        out[1:-1] -= 2 * v
        out[2:] += v
        return out

    z, u = np.zeros((n - 2, len(series))), np.zeros((n - 2, len(series)))
    for _ in range(rounds):
        x = solve(y + rho * unbend(z - u))
        r = np.where(inner, x[:-2] - 2 * x[1:-1] + x[2:] + u, 0.0)
        z = np.sign(r) * np.maximum(np.abs(r) - strength / rho, 0)
        u = r - z
    return [x[:size, j] for j, size in enumerate(sizes)]


def l1_trend(y: np.ndarray, strength: float, rounds: int = 200, rho: float = 1.0) -> np.ndarray:
    """The trend of one series; see `l1_trends`."""
    return l1_trends([np.asarray(y, float)], strength, rounds, rho)[0]


def notch(y: np.ndarray, step: float, low: float, high: float, top: int = 2) -> np.ndarray:
    """A series without its `top` strongest periods between `low` and `high`."""
    f = np.fft.rfft(y - y.mean())
    freq = np.fft.rfftfreq(len(y), step)
    inside = np.flatnonzero((freq > 0) & (1 / np.maximum(freq, 1e-12) >= low) & (1 / np.maximum(freq, 1e-12) <= high))
    f[inside[np.argsort(-np.abs(f[inside]), kind="stable")[:top]]] = 0
    return np.fft.irfft(f, len(y)) + y.mean()


def robust_polynomial(x: np.ndarray, y: np.ndarray, degree: int = 3, rounds: int = 3, sigmas: float = 4.0) -> np.ndarray:
    """A polynomial's values after leaving out, round by round, what lies beyond some robust deviations."""
    keep = np.isfinite(y)
    t = (x - x.mean()) / max(np.ptp(x), 1e-12)
    for _ in range(rounds):
        coef = np.polyfit(t[keep], y[keep], min(degree, max(0, keep.sum() - 1)))
        e = y - np.polyval(coef, t)
        s = 1.4826 * np.median(np.abs(e[keep] - np.median(e[keep])))
        keep = np.isfinite(y) & (np.abs(e) <= sigmas * s) if s > 0 else keep
    return np.polyval(coef, t)


def corridor(barrier: np.ndarray, start: int, end: int) -> tuple[float, list[int]]:
    """(bottleneck, columns): through the rows of a barrier grid, moving at most one column a row, the path whose largest barrier is least.

    Ties go to the straighter, then to the lower column.
    """
    n, m = barrier.shape
    cost, back = np.full(m, np.inf), np.zeros((n, m), int)
    cost[start] = barrier[0, start]
    for i in range(1, n):
        reach = np.stack([cost, np.append(np.inf, cost[:-1]), np.append(cost[1:], np.inf)])
        pick = reach.argmin(axis=0)
        back[i] = np.arange(m) + np.array([0, -1, 1])[pick]
        cost = np.maximum(reach.min(axis=0), barrier[i])
    path = [end]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i, path[-1]]))
    return float(cost[end]), path[::-1]


def corridors(df: DataFrame, key: str, order: str, barrier: str, start: int, end: int) -> DataFrame:
    """(key, order, column, bottleneck): each group's `corridor` through the arrays `barrier` of its rows, from column `start` to column `end`.

    One group is one task's work, in time and memory in proportion to its rows. Arrays of a group are of one
    length; null and missing barriers can't be passed. Where no path leads to `end`, the bottleneck is infinite.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def grouped(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        grid = np.stack([np.array(row, float) for row in part[barrier]])
        bottleneck, path = corridor(np.where(np.isnan(grid), np.inf, grid), start, end)
        return pd.DataFrame({key: part[key], order: part[order], "column": path, "bottleneck": bottleneck})

    return df.select(key, order, barrier).groupBy(key).applyInPandas(grouped, f"{key} {kinds[key]}, {order} {kinds[order]}, column int, bottleneck double")


def medoids(paths: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Which of some paths (rows) stand for all: k medoids by mean absolute distance, begun with the most central one, then the farthest."""
    return medoids_of(np.abs(paths[:, None, :] - paths[None, :, :]).mean(axis=2), k, rounds)


def medoids_of(d: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """`medoids` from the distances between the paths."""
    chosen = [int(d.sum(axis=1).argmin())]
    while len(chosen) < min(k, len(d)):
        chosen.append(int(d[:, chosen].min(axis=1).argmax()))
    for _ in range(rounds):
        of = d[:, chosen].argmin(axis=1)
        new = [int(np.flatnonzero(of == c)[d[np.ix_(of == c, of == c)].sum(axis=1).argmin()]) for c in range(len(chosen))]
        if new == chosen:
            break
        chosen = new
    return np.array(sorted(chosen))
