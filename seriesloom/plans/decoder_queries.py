"""Queries of the sequential decoders and models. Those that SQL can't express are held against brute force in tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged
from seriesloom.operators import candidates, decoders, models, series
from seriesloom.plans.base import BASE, CANDIDATES, KEY, ROW, base, folds, query, rounded, table, tails

GRID = np.arange(-50.0, 50.0 + 0.175, 0.35)
RATES = np.linspace(-0.1, 0.1, 41)
#: Seeds of a series' particle filter, and the temperatures at which their paths are blended.
SEEDS, TEMPERATURES = 64, (3.0, 5.0, 8.0, 12.0)
#: Points of a mean path, and the shifts along it that are tried.
POINTS, SHIFTS = 192, np.arange(-24.0, 25.0, 2.0)


def _tail(spark, sf_dir):
    """Tail rows with the step from the row before, the observation, and the start."""
    rows = tails(spark, sf_dir)
    step = F.coalesce(F.col("md") - F.lag("md").over(series.over(KEY, ROW)), F.lit(0.0)) / 3600
    return rows.select(KEY, ROW, "event_type", step.alias("step"), F.col("gr").alias("observed"), F.lit("all").alias("curve"))


def _curve(spark, sf_dir):
    """A reference curve: position in hundredths of the value's quantiles -> value."""
    q = F.percentile("value", F.array(*(F.lit(i / 50) for i in range(51))))
    return table(spark, sf_dir, "events").agg(q.alias("q")).select(F.lit("all").alias("curve"), F.posexplode("q").alias("i", "cy")).select("curve", (F.col("i") * 2.0 - 50).alias("cx"), "cy")


def _calibrated(spark, sf_dir):
    """Tail rows with `sigma`, `rate` and `start` from the known part of their series.

    There the position is taken as the value less 50, in which the curve is measured.
    """
    known = base(spark, sf_dir).where("known is not null").select(KEY, ROW, "gr", (F.col("md") / 3600).alias("hours"), (F.col("value") - 50).alias("place"), F.lit(50.0).alias("ref"), F.lit(0.0).alias("z"))
    sigma = candidates.noise_scale(known, KEY, "gr", "ref")
    rate = candidates.initial_rate(known, KEY, ROW, "hours", "place", "z", 30).select(KEY, "rate")
    start = known.groupBy(KEY).agg(F.max_by("place", ROW).alias("start"))
    fit = sigma.join(rate, KEY).join(start, KEY).select(KEY, F.coalesce("sigma", F.lit(60.0)).alias("sigma"), F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("start", F.lit(0.0)).alias("start"))
    return _tail(spark, sf_dir).join(fit, KEY)


def particles(spark, sf_dir, kernel, columns: str, each_row: bool = True, **options):
    """What `kernel(paths, log-likelihoods)` makes of a user's tail: 500 particles for each of SEEDS seeds, all in one pass over it."""

    def run(rows: pd.DataFrame, cx: np.ndarray, cy: np.ndarray) -> dict:
        return kernel(*decoders.particle_bank(rows["step"].to_numpy(float), rows["observed"].to_numpy(float), cx, cy, decoders.seeds_of(rows[KEY][0], SEEDS, "pf"), float(rows["start"][0]), float(rows["rate"][0]), float(rows["sigma"][0]), **options))

    return decoders.decode(_calibrated(spark, sf_dir), _curve(spark, sf_dir), KEY, "curve", ROW, run, columns, "cx", "cy", each_row=each_row)


def _blended(spark, sf_dir, **options):
    columns = ", ".join(f"{c} double" for c in ("mean", *(f"scale_{t:g}" for t in TEMPERATURES)))
    return particles(spark, sf_dir, lambda paths, logliks: decoders.blended(paths, logliks, TEMPERATURES, -250.0, 250.0), columns, **options)


@query("particle_filter")
def particle_filter(spark, sf_dir):
    return _blended(spark, sf_dir)


@query("particle_filter_robust")
def particle_filter_robust(spark, sf_dir):
    """The filter with a share of outliers, a part of the particles in a wider regime, and a lag of 192 rows."""
    return _blended(spark, sf_dir, outlier=0.05, wide=(0.25, 4.0), lag=192)


def _emission(rows: pd.DataFrame, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    z = (rows["observed"].to_numpy(float)[:, None] - np.interp(GRID, cx, cy)[None, :]) / rows["sigma"].to_numpy(float)[:, None]
    return np.where(np.isfinite(z), -0.5 * np.minimum(z * z, 600), 0.0)


_POSTERIOR = "mean double, sd double, loglik double, first_mode double, second_peak double"


#: Series whose lattices are handed to the decoder at once.
TOGETHER = 64


@query("hmm_decode")
def hmm_decode(spark, sf_dir):
    def kernel(rows: list[pd.DataFrame], cx: list[np.ndarray], cy: list[np.ndarray]) -> list[dict]:
        steps, first = [x["step"].to_numpy(float) for x in rows], lambda c: [float(x[c][0]) for x in rows]
        return decoders.hmm_each(steps, [_emission(*x) for x in zip(rows, cx, cy, strict=True)], GRID, RATES, first("start"), first("rate"), start_sd=10.0)

    return decoders.decode(_calibrated(spark, sf_dir), _curve(spark, sf_dir), KEY, "curve", ROW, kernel, _POSTERIOR, "cx", "cy", TOGETHER)


@query("hmm_reverting_sticky")
def hmm_reverting_sticky(spark, sf_dir):
    """Around the start, to which a position reverts by a half in 40 rows, with a mode in which observations tell nothing."""
    switch = np.array([[0.98, 0.02], [0.1, 0.9]])

    def modes(rows: pd.DataFrame, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        blind = np.where(np.isfinite(rows["observed"].to_numpy(float)), -2.0, 0.0)[:, None] + np.zeros(len(GRID))
        return np.stack((_emission(rows, cx, cy), blind))

    def kernel(rows: list[pd.DataFrame], cx: list[np.ndarray], cy: list[np.ndarray]) -> list[dict]:
        steps, first = [x["step"].to_numpy(float) for x in rows], lambda c: [float(x[c][0]) for x in rows]
        shifts, pulls = ([np.full(len(x), v) for x in rows] for v in (-0.01, 0.5 ** (1 / 40)))
        return decoders.hmm_each(steps, [modes(*x) for x in zip(rows, cx, cy, strict=True)], GRID, RATES, first("start"), first("rate"), shifts, pulls, first("start"), switch, start_sd=10.0)

    return decoders.decode(_calibrated(spark, sf_dir), _curve(spark, sf_dir), KEY, "curve", ROW, kernel, _POSTERIOR, "cx", "cy", TOGETHER)


@query("beam_decode")
def beam_decode(spark, sf_dir):
    def kernel(rows: pd.DataFrame, cx: np.ndarray, cy: np.ndarray) -> dict:
        return {"path": decoders.beam(rows["step"].to_numpy(float), rows["observed"].to_numpy(float), cx, cy, 0.0, np.array([-1.0, -0.5, 0.0, 0.5, 1.0]))}

    return decoders.decode(_tail(spark, sf_dir), _curve(spark, sf_dir), KEY, "curve", ROW, kernel, "path double", "cx", "cy")


@query("rts_smooth", BASE.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """,
x AS MATERIALIZED (
  SELECT user_id, row_idx, coalesce((md - lag(md) OVER w) / 3600, 0) AS d, gr, coalesce(first_value(gr IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS start
  FROM b WINDOW w AS (PARTITION BY user_id ORDER BY row_idx)),
fw AS (
  SELECT user_id, CAST(-1 AS BIGINT) AS row_idx, 0::DOUBLE AS d, 0::DOUBLE AS sa, 0::DOUBLE AS sb, 0::DOUBLE AS s00, 0::DOUBLE AS s01, 0::DOUBLE AS s11, start AS a, 0::DOUBLE AS r, 1e6::DOUBLE AS v00, 0::DOUBLE AS v01, 1::DOUBLE AS v11 FROM x WHERE row_idx = 0
  UNION ALL
  SELECT user_id, row_idx, d, sa, sb, s00, s01, s11,
         sa + CASE WHEN gr IS NULL THEN 0 ELSE s00 / (s00 + 900) * (gr - sa) END, sb + CASE WHEN gr IS NULL THEN 0 ELSE s01 / (s00 + 900) * (gr - sa) END,
         s00 - CASE WHEN gr IS NULL THEN 0 ELSE s00 / (s00 + 900) * s00 END, s01 - CASE WHEN gr IS NULL THEN 0 ELSE s00 / (s00 + 900) * s01 END, s11 - CASE WHEN gr IS NULL THEN 0 ELSE s01 / (s00 + 900) * s01 END
  FROM (SELECT x.user_id, x.row_idx, x.d, x.gr, a + x.d * r AS sa, r AS sb, v00 + 2 * x.d * v01 + x.d * x.d * v11 + x.d * x.d * x.d / 3 AS s00, v01 + x.d * v11 + x.d * x.d / 2 AS s01, v11 + x.d AS s11
        FROM fw JOIN x ON x.user_id = fw.user_id AND x.row_idx = fw.row_idx + 1)),
bw AS (
  SELECT user_id, row_idx, a, r, v00, v01, v11 FROM fw WHERE (user_id, row_idx) IN (SELECT (user_id, max(row_idx)) FROM x GROUP BY user_id)
  UNION ALL
  SELECT user_id, row_idx, a + g00 * ea + g01 * er, r + g10 * ea + g11 * er,
         v00 + g00 * g00 * w00 + 2 * g00 * g01 * w01 + g01 * g01 * w11, v01 + g00 * g10 * w00 + (g00 * g11 + g01 * g10) * w01 + g01 * g11 * w11, v11 + g10 * g10 * w00 + 2 * g10 * g11 * w01 + g11 * g11 * w11
  FROM (SELECT p.user_id, p.row_idx, p.a, p.r, p.v00, p.v01, p.v11, bw.a - n.sa AS ea, bw.r - n.sb AS er, bw.v00 - n.s00 AS w00, bw.v01 - n.s01 AS w01, bw.v11 - n.s11 AS w11,
               ((p.v00 + n.d * p.v01) * n.s11 - p.v01 * n.s01) / (n.s00 * n.s11 - n.s01 * n.s01) AS g00, (p.v01 * n.s00 - (p.v00 + n.d * p.v01) * n.s01) / (n.s00 * n.s11 - n.s01 * n.s01) AS g01,
               ((p.v01 + n.d * p.v11) * n.s11 - p.v11 * n.s01) / (n.s00 * n.s11 - n.s01 * n.s01) AS g10, (p.v11 * n.s00 - (p.v01 + n.d * p.v11) * n.s01) / (n.s00 * n.s11 - n.s01 * n.s01) AS g11
        FROM bw JOIN fw n ON n.user_id = bw.user_id AND n.row_idx = bw.row_idx JOIN fw p ON p.user_id = bw.user_id AND p.row_idx = bw.row_idx - 1 WHERE bw.row_idx > 0))
SELECT user_id, row_idx, round(a, 4) AS level, round(v00, 4) AS variance FROM bw""")
def rts_smooth(spark, sf_dir):
    def run(parts):
        for part in parts:
            for some in (part.iloc[i : i + 1000] for i in range(0, len(part), 1000)):
                got = [decoders.rts(np.asarray(md, float) / 3600, np.asarray(gr, float), 900.0, 1.0) for md, gr in zip(some["md"], some["gr"], strict=True)]
                rows = {KEY: np.repeat(some[KEY].to_numpy(), [len(x) for x in some["at"]]), ROW: np.concatenate(some["at"].to_list())}
                yield pd.DataFrame(rows | {c: np.concatenate([g[c] for g in got]) for c in ("level", "variance")})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work a series
    whole = base(spark, sf_dir).select(KEY, ROW, "md", "gr").repartition(tasks, KEY).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("at"), "md", "gr"))).alias("s"))
    got = whole.select(KEY, "s.at", "s.md", "s.gr").mapInPandas(run, f"{KEY} long, {ROW} long, level double, variance double")
    return rounded(got, "level", "variance", digits=4)


@query("dtw_to_reference")
def dtw_to_reference(spark, sf_dir):
    """The warping distance of each user's whole series to the mean path of all users, and the shift of that path at which it is least.

    The mean path has POINTS points over the part of a series that has gone by; a series meets it at the places of its own rows.
    Of equal distances the smaller shift, then the negative one counts.
    """
    rows = base(spark, sf_dir).select(KEY, ROW, "value", F.coalesce(F.col(ROW) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0)).alias("part"))
    packed = rows.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(ROW, "value", "part"))).alias("s")).select(KEY, F.col("s.value").alias("a"), F.col("s.part").alias("t"))
    mean = rows.groupBy(F.round(F.col("part") * (POINTS - 1)).alias("i")).agg(F.avg("value").alias("v")).where("v is not null")
    mean = mean.agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m")).select(F.col("m.i").alias("x"), F.col("m.v").alias("y"))  # POINTS values

    @F.pandas_udf("distance double, shift double")
    def nearest(a: pd.Series, t: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = []
        for values, parts, cx, cy in zip(a, t, x, y, strict=True):
            got = decoders.dtw_each(np.asarray(values, float), np.interp(np.asarray(parts, float)[None, :] * (POINTS - 1) + SHIFTS[:, None], cx, cy))
            at = min(range(len(SHIFTS)), key=lambda i: (got[i], abs(SHIFTS[i]), SHIFTS[i]))
            out.append((got[at], SHIFTS[at]))
        return pd.DataFrame(out, columns=["distance", "shift"])

    return packed.crossJoin(F.broadcast(mean)).select(KEY, nearest("a", "t", "x", "y").alias("b")).select(KEY, "b.distance", "b.shift")


def _affine_sql(x: str, rounds: int = 10) -> str:
    """Each round's means, line, residuals and weights as tables of their own."""
    sql = CANDIDATES + f""",
d0 AS MATERIALIZED (SELECT user_id, {x} AS x, tvt AS y, 1.0::DOUBLE AS w FROM cf WHERE {x} IS NOT NULL AND tvt IS NOT NULL)"""
    for i in range(rounds):
        sql += f""",
m{i} AS MATERIALIZED (SELECT user_id, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM d{i} GROUP BY user_id),
v{i} AS (SELECT user_id, mx, my, sum(w * (x - mx) * (x - mx)) / sum(w) AS xx, sum(w * (x - mx) * (y - my)) / sum(w) AS xy, count(*) AS n FROM d{i} JOIN m{i} USING (user_id) GROUP BY ALL),
l{i} AS MATERIALIZED (SELECT user_id, n, mx, my, CASE WHEN xx > 1e-18 * (1 + mx * mx) THEN xy / xx ELSE 1 END AS a FROM v{i})"""
        if i < rounds - 1:
            sql += f""",
e{i} AS MATERIALIZED (SELECT user_id, x, y, abs(y - a * x - (my - a * mx)) AS e FROM d{i} JOIN l{i} USING (user_id)),
k{i} AS (SELECT user_id, 1.4826::DOUBLE * median(e) AS sc FROM e{i} GROUP BY user_id),
d{i + 1} AS MATERIALIZED (SELECT user_id, x, y, CASE WHEN sc = 0 THEN 1 ELSE least(1, 1.345::DOUBLE * sc / greatest(e, 1e-12)) END AS w FROM e{i} JOIN k{i} USING (user_id))"""
    return sql + f"""
SELECT user_id, n, n >= 5 AS valid, round(1 + n / (n + 20.0::DOUBLE) * (CASE WHEN n >= 5 THEN a ELSE 1 END - 1), 5) AS slope, round(n / (n + 20.0::DOUBLE) * CASE WHEN n >= 5 THEN my - a * mx ELSE 0 END, 4) AS intercept FROM l{rounds - 1}"""


def _affine(spark, sf_dir, x: str):
    got = decoders.affine_calibration(tails(spark, sf_dir).select(KEY, x, "tvt"), KEY, x, "tvt", 5, 20)
    return rounded(rounded(got, "slope", digits=5), "intercept", digits=4)


@query("affine_calibration", _affine_sql("last_anchor"))
def affine_calibration(spark, sf_dir):
    """A candidate that is the same in a whole tail: its slope stays 1, the intercept is a robust mean."""
    return _affine(spark, sf_dir, "last_anchor")


@query("affine_calibration_linear", _affine_sql("recent_linear"))
def affine_calibration_linear(spark, sf_dir):
    """A candidate that moves: a robust line of the truth on it."""
    return _affine(spark, sf_dir, "recent_linear")


def _features(spark, sf_dir):
    rows = tails(spark, sf_dir)
    rows = rows.select(KEY, ROW, "fold", "last_anchor", "recent_linear", "ahead", "gr", "tvt", (F.col("tvt") > F.col("recent_linear")).cast("int").alias("above"))
    return staged(models.with_missing_flags(rows, ["gr"]), "features")  # each fit passes over it several times


@query("out_of_fold_linear")
def out_of_fold_linear(spark, sf_dir):
    rows = _features(spark, sf_dir)
    got = models.out_of_fold(rows, "fold", 5, lambda d: models.linear(["last_anchor", "recent_linear", "ahead", "gr", "gr__missing"], "tvt").fit(d))
    return rounded(got.groupBy("fold").agg(F.count("*").alias("rows"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("tvt"), 2))).alias("rmse")), "rmse", digits=3)


@query("logistic_risk")
def logistic_risk(spark, sf_dir):
    rows = _features(spark, sf_dir)
    model = models.logistic(["ahead", "gr", "gr__missing"], "above").fit(rows.where("fold <> 0"))
    return model.transform(rows.where("fold = 0")).select(KEY, ROW, "prediction")


@query("user_clusters")
def user_clusters(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy(KEY).agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return models.clusters(["n", "mean", "std"], 4).fit(users).transform(users).groupBy("prediction").agg(F.count("*").alias("users"))


@query("pca_axis")
def pca_axis(spark, sf_dir):
    users = table(spark, sf_dir, "events").groupBy(KEY).agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).join(folds(spark, sf_dir), KEY)
    return models.first_axis(users.where("fold <> 0"), users.where("fold = 0"), ["n", "mean", "std"], "axis").select(KEY, "axis")


@query("candidate_recentring", CANDIDATES + " SELECT user_id, round((slope + avg(slope) OVER (PARTITION BY fold)) / 2, 9) AS slope FROM sl JOIN f USING (user_id)")
def candidate_recentring(spark, sf_dir):
    """Recent slopes drawn towards the mean of each fold's others."""
    slopes = candidates.recent_slope(base(spark, sf_dir), KEY, ROW, "md", "known").join(folds(spark, sf_dir), KEY)
    means = slopes.groupBy("fold").agg(F.avg("slope").alias("m"))
    return rounded(slopes.join(means, "fold").select(KEY, ((F.col("slope") + F.col("m")) / 2).alias("slope")), "slope", digits=9)
