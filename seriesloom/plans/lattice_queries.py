"""Posteriors on a lattice so coarse that SQL can follow them row by row: 25 places, 5 rates, one or two modes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.operators import decoders
from seriesloom.plans.base import CANDIDATES, KEY, ROW, query, rounded
from seriesloom.plans.decoder_queries import _curve, _tail

PLACES, SLOPES = np.arange(-48.0, 49.0, 4.0), np.array([-0.4, -0.2, 0.0, 0.2, 0.4])
#: Deviation of observations, of the first place and rate, of the noise of rates; how much of a rate stays; chances from mode to mode.
SIGMA, START_SD, RATE_SD, RATE_NOISE, MOMENTUM, SWITCH = 15.0, 10.0, 0.2, 0.1, 0.9, ((0.95, 0.05), (0.2, 0.8))
#: What a blind mode takes an observation for, and the move and pull of the second query.
BLIND, SHIFT, PULL = -1.5, -0.3, 0.98


def _sql(modes: int, shift: float, pull: float) -> str:
    """Forward and backward sums over (mode, place, rate) by recursion over the rows of a tail; mv: chances of a row's moves."""
    switch = ", ".join(f"({k}, {m}, {(SWITCH[k][m] if modes > 1 else 1.0)}::DOUBLE)" for k in range(modes) for m in range(modes))
    rates = ", ".join(f"({i}, {r}::DOUBLE)" for i, r in enumerate(SLOPES))
    return CANDIDATES.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + f""",
x AS MATERIALIZED (SELECT user_id, row_idx, row_number() OVER w AS t, coalesce(md - lag(md) OVER w, 0) / 3600 AS step, gr FROM cf WINDOW w AS (PARTITION BY user_id ORDER BY row_idx)),
g AS (SELECT CAST(i AS INT) AS i, i * 4.0::DOUBLE - 48 AS place, (SELECT quantile_cont(value, list_value({", ".join(str(i / 50) for i in range(51))})) FROM events)[i * 2 + 2] AS seen FROM range(25) u(i)),
rt(r, rate) AS (VALUES {rates}), sw(k, m, s) AS (VALUES {switch}),
mz AS (SELECT a.r AS r0, b.r, exp(-0.5 * power((b.rate - {MOMENTUM}::DOUBLE * a.rate) / {RATE_NOISE}::DOUBLE, 2)) AS w FROM rt a, rt b),
mx AS MATERIALIZED (SELECT k, m, r0, r, s * w / sum(w) OVER (PARTITION BY k, m, r0) AS w FROM mz, sw),
lz AS (SELECT user_id, t, m, i, CASE WHEN gr IS NULL THEN 0 WHEN m = 1 THEN {BLIND} ELSE -0.5 * least(power((gr - seen) / {SIGMA}::DOUBLE, 2), 600) END AS e FROM x, g, (SELECT DISTINCT m FROM sw)),
lk AS MATERIALIZED (SELECT user_id, t, m, i, exp(e - max(e) OVER q) AS like, max(e) OVER q AS top FROM lz WINDOW q AS (PARTITION BY user_id, t)),
wy AS (SELECT user_id, t, r, i, (rate * step + {shift}::DOUBLE) / 4 + ({pull}::DOUBLE - 1) * place / 4 AS way FROM x, rt, g),
mw AS (SELECT user_id, t, r, i, i + CAST(round_even(way, 0) AS INT) + off AS j, exp(-0.5 * power((off - (way - round_even(way, 0))) / 0.5, 2)) AS w FROM wy, (VALUES (-2), (-1), (0), (1), (2)) o(off)),
mv AS MATERIALIZED (SELECT user_id, t, r, i, j, w / greatest(sum(w) OVER (PARTITION BY user_id, t, r, i), 1e-300) AS w FROM mw WHERE j BETWEEN 0 AND 24),
f0 AS (SELECT user_id, CAST(0 AS BIGINT) AS t, m, i, r, CASE WHEN m = 0 THEN exp(-0.5 * (power(place / {START_SD}::DOUBLE, 2) + power(rate / {RATE_SD}::DOUBLE, 2))) ELSE 0 END AS p FROM (SELECT DISTINCT user_id FROM x), g, rt, (SELECT DISTINCT m FROM sw)),
fw AS (
  SELECT user_id, t, m, i, r, p / sum(p) OVER (PARTITION BY user_id) AS p, 0::DOUBLE AS gain FROM f0
  UNION ALL
  SELECT user_id, t, m, i, r, p / sum(p) OVER (PARTITION BY user_id), ln(sum(p) OVER (PARTITION BY user_id))
  FROM (SELECT d.user_id, d.t, d.m, mv.j AS i, d.r, sum(d.p * mv.w * lk.like) AS p
        FROM (SELECT fw.user_id, fw.t + 1 AS t, mx.m, fw.i, mx.r, sum(fw.p * mx.w) AS p FROM fw JOIN mx ON mx.k = fw.m AND mx.r0 = fw.r GROUP BY ALL) d
        JOIN mv ON mv.user_id = d.user_id AND mv.t = d.t AND mv.r = d.r AND mv.i = d.i
        JOIN lk ON lk.user_id = d.user_id AND lk.t = d.t AND lk.m = d.m AND lk.i = mv.j GROUP BY ALL)),
b0 AS (SELECT x.user_id, max(x.t) AS t FROM x GROUP BY x.user_id),
bw AS (
  SELECT user_id, t, m, CAST(i AS INT) AS i, r, 1::DOUBLE AS p FROM b0, g, rt, (SELECT DISTINCT m FROM sw)
  UNION ALL
  SELECT user_id, t, m, i, r, p / max(p) OVER (PARTITION BY user_id)
  FROM (SELECT d.user_id, d.t - 1 AS t, mx.k AS m, d.i, mx.r0 AS r, sum(d.p * mx.w) AS p
        FROM (SELECT bw.user_id, bw.t, bw.m, mv.i, mv.r, sum(bw.p * lk.like * mv.w) AS p FROM bw
              JOIN lk ON lk.user_id = bw.user_id AND lk.t = bw.t AND lk.m = bw.m AND lk.i = bw.i
              JOIN mv ON mv.user_id = bw.user_id AND mv.t = bw.t AND mv.r = bw.r AND mv.j = bw.i WHERE bw.t > 1 GROUP BY ALL) d
        JOIN mx ON mx.m = d.m AND mx.r = d.r GROUP BY ALL)),
ll AS (SELECT user_id, sum(gain + top) AS loglik FROM (SELECT DISTINCT user_id, t, gain FROM fw WHERE t > 0) JOIN (SELECT DISTINCT user_id, t, top FROM lk) USING (user_id, t) GROUP BY user_id),
po AS (SELECT user_id, t, m, place, sum(fw.p * bw.p) AS p FROM fw JOIN bw USING (user_id, t, m, i, r) JOIN g USING (i) GROUP BY ALL),
me AS (SELECT user_id, t, sum(p * place) / sum(p) AS mean, sum(p * place * place) / sum(p) AS square, sum(p) FILTER (m = 0) / sum(p) AS first_mode FROM po GROUP BY ALL)
SELECT user_id, row_idx, round(mean, 5) AS mean, round(sqrt(greatest(0, square - mean * mean)), 4) AS sd, round(loglik, 5) AS loglik, round(first_mode, 5) AS first_mode
FROM me JOIN x USING (user_id, t) JOIN ll USING (user_id)"""


def _decoded(spark, sf_dir, modes: int, shift: float, pull: float):
    def emission(rows: pd.DataFrame, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
        observed = rows["observed"].to_numpy(float)
        z = (observed[:, None] - np.interp(PLACES, cx, cy)[None, :]) / SIGMA
        seen = np.where(np.isfinite(z), -0.5 * np.minimum(z * z, 600), 0.0)
        blind = np.where(np.isfinite(observed), BLIND, 0.0)[:, None] + np.zeros(len(PLACES))
        return np.stack((seen, blind)) if modes > 1 else seen

    def kernel(rows: list[pd.DataFrame], cx: list[np.ndarray], cy: list[np.ndarray]) -> list[dict]:
        zeros = [0.0] * len(rows)
        shifts, pulls = ([np.full(len(x), v) for x in rows] for v in (shift, pull))
        return decoders.hmm_each(
            [x["step"].to_numpy(float) for x in rows], [emission(*x) for x in zip(rows, cx, cy, strict=True)], PLACES, SLOPES, zeros, zeros, shifts, pulls,
            switch=np.array(SWITCH) if modes > 1 else None, start_sd=START_SD, rate_sd=RATE_SD, rate_noise=RATE_NOISE, momentum=MOMENTUM,
        )

    columns = "mean double, sd double, loglik double, first_mode double"
    got = decoders.decode(_tail(spark, sf_dir), _curve(spark, sf_dir), KEY, "curve", ROW, kernel, columns, "cx", "cy", 256)
    return rounded(rounded(got, "mean", "loglik", "first_mode", digits=5), "sd", digits=4)


@query("hmm_lattice", _sql(1, 0.0, 1.0))
def hmm_lattice(spark, sf_dir):
    """Places and rates of each tail by all of its observations."""
    return _decoded(spark, sf_dir, 1, 0.0, 1.0)


@query("hmm_lattice_sticky", _sql(2, SHIFT, PULL))
def hmm_lattice_sticky(spark, sf_dir):
    """The same with a blind mode that stays a while, a move of its own and a pull to the middle."""
    return _decoded(spark, sf_dir, 2, SHIFT, PULL)
