"""Queries of the ordered-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import aggregates, series
from seriesloom.plans.base import BASE, KEY, ROW, base, query, rounded

W = "(PARTITION BY user_id ORDER BY row_idx"


@query("lag_diff_features", BASE + f"""
SELECT user_id, row_idx, lag(value, 1) OVER w AS value_lag1, lag(value, 2) OVER w AS value_lag2, lag(value, 3) OVER w AS value_lag3,
       round(coalesce(value - lag(value) OVER w, 0), 6) AS diff, round(lead(value) OVER w - 2 * value + lag(value) OVER w, 6) AS curvature
FROM b WINDOW w AS {W})""")
def lag_diff_features(spark, sf_dir):
    rows = series.lags(base(spark, sf_dir), KEY, ROW, "value")
    rows = rows.withColumns({"diff": series.first_difference(KEY, ROW, "value"), "curvature": series.second_difference(KEY, ROW, "value")})
    return rounded(rows.select(KEY, ROW, "value_lag1", "value_lag2", "value_lag3", "diff", "curvature"), "diff", "curvature")


@query("rolling_features", BASE + f"""
SELECT user_id, row_idx, round(avg(value) OVER {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3,
       round(avg(value) OVER {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS mean10,
       round(coalesce(stddev_samp(value) OVER {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0), 6) AS std10,
       round(avg(value) OVER {W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS centred11,
       round(median(value) OVER {W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS median5
FROM b""")
def rolling_features(spark, sf_dir):
    t = lambda n: series.trailing_mean(KEY, ROW, "value", n)
    rows = base(spark, sf_dir).select(KEY, ROW, t(3).alias("mean3"), t(10).alias("mean10"), series.trailing_std(KEY, ROW, "value", 10).alias("std10"), series.centred_mean(KEY, ROW, "value", 11).alias("centred11"), series.rolling_median(KEY, ROW, "value", 5).alias("median5"))
    return rounded(rows, "mean3", "mean10", "std10", "centred11", "median5")


@query("ffill_lerp", BASE + f""",
k AS (
  SELECT *, last_value(CASE WHEN gr IS NOT NULL THEN md END IGNORE NULLS) OVER p AS x0, last_value(gr IGNORE NULLS) OVER p AS y0,
         first_value(CASE WHEN gr IS NOT NULL THEN md END IGNORE NULLS) OVER q AS x1, first_value(gr IGNORE NULLS) OVER q AS y1
  FROM b WINDOW p AS {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, row_idx, y0 AS filled,
       round(CASE WHEN gr IS NOT NULL THEN gr WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (md - x0) / (x1 - x0) END, 6) AS line
FROM k""")
def ffill_lerp(spark, sf_dir):
    rows = series.fill_linear(base(spark, sf_dir), KEY, ROW, "gr", "md", "line")
    return rounded(rows.select(KEY, ROW, series.forward_fill(KEY, ROW, "gr").alias("filled"), "line"), "line")


@query("cumsum_since_anchor", BASE + """,
a AS (SELECT user_id, max(row_idx) AS anchor_row_idx, arg_max(known, row_idx) AS anchor_known, arg_max(md, row_idx) AS anchor_md FROM b WHERE known IS NOT NULL GROUP BY user_id)
SELECT user_id, row_idx, row_idx - anchor_row_idx AS steps, round(tvt - anchor_known, 6) AS since, round(md - anchor_md, 6) AS distance FROM b JOIN a USING (user_id)""")
def cumsum_since_anchor(spark, sf_dir):
    rows = base(spark, sf_dir)
    rows = rows.join(series.anchors(rows, KEY, ROW, "known", ["md"]), KEY)
    return rounded(rows.select(KEY, ROW, (F.col(ROW) - F.col("anchor_row_idx")).alias("steps"), (F.col("tvt") - F.col("anchor_known")).alias("since"), (F.col("md") - F.col("anchor_md")).alias("distance")), "since", "distance")


@query("pct_rank_avg_ties", BASE + """
SELECT user_id, row_idx,
       round(CASE WHEN gr IS NOT NULL THEN (rank() OVER (PARTITION BY user_id ORDER BY gr NULLS LAST) + (count(*) OVER (PARTITION BY user_id, gr) - 1) / 2.0) / count(gr) OVER (PARTITION BY user_id) END, 9) AS pct,
       round((value - min(value) OVER (PARTITION BY user_id)) / (max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id) + 1e-8), 9) AS scaled
FROM b""")
def pct_rank_avg_ties(spark, sf_dir):
    rows = base(spark, sf_dir).select(KEY, ROW, series.percent_rank_average(KEY, "gr").alias("pct"), series.min_max(KEY, "value").alias("scaled"))
    return rounded(rows, "pct", "scaled", digits=9)


_ISLANDS = BASE + f""",
m AS (SELECT *, value > 60 AS hot FROM b),
i AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(lag_hot, false) THEN 1 ELSE 0 END) OVER {W}) AS island FROM (SELECT *, lag(hot) OVER {W}) AS lag_hot FROM m))"""


@query("islands", _ISLANDS + """
SELECT user_id, CAST(island AS BIGINT) AS island, min(row_idx) AS first, max(row_idx) AS last, count(*) AS rows FROM i WHERE hot GROUP BY ALL""")
def islands(spark, sf_dir):
    runs = series.islands(base(spark, sf_dir), KEY, ROW, F.col("value") > 60)
    return runs.groupBy(KEY, "island").agg(F.min(ROW).alias("first"), F.max(ROW).alias("last"), F.count("*").alias("rows"))


@query("persistent_episodes", BASE + f""",
e AS (SELECT *, value - 50 AS err FROM b), m AS (SELECT *, abs(err) > 30 AS hot FROM e),
i AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(lag_hot, false) THEN 1 ELSE 0 END) OVER {W}) AS island FROM (SELECT *, lag(hot) OVER {W}) AS lag_hot FROM m))
SELECT user_id, CAST(island AS BIGINT) AS island, min(row_idx) AS first, max(row_idx) AS last, count(*) AS rows, round(median(err), 6) AS median_error,
       round(greatest(avg((err > 0)::INT), 1 - avg((err > 0)::INT)), 6) AS sign_share
FROM i WHERE hot GROUP BY ALL HAVING count(*) >= 3""")
def persistent_episodes(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("err", F.col("value") - 50)
    return rounded(series.episodes(rows, KEY, ROW, "err", 30, 3), "median_error", "sign_share")


@query("blocks_16_8", BASE + """,
k AS (SELECT b.*, CAST(block AS BIGINT) AS block FROM b, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((row_idx - 15) / 8.0) AS BIGINT)), row_idx // 8 + 1)) AS block))
SELECT user_id, block, count(*) AS rows, round(count(gr) / count(*), 9) AS valid, round(avg(gr), 6) AS mean, round(stddev_pop(gr), 6) AS std,
       round(quantile_cont(gr, 0.1), 6) AS p10, round(quantile_cont(gr, 0.5), 6) AS p50, round(quantile_cont(gr, 0.9), 6) AS p90, min(gr) AS min, max(gr) AS max,
       round(arg_max(gr, row_idx) FILTER (gr IS NOT NULL) - arg_min(gr, row_idx) FILTER (gr IS NOT NULL), 6) AS change
FROM k GROUP BY user_id, block""")
def blocks_16_8(spark, sf_dir):
    rows = aggregates.block_statistics(series.blocks(base(spark, sf_dir), ROW, 16, 8), [KEY, "block"], ROW, "gr")
    return rounded(rounded(rows, "mean", "std", "p10", "p50", "p90", "change"), "valid", digits=9)


@query("full_blocks", BASE + """
SELECT user_id, CAST(block AS BIGINT) AS block, count(*) AS rows, round(sum(value), 4) AS total
FROM b, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((row_idx - 15) / 8.0) AS BIGINT)), row_idx // 8 + 1)) AS block)
WHERE block * 8 + 16 <= n GROUP BY ALL""")
def full_blocks(spark, sf_dir):
    rows = series.blocks(base(spark, sf_dir), ROW, 16, 8, "n").groupBy(KEY, "block").agg(F.count("*").alias("rows"), F.sum("value").alias("total"))
    return rounded(rows, "total", digits=4)


@query("equal_row_segments", BASE + """
SELECT user_id, CAST(ceil((row_idx + 1) * 16 / n::DOUBLE) - 1 AS INTEGER) AS segment, count(*) AS rows, min(row_idx) AS first, round(avg(value), 6) AS mean FROM b GROUP BY ALL""")
def equal_row_segments(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("segment", series.equal_segments(ROW, "n", 16))
    return rounded(rows.groupBy(KEY, "segment").agg(F.count("*").alias("rows"), F.min(ROW).alias("first"), F.avg("value").alias("mean")), "mean")


@query("forward_window_mse", BASE + f"""
SELECT user_id, row_idx, round(m, 4) AS forward_mse FROM (SELECT user_id, row_idx, avg(value * value) OVER w AS m, count(value) OVER w AS c FROM b WINDOW w AS {W} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5""")
def forward_window_mse(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("sq", F.col("value") * F.col("value"))
    return rounded(rows.select(KEY, ROW, series.forward_mean(KEY, ROW, "sq", 5).alias("forward_mse")).where("forward_mse is not null"), "forward_mse", digits=4)


@query("error_buckets", BASE + """,
e AS (SELECT *, row_idx - ceil(n * 3 / 5.0) AS ahead FROM b WHERE known IS NULL)
SELECT CASE WHEN ahead < 0 THEN NULL WHEN ahead < 5 THEN '0_4' WHEN ahead < 10 THEN '5_9' WHEN ahead < 20 THEN '10_19' ELSE '20_plus' END AS bucket,
       count(*) AS rows, round(sqrt(avg(power(value - 50, 2))), 6) AS rmse, round(avg(abs(value - 50)), 6) AS mae FROM e GROUP BY ALL""")
def error_buckets(spark, sf_dir):
    rows = base(spark, sf_dir).where("known is null").withColumn("ahead", (F.col(ROW) - F.ceil(F.col("n") * 3 / 5)).cast("double")).withColumn("err", F.col("value") - 50)
    rows = rows.withColumn("bucket", series.bucket("ahead", [0, 5, 10, 20, float("inf")], ["0_4", "5_9", "10_19", "20_plus"]))
    return rounded(rows.groupBy("bucket").agg(*aggregates.error_metrics("err")).select("bucket", "rows", "rmse", "mae"), "rmse", "mae")


@query("refractory_triggers", BASE.replace("WITH s AS", "WITH RECURSIVE s AS") + """,
t AS (SELECT user_id, row_idx FROM b WHERE value > 80),
r AS (
  SELECT user_id, min(row_idx) AS row_idx FROM t GROUP BY user_id
  UNION ALL
  SELECT r.user_id, (SELECT min(t.row_idx) FROM t WHERE t.user_id = r.user_id AND t.row_idx >= r.row_idx + 5) FROM r
  WHERE EXISTS (SELECT 1 FROM t WHERE t.user_id = r.user_id AND t.row_idx >= r.row_idx + 5))
SELECT user_id, row_idx FROM r""")
def refractory_triggers(spark, sf_dir):
    return series.refractory(base(spark, sf_dir), KEY, ROW, F.col("value") > 80, 5)


@query("segment_boundaries", BASE + f"""
, g AS (SELECT *, CAST(ceil((row_idx + 1) * 4 / n::DOUBLE) - 1 AS INTEGER) AS segment FROM b),
h AS (SELECT *, coalesce(CAST(segment <> lag(segment) OVER {W}) AS INTEGER), 0) AS change FROM g)
SELECT user_id, row_idx, segment, max(change) OVER {W} ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) = 1 AS near_boundary,
       round(coalesce((row_number() OVER (PARTITION BY user_id, segment ORDER BY row_idx) - 1) / nullif(count(*) OVER (PARTITION BY user_id, segment) - 1, 0)::DOUBLE, 0), 9) AS relative
FROM h""")
def segment_boundaries(spark, sf_dir):
    rows = base(spark, sf_dir).withColumn("segment", series.equal_segments(ROW, "n", 4))
    rows = series.near_boundary(rows, KEY, ROW, "segment", 2)
    return rounded(rows.select(KEY, ROW, "segment", "near_boundary", series.relative_position([KEY, "segment"], ROW).alias("relative")), "relative", digits=9)


@query("window_slope", BASE + f"""
SELECT user_id, row_idx, round(regr_slope(value, row_idx) OVER {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 5) + 0.0::DOUBLE AS slope FROM b
QUALIFY count(*) OVER {W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) = 10""")
def window_slope(spark, sf_dir):
    w = series.over(KEY, ROW).rowsBetween(-9, 0)
    x, y = F.col(ROW).cast("double"), F.col("value")
    slope = F.covar_pop(x, y).over(w) / F.var_pop(x).over(w)
    return rounded(base(spark, sf_dir).select(KEY, ROW, slope.alias("slope"), F.count("*").over(w).alias("c")).where("c = 10").drop("c"), "slope", digits=5).withColumn("slope", F.col("slope") + 0.0)  # no negative zero


@query("tail_rows", BASE + """
SELECT user_id, row_idx, known FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) AS r FROM b WHERE known IS NOT NULL) WHERE r <= 5""")
def tail_rows(spark, sf_dir):
    return series.tail(base(spark, sf_dir), KEY, ROW, 5, F.col("known").isNotNull()).select(KEY, ROW, "known")


@query("circular_control", BASE + f""",
p AS (SELECT user_id, row_idx, value, n, CASE WHEN n > 1 THEN 7 % (n - 1) + 1 ELSE 0 END AS turn FROM b)
SELECT p.user_id, p.row_idx, d.value AS moved FROM p JOIN b d ON d.user_id = p.user_id AND d.row_idx = (p.row_idx + p.turn) % p.n""")
def circular_control(spark, sf_dir):
    return series.circular_shift(base(spark, sf_dir).select(KEY, ROW, "value"), KEY, ROW, "value", F.lit(7), "moved").select(KEY, ROW, "moved")


@query("multiscale_detail", BASE + f"""
SELECT user_id, row_idx, round(power(avg(value) OVER {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) - value, 2), 4) AS detail_4,
       round(power(avg(value) OVER {W} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) - avg(value) OVER {W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 2), 4) AS detail_8,
       round((-3 * lag(value, 2) OVER {W}) + 12 * lag(value, 1) OVER {W}) + 17 * value + 12 * lead(value, 1) OVER {W}) - 3 * lead(value, 2) OVER {W})) / 35, 4) AS smooth
FROM b""")
def multiscale_detail(spark, sf_dir):
    from seriesloom.operators import decoders

    detail = decoders.detail_energy(KEY, ROW, "value", (4, 8))
    rows = base(spark, sf_dir).select(KEY, ROW, *(v.alias(k) for k, v in detail.items()), decoders.savgol(KEY, ROW, "value").alias("smooth"))
    return rounded(rows, "detail_4", "detail_8", "smooth", digits=4)


@query("sticky_filter", BASE.replace("WITH s AS", "WITH RECURSIVE s AS") + """,
e AS (SELECT user_id, row_idx, CASE WHEN gr IS NULL THEN 0 ELSE -0.5 * least(power((gr - 50) / 30, 2), 600) END AS g, -2.0::DOUBLE AS d FROM b),
r AS (
  SELECT user_id, row_idx, (0.9 * 0.95 + 0.1 * 0.1)::DOUBLE * exp(g - greatest(g, d)) / ((0.9 * 0.95 + 0.1 * 0.1)::DOUBLE * exp(g - greatest(g, d)) + (1 - (0.9 * 0.95 + 0.1 * 0.1)::DOUBLE) * exp(d - greatest(g, d))) AS p FROM e WHERE row_idx = 0
  UNION ALL
  SELECT e.user_id, e.row_idx, (r.p * 0.95::DOUBLE + (1 - r.p) * 0.1::DOUBLE) * exp(g - greatest(g, d)) / ((r.p * 0.95::DOUBLE + (1 - r.p) * 0.1::DOUBLE) * exp(g - greatest(g, d)) + (1 - (r.p * 0.95::DOUBLE + (1 - r.p) * 0.1::DOUBLE)) * exp(d - greatest(g, d)))
  FROM r JOIN e ON e.user_id = r.user_id AND e.row_idx = r.row_idx + 1)
SELECT user_id, row_idx, round(p, 6) AS p_good FROM r""")
def sticky_filter(spark, sf_dir):
    from seriesloom.functions.scalars import gaussian_log_emission
    from seriesloom.operators import decoders

    rows = base(spark, sf_dir).select(KEY, ROW, gaussian_log_emission("gr", F.lit(50.0), 30.0).alias("good"), F.lit(-2.0).alias("bad"))
    return rounded(decoders.sticky_filter(rows, KEY, ROW, "good", "bad", (0.95, 0.9), 0.9), "p_good")


@query("segment_thirds", BASE + """,
t AS (SELECT *, least(row_idx * 3 // n, 2) AS k FROM b)
SELECT user_id, round(avg(value) FILTER (k = 0), 6) AS early_mean, round(stddev_pop(value) FILTER (k = 0), 6) AS early_std,
       round(avg(value) FILTER (k = 1), 6) AS middle_mean, round(stddev_pop(value) FILTER (k = 1), 6) AS middle_std,
       round(avg(value) FILTER (k = 2), 6) AS late_mean, round(stddev_pop(value) FILTER (k = 2), 6) AS late_std FROM t GROUP BY user_id""")
def segment_thirds(spark, sf_dir):
    rows = aggregates.segment_summary(base(spark, sf_dir), KEY, ROW, "value")
    return rounded(rows, *(c for c in rows.columns if c != KEY))


