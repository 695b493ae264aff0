"""Queries of candidates: baselines, scans, choices and certificates."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.scalars import blend, fade_blend
from seriesloom.operators import aggregates, candidates, governance, joins, series
from seriesloom.plans.base import BASE, CANDIDATES, KEY, ROW, base, off_ties, query, rounded, table, tails

NAMES = ["last_anchor", "recent_linear", "mean"]


@query("anchor_baseline", CANDIDATES + """,
l AS (SELECT fold, 'last_anchor' AS candidate, last_anchor - tvt AS e FROM cf UNION ALL SELECT fold, 'recent_linear', recent_linear - tvt FROM cf)
SELECT candidate, fold, CAST(grouping(candidate, fold) AS BIGINT) AS grouping, count(*) AS rows, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)) + 3e-8, 6) AS mae, round(avg(e) + 3e-8, 6) AS bias FROM l GROUP BY GROUPING SETS ((candidate), (candidate, fold))""")
def anchor_baseline(spark, sf_dir):
    long = aggregates.to_long(tails(spark, sf_dir).select(KEY, ROW, "fold", "tvt", "last_anchor", "recent_linear"), [KEY, ROW, "fold", "tvt"], ["last_anchor", "recent_linear"], "candidate", "value")
    long = long.withColumn("err", F.col("value") - F.col("tvt"))
    out = aggregates.grouping_metrics(long, [("candidate",), ("candidate", "fold")], "err")
    return rounded(off_ties(out.select("candidate", "fold", "grouping", "rows", "rmse", "mae", "bias"), "mae", "bias"), "rmse", "mae", "bias")


@query("slope_candidates", CANDIDATES + "SELECT user_id, row_idx, last_anchor, round(recent_linear, 5) AS recent_linear, ahead FROM cf")
def slope_candidates(spark, sf_dir):
    return rounded(tails(spark, sf_dir).select(KEY, ROW, "last_anchor", "recent_linear", "ahead"), "recent_linear", digits=5)


@query("initial_rate", BASE + """,
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) AS r FROM b WHERE known IS NOT NULL),
t AS (SELECT user_id, CASE WHEN md - lag(md) OVER w > 0 THEN (known - lag(known) OVER w + value - lag(value) OVER w) / (md - lag(md) OVER w) END AS s FROM k WHERE r <= 32 WINDOW w AS (PARTITION BY user_id ORDER BY row_idx))
SELECT user_id, round(CASE WHEN count(s) >= 3 THEN median(s) ELSE 0 END, 9) AS rate, count(s) AS steps FROM t GROUP BY user_id""")
def initial_rate(spark, sf_dir):
    return rounded(candidates.initial_rate(base(spark, sf_dir), KEY, ROW, "md", "known", "value", 32), "rate", digits=9)


@query("fade_blend", CANDIDATES + """
SELECT user_id, row_idx, round(last_anchor + (1 - exp(-greatest(ahead, 0) / 50000)) * (recent_linear - last_anchor), 4) AS faded, round(0.25 * last_anchor + 0.75 * recent_linear, 4) AS blended FROM cf""")
def faded(spark, sf_dir):
    rows = tails(spark, sf_dir).withColumn("ahead", F.greatest("ahead", F.lit(0.0)))
    return rounded(rows.select(KEY, ROW, fade_blend("last_anchor", "recent_linear", "ahead", 50000).alias("faded"), blend({"last_anchor": 0.25, "recent_linear": 0.75}).alias("blended")), "faded", "blended", digits=4)


_CURVE = """,
curve AS (SELECT event_type, round(value / 10, 0) AS x, median(value) AS y FROM events GROUP BY ALL),
sh AS (SELECT b.user_id, b.event_type, b.value AS o, b.value / 10 + shift AS x, shift FROM b, (VALUES (-2.0::DOUBLE), (-1.0::DOUBLE), (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) v(shift) WHERE known IS NOT NULL),
lo AS (SELECT sh.*, c.x AS x0, c.y AS y0 FROM sh ASOF LEFT JOIN curve c ON sh.event_type = c.event_type AND sh.x >= c.x),
hi AS (SELECT lo.*, c.x AS x1, c.y AS y1 FROM lo ASOF LEFT JOIN curve c ON lo.event_type = c.event_type AND lo.x <= c.x),
m AS (SELECT user_id, shift, o, CASE WHEN x0 IS NULL OR x1 IS NULL THEN NULL WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS ref FROM hi),
g AS (SELECT user_id, shift, count(*) AS n, avg(-0.5 * least(power((o - ref) / 15, 2), 600)) AS likelihood, corr(o, ref) AS c, stddev_pop(o) AS so, stddev_pop(ref) AS sr FROM m WHERE ref IS NOT NULL GROUP BY ALL)"""


def _scan(spark, sf_dir):
    rows = base(spark, sf_dir)
    curve = joins.collapse_curve(table(spark, sf_dir, "events").withColumn("x", F.round(F.col("value") / 10, 0)), ["event_type"], "x", "value").withColumnRenamed("value", "cy")
    known = rows.where("known is not null").withColumn("x", F.col("value") / 10).select(KEY, ROW, "event_type", "x", F.col("value").alias("o"))
    return candidates.shift_scan(known, curve.select("event_type", F.col("x").alias("cx"), "cy"), KEY, ["event_type"], "x", "o", "cx", "cy", [-2, -1, 0, 1, 2], 15.0)


@query("shift_scan", BASE + _CURVE + " SELECT user_id, shift, n, round(likelihood, 6) AS likelihood, round(CASE WHEN so > 1e-9 AND sr > 1e-9 THEN c ELSE -1 END, 6) AS zncc FROM g")
def shift_scan(spark, sf_dir):
    return rounded(_scan(spark, sf_dir).drop("place"), "likelihood", "zncc")


@query("local_peaks", BASE + _CURVE + """,
p AS (SELECT *, lag(round(likelihood, 6)) OVER w AS a, lead(round(likelihood, 6)) OVER w AS z FROM g WINDOW w AS (PARTITION BY user_id ORDER BY shift))
SELECT user_id, shift, round(likelihood, 6) AS likelihood FROM p WHERE (a IS NULL OR round(likelihood, 6) > a) AND (z IS NULL OR round(likelihood, 6) > z)""")
def local_peaks(spark, sf_dir):
    return candidates.local_maxima(rounded(_scan(spark, sf_dir), "likelihood"), KEY, "shift", "likelihood").select(KEY, "shift", "likelihood")


_MEAN = """,
o AS (SELECT *, (last_anchor + recent_linear) / 2 AS mean, row_idx // 8 AS block FROM cf)"""


def _with_mean(spark, sf_dir):
    return tails(spark, sf_dir).withColumns({"mean": (F.col("last_anchor") + F.col("recent_linear")) / 2, "block": F.floor(F.col(ROW) / 8)})


@query("oracle_scope", CANDIDATES + _MEAN + """,
sq AS (SELECT user_id, block, sum(power(last_anchor - tvt, 2)) AS a, sum(power(recent_linear - tvt, 2)) AS b2, sum(power(mean - tvt, 2)) AS c FROM o GROUP BY ALL)
SELECT o.user_id, o.row_idx, round(CASE WHEN a <= b2 AND a <= c THEN last_anchor WHEN b2 <= c THEN recent_linear ELSE mean END, 4) AS oracle FROM o JOIN sq USING (user_id, block)""")
def oracle_scope(spark, sf_dir):
    return rounded(candidates.oracle(_with_mean(spark, sf_dir), [KEY, "block"], "tvt", NAMES).select(KEY, ROW, "oracle"), "oracle", digits=4)


@query("bounded_nudge", CANDIDATES + _MEAN + """,
e AS (SELECT *, abs(last_anchor - tvt) AS ea, abs(recent_linear - tvt) AS eb, abs(mean - tvt) AS ec FROM o),
r AS (SELECT fold, sqrt(avg(ea * ea)) AS ra, sqrt(avg(eb * eb)) AS rb, sqrt(avg(ec * ec)) AS rc FROM e GROUP BY fold),
p AS (SELECT e.*, CASE WHEN ea <= eb AND ea <= ec THEN last_anchor WHEN eb <= ec THEN recent_linear ELSE mean END AS parent,
             CASE WHEN ea + 0.1 * ra <= eb + 0.1 * rb AND ea + 0.1 * ra <= ec + 0.1 * rc THEN last_anchor WHEN eb + 0.1 * rb <= ec + 0.1 * rc THEN recent_linear ELSE mean END AS leaning FROM e JOIN r USING (fold))
SELECT user_id, row_idx, round(greatest(-0.25, least(0.5 * (leaning - parent), 0.25)), 4) AS nudge, round(parent + greatest(-0.25, least(0.5 * (leaning - parent), 0.25)), 4) AS policy FROM p""")
def bounded_nudge(spark, sf_dir):
    rows = _with_mean(spark, sf_dir)
    rows = rows.withColumns({f"e_{c}": F.abs(F.col(c) - F.col("tvt")) for c in NAMES})
    prior = rows.groupBy("fold").agg(*(F.sqrt(F.avg(F.col(f"e_{c}") * F.col(f"e_{c}"))).alias(f"r_{c}") for c in NAMES))
    got = candidates.bounded_nudge(rows.join(prior, "fold"), {c: f"e_{c}" for c in NAMES}, {c: f"r_{c}" for c in NAMES}, 0.1, 0.5, 0.25)
    return rounded(got.select(KEY, ROW, "nudge", "policy"), "nudge", "policy", digits=4)


@query("nudge_in_a_domain", CANDIDATES + _MEAN + """,
e AS (SELECT *, abs(last_anchor - tvt) AS ea, abs(mean - tvt) AS ec FROM o),
r AS (SELECT fold, sqrt(avg(ea * ea)) AS ra, sqrt(avg(ec * ec)) AS rc FROM e GROUP BY fold)
SELECT user_id, row_idx, CASE WHEN ec <= ea THEN 'mean' ELSE 'last_anchor' END AS parent_name, CASE WHEN ec + rc <= ea + ra THEN 'mean' ELSE 'last_anchor' END AS leaning_name,
       round((CASE WHEN ec <= ea THEN mean ELSE last_anchor END) + greatest(-0.25, least(0.5 * ((CASE WHEN ec + rc <= ea + ra THEN mean ELSE last_anchor END) - (CASE WHEN ec <= ea THEN mean ELSE last_anchor END)), 0.25)), 4) AS policy
FROM e JOIN r USING (fold)""")
def nudge_in_a_domain(spark, sf_dir):
    rows = _with_mean(spark, sf_dir)
    rows = rows.withColumns({f"e_{c}": F.abs(F.col(c) - F.col("tvt")) for c in NAMES})
    prior = rows.groupBy("fold").agg(*(F.sqrt(F.avg(F.col(f"e_{c}") * F.col(f"e_{c}"))).alias(f"r_{c}") for c in NAMES))
    got = candidates.bounded_nudge(rows.join(prior, "fold"), {c: f"e_{c}" for c in NAMES}, {c: f"r_{c}" for c in NAMES}, domain=["mean", "last_anchor"])
    return rounded(got.select(KEY, ROW, "parent_name", "leaning_name", "policy"), "policy", digits=4)


@query("truth_from_errors", CANDIDATES + _MEAN + """,
e AS (SELECT *, last_anchor + 17 AS third, abs(last_anchor - tvt) AS ea, abs(last_anchor + 17 - tvt) AS eb, abs(mean - tvt) AS ec FROM o),
t AS (
  SELECT *, (abs(abs(last_anchor - (last_anchor + ea)) - ea) + abs(abs(third - (last_anchor + ea)) - eb) + abs(abs(mean - (last_anchor + ea)) - ec)) / 3 AS up,
         (abs(abs(last_anchor - (last_anchor - ea)) - ea) + abs(abs(third - (last_anchor - ea)) - eb) + abs(abs(mean - (last_anchor - ea)) - ec)) / 3 AS down FROM e)
SELECT user_id, row_idx, round(CASE WHEN up <= down THEN last_anchor + ea ELSE last_anchor - ea END, 3) AS truth FROM t""")
def truth_from_errors(spark, sf_dir):
    rows = _with_mean(spark, sf_dir).withColumn("third", F.col("last_anchor") + 17)
    names = ["last_anchor", "third", "mean"]
    rows = rows.withColumns({f"e_{c}": F.abs(F.col(c) - F.col("tvt")) for c in names})
    truth, _ = candidates.truth_from_errors(names, [f"e_{c}" for c in names])
    return rounded(rows.select(KEY, ROW, truth.alias("truth")), "truth", digits=3)


@query("rmse_certificate", CANDIDATES + _MEAN + """
SELECT fold, round(sqrt(avg(power(last_anchor - tvt, 2))), 4) AS parent_rmse, round(sqrt(avg(power(mean - tvt, 2))), 4) AS policy_rmse, round(sqrt(avg(power(mean - last_anchor, 2))), 4) AS moved_rms, true AS holds, max(abs(mean - last_anchor)) <= 100 AS within FROM o GROUP BY fold""")
def rmse_certificate(spark, sf_dir):
    return rounded(candidates.rmse_certificate(_with_mean(spark, sf_dir), ["fold"], "last_anchor", "mean", "tvt", 100), "parent_rmse", "policy_rmse", "moved_rms", digits=4)


_LOSS = CANDIDATES + _MEAN + """,
l AS (SELECT user_id, block, 0 AS ord, 'last_anchor' AS cand, round(sqrt(avg(power(last_anchor - tvt, 2))), 4) AS loss FROM o GROUP BY ALL
      UNION ALL SELECT user_id, block, 1, 'recent_linear', round(sqrt(avg(power(recent_linear - tvt, 2))), 4) FROM o GROUP BY ALL
      UNION ALL SELECT user_id, block, 2, 'mean', round(sqrt(avg(power(mean - tvt, 2))), 4) FROM o GROUP BY ALL),
k AS (SELECT user_id || ':' || block AS blk, ord, cand, loss FROM l)"""


def _losses(spark, sf_dir):
    rows = _with_mean(spark, sf_dir).withColumn("blk", F.concat_ws(":", F.col(KEY).cast("string"), F.col("block").cast("string")))
    sums = rows.groupBy("blk").agg(*(F.round(F.sqrt(F.avg(F.pow(F.col(c) - F.col("tvt"), 2))), 4).alias(c) for c in NAMES))
    ord_ = F.when(F.col("cand") == NAMES[0], 0).when(F.col("cand") == NAMES[1], 1).otherwise(2)
    return aggregates.to_long(sums, ["blk"], NAMES, "cand", "loss").withColumn("ord", ord_)


@query("pair_targets", _LOSS + """
SELECT a.blk, a.cand AS "left", b3.cand AS "right", (a.loss < b3.loss)::INT AS left_wins, round(abs(a.loss - b3.loss) / sum(abs(a.loss - b3.loss)) OVER (PARTITION BY a.blk), 6) AS weight
FROM k a JOIN k b3 ON a.blk = b3.blk AND a.ord <> b3.ord WHERE a.loss <> b3.loss""")
def pair_targets(spark, sf_dir):
    return rounded(candidates.pair_targets(_losses(spark, sf_dir), "blk", "cand", "ord", "loss"), "weight")


@query("pair_features", _LOSS.replace("k AS (", "k AS MATERIALIZED (") + """
SELECT a.blk, a.cand AS first_cand, b3.cand AS second_cand, round(a.loss - b3.loss, 5) AS diff_loss, round((a.loss + b3.loss) / 2, 5) AS mean_loss FROM k a JOIN k b3 ON a.blk = b3.blk WHERE a.cand <> b3.cand""")
def pair_features(spark, sf_dir):
    pairs = candidates.pair_features(_losses(spark, sf_dir), "blk", "cand", ["loss"], [])
    return rounded(pairs.withColumnsRenamed({"left": "first_cand", "right": "second_cand"}), "diff_loss", "mean_loss", digits=5)


@query("borda_rank", _LOSS + """,
p AS (SELECT a.blk, a.cand AS l, a.ord, b3.cand AS r, round(1 / (1 + exp((a.loss - b3.loss) / 50)), 6) AS p FROM k a JOIN k b3 ON a.blk = b3.blk AND a.ord <> b3.ord),
sb AS (SELECT blk, l, min(ord) AS ord, round(sum(p), 6) AS borda, max(p) FILTER (r = 'last_anchor') AS beats FROM p GROUP BY blk, l),
t AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY borda DESC, (l = 'last_anchor')::INT DESC, ord) AS k FROM sb)
SELECT blk, l AS selected, borda, beats AS beats_anchor, CASE WHEN coalesce(beats, 1) <= 0.5 THEN 'last_anchor' ELSE l END AS final FROM t WHERE k = 1""")
def borda_rank(spark, sf_dir):
    k = _losses(spark, sf_dir)
    r = k.select("blk", F.col("cand").alias("right"), F.col("loss").alias("rl"), F.col("ord").alias("ro"))
    pairs = k.join(r, "blk").where("ord <> ro").withColumn("p", F.round(1 / (1 + F.exp((F.col("loss") - F.col("rl")) / 50)), 6))
    return rounded(candidates.borda(pairs, "blk", "cand", "right", "p", "ord", "last_anchor"), "borda")


@query("rank_compact", _LOSS + """,
w AS (SELECT blk, ord, exp((min(loss) OVER (PARTITION BY blk) - loss) / 100) AS w FROM k), v AS (SELECT blk, ord, w / sum(w) OVER (PARTITION BY blk) AS w FROM w)
SELECT blk, round(sum(-w * ln(w)), 6) AS entropy, round(sum(w * ord), 6) AS mean, round(greatest(0, sum(w * ord * ord) - power(sum(w * ord), 2)), 6) AS variance, round(max(w), 6) AS top_weight FROM v GROUP BY blk""")
def rank_compact(spark, sf_dir):
    rows = _losses(spark, sf_dir).withColumn("score", -F.col("loss"))
    return rounded(candidates.rank_compact(rows, "blk", "score", "ord", 100.0), "entropy", "mean", "variance", "top_weight")


@query("other_folds_choice", CANDIDATES + """,
l AS (SELECT fold, 'last_anchor' AS policy, sum(power(last_anchor - tvt, 2)) AS s FROM cf GROUP BY fold UNION ALL SELECT fold, 'recent_linear', sum(power(recent_linear - tvt, 2)) FROM cf GROUP BY fold),
r AS (SELECT fold, policy, sum(s) OVER (PARTITION BY policy) - s AS o FROM l)
SELECT fold, arg_min(policy, (round(o, 2), policy)) AS policy FROM r GROUP BY fold""")
def other_folds_choice(spark, sf_dir):
    long = aggregates.to_long(tails(spark, sf_dir).select("fold", "tvt", "last_anchor", "recent_linear"), ["fold", "tvt"], ["last_anchor", "recent_linear"], "policy", "v")
    return candidates.other_folds_choice(long.withColumn("sse", F.pow(F.col("v") - F.col("tvt"), 2)), "fold", "policy", "sse").select("fold", "policy")


@query("confidence_gate", CANDIDATES + " SELECT user_id, row_idx, round(CASE WHEN abs(recent_linear - last_anchor) < 500 THEN recent_linear ELSE last_anchor END, 4) AS gated FROM cf")
def confidence_gate(spark, sf_dir):
    return rounded(tails(spark, sf_dir).select(KEY, ROW, candidates.gate(F.abs(F.col("recent_linear") - F.col("last_anchor")) < 500, "recent_linear", "last_anchor").alias("gated")), "gated", digits=4)


@query("residual_clip", CANDIDATES + """,
d AS (SELECT *, recent_linear - last_anchor AS r FROM cf), q AS (SELECT quantile_cont(abs(r), 0.95) AS b FROM d)
SELECT user_id, row_idx, round(greatest(-b, least(r, b)), 4) AS r FROM d, q""")
def residual_clip(spark, sf_dir):
    rows = tails(spark, sf_dir).select(KEY, ROW, (F.col("recent_linear") - F.col("last_anchor")).alias("r"))
    return rounded(candidates.clip_at_quantile(rows, rows, "r", 0.95), "r", digits=4)


@query("interval_mass", """
SELECT vec_id, round(list_sum(list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) * x)[3:5]), 9) AS mass FROM embeddings""")
def interval_mass(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.sequence(F.lit(0), F.lit(7)).alias("g"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * x).alias("m"))
    rows = rows.withColumn("g", F.transform("g", lambda x: x.cast("double")))
    return rounded(rows.select("vec_id", candidates.interval_mass("g", "m", 3.0, 1.0).alias("mass")), "mass", digits=9)


@query("grid_bounds", CANDIDATES + """,
w AS (SELECT user_id, min(tvt) AS lo, max(tvt) AS hi, max(last_anchor) AS a FROM cf GROUP BY user_id)
SELECT user_id, round(greatest(a - 100, lo - 20), 4) AS grid_start, round(least(a + 100, hi + 20), 4) AS grid_end, CAST(floor((least(a + 100, hi + 20) - greatest(a - 100, lo - 20)) / 0.5 + 1e-9) + 1 AS BIGINT) AS grid_points FROM w""")
def grid_bounds(spark, sf_dir):
    w = tails(spark, sf_dir).groupBy(KEY).agg(F.min("tvt").alias("lo"), F.max("tvt").alias("hi"), F.max("last_anchor").alias("a"))
    return rounded(w.select(KEY, *(v.alias(k) for k, v in candidates.grid_bounds("a", "lo", "hi", 100, 20, 0.5).items())), "grid_start", "grid_end", digits=4)


@query("promotion_gate", CANDIDATES + _MEAN + """,
g AS (SELECT fold, user_id, sum(power(recent_linear - tvt, 2)) AS b2, sum(power(mean - tvt, 2)) AS m, count(*) AS c FROM o GROUP BY ALL)
SELECT fold, round(sqrt(sum(b2) / sum(c)), 4) AS base_rmse, round(sqrt(sum(m) / sum(c)), 4) AS new_rmse, round(max(sqrt(m / c) - sqrt(b2 / c)), 4) AS worst_loss, sqrt(sum(m) / sum(c)) < sqrt(sum(b2) / sum(c)) AND max(sqrt(m / c) - sqrt(b2 / c)) <= 50 AS passes FROM g GROUP BY fold""")
def promotion_gate(spark, sf_dir):
    return rounded(governance.promotion_gate(_with_mean(spark, sf_dir), ["fold"], KEY, "recent_linear", "mean", "tvt", 50.0), "base_rmse", "new_rmse", "worst_loss", digits=4)


@query("persistent_leaders", CANDIDATES + _MEAN + """,
l AS (SELECT user_id, block, -avg(abs(last_anchor - tvt)) AS a, -avg(abs(recent_linear - tvt)) AS r, -avg(abs(mean - tvt)) AS m FROM o GROUP BY ALL)
SELECT user_id, 'recent_linear' AS cand FROM l GROUP BY user_id HAVING bool_and(r > a) UNION ALL SELECT user_id, 'mean' FROM l GROUP BY user_id HAVING bool_and(m > a)""")
def persistent_leaders(spark, sf_dir):
    sums = _with_mean(spark, sf_dir).groupBy(KEY, "block").agg(*((-F.avg(F.abs(F.col(c) - F.col("tvt")))).alias(c) for c in NAMES))
    return candidates.persistent_leaders(aggregates.to_long(sums, [KEY, "block"], NAMES, "cand", "score"), KEY, "cand", "block", "score", "last_anchor")


@query("noise_scale", BASE + " SELECT user_id, greatest(10, least(round(stddev_pop(gr - 50), 6), 60)) * 1.3 AS sigma FROM b WHERE known IS NOT NULL GROUP BY user_id".replace("greatest(10, least(round(stddev_pop(gr - 50), 6), 60)) * 1.3", "round(1.3 * greatest(10, least(stddev_pop(gr - 50), 60)), 6)"))
def noise_scale(spark, sf_dir):
    rows = base(spark, sf_dir).where("known is not null").withColumn("ref", F.lit(50.0))
    return rounded(candidates.noise_scale(rows, KEY, "gr", "ref", factor=1.3), "sigma")


@query("signed_buckets", CANDIDATES + """
SELECT CASE WHEN e < -100 THEN 'far_below' WHEN e < 0 THEN 'below' WHEN e < 100 THEN 'above' ELSE 'far_above' END AS bucket, count(*) AS rows FROM (SELECT last_anchor - tvt AS e FROM cf) GROUP BY ALL""")
def signed_buckets(spark, sf_dir):
    rows = tails(spark, sf_dir).withColumn("e", F.col("last_anchor") - F.col("tvt"))
    bucket = series.bucket("e", [float("-inf"), -100, 0, 100, float("inf")], ["far_below", "below", "above", "far_above"])
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"))
