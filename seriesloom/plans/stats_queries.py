"""Queries of statistics, splits and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.operators import augment, splits, stats
from seriesloom.plans.base import BASE, KEY, ROW, base, query, rounded, table


@query("auc_mannwhitney", """
WITH d AS (SELECT l_shipdate >= DATE '1998-01-01' AS y, l_returnflag, l_extendedprice AS s FROM lineitem),
c AS (SELECT l_returnflag, s, count(*) AS k FROM d GROUP BY ALL), r AS (SELECT *, sum(k) OVER (PARTITION BY l_returnflag ORDER BY s) - (k - 1) / 2.0 AS rk FROM c),
g AS (SELECT l_returnflag, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, sum(rk) FILTER (y) AS t, avg(s) FILTER (y) AS mp, avg(s) FILTER (NOT y) AS mq, var_samp(s) FILTER (y) AS vp, var_samp(s) FILTER (NOT y) AS vq FROM d JOIN r USING (l_returnflag, s) GROUP BY ALL),
u AS (SELECT *, t - positives * (positives + 1) / 2.0 AS u FROM g)
SELECT l_returnflag, positives, negatives, round(u / (positives * negatives), 9) AS auc, round(u, 1) AS mann_whitney_u, round(2 * u / (positives * negatives) - 1, 9) AS cliffs_delta, round((mp - mq) / sqrt((vp + vq) / 2), 6) AS smd FROM u""")
def auc_mannwhitney(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("y"), F.col("l_extendedprice").alias("s"))
    got = stats.auc(rows, ["l_returnflag"], "y", "s")
    return rounded(rounded(rounded(got, "auc", "cliffs_delta", digits=9), "mann_whitney_u", digits=1), "smd")


@query("spearman", """
WITH q AS (SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem),
ca AS (SELECT l_returnflag, l_quantity, count(*) AS k FROM q GROUP BY ALL), cb AS (SELECT l_returnflag, l_extendedprice, count(*) AS k FROM q GROUP BY ALL),
a AS (SELECT l_returnflag, l_quantity, sum(k) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - (k - 1) / 2.0 AS ra FROM ca),
b AS (SELECT l_returnflag, l_extendedprice, sum(k) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - (k - 1) / 2.0 AS rb FROM cb)
SELECT l_returnflag, count(*) AS rows, round(corr(CAST(ra AS DOUBLE), CAST(rb AS DOUBLE)), 8) AS rho FROM q JOIN a USING (l_returnflag, l_quantity) JOIN b USING (l_returnflag, l_extendedprice) GROUP BY ALL""")
def spearman(spark, sf_dir):
    return rounded(stats.spearman(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "rho", digits=8)


@query("pearson", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY ALL")
def pearson(spark, sf_dir):
    return rounded(stats.pearson(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "r", digits=8)


@query("bh_qvalues", """
WITH p AS (SELECT c_custkey, ((c_custkey * 7919) % 1000 + 1) / 1000.0::DOUBLE AS p, c_nationkey FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY p, c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM p)
SELECT c_custkey, round(least(1, min(p * n / k) OVER (PARTITION BY c_nationkey ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS q FROM r""")
def bh_qvalues(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (((F.col("c_custkey") * 7919) % 1000 + 1) / 1000).alias("p"))
    return rounded(stats.benjamini_hochberg(rows, "p", "c_custkey", ["c_nationkey"]).select("c_custkey", "q"), "q", digits=9)


@query("ecdf_reference", """
WITH r AS (SELECT n_regionkey, s_acctbal AS x FROM supplier JOIN nation ON s_nationkey = n_nationkey), q AS (SELECT c_custkey, n_regionkey, c_acctbal AS x FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, round((SELECT (count(*) FILTER (r.x < q.x) + count(*) FILTER (r.x = q.x) / 2.0) / nullif(count(*), 0) FROM r WHERE r.n_regionkey = q.n_regionkey), 9) AS pct FROM q""")
def ecdf_reference(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", F.col("s_acctbal").alias("x"))
    q = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey", F.col("c_acctbal").alias("x"))
    return rounded(stats.empirical_percentile(q, r, ["n_regionkey"], "x", "pct").select("c_custkey", "pct"), "pct", digits=9)


@query("ranking_metrics", """
WITH r AS (SELECT l_orderkey, l_returnflag = 'R' AS hit, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_linenumber) AS k FROM lineitem), f AS (SELECT l_orderkey, min(k) FILTER (hit) AS r FROM r GROUP BY ALL)
SELECT count(*) AS events, round(avg(coalesce(1.0 / r, 0)), 9) AS mrr, round(avg(coalesce((r <= 1)::INT, 0)), 9) AS top1, round(avg(coalesce((r <= 3)::INT, 0)), 9) AS top3 FROM f""")
def ranking_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("hit"), F.col("l_extendedprice").alias("s"), F.struct("l_partkey", "l_linenumber").alias("tie"))
    return rounded(stats.ranking_metrics(rows, "l_orderkey", "hit", "s", "tie"), "mrr", "top1", "top3", digits=9)


@query("lift_quintiles", """
WITH e AS (SELECT quantile_cont(l_extendedprice, 0.2) AS a, quantile_cont(l_extendedprice, 0.4) AS b, quantile_cont(l_extendedprice, 0.6) AS c, quantile_cont(l_extendedprice, 0.8) AS d, avg((l_returnflag = 'R')::INT) AS base FROM lineitem),
k AS (SELECT CAST(1 + (l_extendedprice > a)::INT + (l_extendedprice > b)::INT + (l_extendedprice > c)::INT + (l_extendedprice > d)::INT AS INTEGER) AS bucket, l_returnflag = 'R' AS hit, base FROM lineitem, e)
SELECT bucket, count(*) AS rows, count(*) FILTER (hit) AS hits, round(avg(hit::INT), 9) AS rate, round(avg(hit::INT) / max(base), 6) AS lift FROM k GROUP BY bucket""")
def lift_quintiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("hit", F.col("l_returnflag") == "R")
    return rounded(rounded(stats.lift_by_bucket(rows, "l_extendedprice", "l_orderkey", "hit", 5), "rate", digits=9), "lift")


@query("psi_drift", BASE + """,
x AS (SELECT CASE WHEN known IS NOT NULL THEN 'train' ELSE 'test' END AS side, gr, (gr >= 10)::INT + (gr >= 30)::INT + (gr >= 60)::INT + (gr >= 120)::INT AS bin FROM b),
c AS (SELECT bin, count(*) FILTER (side = 'train') AS p, count(*) FILTER (side = 'test') AS q FROM x WHERE gr IS NOT NULL GROUP BY bin),
z AS (SELECT greatest(p / (SELECT sum(p) FROM c), 1e-4) AS p, greatest(q / (SELECT sum(q) FROM c), 1e-4) AS q FROM c)
SELECT round((SELECT sum((q - p) * ln(q / p)) FROM z), 8) AS psi,
       round((avg(gr) FILTER (side = 'test') - avg(gr) FILTER (side = 'train')) / sqrt((var_samp(gr) FILTER (side = 'train') + var_samp(gr) FILTER (side = 'test')) / 2), 8) AS smd,
       round(avg((gr IS NULL)::INT) FILTER (side = 'train'), 8) AS missing_train, round(avg((gr IS NULL)::INT) FILTER (side = 'test'), 8) AS missing_test FROM x""")
def psi_drift(spark, sf_dir):
    rows = base(spark, sf_dir)
    return rounded(stats.drift(rows.where("known is not null"), rows.where("known is null"), "gr", [10, 30, 60, 120]), "psi", "smd", "missing_train", "missing_test", digits=8)


@query("stable_sample", """
SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY sha256('pick::' || user_id), user_id LIMIT (SELECT CAST(round_even(count(DISTINCT user_id) * 0.3::DOUBLE, 0) AS BIGINT) FROM events)""")
def stable_sample(spark, sf_dir):
    return splits.stable_sample(table(spark, sf_dir, "events"), KEY, 0.3, "pick")


@query("group_kfold", """
WITH RECURSIVE g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n DESC, user_id) AS i, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)),
r AS (
  SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, [0, 0, 0, 0, 0]::BIGINT[] AS held
  UNION ALL
  SELECT g.i, list_transform(load, lambda x, j: x + CASE WHEN j = list_position(load, list_min(load)) THEN g.n ELSE 0 END), list_transform(held, lambda x, j: x + CASE WHEN j = list_position(load, list_min(load)) THEN 1 ELSE 0 END)
  FROM r JOIN g ON g.i = r.i + 1)
SELECT CAST(k - 1 AS INTEGER) AS fold, held[k] AS groups, load[k] AS rows FROM (SELECT * FROM r ORDER BY i DESC LIMIT 1), range(1, 6) t(k) WHERE held[k] > 0""")
def group_kfold(spark, sf_dir):
    sizes = table(spark, sf_dir, "events").groupBy(KEY).agg(F.count("*").alias("rows"))
    return splits.group_kfold(sizes, KEY, "rows", 5).join(sizes, KEY).groupBy("fold").agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"))


@query("capped_rows", """
SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sha256('cap::' || event_id), event_id) AS k FROM events) WHERE k <= 10""")
def capped_rows(spark, sf_dir):
    return splits.capped_rows(table(spark, sf_dir, "events"), KEY, "event_id", 10).select(KEY, "event_id")


@query("stratified_holdout", """
WITH g AS (SELECT user_id, count(*) AS c, avg(value) AS v FROM events GROUP BY ALL), e AS (SELECT quantile_cont(c, 0.5) AS ec, quantile_cont(v, 0.5) AS ev FROM g),
s AS (SELECT user_id, CAST((c > ec)::INT AS VARCHAR) || '-' || CAST((v > ev)::INT AS VARCHAR) AS stratum FROM g, e)
SELECT user_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY sha256('hold::' || user_id), user_id) <= round_even(count(*) OVER (PARTITION BY stratum) * 0.25::DOUBLE, 0) AS held FROM s""")
def stratified_holdout(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(KEY).agg(F.count("*").alias("c"), F.avg("value").alias("v"))
    return splits.stratified_holdout(g, KEY, ["c", "v"], 2, 0.25, "hold")


@query("pseudo_mask", BASE + """,
k AS (SELECT *, count(known) OVER (PARTITION BY user_id ORDER BY row_idx) AS p, count(known) OVER (PARTITION BY user_id) AS c FROM b)
SELECT user_id, row_idx, CASE WHEN p <= floor(c * 0.5::DOUBLE) THEN known END AS masked FROM k""")
def pseudo_mask(spark, sf_dir):
    return splits.pseudo_mask(base(spark, sf_dir), KEY, ROW, "known", 0.5, "masked").select(KEY, ROW, "masked")


@query("sampled_positions", BASE + "SELECT user_id, row_idx FROM b WHERE row_idx % 8 = 0 OR event_type = 'signup' OR row_idx = n - 1")
def sampled_positions(spark, sf_dir):
    return splits.sampled_positions(base(spark, sf_dir), KEY, ROW, 8, F.col("event_type") == "signup").select(KEY, ROW)


@query("shuffled_control", BASE + """,
a AS (SELECT user_id, row_idx, value, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) AS p, row_number() OVER (PARTITION BY user_id ORDER BY sha256('control::' || row_idx), row_idx) AS q FROM b)
SELECT a.user_id, a.row_idx, d.value AS control FROM a JOIN a d ON a.user_id = d.user_id AND a.p = d.q""")
def shuffled_control(spark, sf_dir):
    return splits.shuffled_within(base(spark, sf_dir).select(KEY, ROW, "value"), KEY, ROW, "value", "control").select(KEY, ROW, "control")


@query("nested_plan", """
WITH f AS (SELECT user_id, CAST((row_number() OVER (ORDER BY sha256('fold::' || user_id)) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM events))
SELECT CAST(o AS INTEGER) AS outer, CAST(i AS INTEGER) AS inner, CASE WHEN fold = o THEN 'test' WHEN fold = i THEN 'validate' ELSE 'train' END AS role, count(*) AS groups FROM f, range(5) a(o), range(5) b(i) WHERE o <> i GROUP BY ALL""".replace(" AS outer", ' AS "outer"').replace(" AS inner", ' AS "inner"'))
def nested_plan(spark, sf_dir):
    return splits.nested_plan(splits.sha_folds(table(spark, sf_dir, "events"), KEY, 5, "fold"), KEY, "fold", 5).groupBy("outer", "inner", "role").agg(F.count("*").alias("groups"))


@query("datum_shift", BASE + """,
u AS (SELECT user_id, [-20.0::DOUBLE, -5.0::DOUBLE, 5.0::DOUBLE, 20.0::DOUBLE][1 + CAST(('0x' || substr(sha256('datum::' || user_id), 1, 15))::BIGINT % 4 AS INTEGER)] AS shift FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 0)
SELECT user_id, row_idx, tvt, known, false AS augmented FROM b UNION ALL SELECT user_id, row_idx, round(tvt + shift, 6), round(known + shift, 6), true FROM b JOIN u USING (user_id)""")
def datum_shift(spark, sf_dir):
    rows = base(spark, sf_dir).select(KEY, ROW, "tvt", "known")
    chosen = rows.where("user_id % 3 = 0").select(KEY).distinct().withColumn("shift", augment.shift_for(KEY, [-20.0, -5.0, 5.0, 20.0]))
    return rounded(augment.datum_shift(rows, chosen, KEY, "shift", ["tvt", "known"]), "tvt", "known")


@query("residual_transplant", BASE + """,
r AS (SELECT user_id, row_idx, value - 50 AS res, row_idx // 16 AS blk, row_idx % 16 AS o FROM b),
h AS (SELECT *, row_number() OVER (PARTITION BY blk ORDER BY sha256('0::' || user_id), user_id) - 1 AS i, count(*) OVER (PARTITION BY blk) AS c FROM (SELECT DISTINCT user_id, blk FROM r)),
d AS (SELECT a.user_id, a.blk, g.user_id AS donor FROM h a JOIN h g ON a.blk = g.blk AND g.i = (a.i + 1) % a.c)
SELECT r.user_id, r.row_idx, round(g.res, 6) + 0.0 AS given FROM r JOIN d USING (user_id, blk) LEFT JOIN r g ON g.user_id = donor AND g.blk = r.blk AND g.o = r.o""")
def residual_transplant(spark, sf_dir):
    rows = base(spark, sf_dir).select(KEY, ROW, (F.col("value") - 50).alias("res"))
    return augment.transplanted(rows, KEY, ROW, "res", 16, "given").select(KEY, ROW, (F.round("given", 6) + 0.0).alias("given"))


@query("envelope_guard", BASE + """,
q AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM b WHERE known IS NOT NULL)
SELECT 'value' AS "column", round(avg((value BETWEEN lo AND hi)::INT), 9) AS inside, avg((value BETWEEN lo AND hi)::INT) >= 0.9 AS ok FROM b, q WHERE known IS NULL""")
def envelope_guard(spark, sf_dir):
    rows = base(spark, sf_dir)
    return rounded(augment.envelope(rows.where("known is null"), rows.where("known is not null"), ["value"]), "inside", digits=9)


@query("pseudo_starts", BASE + """,
p AS (SELECT *, count(known) OVER (PARTITION BY user_id ORDER BY row_idx) AS k, count(known) OVER (PARTITION BY user_id) AS c FROM b)
SELECT start_part, user_id, count(CASE WHEN k <= floor(c * start_part) THEN known END) AS kept FROM p, (VALUES (0.5::DOUBLE), (0.75::DOUBLE)) v(start_part) GROUP BY ALL""")
def pseudo_starts(spark, sf_dir):
    return augment.pseudo_starts(base(spark, sf_dir), KEY, ROW, "known", [0.5, 0.75]).groupBy("start_part", KEY).agg(F.count("masked").alias("kept"))
