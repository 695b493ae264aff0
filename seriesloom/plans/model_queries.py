"""Queries of models out of fold. Boosting and search are held against their rules by tests, what has a closed form against SQL."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged
from seriesloom.operators import decoders, models, tuning
from seriesloom.plans.base import CANDIDATES, FOLDS, KEY, ROW, folds, query, rounded, table, tails
from seriesloom.plans.decoder_queries import _features

FEATURES = ["last_anchor", "recent_linear", "ahead", "gr", "gr__missing"]
#: Parameters of the searched linear model.
SPACE = {"regParam": tuning.Range(1e-3, 1e3, log=True), "elasticNetParam": tuning.Range(0.0, 1.0)}


def _with_residual(spark, sf_dir):
    """Tail rows with the linear model's prediction, out of fold, and what it leaves."""
    rows = _features(spark, sf_dir)
    base = models.out_of_fold(rows, "fold", 5, lambda d: models.linear(FEATURES, "tvt").fit(d))
    base = base.select(*rows.columns, F.col("prediction").alias("base"))
    return staged(base.withColumn("residual", F.col("tvt") - F.col("base")), "residual")


def _boosted(spark, sf_dir):
    return tuning.boosted_out_of_fold(_with_residual(spark, sf_dir), FEATURES, "residual", "fold", 5, KEY, trees=20)


@query("boosted_out_of_fold")
def boosted_out_of_fold(spark, sf_dir):
    """For each fold its rows, the trees that its model kept, and the errors of the linear model with and without them."""
    got = _boosted(spark, sf_dir)
    error = lambda c: F.sqrt(F.avg(F.pow(c - F.col("tvt"), 2)))
    sums = got.rows.groupBy("fold").agg(F.count("*").alias("rows"), error(F.col("base")).alias("linear_rmse"), error(F.col("base") + F.col("prediction")).alias("rmse"))
    trees = spark.createDataFrame(list(enumerate(got.trees)), "fold int, trees int")
    return rounded(sums.join(F.broadcast(trees), "fold"), "linear_rmse", "rmse", digits=3)


@query("boosted_importances")
def boosted_importances(spark, sf_dir):
    """How much each feature lowers the loss, as a mean over the folds' models."""
    return rounded(spark.createDataFrame(tuning.mean_importances(_boosted(spark, sf_dir), FEATURES), "feature string, importance double"), "importance", digits=4)


@query("stacked_out_of_fold", CANDIDATES + """,
u AS (SELECT fold, count(*) AS rows, sum(last_anchor * last_anchor) AS g00, sum(last_anchor * recent_linear) AS g01, sum(recent_linear * recent_linear) AS g11, sum(last_anchor * tvt) AS b0, sum(recent_linear * tvt) AS b1,
             sqrt(avg(power(last_anchor - tvt, 2))) AS e0, sqrt(avg(power(recent_linear - tvt, 2))) AS e1 FROM cf GROUP BY fold),
o AS (SELECT a.fold, sum(b.g00) + 0.001 AS g00, sum(b.g01) AS g01, sum(b.g11) + 0.001 AS g11, sum(b.b0) AS b0, sum(b.b1) AS b1 FROM u a JOIN u b ON a.fold <> b.fold GROUP BY a.fold),
fit AS (SELECT *, (b0 * g11 - b1 * g01) / (g00 * g11 - g01 * g01) AS v0, (b1 * g00 - b0 * g01) / (g00 * g11 - g01 * g01) AS v1 FROM o),
w AS (SELECT fold, CASE WHEN v0 < 0 THEN 0 WHEN v1 < 0 THEN greatest(0, b0 / g00) ELSE v0 END AS w0, CASE WHEN v1 < 0 THEN 0 WHEN v0 < 0 THEN greatest(0, b1 / g11) ELSE v1 END AS w1 FROM fit)
SELECT fold, rows, round(sqrt(avg(power(w0 * last_anchor + w1 * recent_linear - tvt, 2))), 5) AS stacked_rmse, round(e0, 5) AS last_anchor_rmse, round(e1, 5) AS recent_linear_rmse,
       round(w0, 5) AS w_last_anchor, round(w1, 5) AS w_recent_linear
FROM cf JOIN w USING (fold) JOIN u USING (fold) GROUP BY fold, rows, e0, e1, w0, w1""")
def stacked_out_of_fold(spark, sf_dir):
    """For each fold the non-negative weights of two candidates, fitted on the other folds, and the errors there."""
    rows = staged(tails(spark, sf_dir).select(KEY, ROW, "fold", "last_anchor", "recent_linear", "tvt"), "stack")
    weights = models.stack_weights(rows, "fold", ["last_anchor", "recent_linear"], "tvt")
    stacked = models.stacked(rows, weights, "fold", ["last_anchor", "recent_linear"])
    error = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("tvt"), 2))).alias(f"{c}_rmse")
    got = stacked.groupBy("fold").agg(F.count("*").alias("rows"), error("stacked"), error("last_anchor"), error("recent_linear")).join(weights, "fold")
    return rounded(got, "stacked_rmse", "last_anchor_rmse", "recent_linear_rmse", "w_last_anchor", "w_recent_linear", digits=5)


@query("searched_linear")
def searched_linear(spark, sf_dir):
    """The trials of a search for the penalties of a linear model, by its error in the first fold."""
    rows = _features(spark, sf_dir)
    fill = tuning.Pipeline(stages=models.assembled(FEATURES)).fit(rows.where("fold > 1"))
    ready = staged(fill.transform(rows).select("fold", "features", "tvt"), "ready")
    measure = RegressionEvaluator(labelCol="tvt")

    def loss(values: dict) -> float:
        model = models.LinearRegression(labelCol="tvt", maxIter=50, **values).fit(ready.where("fold > 1"))
        return measure.evaluate(model.transform(ready.where("fold = 1")))

    trials = tuning.searched_by_model(SPACE, loss, rounds=3)
    return rounded(spark.createDataFrame([(i, t.round, t.values["regParam"], t.values["elasticNetParam"], t.loss) for i, t in enumerate(trials)], "trial int, round int, reg_param double, elastic_net double, rmse double"), "rmse", digits=3)


@query("switching_path", CANDIDATES.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """,
h AS MATERIALIZED (SELECT user_id, row_idx, fold, CAST(floor(log2(greatest(ahead, 1))) AS INTEGER) AS far, abs(last_anchor - tvt) AS e0, abs(recent_linear - tvt) AS e1 FROM cf),
u AS (SELECT fold, far, count(*) AS n, sum(e0) AS s0, sum(e1) AS s1 FROM h GROUP BY fold, far),
p AS (
  SELECT fold, far, round(coalesce((sum(s0) OVER a - s0) / nullif(sum(n) OVER a - n, 0), (sum(s0) OVER () - sum(s0) OVER o) / nullif(sum(n) OVER () - sum(n) OVER o, 0), 0), 9) AS c0,
         round(coalesce((sum(s1) OVER a - s1) / nullif(sum(n) OVER a - n, 0), (sum(s1) OVER () - sum(s1) OVER o) / nullif(sum(n) OVER () - sum(n) OVER o, 0), 0), 9) AS c1
  FROM u WINDOW a AS (PARTITION BY far), o AS (PARTITION BY fold)),
x AS MATERIALIZED (SELECT user_id, row_idx, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) AS i, c0, c1 FROM h JOIN p USING (fold, far)),
fw AS (
  SELECT user_id, i, c0 AS t0, c1 AS t1, 0 AS b0, 0 AS b1 FROM x WHERE i = 1
  UNION ALL
  SELECT x.user_id, x.i, least(t0, least(t0, t1) + 50) + c0, least(t1, least(t0, t1) + 50) + c1,
         CASE WHEN t0 <= least(t0, t1) + 50 THEN 0 ELSE 1 END, CASE WHEN t1 <= least(t0, t1) + 50 THEN 1 ELSE 0 END
  FROM fw JOIN x ON x.user_id = fw.user_id AND x.i = fw.i + 1),
bw AS (
  SELECT user_id, i, CASE WHEN t0 <= t1 THEN 0 ELSE 1 END AS k FROM fw WHERE (user_id, i) IN (SELECT (user_id, max(i)) FROM x GROUP BY user_id)
  UNION ALL
  SELECT bw.user_id, bw.i - 1, CASE WHEN k = 0 THEN b0 ELSE b1 END FROM bw JOIN fw ON fw.user_id = bw.user_id AND fw.i = bw.i WHERE bw.i > 1)
SELECT user_id, row_idx, k AS candidate FROM bw JOIN x USING (user_id, i)""")
def switching_path(spark, sf_dir):
    """Of two candidates the one of each row on the cheapest path, by errors that are predicted without the truth of the row's fold.

    A candidate's predicted error is its mean absolute one at rows as far ahead (by powers of 2) in the other folds, or in all that there is elsewhere.
    """
    names = ["last_anchor", "recent_linear"]
    rows = tails(spark, sf_dir).select(KEY, ROW, "fold", F.floor(F.log2(F.greatest("ahead", F.lit(1.0)))).cast("int").alias("far"), "tvt", *names)
    sums = rows.groupBy("fold", "far").agg(F.count("*").alias("n"), *(F.sum(F.abs(F.col(c) - F.col("tvt"))).alias(c) for c in names))
    near, whole, own = (decoders.Window.partitionBy(*k) for k in (["far"], [], ["fold"]))  # sums has a row for each fold and power

    def elsewhere(c: str):
        at_far = (F.sum(c).over(near) - F.col(c)) / F.nullif(F.sum("n").over(near) - F.col("n"), F.lit(0))
        return F.coalesce(at_far, (F.sum(c).over(whole) - F.sum(c).over(own)) / F.nullif(F.sum("n").over(whole) - F.sum("n").over(own), F.lit(0)), F.lit(0.0))

    predicted = sums.select("fold", "far", *(F.round(elsewhere(c), 9).alias(f"cost_{c}") for c in names))
    costs = rows.join(F.broadcast(predicted), ["fold", "far"]).select(KEY, ROW, *(f"cost_{c}" for c in names))

    def run(part):
        part = part.sort_values(ROW)
        return decoders.pd.DataFrame({KEY: part[KEY], ROW: part[ROW], "candidate": decoders.switching_path(part[[f"cost_{c}" for c in names]].to_numpy(), 50.0)})

    return costs.groupBy(KEY).applyInPandas(run, f"{KEY} long, {ROW} long, candidate int")


@query("out_of_fold_line", CANDIDATES + """,
l AS (SELECT o.fold, regr_slope(tvt, recent_linear) AS a, regr_intercept(tvt, recent_linear) AS b FROM (SELECT DISTINCT fold FROM f) o JOIN cf ON cf.fold <> o.fold GROUP BY o.fold)
SELECT fold, count(*) AS rows, round(sqrt(avg(power(a * recent_linear + b - tvt, 2))), 5) AS rmse FROM cf JOIN l USING (fold) GROUP BY fold""")
def out_of_fold_line(spark, sf_dir):
    """The error in each fold of a line that was fitted on the others."""
    rows = staged(tails(spark, sf_dir).select("fold", "recent_linear", "tvt"), "line")
    got = models.out_of_fold(rows, "fold", 5, lambda d: models.linear(["recent_linear"], "tvt").fit(d))
    return rounded(got.groupBy("fold").agg(F.count("*").alias("rows"), F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("tvt"), 2))).alias("rmse")), "rmse", digits=5)


@query("pca_pair", "WITH z AS (SELECT 1)" + FOLDS + """,
u AS (SELECT user_id, fold, count(*)::DOUBLE AS n, sum(value) AS total FROM events JOIN f USING (user_id) GROUP BY ALL),
d AS (SELECT stddev_samp(n) AS sn, stddev_samp(total) AS st, corr(n, total) AS r FROM u WHERE fold <> 0)
SELECT user_id, round((n / sn + CASE WHEN r > 0 THEN total / st END) / sqrt(2), 6) AS axis FROM u, d WHERE fold = 0""")
def pca_pair(spark, sf_dir):
    """Users of the first fold on the axis of the others' counts and sums, which grow together: of two scaled numbers both load alike."""
    users = table(spark, sf_dir, "events").groupBy(KEY).agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("total")).join(folds(spark, sf_dir), KEY)
    got = models.first_axis(users.where("fold <> 0"), users.where("fold = 0"), ["n", "total"], "axis")
    return rounded(got.select(KEY, "axis"), "axis")
