"""Queries of filling by a chain, clipping to a reference, runs of matches, and neighbours in standardised places."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.staging import new_path
from seriesloom.operators import candidates, joins, series, shapes, splits
from seriesloom.plans.base import BASE, CANDIDATES, KEY, ORACLES, ROW, base, folds, query, rounded, table, tails
from seriesloom.sources import files

_AT = "CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z"


def _places(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


@query("fill_chain", BASE + """,
f AS (SELECT user_id, CAST((row_number() OVER (ORDER BY sha256('fold::' || user_id)) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM events)),
g AS (SELECT user_id, row_idx, md, fold, CASE WHEN event_type = 'signup' THEN value END AS v FROM b JOIN f USING (user_id)),
m AS (SELECT fold, avg(v) AS mean FROM g GROUP BY fold),
k AS (
  SELECT *, last_value(CASE WHEN v IS NOT NULL THEN md END IGNORE NULLS) OVER p AS x0, last_value(v IGNORE NULLS) OVER p AS y0, first_value(CASE WHEN v IS NOT NULL THEN md END IGNORE NULLS) OVER q AS x1, first_value(v IGNORE NULLS) OVER q AS y1
  FROM g WINDOW p AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, row_idx, round(coalesce(CASE WHEN v IS NOT NULL THEN v WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL THEN y0 WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (md - x0) / (x1 - x0) END, mean), 5) AS filled FROM k JOIN m USING (fold)""")
def fill_chain(spark, sf_dir):
    """Values at sign-ups carried on by time; users without any have the mean of their fold's sign-ups."""
    rows = base(spark, sf_dir).join(folds(spark, sf_dir), KEY).withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return rounded(series.fill_chain(rows, KEY, ROW, "v", "md", "filled", rows, "fold", "v").select(KEY, ROW, "filled"), "filled", digits=5)


@query("clip_to_reference", CANDIDATES + """,
k AS (SELECT user_id, min(known) AS low, max(known) AS high FROM b GROUP BY user_id)
SELECT user_id, row_idx, round(least(greatest(recent_linear, low), high), 6) AS clipped FROM cf JOIN k USING (user_id)""")
def clip_to_reference(spark, sf_dir):
    """The linear candidate within the range of what its user is known to have had."""
    rows = candidates.clip_to_reference(tails(spark, sf_dir), KEY, "recent_linear", base(spark, sf_dir).where("known is not null"), "known", "clipped")
    return rounded(rows.select(KEY, ROW, "clipped"), "clipped")


@query("run_segments", f"""
WITH m AS ({ORACLES["self_matches"]}),
g AS (SELECT *, CASE WHEN receiver - lag(receiver) OVER w = 1 AND orientation = lag(orientation) OVER w AND donor - lag(donor) OVER w = CASE orientation WHEN 'reversed' THEN -1 ELSE 1 END THEN 0 ELSE 1 END AS new FROM m WINDOW w AS (PARTITION BY user_id ORDER BY receiver)),
s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY receiver) - 1 AS BIGINT) AS segment FROM g)
SELECT user_id, segment, min(receiver) AS first, max(receiver) AS last, arg_min(donor, receiver) AS first_donor, arg_max(donor, receiver) AS last_donor, any_value(orientation) AS orientation, count(*) AS rows, count(*) >= 2 AS supported FROM s GROUP BY user_id, segment""")
def run_segments(spark, sf_dir):
    """Where the tail of a user goes on like its known part for several rows: runs of best matches, forward or reversed."""
    found = shapes.self_matches(base(spark, sf_dir), KEY, ROW, "value", "known", 8)
    return series.run_segments(found, KEY, "receiver", "donor", "orientation", 2)


@query("knn_standardised", f"""
WITH e AS (SELECT vec_id, label, {_AT} FROM embeddings),
a AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy, avg(z) AS mz, stddev_pop(z) AS sz FROM e),
s AS MATERIALIZED (SELECT vec_id, label, (x - mx) / sx AS x, (y - my) / sy AS y, (z - mz) / sz AS z FROM e, a),
p AS (SELECT q.vec_id, r.vec_id AS neighbour, sqrt(power(q.x - r.x, 2) + power(q.y - r.y, 2) + power(q.z - r.z, 2)) AS d, r.z AS v FROM s q JOIN s r ON q.label <> r.label),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM p)
SELECT vec_id, round(avg(v), 6) AS knn_mean, round(stddev_pop(v), 6) AS knn_std, round(avg(d), 6) AS knn_distance FROM k WHERE rank <= 20 GROUP BY vec_id""")
def knn_standardised(spark, sf_dir):
    """Mean, deviation and distance of the 20 nearest rows of other labels, in places measured by their spread."""
    e = joins.standardised(_places(spark, sf_dir), ["x", "y", "z"], "_s").withColumn("v", F.col("z_s"))
    near = joins.nearest_rows(e, e, ["x_s", "y_s", "z_s"], "vec_id", "label", 20, payload=("v",))
    return rounded(joins.knn_summary(near, "vec_id", "v"), "knn_mean", "knn_std", "knn_distance")


@query("surface_moves", f"""
WITH e AS (SELECT vec_id, vec_id // 50 AS track, {_AT} FROM embeddings),
p AS (SELECT q.vec_id, r.vec_id AS neighbour, sqrt(power(q.x - r.x, 2) + power(q.y - r.y, 2)) AS d, (r.x - q.x) / 0.1::DOUBLE AS dx, (r.y - q.y) / 0.1::DOUBLE AS dy, r.z AS v FROM e q JOIN e r ON q.track <> r.track),
k AS (SELECT *, exp(-0.5::DOUBLE * power(d / 0.1::DOUBLE, 2)) AS w, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM p),
m AS (
  SELECT vec_id, sum(w) AS s, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dx * dx) + 1e-6::DOUBLE AS sxx, sum(w * dx * dy) AS sxy, sum(w * dy * dy) + 1e-6::DOUBLE AS syy, sum(w * v) AS sv, sum(w * dx * v) AS sxv, sum(w * dy * v) AS syv
  FROM k WHERE rank <= 50 GROUP BY vec_id),
c AS (SELECT vec_id, sxx - sx * sx / s AS xx, sxy - sx * sy / s AS xy, syy - sy * sy / s AS yy, sxv - sx * sv / s AS xv, syv - sy * sv / s AS yv, s FROM m),
g AS (SELECT vec_id, CASE WHEN abs(s * (xx * yy - xy * xy)) > 1e-12 THEN (xv * yy - xy * yv) / (xx * yy - xy * xy) / 0.1::DOUBLE ELSE 0 END AS gx, CASE WHEN abs(s * (xx * yy - xy * xy)) > 1e-12 THEN (xx * yv - xy * xv) / (xx * yy - xy * xy) / 0.1::DOUBLE ELSE 0 END AS gy FROM c)
SELECT vec_id, track, round(coalesce(gx * (x - lag(x) OVER w) + gy * (y - lag(y) OVER w), 0), 4) + 0.0 AS move FROM e LEFT JOIN g USING (vec_id) WINDOW w AS (PARTITION BY track ORDER BY vec_id)""")
def surface_moves(spark, sf_dir):
    """How a surface, fitted around each place from other tracks, rises along tracks of 50 successive places."""
    e = _places(spark, sf_dir).withColumn("track", F.floor(F.col("vec_id") / 50)).withColumns({"px": F.col("x"), "py": F.col("y")})
    near = joins.nearest_rows(e, e, ["x", "y"], "vec_id", "track", 50, payload=("px", "py", "z"))
    slopes = joins.local_plane(near, e, "vec_id", "px", "py", "z", 0.1).select("vec_id", "slope_x", "slope_y")
    moves = joins.surface_moves(e.join(slopes, "vec_id", "left"), "track", "vec_id", "x", "y", "slope_x", "slope_y")
    return rounded(moves.select("vec_id", "track", "move"), "move", digits=4).withColumn("move", F.col("move") + 0.0)  # no negative zero


@query("shuffled_labels", """
WITH g AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS p, row_number() OVER (ORDER BY sha256('labels::' || c_custkey), c_custkey) AS q FROM customer)
SELECT a.c_custkey, a.c_mktsegment, d.c_mktsegment AS control FROM g a JOIN g d ON a.p = d.q""")
def shuffled_labels(spark, sf_dir):
    """A control in which customers have the market segments of others, each segment as often as before."""
    return splits.shuffled_labels(table(spark, sf_dir, "customer"), "c_custkey", "c_mktsegment", "control")


@query("leaf_columns", "SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def leaf_columns(spark, sf_dir):
    """One leaf folder of orders written by status, read for two columns without the folder's own."""
    path = new_path(spark, "orders")
    files.write_parquet(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_custkey", "o_orderstatus"), path, ["o_orderstatus"])
    return files.read_parquet(spark, f"{path}/o_orderstatus=F", ["o_orderkey", "o_totalprice"], {"o_orderkey": "bigint", "o_totalprice": "double"})
