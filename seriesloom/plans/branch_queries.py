"""Queries of fixed branches, of choices among them, and of picks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import scalars
from seriesloom.functions.staging import new_path
from seriesloom.operators import aggregates, branches, candidates, decoders, selection, series
from seriesloom.plans.base import BASE, CANDIDATES, KEY, ROW, base, query, rounded, table, tails
from seriesloom.sources import files

#: hours: tail rows with the axis in hours, the last known place, and the rate of the last 30 known rows an hour.
HOURS = CANDIDATES + """,
rt AS (
  SELECT user_id, coalesce(CASE WHEN count(s) >= 3 THEN median(s) END, 0) AS rate FROM (
    SELECT user_id, CASE WHEN md - lag(md) OVER w > 0 THEN (known - lag(known) OVER w) / ((md - lag(md) OVER w) / 3600) END AS s
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) AS r FROM b WHERE known IS NOT NULL) WHERE r <= 30
    WINDOW w AS (PARTITION BY user_id ORDER BY row_idx)) GROUP BY user_id),
h AS (SELECT cf.*, md / 3600 AS hours, (md - ahead) / 3600 AS last_hours, rate, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) AS t FROM cf JOIN rt USING (user_id))"""


def _hours(spark, sf_dir):
    rows = tails(spark, sf_dir)
    known = base(spark, sf_dir).where("known is not null").select(KEY, ROW, "known", (F.col("md") / 3600).alias("hours"), F.lit(0.0).alias("z"))
    rate = candidates.initial_rate(known, KEY, ROW, "hours", "known", "z", 30).select(KEY, "rate")
    return rows.join(rate, KEY).withColumns({"hours": F.col("md") / 3600, "last_hours": (F.col("md") - F.col("ahead")) / 3600, "zero": F.lit(0.0)})


@query("signed_paths", HOURS + """,
s2 AS (SELECT *, power(0.998::DOUBLE, t) AS k, hours - coalesce(lag(hours) OVER (PARTITION BY user_id ORDER BY row_idx), last_hours) AS d FROM h),
s3 AS (SELECT *, sum(rate * k * d) OVER w AS straight, sum(0.05 * (1 - k) / 0.002::DOUBLE * d) OVER w AS bend FROM s2 WINDOW w AS (PARTITION BY user_id ORDER BY row_idx))
SELECT user_id, row_idx, sign, round(greatest(-5000, least(last_anchor + straight + sign * bend, 5000)), 3) AS path FROM s3, (VALUES (-1), (0), (1)) AS v(sign)""")
def signed_paths(spark, sf_dir):
    got = branches.signed_paths(_hours(spark, sf_dir), KEY, ROW, "hours", "zero", "last_hours", "zero", "last_anchor", "rate", drift=0.05, low=-5000, high=5000)
    return rounded(got.select(KEY, ROW, "sign", "path"), "path", digits=3)


@query("reset_branches", CANDIDATES + """,
v(branch, jump, hold) AS (
  SELECT 'base', 0.0::DOUBLE, 0 UNION ALL
  SELECT 'jump_' || CASE WHEN jump < 0 THEN 'm' ELSE 'p' END || replace(CAST(abs(jump) AS VARCHAR), '.', 'p') || '_h' || hold, jump, hold
  FROM (VALUES (-6.3::DOUBLE), (6.3::DOUBLE), (-12.6::DOUBLE), (12.6::DOUBLE)) AS j(jump), (VALUES (4), (8), (512)) AS h(hold)),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) AS k FROM cf)
SELECT user_id, row_idx, branch, round(CASE WHEN k <= hold THEN greatest(0, least(recent_linear + jump, 4000)) ELSE recent_linear END, 4) AS path FROM t, v""")
def reset_branches(spark, sf_dir):
    got = branches.reset_branches(tails(spark, sf_dir), KEY, ROW, "recent_linear", branches.branch_specs(holds=(4, 8, 512)), 0, 4000)
    return rounded(got.select(KEY, ROW, "branch", "path"), "path", digits=4)


@query("shift_branches", CANDIDATES + """,
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) AS future_offset FROM cf)
SELECT user_id, row_idx, future_offset, shift, round(recent_linear + shift, 4) AS path FROM t, (VALUES (0.0::DOUBLE), (-15.0::DOUBLE), (15.0::DOUBLE)) AS v(shift) WHERE future_offset <= 512""")
def shift_branches(spark, sf_dir):
    got = branches.shift_branches(tails(spark, sf_dir), KEY, ROW, "recent_linear", (-15.0, 15.0))
    return rounded(got.select(KEY, ROW, "future_offset", "shift", "path"), "path", digits=4)


@query("residual_rate", BASE + """,
k AS (SELECT user_id, row_idx, md / 3600 AS hours, known, sqrt(row_idx) AS z, 2.0 * row_idx AS x, sin(row_idx) AS y FROM b WHERE known IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) AS r FROM k),
v AS (
  SELECT user_id, CASE WHEN hours - lag(hours) OVER w > 0 THEN (known - lag(known) OVER w + z - lag(z) OVER w - 0.04::DOUBLE * (x - lag(x) OVER w) + 0.015::DOUBLE * (y - lag(y) OVER w)) / (hours - lag(hours) OVER w) END AS s
  FROM t WHERE r <= 30 WINDOW w AS (PARTITION BY user_id ORDER BY row_idx))
SELECT user_id, round(CASE WHEN count(s) >= 3 THEN median(s) ELSE 0 END, 4) AS rate, count(s) AS steps FROM v GROUP BY user_id""")
def residual_rate(spark, sf_dir):
    """The initial rate that is left when the motion along a plane of slopes 0.04 and -0.015 is taken off."""
    i = F.col(ROW).cast("double")
    known = base(spark, sf_dir).where("known is not null").select(KEY, ROW, "known", (F.col("md") / 3600).alias("hours"), (F.sqrt(i) - 0.04 * (2.0 * i) + 0.015 * F.sin(i)).alias("z"))
    return rounded(candidates.initial_rate(known, KEY, ROW, "hours", "known", "z", 30), "rate", digits=4)


_SCORES = CANDIDATES + """,
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) AS k, 50 + 40 * sin(last_anchor / 100) AS ea, 50 + 40 * sin(recent_linear / 100) AS eb, 50 + 40 * sin(row_idx) AS ec FROM cf),
l AS (
  SELECT user_id, candidate, position, gr, x FROM (
    SELECT user_id, 'last_anchor' AS candidate, 0 AS position, gr, ea AS x FROM e WHERE k <= 256 UNION ALL
    SELECT user_id, 'recent_linear', 1, gr, eb FROM e WHERE k <= 256 UNION ALL SELECT user_id, 'wave', 2, gr, ec FROM e WHERE k <= 256) WHERE gr IS NOT NULL),
g AS (
  SELECT user_id, candidate, position, count(*) AS pairs, avg(-0.5 * least(power((gr - x) / 30, 2), 600)) AS fit,
         CASE WHEN candidate <> 'last_anchor' AND count(*) > 1 AND stddev_pop(x) > 0 AND stddev_pop(gr) > 0 THEN corr(gr, x) END AS agreement
  FROM l GROUP BY user_id, candidate, position),
d AS (SELECT *, fit - median(fit) OVER w AS df, agreement - median(agreement) OVER w AS da FROM g WINDOW w AS (PARTITION BY user_id)),
m AS (SELECT *, 1.4826 * median(abs(df)) OVER w AS mf, 1.4826 * median(abs(da)) OVER w AS ma FROM d WINDOW w AS (PARTITION BY user_id)),
z AS (
  SELECT *, pairs >= 6 AND agreement IS NOT NULL AS eligible,
         (CASE WHEN mf > 0 THEN df / mf ELSE 0 END + coalesce(CASE WHEN ma > 0 THEN da / ma WHEN da IS NOT NULL THEN 0 END, 0)) / 2 AS composite FROM m)"""


def _scores(spark, sf_dir):
    curve = lambda c: 50 + 40 * F.sin(c)
    rows = tails(spark, sf_dir).withColumns({"ea": F.lit(1.0), "eb": curve(F.col("recent_linear") / 100), "ec": curve(F.col(ROW).cast("double"))})
    rows = rows.withColumn("ea", curve(F.col("last_anchor") / 100))
    return branches.horizon_scores(rows, [KEY], ROW, "gr", {"last_anchor": "ea", "recent_linear": "eb", "wave": "ec"}, 256, 30, 6)


@query("horizon_scores", _SCORES + " SELECT user_id, candidate, pairs, round(fit, 6) AS fit, round(agreement, 5) AS agreement, eligible FROM z")
def horizon_scores(spark, sf_dir):
    got = _scores(spark, sf_dir)
    return rounded(rounded(got.select(KEY, "candidate", "pairs", "fit", "agreement", "eligible"), "fit"), "agreement", digits=5)


@query("target_free_choice", _SCORES + """
SELECT user_id, coalesce(arg_max(candidate, (round(composite, 6), CAST(candidate = 'wave' AS INT), -position)) FILTER (eligible), 'wave') AS selected FROM z GROUP BY user_id""")
def target_free_choice(spark, sf_dir):
    scores = rounded(_scores(spark, sf_dir), "composite")
    return branches.target_free_choice(scores, [KEY], "wave").select(KEY, "selected")


@query("best_labels", CANDIDATES + """,
l AS (
  SELECT user_id, 'last_anchor' AS candidate, round(sqrt(avg(power(last_anchor - tvt, 2))), 4) AS loss FROM cf GROUP BY user_id
  UNION ALL SELECT user_id, 'recent_linear', round(sqrt(avg(power(recent_linear - tvt, 2))), 4) FROM cf GROUP BY user_id)
SELECT user_id, candidate, loss <= min(loss) OVER (PARTITION BY user_id) + 1e-9 AS best FROM l""")
def best_labels(spark, sf_dir):
    names = ["last_anchor", "recent_linear"]
    sums = tails(spark, sf_dir).groupBy(KEY).agg(*(F.round(F.sqrt(F.avg(F.pow(F.col(c) - F.col("tvt"), 2))), 4).alias(c) for c in names))
    return branches.best_labels(aggregates.to_long(sums, [KEY], names, "candidate", "loss"), [KEY], "candidate", "loss").select(KEY, "candidate", "best")


@query("shifted_similarity", """
WITH c AS (SELECT event_type AS k, CAST(epoch_us(ts) // 3600000000 % 64 AS BIGINT) AS i, round(avg(value), 6) AS v FROM events GROUP BY ALL),
p AS (SELECT DISTINCT a.k AS l, b.k AS r FROM c a JOIN c b ON a.k < b.k),
x AS (SELECT l, r, s, count(*) AS n, round(corr(a.v, b.v), 9) AS cc FROM p, (SELECT unnest(range(-8, 9)) AS s) JOIN c a ON a.k = l JOIN c b ON b.k = r AND b.i = a.i + s GROUP BY l, r, s)
SELECT l AS left, r AS right, round(max(cc), 6) AS similarity FROM x WHERE n >= 0.7 * 64 GROUP BY l, r""")
def shifted_similarity(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    curves = events.groupBy(F.col("event_type").alias("k"), F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000), F.lit(64)).cast("long").alias("i")).agg(F.round(F.avg("value"), 6).alias("v"))
    kinds = curves.select("k").distinct()  # the few kinds of events
    pairs = kinds.select(F.col("k").alias("left")).join(kinds.select(F.col("k").alias("right")), F.col("left") < F.col("right"))
    return rounded(branches.shifted_similarity(curves, pairs, "k", "i", "v", 64, 8).select("left", "right", "similarity"), "similarity")


@query("spaced_picks", """
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p, count(*) OVER () AS c FROM orders),
q AS (SELECT i, CAST(round_even(i * ((SELECT any_value(c) FROM n) - 1) / 15.0, 0) AS BIGINT) AS p FROM (SELECT unnest(range(16)) AS i))
SELECT CAST(i AS BIGINT) AS pick, o_orderkey FROM q JOIN n USING (p)""")
def spaced_picks(spark, sf_dir):
    return selection.spaced_picks(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], 16).select(F.col("pick").cast("long").alias("pick"), "o_orderkey")


@query("cover_then_fill", """
WITH RECURSIVE o AS MATERIALIZED (SELECT o_orderpriority AS c, o_custkey AS o, o_orderkey AS i, CAST(o_totalprice AS DOUBLE) AS s FROM orders),
t AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY sum(s) DESC, c) AS place FROM o GROUP BY c),
r AS (
  SELECT 0::BIGINT AS place, []::BIGINT[] AS taken, NULL::VARCHAR AS c, NULL::BIGINT AS o, NULL::BIGINT AS i, NULL::DOUBLE AS s
  UNION ALL
  SELECT place, CASE WHEN o IS NULL THEN taken ELSE list_append(taken, o) END, c, o, i, s
  FROM (SELECT t.place, r.taken, t.c, x.o, x.i, x.s, row_number() OVER (ORDER BY x.s DESC NULLS LAST, x.i) AS k FROM r JOIN t ON t.place = r.place + 1 LEFT JOIN o x ON x.c = t.c AND NOT list_contains(r.taken, x.o)) WHERE k = 1),
v AS (SELECT row_number() OVER (ORDER BY place) - 1 AS k, o, i, c, s FROM r WHERE o IS NOT NULL),
b AS (SELECT o, arg_min(i, (-s, i)) AS i, arg_min(c, (-s, i)) AS c, max(s) AS s FROM o WHERE o NOT IN (SELECT o FROM v) GROUP BY o),
w AS (SELECT row_number() OVER (ORDER BY s DESC, i) - 1 + (SELECT count(*) FROM v) AS k, o, i, c, s FROM b)
SELECT CAST(k AS INTEGER) AS selection_order, o AS o_custkey, i AS o_orderkey, c AS o_orderpriority, s AS o_totalprice, phase
FROM (SELECT *, 'cover' AS phase FROM v UNION ALL SELECT *, 'fill' FROM w) WHERE k < 12""")
def cover_then_fill(spark, sf_dir):
    """Twelve orders of different customers: for each priority the dearest of a customer not taken yet, then the dearest of all."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    return selection.cover_then_fill(orders, "o_orderpriority", "o_custkey", "o_orderkey", "o_totalprice", 12)


@query("parsed_order", """
WITH t AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS score FROM events)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(try_cast(score AS DOUBLE), '-infinity'::DOUBLE) DESC, event_id) AS place, event_id FROM t""")
def parsed_order(spark, sf_dir):
    score = F.when(F.col("event_type") == "error", "n/a").otherwise(F.round(F.col("value") * 100).cast("long").cast("string"))
    rows = table(spark, sf_dir, "events").select(KEY, "event_id", score.alias("score")).withColumn("k", selection.score_key("score"))
    return rows.select(KEY, F.row_number().over(series.Window.partitionBy(KEY).orderBy(F.desc("k"), "event_id")).cast("long").alias("place"), "event_id")


@query("rmse_offsets", CANDIDATES + """,
l AS (SELECT user_id, row_idx, fold, 'last_anchor' AS candidate, abs(last_anchor - tvt) AS e FROM cf UNION ALL SELECT user_id, row_idx, fold, 'recent_linear', abs(recent_linear - tvt) FROM cf),
v AS (SELECT fold, candidate, sum(e * e) AS s, count(*) AS n FROM l GROUP BY ALL),
o AS (SELECT fold, candidate, sqrt((sum(s) OVER w - s) / (sum(n) OVER w - n)) AS o FROM v WINDOW w AS (PARTITION BY candidate))
SELECT user_id, row_idx, candidate, round(o, 4) AS "offset", round(e - o, 3) AS residual FROM l JOIN o USING (fold, candidate)""")
def rmse_offsets(spark, sf_dir):
    rows = tails(spark, sf_dir)
    errors = rows.select(KEY, ROW, "fold", *(F.abs(F.col(c) - F.col("tvt")).alias(c) for c in ("last_anchor", "recent_linear")))
    got = selection.rmse_offsets(aggregates.to_long(errors, [KEY, ROW, "fold"], ["last_anchor", "recent_linear"], "candidate", "e"), "fold", "candidate", "e")
    return rounded(rounded(got.select(KEY, ROW, "candidate", "offset", "residual"), "offset", digits=4), "residual", digits=3)


@query("residual_from_base", CANDIDATES + """,
v AS (SELECT fold, sum(tvt - last_anchor) AS s, count(*) AS n FROM cf GROUP BY fold),
o AS (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS m FROM v)
SELECT user_id, row_idx, round(last_anchor + m, 3) AS prediction FROM cf JOIN o USING (fold)""")
def residual_from_base(spark, sf_dir):
    """The last anchor and the mean residual of the other folds."""
    rows = selection.residual_target(tails(spark, sf_dir), "tvt", "last_anchor")
    sums = rows.groupBy("fold").agg(F.sum("residual").alias("s"), F.count("*").alias("n"))
    whole = series.Window.partitionBy(F.lit(0))
    means = sums.select("fold", ((F.sum("s").over(whole) - F.col("s")) / (F.sum("n").over(whole) - F.col("n"))).alias("m"))  # a row for each fold
    return rounded(selection.added_back(rows.join(means, "fold"), "m", "last_anchor").select(KEY, ROW, "prediction"), "prediction", digits=3)


@query("savgol", BASE + """
SELECT user_id, row_idx, round((-3 * lag(value, 2) OVER w + 12 * lag(value) OVER w + 17 * value + 12 * lead(value) OVER w - 3 * lead(value, 2) OVER w) / 35, 6) AS smooth
FROM b WINDOW w AS (PARTITION BY user_id ORDER BY row_idx)""")
def savgol(spark, sf_dir):
    return rounded(base(spark, sf_dir).select(KEY, ROW, decoders.savgol(KEY, ROW, "value").alias("smooth")), "smooth")


@query("row_mean", "SELECT l_orderkey, l_linenumber, round((CAST(l_quantity AS DOUBLE) + coalesce(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_tax AS DOUBLE) END, 0)) / CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 1 END, 6) AS mean FROM lineitem")
def row_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax").cast("double")).alias("x"))
    return rounded(rows.select("l_orderkey", "l_linenumber", scalars.row_mean(["q", "x"]).alias("mean")), "mean")


@query("bucket_shrink", CANDIDATES + """,
t AS (SELECT *, least(row_idx // 20, 3) AS bucket FROM cf)
SELECT user_id, row_idx, round((recent_linear - last_anchor) * CASE bucket WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.3 ELSE 1 END, 4) AS correction FROM t""")
def bucket_shrink(spark, sf_dir):
    factors = spark.createDataFrame([(0, 0.9), (1, 0.6), (2, 0.3)], "bucket long, alpha double")
    rows = tails(spark, sf_dir).select(KEY, ROW, F.least(F.floor(F.col(ROW) / 20), F.lit(3)).alias("bucket"), (F.col("recent_linear") - F.col("last_anchor")).alias("correction"))
    return rounded(candidates.bucket_shrink(rows, F.broadcast(factors), "bucket", "correction", "alpha").select(KEY, ROW, "correction"), "correction", digits=4)


@query("restore_order", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place, round(CAST(o_totalprice AS DOUBLE), 2) AS price FROM orders")
def restore_order(spark, sf_dir):
    """Every order in the template's order, by places that ranges of keys are numbered for."""
    orders = table(spark, sf_dir, "orders")
    template = selection.numbered(orders.select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", (F.col("position") + 1).alias("place"))
    return rounded(candidates.restore_order(template, orders.select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")), "o_orderkey", "price"), "price", digits=2)


@query("csv_round_trip", "SELECT user_id, event_id, event_type, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN event_type <> 'error' THEN round(value, 6) END AS gr FROM events")
def csv_round_trip(spark, sf_dir):
    """Events written as gzipped CSV with gaps as NaN, and read back with a schema."""
    path = new_path(spark, "csv")
    gr = F.when(F.col("event_type") != "error", F.round("value", 6)).otherwise(F.lit(float("nan")))
    files.write_csv(table(spark, sf_dir, "events").select(KEY, "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), gr.alias("gr")), path, "gzip")
    return files.read_csv(spark, path, f"{KEY} long, event_id long, event_type string, cents long, gr double")


@query("parquet_round_trip", "SELECT event_type, user_id, event_id FROM events WHERE event_type = 'error'")
def parquet_round_trip(spark, sf_dir):
    """Events written by kind, and one kind read back; the other folders are never opened."""
    path = new_path(spark, "parquet")
    files.write_parquet(table(spark, sf_dir, "events").select(KEY, "event_id", "event_type"), path, ["event_type"])
    return files.read_parquet(spark, path, ["event_type", KEY, "event_id"], {KEY: "bigint"}).where("event_type = 'error'")


@query("json_round_trip", "SELECT o_orderkey, o_orderpriority, round(CAST(o_totalprice AS DOUBLE), 2) AS price FROM orders")
def json_round_trip(spark, sf_dir):
    path = new_path(spark, "json")
    files.write_json(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.round(F.col("o_totalprice").cast("double"), 2).alias("price")), path)
    return files.read_json(spark, path, "o_orderkey long, o_orderpriority string, price double")


@query("iso_dates", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY ALL")
def iso_dates(spark, sf_dir):
    """Events a user and day, by the date at the front of the time's text."""
    return table(spark, sf_dir, "events").groupBy(KEY, F.substring(F.col("ts").cast("string"), 1, 10).alias("day")).agg(F.count("*").alias("events"))


@query("mean_of_prefix", "SELECT user_id, row_idx, round((last_anchor + recent_linear) / 2, 4) AS mean FROM (" + CANDIDATES + " SELECT * FROM cf)")
def mean_of_prefix(spark, sf_dir):
    """The mean of all candidate columns, found by their prefix."""
    rows = tails(spark, sf_dir).select(KEY, ROW, F.col("last_anchor").alias("cand_a"), F.col("recent_linear").alias("cand_b"))
    return rounded(rows.select(KEY, ROW, scalars.row_mean(scalars.with_prefix(rows, "cand_")).alias("mean")), "mean", digits=4)
