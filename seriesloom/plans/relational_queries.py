"""Queries of joins, aggregations, sets, strings and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions import scalars
from seriesloom.operators import aggregates, joins, series
from seriesloom.plans.base import BASE, CANDIDATES, FOLDS, KEY, ROW, base, folds, off_ties, query, rounded, table, tails


@query("asof_backward", """
WITH q AS (SELECT * FROM events WHERE event_type = 'purchase'), r AS (SELECT * FROM events WHERE event_type = 'view')
SELECT q.user_id, q.event_id, r.value, CAST(epoch_us(r.ts) AS BIGINT) AS matched
FROM q ASOF LEFT JOIN r ON q.user_id = r.user_id AND q.ts >= r.ts""")
def asof_backward(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    q, r = e.where("event_type = 'purchase'").select(KEY, "event_id", "us"), e.where("event_type = 'view'").select(KEY, "us", "value")
    return joins.asof_join(q, r, [KEY], "us", "us", ["value"]).select(KEY, "event_id", "value", F.col("matched_x").alias("matched"))


@query("asof_nearest", """
WITH q AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'view'),
p AS (SELECT q.user_id, q.event_id, r.us, r.value, row_number() OVER (PARTITION BY q.event_id ORDER BY abs(r.us - q.us), r.us) AS k FROM q LEFT JOIN r USING (user_id))
SELECT user_id, event_id, value, CAST(us AS BIGINT) AS matched FROM p WHERE k = 1""")
def asof_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    q, r = e.where("event_type = 'purchase'").select(KEY, "event_id", "us"), e.where("event_type = 'view'").select(KEY, "us", "value")
    return joins.asof_join(q, r, [KEY], "us", "us", ["value"], "nearest").select(KEY, "event_id", "value", F.col("matched_x").alias("matched"))


_CURVE = "curve AS (SELECT p_brand, CAST(p_size AS DOUBLE) AS x, median(p_retailprice) AS y FROM part GROUP BY ALL)"


def _curve(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("x", F.col("p_size").cast("double"))
    return joins.collapse_curve(part, ["p_brand"], "x", "p_retailprice").withColumnRenamed("p_retailprice", "y")


@query("curve_dedup_median", f"WITH {_CURVE} SELECT p_brand, x, round(y, 6) AS y FROM curve")
def curve_dedup_median(spark, sf_dir):
    return rounded(_curve(spark, sf_dir), "y")


_INTERP = f"""
WITH {_CURVE},
l AS (SELECT l_orderkey, l_linenumber, p_brand, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey),
lo AS (SELECT l.*, c.x AS x0, c.y AS y0 FROM l ASOF LEFT JOIN curve c ON l.p_brand = c.p_brand AND l.q >= c.x),
hi AS (SELECT lo.*, c.x AS x1, c.y AS y1 FROM lo ASOF LEFT JOIN curve c ON lo.p_brand = c.p_brand AND lo.q <= c.x)
SELECT l_orderkey, l_linenumber, q, round(CASE WHEN x0 IS NULL THEN {{low}} WHEN x1 IS NULL THEN {{high}} WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (q - x0) / (x1 - x0) END, 5) AS price FROM hi"""


def _interp(spark, sf_dir, clamp):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    items = items.select("l_orderkey", "l_linenumber", "p_brand", F.col("l_quantity").alias("q"))
    rows = joins.interpolate_join(items, _curve(spark, sf_dir), ["p_brand"], "q", "x", "y", "price", clamp)
    return rounded(rows.select("l_orderkey", "l_linenumber", "q", "price"), "price", digits=5)


@query("interp_join_clamped", _INTERP.format(low="y1", high="y0"))
def interp_join_clamped(spark, sf_dir):
    return _interp(spark, sf_dir, True)


@query("interp_join_inside", _INTERP.format(low="NULL", high="NULL"))
def interp_join_inside(spark, sf_dir):
    return _interp(spark, sf_dir, False)


@query("rounded_lookup", """
WITH r AS (SELECT p_brand, p_retailprice AS x, p_partkey FROM part), q AS (SELECT s_suppkey, 'Brand#' || CAST(1 + s_suppkey % 5 AS VARCHAR) || CAST(1 + s_suppkey % 3 AS VARCHAR) AS p_brand, 900 + abs(s_acctbal) / 10 AS x FROM supplier),
ex AS (SELECT p_brand, round(x, 1) AS rx, arg_min(p_partkey, (x, p_partkey)) AS e FROM r GROUP BY ALL),
nr AS (SELECT q.s_suppkey, q.p_brand, round(q.x, 1) AS rx, r.p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(r.x - q.x), r.x, r.p_partkey) AS k FROM q JOIN r USING (p_brand))
SELECT s_suppkey, e IS NOT NULL AS exact FROM nr LEFT JOIN ex ON nr.p_brand = ex.p_brand AND nr.rx = ex.rx WHERE k = 1""")
def rounded_lookup(spark, sf_dir):
    r = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").alias("x"), "p_partkey")
    n = F.col("s_suppkey")
    q = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Brand#"), (1 + n % 5).cast("string"), (1 + n % 3).cast("string")).alias("p_brand"), (900 + F.abs("s_acctbal") / 10).alias("x"))
    got = joins.rounded_lookup(q, r, ["p_brand"], "x", "x", ["p_partkey"], 1)
    return got.where("p_partkey is not null").select("s_suppkey", "exact")


@query("positional_join", BASE + """
SELECT v.user_id, CAST(v.k AS INTEGER) AS position, v.event_id AS view_id, p.event_id AS purchase_id
FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) - 1 AS k FROM b WHERE event_type = 'view') v
JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY row_idx) - 1 AS k FROM b WHERE event_type = 'purchase') p ON v.user_id = p.user_id AND v.k = p.k""")
def positional_join(spark, sf_dir):
    rows = base(spark, sf_dir)
    side = lambda t, n: rows.where(F.col("event_type") == t).select(KEY, F.col(ROW).alias(f"{n}_row"), F.col("event_id").alias(f"{n}_id"))
    return joins.positional_join(side("view", "view"), side("purchase", "purchase"), KEY, "view_row", "purchase_row").select(KEY, "position", "view_id", "purchase_id")


@query("knn_exclude_self_group", """
WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
p AS (SELECT q.vec_id, r.vec_id AS neighbour, sqrt(power(q.x - r.x, 2) + power(q.y - r.y, 2) + power(q.z - r.z, 2)) AS d, CAST(r.label AS DOUBLE) AS v
      FROM e q JOIN e r ON q.label <> r.label),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM p)
SELECT vec_id, round(avg(v), 6) AS knn_mean, round(stddev_pop(v), 6) AS knn_std, round(avg(d), 6) AS knn_distance FROM k WHERE rank <= 10 GROUP BY vec_id""")
def knn_exclude_self_group(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), F.col("label").cast("double").alias("v"))
    near = joins.nearest_rows(e, e, ["x", "y", "z"], "vec_id", "label", 10, payload=("v",))
    return rounded(joins.knn_summary(near, "vec_id", "v"), "knn_mean", "knn_std", "knn_distance")


@query("same_group_top8", """
WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
p AS (SELECT q.vec_id, r.vec_id AS neighbour, sqrt(power(q.x - r.x, 2) + power(q.y - r.y, 2) + power(q.z - r.z, 2)) AS d FROM e q JOIN e r ON q.label = r.label AND q.vec_id <> r.vec_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS INTEGER) AS rank FROM p)
SELECT vec_id, rank, neighbour, round(1 / (1 + d), 6) AS similarity FROM k WHERE rank <= 8""")
def same_group_top8(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))
    near = joins.nearest_rows(e, e, ["x", "y", "z"], "vec_id", "label", 8, same_group=True)
    return rounded(near.select("vec_id", "rank", "neighbour", (1 / (1 + F.col("distance"))).alias("similarity")), "similarity")


@query("local_plane", """
WITH e AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS v FROM embeddings),
p AS (SELECT q.vec_id, r.vec_id AS neighbour, sqrt(power(q.x - r.x, 2) + power(q.y - r.y, 2)) AS d, (r.x - q.x) / 0.1::DOUBLE AS dx, (r.y - q.y) / 0.1::DOUBLE AS dy, r.v FROM e q JOIN e r ON q.label <> r.label),
k AS (SELECT *, exp(-0.5::DOUBLE * power(d / 0.1::DOUBLE, 2)) AS w, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM p),
m AS (
  SELECT vec_id, sum(w) AS s, sum(w * dx) AS sx, sum(w * dy) AS sy, sum(w * dx * dx) + 1e-6::DOUBLE AS sxx, sum(w * dx * dy) AS sxy, sum(w * dy * dy) + 1e-6::DOUBLE AS syy, sum(w * v) AS sv, sum(w * dx * v) AS sxv, sum(w * dy * v) AS syv
  FROM k WHERE rank <= 50 GROUP BY vec_id),
t AS (
  SELECT vec_id, s, sv, s * (sxx * syy - sxy * sxy) - sx * (sx * syy - sxy * sy) + sy * (sx * sxy - sxx * sy) AS det,
         sv * (sxx * syy - sxy * sxy) - sx * (sxv * syy - sxy * syv) + sy * (sxv * sxy - sxx * syv) AS top FROM m)
SELECT vec_id, round(CASE WHEN abs(det) > 1e-12 THEN top / det ELSE sv / s END, 4) + 0.0 AS plane FROM t""")
def local_plane(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", at(1).alias("x"), at(2).alias("y"), at(3).alias("v"), at(1).alias("px"), at(2).alias("py"))
    near = joins.nearest_rows(e, e, ["x", "y"], "vec_id", "label", 50, payload=("px", "py", "v"))
    return rounded(joins.local_plane(near, e, "vec_id", "px", "py", "v", 0.1).select("vec_id", "plane"), "plane", digits=4).withColumn("plane", F.col("plane") + 0.0)  # no negative zero


@query("kgram_pairs", BASE + """,
g AS (SELECT user_id, sha256(list_aggregate(list(event_type) OVER w, 'string_agg', ',')) AS gram, count(*) OVER w AS c FROM b WINDOW w AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
d AS (SELECT DISTINCT user_id, gram FROM g WHERE c = 7), r AS (SELECT gram FROM d GROUP BY gram HAVING count(*) >= 2), h AS (SELECT * FROM d JOIN r USING (gram))
SELECT a.user_id AS left_key, b2.user_id AS right_key, count(*) AS shared FROM h a JOIN h b2 ON a.gram = b2.gram AND a.user_id < b2.user_id GROUP BY ALL""")
def kgram_pairs(spark, sf_dir):
    return joins.kgram_pairs(base(spark, sf_dir), KEY, ROW, "event_type", 7)


@query("anti_semi_coverage", """
SELECT c_custkey AS user_id, 'missing' AS status FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)
UNION ALL SELECT DISTINCT user_id, 'extra' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def anti_semi_coverage(spark, sf_dir):
    return joins.coverage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), table(spark, sf_dir, "events"), ["user_id"])


@query("validated_lookup", """
SELECT o_orderkey, c_mktsegment, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def validated_lookup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = joins.validated_join(o, t("customer"), ["c_custkey"], validate="many_to_one").withColumnRenamed("c_nationkey", "n_nationkey")
    rows = joins.validated_join(rows, t("nation"), ["n_nationkey"], validate="many_to_one").withColumnRenamed("n_regionkey", "r_regionkey")
    return joins.validated_join(rows, t("region"), ["r_regionkey"], validate="many_to_one").select("o_orderkey", "c_mktsegment", "n_name", "r_name")


@query("grouping_metrics", CANDIDATES + """
SELECT fold, event_type, CAST(grouping(fold, event_type) AS BIGINT) AS grouping, count(*) AS rows, round(sqrt(avg(power(last_anchor - tvt, 2))), 6) AS rmse, round(avg(abs(last_anchor - tvt)) + 3e-8, 6) AS mae, round(avg(last_anchor - tvt) + 3e-8, 6) AS bias,
       round(avg((abs(last_anchor - tvt) <= 100)::INT), 6) AS within100
FROM cf GROUP BY GROUPING SETS ((), (fold), (fold, event_type))""")
def grouping_metrics(spark, sf_dir):
    rows = tails(spark, sf_dir).withColumn("err", F.col("last_anchor") - F.col("tvt"))
    out = rows.groupingSets([[], ["fold"], ["fold", "event_type"]], "fold", "event_type").agg(F.grouping_id().alias("grouping"), *aggregates.error_metrics("err", (100,)))
    return rounded(off_ties(out, "mae", "bias"), "rmse", "mae", "bias", "within100")


@query("worst_groups_share", CANDIDATES + """,
g AS (SELECT user_id, sum(power(last_anchor - tvt, 2)) AS sse, count(*) AS rows FROM cf GROUP BY user_id)
SELECT user_id, round(sse, 2) AS sse, rows, round(sse / (SELECT sum(sse) FROM g), 8) AS share FROM g ORDER BY sse DESC, user_id LIMIT 10""")
def worst_groups_share(spark, sf_dir):
    rows = aggregates.share_of_total(tails(spark, sf_dir).withColumn("err", F.col("last_anchor") - F.col("tvt")), KEY, "err")
    return rounded(rounded(rows.orderBy(F.desc("sse"), KEY).limit(10), "sse", digits=2), "share", digits=8)


@query("threshold_sweep", BASE + """,
t AS (SELECT b.*, threshold, abs(value - 50) > threshold AS hot FROM b, (VALUES (20.0::DOUBLE), (40.0::DOUBLE)) v(threshold)),
i AS (SELECT *, sum(CASE WHEN hot AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, threshold ORDER BY row_idx) AS island FROM (SELECT *, lag(hot) OVER (PARTITION BY user_id, threshold ORDER BY row_idx) AS p FROM t)),
r AS (SELECT user_id, threshold, island, count(*) AS k FROM i WHERE hot GROUP BY ALL)
SELECT threshold, CAST(least_rows AS INTEGER) AS least, count(*) AS episodes, CAST(sum(k) AS BIGINT) AS rows FROM r, (VALUES (1), (2), (4)) v(least_rows) WHERE k >= least_rows GROUP BY ALL""")
def threshold_sweep(spark, sf_dir):
    return aggregates.threshold_sweep(base(spark, sf_dir).withColumn("err", F.col("value") - 50), KEY, ROW, "err", [20, 40], [1, 2, 4])


@query("pairwise_distance_report", CANDIDATES + """
SELECT count(*) AS rows, round(sqrt(avg(power(d, 2))), 4) AS rmse, round(avg(abs(d)), 4) AS mae, round(avg(d), 4) AS mean_difference, round(stddev_pop(d), 4) AS std_difference, round(max(abs(d)), 4) AS max,
       CAST(sum((abs(d) > 1)::INT) AS BIGINT) AS over1, CAST(sum((abs(d) > 2)::INT) AS BIGINT) AS over2, CAST(sum((abs(d) > 5)::INT) AS BIGINT) AS over5, CAST(sum((abs(d) > 10)::INT) AS BIGINT) AS over10,
       round(quantile_cont(abs(d), 0.5), 4) AS p50, round(quantile_cont(abs(d), 0.9), 4) AS p90, round(quantile_cont(abs(d), 0.95), 4) AS p95, round(quantile_cont(abs(d), 0.99), 4) AS p99
FROM (SELECT last_anchor - recent_linear AS d FROM cf)""")
def pairwise_distance_report(spark, sf_dir):
    rows = aggregates.distance_report(tails(spark, sf_dir), "last_anchor", "recent_linear")
    return rounded(rows, "rmse", "mae", "mean_difference", "std_difference", "max", "p50", "p90", "p95", "p99", digits=4)


@query("robust_z", """
WITH m AS (SELECT event_type, median(value) AS location FROM events GROUP BY ALL), d AS (SELECT event_type, 1.4826 * median(abs(value - location)) AS scale FROM events JOIN m USING (event_type) GROUP BY ALL)
SELECT event_id, round(CASE WHEN scale = 0 THEN 0 ELSE (value - location) / scale END, 6) AS z FROM events JOIN m USING (event_type) JOIN d USING (event_type)""")
def robust_z(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.join(aggregates.robust_location_scale(e, ["event_type"], "value"), "event_type")
    return rounded(rows.select("event_id", scalars.robust_z("value", "location", F.col("scale") / 1.4826).alias("z")), "z")


@query("weighted_quantile", """
WITH v AS (SELECT l_returnflag, l_extendedprice AS x, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS upto, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM v)
SELECT l_returnflag, min(x) FILTER (upto >= 0.25 * total) AS q25, min(x) FILTER (upto >= 0.5 * total) AS q50, min(x) FILTER (upto >= 0.9 * total) AS q90 FROM c GROUP BY l_returnflag""")
def weighted_quantile(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("w", F.col("l_quantity").cast("long"))
    return aggregates.weighted_quantiles(items, ["l_returnflag"], "l_extendedprice", "w", [0.25, 0.5, 0.9])


@query("shrunk_table", """
WITH g AS (SELECT avg(s_acctbal) AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey), fa AS (SELECT n_regionkey, avg(s_acctbal) AS fm, count(*) AS fn FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
fe AS (SELECT n_regionkey, g + fn / (fn + 20.0::DOUBLE) * (fm - g) AS fe FROM fa, g), o AS (SELECT n_nationkey, n_regionkey, avg(s_acctbal) AS m, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT n_nationkey, n_regionkey, n, round(fe + n / (n + 20.0::DOUBLE) * (m - fe), 6) AS estimate FROM o JOIN fe USING (n_regionkey)""")
def shrunk_table(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rounded(aggregates.shrunk_table(rows, "n_nationkey", "n_regionkey", "s_acctbal", 20), "estimate")


@query("equal_group_prior", """
SELECT event_type, count(*) AS groups, round(median(m), 6) AS prior FROM (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY ALL) GROUP BY event_type""")
def equal_group_prior(spark, sf_dir):
    return rounded(aggregates.equal_group_prior(table(spark, sf_dir, "events"), KEY, "event_type", "value"), "prior")


@query("top_rows", "SELECT o_custkey, o_orderkey, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_rows(spark, sf_dir):
    return aggregates.top_n(table(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("dup_groups", "SELECT sha256(coalesce(text, '')) AS digest, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    return aggregates.duplicates(rows, ["digest"])


@query("null_counts", """
SELECT 'gr' AS "column", count(*) FILTER (gr IS NULL) AS nulls, count(*) AS rows FROM (SELECT CASE WHEN event_type <> 'error' THEN value END AS gr FROM events)
UNION ALL SELECT 'ts', count(*) FILTER (ts IS NULL), count(*) FROM events""")
def null_counts(spark, sf_dir):
    return aggregates.null_counts(table(spark, sf_dir, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("gr"), "ts").withColumn("ts", F.col("ts").isNull().cast("int")).withColumn("ts", F.nullif("ts", F.lit(1)))).select("column", "nulls", "rows")


@query("describe_numeric", """
SELECT 'l_quantity' AS "column", count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS min, quantile_cont(l_quantity, 0.25) AS q25, quantile_cont(l_quantity, 0.5) AS q50, quantile_cont(l_quantity, 0.75) AS q75, max(l_quantity) AS max FROM lineitem
UNION ALL SELECT 'l_tax', count(l_tax), round(avg(l_tax), 6), round(stddev_samp(l_tax), 6), min(l_tax), quantile_cont(l_tax, 0.25), quantile_cont(l_tax, 0.5), quantile_cont(l_tax, 0.75), max(l_tax) FROM lineitem""")
def describe_numeric(spark, sf_dir):
    return rounded(aggregates.describe_numeric(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_tax"]), "mean", "std")


@query("one_hot_pivot", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY ALL""")
def one_hot_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", *scalars.one_hot("o_orderstatus", ["F", "O", "P"], "is_"))
    return rows.groupBy("o_orderpriority").agg(*(F.sum(f"is_{s}").alias(s) for s in "FOP"))


@query("long_wide", """
SELECT o_custkey, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F", round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O" FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus IN ('F', 'O')) > 0""")
def long_wide(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_custkey", "o_orderstatus").agg(F.sum("o_totalprice").alias("v"))
    return rounded(aggregates.to_wide(sums, ["o_custkey"], "o_orderstatus", ["F", "O"], "v"), "F", "O", digits=2)


@query("evidence_classes", """
WITH g AS (SELECT CASE WHEN l_discount - l_tax > 0.02 THEN 'candidate' WHEN l_discount - l_tax < -0.02 THEN 'truth' ELSE 'tie' END AS class, power(l_quantity - 25, 2) AS e FROM lineitem)
SELECT class, round(sum(e), 2) AS sse, count(*) AS rows, round(sum(e) / (SELECT sum(e) FROM g), 8) AS share FROM g GROUP BY class""")
def evidence_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("err", F.col("l_quantity") - 25)
    return rounded(rounded(aggregates.evidence_classes(rows, "l_discount", "l_tax", 0.02, "err"), "sse", digits=2), "share", digits=8)


@query("set_operations", """
SELECT 'both' AS side, count(*) AS n FROM (SELECT user_id FROM events INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'events', count(*) FROM (SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders)
UNION ALL SELECT 'either', count(*) FROM (SELECT user_id FROM events UNION SELECT o_custkey FROM orders)""")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "events").select("user_id"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"))
    n = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.subtract(b), "events")).unionByName(n(a.union(b).distinct(), "either"))


@query("string_functions", """
SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, p_brand || '_' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS row_id, p_partkey AS position, coalesce(nullif(p_type, ''), '-') AS shown,
       sha256(p_name) AS digest, starts_with(p_type, 'PROMO') AS promo FROM part""")
def string_functions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rid = scalars.row_id("p_brand", "p_partkey", 8)
    return p.select("p_partkey", scalars.slug("p_name").alias("slug"), rid.alias("row_id"), scalars.id_position(rid).alias("position"), scalars.shown("p_type").alias("shown"), F.sha2(F.col("p_name").cast("binary"), 256).alias("digest"), F.startswith("p_type", F.lit("PROMO")).alias("promo"))


@query("stable_seeds", """
SELECT c_custkey, CAST(CAST(('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 2147483647 AS BIGINT) + 1 AS BIGINT) AS seed, CAST(('0x' || substr(sha256(c_name), 1, 15))::BIGINT % 7 AS INTEGER) AS bucket FROM customer""")
def stable_seeds(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.stable_seed("c_name").alias("seed"), scalars.stable_bucket("c_name", 7).alias("bucket"))


@query("scalar_transforms", """
SELECT l_orderkey, l_linenumber, round(1 - exp(-l_quantity / 85), 9) AS fade, round(power(2, -l_quantity / 10), 9) AS half, greatest(5, least(l_quantity, 40)) AS clipped,
       round(-0.5 * least(power((l_quantity - 25) / 10, 2), 600), 9) AS emission, round(greatest(0, l_quantity - 20) / (greatest(0, l_quantity - 20) + 10), 9) AS risk FROM lineitem""")
def scalar_transforms(spark, sf_dir):
    q = F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.fade(q, 85).alias("fade"), scalars.half_life(q, F.lit(10.0)).alias("half"), scalars.clip(q, 5.0, 40.0).alias("clipped"), scalars.gaussian_log_emission(q, F.lit(25.0), 10).alias("emission"), scalars.monotone_risk(q, F.lit(20), F.lit(10)).alias("risk"))
    return rounded(rows, "fade", "half", "emission", "risk", digits=9)


@query("geometry", """
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), r AS (SELECT *, sqrt(x * x + y * y) AS radius FROM e)
SELECT vec_id, round(radius, 9) AS radius, round(x * y, 9) AS xy, round(CASE WHEN radius > 0 THEN vec_id / radius ELSE 0 END, 4) AS tortuosity, round(CASE WHEN radius > 0 THEN y / radius ELSE 0 END, 9) AS azimuth_sin, round(CASE WHEN radius > 0 THEN x / radius ELSE 1 END, 9) AS azimuth_cos FROM r""")
def geometry(spark, sf_dir):
    at = lambda i: F.element_at("embedding", i).cast("double")
    e = table(spark, sf_dir, "embeddings").select("vec_id", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), F.col("vec_id").cast("double").alias("md"))
    g = scalars.geometry("x", "y", "z", "md")
    rows = e.select("vec_id", *(g[c].alias(c) for c in ("radius", "xy", "tortuosity", "azimuth_sin", "azimuth_cos")))
    return rounded(rounded(rows, "radius", "xy", "azimuth_sin", "azimuth_cos", digits=9), "tortuosity", digits=4)


@query("json_fields", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS VARCHAR), 'none') AS k, CAST(strftime(ts, '%Y-%m-%d') AS VARCHAR) AS day FROM events")
def json_fields(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.dotted("props", "k", "none").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("sha_folds", ("WITH" + FOLDS[1:] + " SELECT user_id, fold FROM f"))
def sha_folds(spark, sf_dir):
    return folds(spark, sf_dir)


@query("value_counts", "SELECT CASE WHEN event_type <> 'error' THEN event_type END AS value, count(*) AS n FROM events GROUP BY ALL")
def value_counts(spark, sf_dir):
    return aggregates.value_counts(table(spark, sf_dir, "events").withColumn("t", F.when(F.col("event_type") != "error", F.col("event_type"))), "t")


@query("anchors", BASE + "SELECT user_id, max(row_idx) AS anchor_row_idx, arg_max(known, row_idx) AS anchor_known, round(arg_max(md, row_idx), 6) AS anchor_md FROM b WHERE known IS NOT NULL GROUP BY user_id")
def anchors(spark, sf_dir):
    return rounded(series.anchors(base(spark, sf_dir), KEY, ROW, "known", ["md"]), "anchor_md")
