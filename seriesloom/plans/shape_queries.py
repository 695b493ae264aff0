"""Queries of the shape operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seriesloom.operators import shapes
from seriesloom.plans import decoder_queries
from seriesloom.plans.base import BASE, CANDIDATES, KEY, ROW, base, query, rounded, tails


@query("self_matches", BASE + """,
w AS (SELECT user_id, row_idx, list(value) OVER p AS a, count(known) OVER p AS k FROM b WINDOW p AS (PARTITION BY user_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
m AS (SELECT user_id, row_idx, k, list_transform(a, lambda x: x - list_avg(a)) AS a FROM w WHERE len(a) = 8),
v AS (SELECT user_id, row_idx, k, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS a FROM m WHERE list_inner_product(a, a) > 1e-18),
d AS (SELECT user_id, row_idx AS donor, 'forward' AS orientation, a FROM v WHERE k = 8 UNION ALL SELECT user_id, row_idx, 'reversed', list_reverse(a) FROM v WHERE k = 8),
p AS (SELECT v.user_id, v.row_idx AS receiver, donor, orientation, round(list_inner_product(v.a, d.a), 9) AS ncc FROM v JOIN d USING (user_id) WHERE v.k = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, receiver ORDER BY ncc DESC, donor, orientation) AS k FROM p)
SELECT user_id, receiver, donor, orientation, round(ncc, 6) AS ncc FROM r WHERE k = 1""")
def self_matches(spark, sf_dir):
    return rounded(shapes.self_matches(base(spark, sf_dir), KEY, ROW, "value", "known", 8), "ncc")


def _huber_plane_sql(rounds: int = 5) -> str:
    """Each round's sums, fit, residuals and weights as tables of their own."""
    sql = CANDIDATES + """,
mid AS MATERIALIZED (SELECT fold, avg(ahead) AS mx, avg(last_anchor) AS my FROM cf GROUP BY fold),
d0 AS MATERIALIZED (SELECT fold, ahead - mx AS x, last_anchor - my AS y, tvt AS v, 1.0::DOUBLE AS w FROM cf JOIN mid USING (fold))"""
    for i in range(rounds):
        sql += f""",
m{i} AS (SELECT fold, sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy, sum(w * v) AS sv, sum(w * x * v) AS sxv, sum(w * y * v) AS syv, count(*) AS rows FROM d{i} GROUP BY fold),
c{i} AS (SELECT *, sxx - sx * sx / s AS xx, sxy - sx * sy / s AS xy, syy - sy * sy / s AS yy, sxv - sx * sv / s AS xv, syv - sy * sv / s AS yv FROM m{i}),
b{i} AS (SELECT *, CASE WHEN xx * yy - xy * xy > 1e-9 * xx * yy THEN (xv * yy - yv * xy) / (xx * yy - xy * xy) ELSE 0 END AS b, CASE WHEN xx * yy - xy * xy > 1e-9 * xx * yy THEN (yv * xx - xv * xy) / (xx * yy - xy * xy) ELSE 0 END AS c FROM c{i}),
f{i} AS MATERIALIZED (SELECT fold, (sv - b * sx - c * sy) / s AS a, b, c, rows FROM b{i})"""
        if i < rounds - 1:
            sql += f""",
e{i} AS MATERIALIZED (SELECT d.*, abs(v - a - b * x - c * y) AS e FROM d{i} d JOIN f{i} USING (fold)),
k{i} AS (SELECT fold, 1.4826::DOUBLE * median(e) AS sc FROM e{i} GROUP BY fold),
d{i + 1} AS MATERIALIZED (SELECT fold, x, y, v, CASE WHEN sc <= 0 THEN 1 ELSE least(1, 1.345::DOUBLE * sc / greatest(e, 1e-12)) END AS w FROM e{i} JOIN k{i} USING (fold))"""
    return sql + f" SELECT fold, round(a - b * mx - c * my, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, rows FROM f{rounds - 1} JOIN mid USING (fold)"


@query("huber_plane", _huber_plane_sql())
def huber_plane(spark, sf_dir):
    rows = tails(spark, sf_dir).select("fold", "ahead", "last_anchor", "tvt")
    return rounded(shapes.huber_plane(rows, ["fold"], "ahead", "last_anchor", "tvt"), "a", "b", "c", digits=4)


@query("corridors", BASE.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """,
x AS MATERIALIZED (SELECT user_id, row_idx, list_transform(range(9), lambda c: round(abs(value - 12.5::DOUBLE * c), 6)) AS z FROM b),
fw AS (
  SELECT user_id, row_idx, list_transform(z, lambda v, j: CASE WHEN j = 5 THEN v ELSE 'infinity'::DOUBLE END) AS cost, list_transform(z, lambda v, j: CAST(j AS BIGINT)) AS back FROM x WHERE row_idx = 0
  UNION ALL
  SELECT x.user_id, x.row_idx, list_transform(z, lambda v, j: greatest(v, least(cost[j], coalesce(CASE WHEN j > 1 THEN cost[j - 1] END, 'infinity'::DOUBLE), coalesce(cost[j + 1], 'infinity'::DOUBLE)))),
         list_transform(z, lambda v, j: CAST(CASE WHEN cost[j] <= coalesce(CASE WHEN j > 1 THEN cost[j - 1] END, 'infinity'::DOUBLE) AND cost[j] <= coalesce(cost[j + 1], 'infinity'::DOUBLE) THEN j
                                                  WHEN coalesce(CASE WHEN j > 1 THEN cost[j - 1] END, 'infinity'::DOUBLE) <= coalesce(cost[j + 1], 'infinity'::DOUBLE) THEN j - 1 ELSE j + 1 END AS BIGINT))
  FROM fw JOIN x ON x.user_id = fw.user_id AND x.row_idx = fw.row_idx + 1),
bw AS (
  SELECT user_id, row_idx, CAST(5 AS BIGINT) AS c, cost[5] AS bottleneck FROM fw WHERE (user_id, row_idx) IN (SELECT (user_id, max(row_idx)) FROM x GROUP BY user_id)
  UNION ALL
  SELECT bw.user_id, bw.row_idx - 1, back[c], bottleneck FROM bw JOIN fw ON fw.user_id = bw.user_id AND fw.row_idx = bw.row_idx WHERE bw.row_idx > 0)
SELECT user_id, row_idx, CAST(c - 1 AS INTEGER) AS "column", bottleneck FROM bw""")
def corridors(spark, sf_dir):
    """Through nine levels of value, from the middle one to the middle one, the path of each user that stays nearest its values at the worst row."""
    barrier = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda c: F.round(F.abs(F.col("value") - 12.5 * c), 6))
    return shapes.corridors(base(spark, sf_dir).select(KEY, ROW, barrier.alias("barrier")), KEY, ROW, "barrier", 4, 4)


@query("trend_filters")
def trend_filters(spark, sf_dir):
    """Piecewise linear, notched and polynomial trends of each user's signal."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            series = [(row[KEY], np.asarray(row["at"]), np.asarray(row["md"], float), np.asarray(row["value"], float)) for row in part.to_dict("records")]
            series.sort(key=lambda r: len(r[1]))  # series of like lengths are solved side by side
            for group in (series[i : i + 64] for i in range(0, len(series), 64)):
                for (key, at, x, y), trend in zip(group, shapes.l1_trends([r[3] for r in group], 50.0), strict=True):
                    yield pd.DataFrame({KEY: key, ROW: at, "trend": trend, "notched": shapes.notch(y, 1.0, 2.0, 16.0), "poly": shapes.robust_polynomial(x, y)})

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work a series
    whole = base(spark, sf_dir).select(KEY, ROW, "md", "value").repartition(tasks, KEY).groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct(F.col(ROW).alias("at"), "md", "value"))).alias("s"))
    return whole.select(KEY, "s.at", "s.md", "s.value").mapInPandas(run, f"{KEY} long, {ROW} long, trend double, notched double, poly double")


@query("path_medoids")
def path_medoids(spark, sf_dir):
    """Two typical particle-filter paths of each user: the medoids of its seeds by the mean distance over the whole tail."""

    def typical(paths: np.ndarray, logliks: np.ndarray) -> dict:
        return {"seeds": [int(i) for i in shapes.medoids_of(np.stack([np.abs(paths - path).mean(axis=1) for path in paths]), 2)]}

    rows = decoder_queries.particles(spark, sf_dir, typical, "seeds array<int>", each_row=False)
    return rows.select(KEY, F.explode("seeds").alias("seed")).select(KEY, F.concat_ws("::", F.lit("pf"), F.col(KEY).cast("string"), F.col("seed").cast("string")).alias("seed_key"))
