"""Queries of changed copies and of smoothing by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.staging import staged
from seriesloom.operators import augment, decoders, series
from seriesloom.plans.base import BASE, KEY, ROW, base, query, rounded, table
from seriesloom.plans.decoder_queries import hmm_decode

_WEIGHTS = "[" + ", ".join("[" + ", ".join("[" + ", ".join(f"{w:.17g}::DOUBLE" for w in row) + "]" for row in decoders.savgol_weights(n, 3)) + "]" for n in range(5, 18, 2)) + "]"


@query("savgol_groups", f"""
WITH g AS (SELECT event_type || ':' || user_id AS k, user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events),
y AS (SELECT k, list(value ORDER BY i) AS y FROM g GROUP BY k),
w AS (SELECT *, least(17, n - 1 + n % 2) AS w, {_WEIGHTS} AS tables FROM g JOIN y USING (k)),
s AS (SELECT *, greatest(0, least(i - (w - 1) // 2, n - w)) AS s FROM w)
SELECT k, event_id, round(CASE WHEN w < 5 THEN value ELSE list_sum(list_transform(range(1, w + 1), lambda j: y[s + j] * tables[(w - 5) // 2 + 1][i - s + 1][j])) END, 6) AS smooth FROM s""")
def savgol_groups(spark, sf_dir):
    """Values of each user and kind of event, smoothed over 17 rows or as many as there are."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("k"), "event_id", "value")
    return rounded(decoders.savgol_groups(rows, "k", "event_id", "value").withColumn("smooth", F.col("smooth") + 0.0), "smooth")


_TAIL = BASE + """,
a AS (SELECT user_id, max(md) FILTER (known IS NOT NULL) AS anchor, max(md) AS last FROM b GROUP BY user_id HAVING count(known) > 0),
t AS (SELECT b.*, anchor, last, greatest(0, coalesce((md - anchor) / nullif(last - anchor, 0), 0)) AS part FROM b JOIN a USING (user_id))"""


def _bend(salt: str) -> str:
    at = lambda i: f"(CASE WHEN {i} = 0 THEN 0.0::DOUBLE ELSE CAST('0x' || sha256('{salt}::' || user_id || '::' || {i})[1:15] AS BIGINT) % 2001 / 1000.0::DOUBLE - 1 END)"
    cell, t = "least(CAST(floor(least(part, 1) * 5) AS BIGINT), 4)", "(least(part, 1) * 5 - least(CAST(floor(least(part, 1) * 5) AS BIGINT), 4))"
    return f"({at(cell)} * (1 - {t}) + {at(f'({cell} + 1)')} * {t})"


def _with_anchor(spark, sf_dir):
    whole = series.Window.partitionBy(KEY)
    rows = base(spark, sf_dir).withColumns({"anchor": F.max(F.when(F.col("known").isNotNull(), F.col("md"))).over(whole), "last": F.max("md").over(whole)})
    return rows.where("anchor is not null")


@query("warped_tail", _TAIL + f" SELECT user_id, row_idx, round(md + 0.3::DOUBLE * (last - anchor) / 5 * {_bend('warp')}, 3) AS moved FROM t")
def warped_tail(spark, sf_dir):
    moved = augment.warped_tail(_with_anchor(spark, sf_dir), KEY, "md", "anchor", "last", 0.3, "moved")
    return rounded(moved.select(KEY, ROW, "moved"), "moved", digits=3)


@query("perturbed_tail", _TAIL + f" SELECT user_id, row_idx, round(value + 5 * {_bend('perturb::value')}, 6) AS value, round(tvt + 20 * {_bend('perturb::tvt')}, 6) AS tvt FROM t")
def perturbed_tail(spark, sf_dir):
    moved = augment.perturbed_tail(_with_anchor(spark, sf_dir), KEY, "md", "anchor", "last", {"value": 5.0, "tvt": 20.0})
    return rounded(moved.select(KEY, ROW, "value", "tvt"), "value", "tvt")


@query("stretched_sheared_tail", _TAIL + """
SELECT user_id, row_idx, round(CASE WHEN md > anchor THEN anchor + 1.1::DOUBLE * (md - anchor) ELSE md END, 4) AS md, round(tvt + 0.001::DOUBLE * greatest(0, md - anchor), 4) AS tvt FROM t""")
def stretched_sheared_tail(spark, sf_dir):
    sheared = augment.sheared_tail(_with_anchor(spark, sf_dir), "md", "anchor", "tvt", 0.001)
    return rounded(augment.stretched_tail(sheared, "md", "anchor", 1.1).select(KEY, ROW, "md", "tvt"), "md", "tvt", digits=4)


@query("mode_persistence")
def mode_persistence(spark, sf_dir):
    """Stretches of at least three tail rows whose posterior has a second peak a fifth as high as the first, with its greatest height."""
    rows = staged(hmm_decode(spark, sf_dir).select(KEY, ROW, "second_peak", "sd"), "posterior")
    runs = series.islands(rows, KEY, ROW, F.col("second_peak") >= 0.2).groupBy(KEY, "island")
    got = runs.agg(F.min(ROW).alias("first"), F.max(ROW).alias("last"), F.count("*").alias("rows"), F.max("second_peak").alias("height"), F.avg("sd").alias("sd"))
    return rounded(got.where("rows >= 3"), "height", "sd", digits=5)
