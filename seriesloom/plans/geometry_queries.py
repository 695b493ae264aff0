"""Queries of spline and neighbour paths. SQL can't solve the splines; tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.staging import staged
from seriesloom.operators import geometry
from seriesloom.plans.base import KEY, ROW, base, folds, query, rounded


def geometry_parts(spark, sf_dir):
    """(tail rows, own splines, donors' mean splines): places are parts of a series' rows; donors are whole series of other folds."""
    place = F.col(ROW) / F.greatest(F.col("n") - 1, F.lit(1))
    rows = staged(base(spark, sf_dir).withColumn("place", place.cast("double")).join(folds(spark, sf_dir), KEY).select(KEY, "fold", ROW, "place", "known", "tvt"), "geometry")
    known = rows.where("known is not null")
    about = known.groupBy(KEY, "fold").agg(F.max("place").alias("anchor"), F.max_by("known", ROW).alias("anchor_value"), F.avg("known").alias("level"), F.count("*").cast("double").alias("size"))
    own = staged(geometry.spline_weights(known, KEY, "place", "known"), "own")
    donors = about.join(staged(geometry.spline_weights(rows, KEY, "place", "tvt"), "donors"), KEY)
    slope = ((F.col("anchor_value") - F.col("level")) / 100).alias("rise")
    coords = [F.col("anchor_value") / 100, slope]
    spot = lambda df, *more: staged(df.select(KEY, "fold", "anchor", "anchor_value", coords[0].alias("height"), coords[1], *more), "spots")
    others = geometry.neighbour_weights(spot(about), spot(donors, "weights"), KEY, "fold", ["height", "rise"], "anchor", "weights")
    tail = rows.where("known is null").join(about.select(KEY, "anchor", "anchor_value"), KEY)
    return tail, own, others


@query("spline_kernel_path")
def spline_kernel_path(spark, sf_dir):
    """For each tail row its series' own spline, how the eight nearest series of other folds went on, and both blended by the donors' distance."""
    tail, own, others = geometry_parts(spark, sf_dir)
    got = geometry.blended_path(tail, own, others, KEY, "place", "anchor", "anchor_value", 1.0)
    return rounded(got.select(KEY, ROW, "spline", "neighbours", "kappa", "path"), "spline", "neighbours", "kappa", "path", digits=4)
