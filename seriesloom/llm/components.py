"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.staging import drop_staged, staged


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of `edges`, root being the smallest node that is reachable.

    Alternates large-star and small-star steps: each points a node's neighbours at the smallest
    one it knows, so the depth falls by a constant factor a round and nothing is gathered.
    Minima are summed up before the shuffle; the joins that follow are plain ones, so that a hub
    with very many links is split by the adaptive planner. Null ends and loops are dropped.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    now = staged(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38, 0)))")).first()
        if state == before:
            break
        before = state
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.expr("array(struct(u as a, m as b), struct(v as a, m as b))")).alias("e"))
        after = staged(small.select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct(), "edges")
        drop_staged(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
