"""Rank statistics, correlations and drift, each as sums over groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import correlation
from seriesloom.functions.staging import staged
from seriesloom.operators.selection import numbered, running_total


def average_ranks(df: DataFrame, key: list[str], column: str, out: str) -> DataFrame:
    """`df` with ranks from 1, ties sharing their mean, over non-null values.

    Ranks come from counts of distinct values, so that a value that very many rows share is one row of the sort, and from ranges, so that a large group isn't one task.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count("*").alias("__n"))
    ranks = running_total(counts, key, column, "__n", "__upto")
    ranks = ranks.withColumn(out, F.col("__upto") - (F.col("__n") - 1) / 2).drop("__n", "__upto")
    return df.join(ranks, [*key, column], "left")


def auc(df: DataFrame, key: list[str], label: str, score: str) -> DataFrame:
    """(key, positives, negatives, auc, mann_whitney_u, cliffs_delta, smd): null where a class is missing."""
    rows = average_ranks(df.where(F.col(score).isNotNull() & F.col(label).isNotNull()), key, score, "__rank")
    p = F.col(label).cast("int") == 1
    sums = rows.groupBy(key).agg(
        F.sum(p.cast("long")).alias("positives"),
        F.sum((~p).cast("long")).alias("negatives"),
        F.sum(F.when(p, F.col("__rank"))).alias("r"),
        *(f(F.when(p if side == "p" else ~p, F.col(score))).alias(f"{n}_{side}") for side in "pq" for n, f in (("mean", F.avg), ("var", F.var_samp))),
    )
    pairs = F.col("positives") * F.col("negatives")
    u = F.col("r") - F.col("positives") * (F.col("positives") + 1) / 2
    both = pairs > 0
    pooled = F.sqrt((F.col("var_p") + F.col("var_q")) / 2)
    return sums.select(*key, "positives", "negatives", F.when(both, u / pairs).alias("auc"), F.when(both, u).alias("mann_whitney_u"), F.when(both, 2 * u / pairs - 1).alias("cliffs_delta"), F.when(both & (pooled > 0), (F.col("mean_p") - F.col("mean_q")) / pooled).alias("smd"))


def mann_whitney_p(u, n1, n2):
    """The two-sided p-value by the normal approximation, without ties."""
    mean, sd = n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    z = F.abs((u - mean) / sd)
    t = 1 / (1 + 0.3275911 * z / F.sqrt(F.lit(2.0)))  # a fixed approximation of the error function
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-z * z / 2)


def spearman(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, rows, rho): the correlation of average ranks over rows that have both."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    rows = average_ranks(average_ranks(rows, key, a, "__ra"), key, b, "__rb")
    return rows.groupBy(key).agg(F.count("*").alias("rows"), correlation("__ra", "__rb").alias("rho"))


def pearson(df: DataFrame, key: list[str], a: str, b: str) -> DataFrame:
    """(key, r): 0 where a side doesn't vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    got = df.where(both).groupBy(key).agg(correlation(a, b).alias("r"), F.min(a).alias("a0"), F.max(a).alias("a1"), F.min(b).alias("b0"), F.max(b).alias("b1"))
    return got.select(*key, F.when((F.col("a0") == F.col("a1")) | (F.col("b0") == F.col("b1")), 0.0).otherwise(F.col("r")).alias("r"))


def benjamini_hochberg(df: DataFrame, p: str, tie: str, key: list[str] | None = None) -> DataFrame:
    """`df` (a row for each test) with `q`, the false discovery rate at which a test is called."""
    if not key:
        return _whole_benjamini_hochberg(df, p, tie)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(p, tie))
    n = F.count("*").over(Window.partitionBy(key))
    rows = df.withColumn("__raw", F.col(p) * n / rank).withColumn("__rank", rank)
    q = F.min("__raw").over(Window.partitionBy(key).orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("q", F.least(q, F.lit(1.0))).drop("__raw", "__rank")


def _whole_benjamini_hochberg(df: DataFrame, p: str, tie: str, block: int = 65_536) -> DataFrame:
    """All tests as one family: ranks by ranges of p, least values from the end within blocks of ranks, and over the few blocks."""
    rows = numbered(df, [p, tie], "__rank")
    n = rows.count()
    rows = rows.withColumns({"__raw": F.col(p) * n / (F.col("__rank") + 1), "__block": F.floor(F.col("__rank") / block)})
    later = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("__block").agg(F.min("__raw").alias("m")).select("__block", F.min("m").over(later).alias("__later"))  # a row for each block
    own = F.min("__raw").over(Window.partitionBy("__block").orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(F.broadcast(blocks), "__block").withColumn("q", F.least(own, "__later", F.lit(1.0))).drop("__raw", "__rank", "__block", "__later")


def empirical_percentile(df: DataFrame, reference: DataFrame, key: list[str], column: str, out: str) -> DataFrame:
    """`df` with the part of the reference below each value, ties counted half; null where the reference is empty."""
    ref = reference.where(F.col(column).isNotNull()).groupBy(*key, column).agg(F.count("*").alias("__ref"))
    mine = df.where(F.col(column).isNotNull()).select(*key, column).distinct().withColumn("__ref", F.lit(0).cast("long"))
    both = ref.unionByName(mine).groupBy(*key, column).agg(F.sum("__ref").alias("__ref"))
    totals = ref.groupBy(*key).agg(F.sum("__ref").alias("__total"))
    table = running_total(both, key, column, "__ref", "__upto").join(totals, key, "left")
    table = table.withColumn(out, F.when(F.col("__total") > 0, (F.col("__upto") - F.col("__ref") / 2) / F.col("__total"))).drop("__ref", "__upto", "__total")
    return df.join(table, [*key, column], "left")


def ranking_metrics(df: DataFrame, event: str, relevant: str, score: str, tie: str) -> DataFrame:
    """(events, mrr, top1, top3): over events, where the first relevant candidate ranks by score."""
    rank = F.row_number().over(Window.partitionBy(event).orderBy(F.desc(score), tie))
    first = df.withColumn("__r", rank).groupBy(event).agg(F.min(F.when(F.col(relevant), F.col("__r"))).alias("r"))
    return first.agg(F.count("*").alias("events"), F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))).alias("mrr"), *(F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0))).alias(f"top{k}") for k in (1, 3)))


def exact_quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """The quantiles of a column's values, between two of them by a line, as `percentile` gives them; nulls take no part.

    Equal values are counted together and counts are summed up by ranges of values; two values a quantile come to the driver.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.lit(0).alias("__all"), F.col(column).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    table = staged(running_total(counts, ["__all"], "__v", "__n", "__upto"), "quantiles")
    total = table.agg(F.sum("__n")).first()[0] or 0
    if not total:
        return [None] * len(shares)
    places = [(total - 1) * s for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    at = F.explode(F.filter(F.array(*(F.lit(r).cast("long") for r in ranks)), lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__n"))))
    found = {r["r"]: r["__v"] for r in table.select("__v", at.alias("r")).collect()}
    ends = ((p, math.floor(p), math.ceil(p)) for p in places)
    return [found[low] if low == high or found[low] == found[high] else (high - p) * found[low] + (p - low) * found[high] for p, low, high in ends]


def lift_by_bucket(df: DataFrame, score: str, tie: str, hit: str, n: int) -> DataFrame:
    """(bucket, rows, hits, rate, lift): equal buckets of the score, each rate against the whole's; infinite over a rate of 0.

    Buckets come from exact quantile edges, found from counts of values by ranges: no task holds all values.
    """
    edges = exact_quantiles(df, score, [i / n for i in range(1, n)])
    rows = df.crossJoin(F.broadcast(df.agg(F.avg(F.col(hit).cast("double")).alias("base"))))  # one row
    bucket = F.size(F.filter(F.array(*(F.lit(e).cast("double") for e in edges)), lambda e: F.col(score) > e)) + 1
    got = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("rows"), F.sum(F.col(hit).cast("long")).alias("hits"), F.max("base").alias("base"))
    rate = F.col("hits") / F.col("rows")
    return got.select("bucket", "rows", "hits", rate.alias("rate"), F.when(F.col("base") > 0, rate / F.col("base")).otherwise(F.lit(float("inf"))).alias("lift"))


def drift(train: DataFrame, test: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(psi, smd, missing_train, missing_test): how a column's distribution differs, over fixed bins; an empty bin counts as 1e-4."""
    x = F.col(column)
    at = F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: x >= e))
    side = lambda df, s: df.select(x.alias(column), at.alias("bin"), F.lit(s).alias("side"))
    rows = side(train, "train").unionByName(side(test, "test"))
    counts = rows.where(x.isNotNull()).groupBy("bin").agg(*(F.sum((F.col("side") == s).cast("long")).alias(s) for s in ("train", "test")))
    full = counts.crossJoin(F.broadcast(counts.agg(F.sum("train").alias("a"), F.sum("test").alias("b"))))  # one row
    p, q = F.greatest(F.col("train") / F.col("a"), F.lit(1e-4)), F.greatest(F.col("test") / F.col("b"), F.lit(1e-4))
    psi = full.agg(F.sum((q - p) * F.log(q / p)).alias("psi"))
    m = rows.agg(*(f(F.when(F.col("side") == s, e)).alias(f"{n}_{s}") for s in ("train", "test") for n, f, e in (("mean", F.avg, x), ("var", F.var_samp, x), ("missing", F.avg, x.isNull().cast("double")))))
    m = m.select(((F.col("mean_test") - F.col("mean_train")) / F.sqrt((F.col("var_train") + F.col("var_test")) / 2)).alias("smd"), "missing_train", "missing_test")
    return psi.crossJoin(m)  # one row each
