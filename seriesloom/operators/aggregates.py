"""Aggregations over errors, blocks and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import is_finite


def error_metrics(error: str, within=(1, 5, 10)) -> list[Column]:
    """Rows, RMSE, MAE, bias and shares within bounds, all mergeable before the shuffle."""
    e = F.col(error)
    return [
        F.count(e).alias("rows"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("bias"),
        *(F.avg((F.abs(e) <= k).cast("double")).alias(f"within{k}") for k in within),
    ]


def grouping_metrics(df: DataFrame, sets: list[tuple[str, ...]], error: str) -> DataFrame:
    """Error metrics of several groupings in one pass; `grouping` has a bit for each column that a row sums over."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    return out.agg(F.grouping_id().alias("grouping"), *error_metrics(error))


def share_of_total(df: DataFrame, key: str, error: str) -> DataFrame:
    """(key, sse, rows, share): each group's part of all squared error."""
    sums = df.groupBy(key).agg(F.sum(F.col(error) * F.col(error)).alias("sse"), F.count(error).alias("rows"))
    total = sums.agg(F.sum("sse").alias("__total"))
    return sums.crossJoin(F.broadcast(total)).withColumn("share", F.col("sse") / F.col("__total")).drop("__total")  # one row


def top_n(df: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def robust_location_scale(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, location, scale): the median, and 1.4826 times the median distance from it."""
    middle = df.groupBy(key).agg(F.median(column).alias("location"))
    spread = df.join(middle, key).groupBy(key).agg((1.4826 * F.median(F.abs(F.col(column) - F.col("location")))).alias("scale"))
    return middle.join(spread, key)


def weighted_quantiles(df: DataFrame, key: list[str], value: str, weight: str, quantiles: list[float]) -> DataFrame:
    """(key, q<percent>): the least value at which the running weight reaches each part of the whole."""
    sums = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*key, value).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(key).orderBy(value)
    rows = sums.withColumns({"upto": F.sum("w").over(w), "total": F.sum("w").over(Window.partitionBy(key))})
    return rows.groupBy(key).agg(*(F.min(F.when(F.col("upto") >= q * F.col("total") - 1e-12, F.col(value))).alias(f"q{round(100 * q)}") for q in quantiles))


def block_statistics(df: DataFrame, key: list[str], order: str, column: str) -> DataFrame:
    """Nine statistics of each block; without finite values the valid part is 0 and the rest null."""
    good = F.when(is_finite(column), F.col(column))
    at = F.when(is_finite(column), F.col(order))
    p = F.percentile(good, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    rows = df.groupBy(key).agg(F.count("*").alias("rows"), (F.count(good) / F.count("*")).alias("valid"), F.avg(good).alias("mean"), F.stddev_pop(good).alias("std"), p.alias("p"), F.min(good).alias("min"), F.max(good).alias("max"), (F.max_by(good, at) - F.min_by(good, at)).alias("change"))
    return rows.select(*key, "rows", "valid", "mean", "std", *(F.col("p")[i].alias(f"p{q}") for i, q in enumerate((10, 50, 90))), "min", "max", "change")


def shrunk_table(df: DataFrame, key: str, group: str, value: str, k: float) -> DataFrame:
    """(key, group, n, estimate): a group's mean drawn to that of its family, and this to the whole's, by n / (n + k)."""
    whole = df.agg(F.avg(value).alias("g"))
    family = df.groupBy(group).agg(F.avg(value).alias("fm"), F.count(value).alias("fn")).crossJoin(F.broadcast(whole))  # one row
    family = family.select(group, (F.col("g") + F.col("fn") / (F.col("fn") + k) * (F.col("fm") - F.col("g"))).alias("fe"))
    own = df.groupBy(key, group).agg(F.avg(value).alias("m"), F.count(value).alias("n")).join(family, group)
    return own.select(key, group, "n", (F.col("fe") + F.col("n") / (F.col("n") + k) * (F.col("m") - F.col("fe"))).alias("estimate"))


def equal_group_prior(df: DataFrame, key: str, group: str, value: str) -> DataFrame:
    """(group, groups, prior): the median over groups of each one's median, so that long ones don't count more."""
    own = df.groupBy(key, group).agg(F.median(value).alias("m"))
    return own.groupBy(group).agg(F.count("*").alias("groups"), F.median("m").alias("prior"))


def segment_summary(df: DataFrame, key: str, position: str, column: str) -> DataFrame:
    """A row for each group with mean and deviation of its early, middle and late third."""
    n = F.count("*").over(Window.partitionBy(key))
    rows = df.withColumn("segment", F.element_at(F.array(F.lit("early"), F.lit("middle"), F.lit("late")), F.least(F.floor(F.col(position) * 3 / n), F.lit(2)).cast("int") + 1))
    return rows.groupBy(key).pivot("segment", ["early", "middle", "late"]).agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"))


def distance_report(df: DataFrame, left: str, right: str) -> DataFrame:
    """How far two columns are apart: RMSE, MAE, mean and deviation of the difference, quantiles, counts beyond bounds."""
    d = F.col(left) - F.col(right)
    a = F.abs(d)
    q = F.percentile(a, F.array(*(F.lit(x) for x in (0.5, 0.9, 0.95, 0.99))))
    one = df.agg(F.count(d).alias("rows"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(a).alias("mae"), F.avg(d).alias("mean_difference"), F.stddev_pop(d).alias("std_difference"), F.max(a).alias("max"), q.alias("q"), *(F.sum((a > k).cast("long")).alias(f"over{k}") for k in (1, 2, 5, 10)))
    return one.select(*(c for c in one.columns if c != "q"), *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))))


def threshold_sweep(df: DataFrame, key: str, order: str, error: str, thresholds: list[float], lengths: list[int]) -> DataFrame:
    """(threshold, least, episodes, rows): how many runs of large error there are for each pair of parameters."""
    rows = df.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    w = Window.partitionBy(key, "threshold").orderBy(order)
    on = F.coalesce(F.abs(error) > F.col("threshold"), F.lit(False))
    rows = rows.withColumn("on", on).withColumn("new", (F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False))).cast("int")).withColumn("island", F.sum("new").over(w))
    runs = rows.where("on").groupBy(key, "threshold", "island").agg(F.count("*").alias("n"))
    runs = runs.withColumn("least", F.explode(F.array(*(F.lit(n) for n in lengths)))).where("n >= least")
    return runs.groupBy("threshold", "least").agg(F.count("*").alias("episodes"), F.sum("n").alias("rows"))


def evidence_classes(df: DataFrame, candidate: str, truth: str, margin: float, error: str) -> DataFrame:
    """(class, rows, sse, share): rows where the candidate's score leads, the truth's does, or neither by more than the margin."""
    gap = F.col(candidate) - F.col(truth)
    rows = df.withColumn("class", F.when(gap > margin, "candidate").when(gap < -margin, "truth").otherwise("tie"))
    return share_of_total(rows, "class", error)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(keys).agg(F.count("*").alias("copies")).where("copies > 1")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, rows) of every column, in one pass."""
    one = df.agg(F.count("*").alias("rows"), *(F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns))
    return one.select("rows", F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in df.columns)), F.array(*df.columns))).alias("column", "nulls"))


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, min, q25, q50, q75, max)."""
    one = df.agg(*(F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(c).cast("double").alias("max")).alias(c) for c in columns))
    rows = one.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*columns))).alias("column", "s"))
    return rows.select("column", "s.n", "s.mean", "s.std", "s.min", *(F.col("s.q")[i].alias(f"q{p}") for i, p in enumerate((25, 50, 75))), "s.max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), null included."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def to_long(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def to_wide(df: DataFrame, ids: list[str], name: str, names: list[str], value: str) -> DataFrame:
    return df.groupBy(ids).pivot(name, names).agg(F.first(value))
