"""Picking few rows of many, and predictions as corrections of a base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged


#: Rows of a group that one task sorts at most.
ONE_TASK = 1_000_000


def score_key(text) -> Column:
    """The number that a text holds; what can't be read as one comes after all numbers, as minus infinity."""
    number = F.expr(f"try_cast(trim({text}) as double)")
    return F.coalesce(F.nanvl(number, F.lit(float("-inf"))), F.lit(float("-inf")))


def numbered(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """`df` with its rows' places from 0 by `order`, whose values tell all rows apart.

    Rows are dealt to tasks by ranges and numbered there; only counts of the ranges are summed up together.
    """
    ranged = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))  # a row for each shuffle partition
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(counts), "__part").withColumn(out, F.col("__before") + own - 1).drop("__part", "__before")


def running_total(df: DataFrame, key: list[str], order: str, weight: str, out: str) -> DataFrame:
    """`df` with the sum of `weight` up to each row of its group by `order`, of which no two rows of a group have the same value.

    A group may be as large as the table: if one has more than ONE_TASK rows, rows are dealt to tasks by ranges of group and order and
    summed up there; only sums of a group's part of a range are added up together.
    """
    df = staged(df, "totals")
    if (df.groupBy(*key).count().agg(F.max("count")).first()[0] or 0) <= ONE_TASK:
        return df.withColumn(out, F.sum(weight).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranged = staged(df.repartitionByRange(*key, order).withColumn("__part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy(*key, "__part").agg(F.sum(weight).alias("__s"))
    before = F.coalesce(F.sum("__s").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(k).alias(f"__k_{k}") for k in key), F.col("__part").alias("__p"), before.alias("__before"))  # a group has a row a range that it reaches into
    own = F.sum(weight).over(Window.partitionBy(*key, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key), F.col("__part") == F.col("__p"))
    return ranged.withColumn("__own", own).join(parts, same).withColumn(out, F.col("__before") + F.col("__own")).drop("__part", "__p", "__own", "__before", *(f"__k_{k}" for k in key))


def spaced_picks(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """n rows whose places by `order` are evenly spaced, the first and the last among them, with `pick` from 0; all rows if there are no more."""
    rows = numbered(df, order)
    count = rows.count()
    if count <= n:
        return rows.withColumn("pick", F.col("position")).drop("position")
    places = [round(i * (count - 1) / (n - 1)) for i in range(n)] if n > 1 else [0]
    return rows.where(F.col("position").isin(places)).withColumn("pick", F.array_position(F.array(*(F.lit(p).cast("long") for p in places)), F.col("position")) - 1).drop("position")


def cover_then_fill(df: DataFrame, cause: str, owner: str, ident: str, score: str, most: int) -> DataFrame:
    """(selection_order, owner, ident, cause, score, phase): at most `most` rows of different owners.

    First one row for each cause, in the order of the causes' total scores: its best one whose owner
    isn't taken. Then the best rows of all. Ties: the smaller `ident`, of causes the smaller name. What comes to the driver is
    `most` rows a cause for the `most` causes of the highest totals, and `most` rows more.
    """
    totals = df.groupBy(cause).agg(F.sum(score).alias("t")).orderBy(F.desc("t"), cause).limit(most).collect()
    best = lambda keys: df.groupBy(*keys).agg(F.min(F.struct(F.negate(score).alias("s"), F.col(ident).alias("i"), F.col(cause).alias("c"))).alias("b"))
    mine = best([cause, owner]).select(F.col(cause).alias("c"), F.col(owner).alias("o"), F.col("b.i").alias("i"), F.negate(F.col("b.s")).alias("s"))
    mine = mine.withColumn("k", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("s"), "i"))).where(F.col("k") <= most)
    by_cause: dict = {}
    for r in sorted(mine.where(F.col("c").isin([t[cause] for t in totals])).collect(), key=lambda r: r["k"]):
        by_cause.setdefault(r["c"], []).append(r)
    every = best([owner]).select(F.col(owner).alias("o"), F.col("b.i").alias("i"), F.col("b.c").alias("c"), F.negate(F.col("b.s")).alias("s")).orderBy(F.desc("s"), "i").limit(2 * most).collect()
    taken, out = set(), []
    for rows, phase, many in [*((by_cause.get(t[cause], []), "cover", 1) for t in totals), (every, "fill", most)]:
        for r in rows:
            if many and len(out) < most and r["o"] not in taken:
                taken.add(r["o"])
                out.append((len(out), r["o"], r["i"], r["c"], float(r["s"]), phase))
                many -= 1
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.sparkSession.createDataFrame(out, f"selection_order int, {owner} {kinds[owner]}, {ident} {kinds[ident]}, {cause} {kinds[cause]}, {score} double, phase string")


def rmse_offsets(long: DataFrame, fold: str, candidate: str, error: str) -> DataFrame:
    """`long` with `offset`, the candidate's RMSE in all other folds, and `residual`, the error less it."""
    sums = long.groupBy(fold, candidate).agg(F.sum(F.col(error) * F.col(error)).alias("s"), F.count(error).alias("n"))
    whole = Window.partitionBy(candidate)
    rest = sums.select(fold, candidate, F.sqrt((F.sum("s").over(whole) - F.col("s")) / F.nullif(F.sum("n").over(whole) - F.col("n"), F.lit(0))).alias("offset"))
    return long.join(rest, [fold, candidate]).withColumn("residual", F.col(error) - F.col("offset"))


def with_offset(residual: Column, offset: Column) -> Column:
    """The error that a predicted residual stands for, not below 0."""
    return F.greatest(residual + offset, F.lit(0.0))


def residual_target(df: DataFrame, target: str, base: str) -> DataFrame:
    """`df` with `residual`: what a model has to learn on top of `base`."""
    return df.withColumn("residual", F.col(target) - F.col(base))


def added_back(df: DataFrame, predicted: str, base: str) -> DataFrame:
    """`df` with `prediction`: the base where no residual was predicted, else both together."""
    return df.withColumn("prediction", F.col(base) + F.coalesce(F.nanvl(F.col(predicted).cast("double"), F.lit(0.0)), F.lit(0.0)))
