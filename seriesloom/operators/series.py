"""Window functions over ordered groups. Every order ends in a unique column, so that results don't depend on the layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(key: str | list[str], order: str | list[str]) -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def with_row_idx(df: DataFrame, key: str, order: list[str], name: str = "row_idx") -> DataFrame:
    """A position from 0 in each group, to be written once at ingest: Spark has no row order of its own."""
    return df.withColumn(name, (F.row_number().over(over(key, order)) - 1).cast("long"))


def lags(df: DataFrame, key, order, column: str, steps=(1, 2, 3)) -> DataFrame:
    w = over(key, order)
    return df.withColumns({f"{column}_lag{k}": F.lag(column, k).over(w) for k in steps})


def first_difference(key, order, column: str) -> Column:
    """The change from the row before; 0 at the start and where either is null."""
    return F.coalesce(F.col(column) - F.lag(column).over(over(key, order)), F.lit(0.0))


def second_difference(key, order, column: str) -> Column:
    """Next - 2 * own + last; null at either end."""
    w = over(key, order)
    return F.lead(column).over(w) - 2 * F.col(column) + F.lag(column).over(w)


def trailing_mean(key, order, column: str, size: int) -> Column:
    return F.avg(column).over(over(key, order).rowsBetween(1 - size, 0))


def trailing_std(key, order, column: str, size: int) -> Column:
    """The sample deviation; 0 where there is none."""
    return F.coalesce(F.stddev_samp(column).over(over(key, order).rowsBetween(1 - size, 0)), F.lit(0.0))


def centred_mean(key, order, column: str, size: int) -> Column:
    half = size // 2
    return F.avg(column).over(over(key, order).rowsBetween(-half, half))


def rolling_median(key, order, column: str, size: int) -> Column:
    """The median of a centred window, from its at most `size` values as a sorted array."""
    half = size // 2
    a = F.array_sort(F.collect_list(column).over(over(key, order).rowsBetween(-half, half)))
    n = F.size(a)
    return F.when(n > 0, (F.try_element_at(a, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(a, F.floor(n / 2 + 1).cast("int"))) / 2)


def forward_mean(key, order, column: str, size: int) -> Column:
    """The mean of a row and those that follow; null where fewer than `size` non-null values are there."""
    w = over(key, order).rowsBetween(0, size - 1)
    return F.when(F.count(column).over(w) == size, F.avg(column).over(w))


def forward_fill(key, order, column: str) -> Column:
    return F.last(column, ignorenulls=True).over(over(key, order).rowsBetween(Window.unboundedPreceding, 0))


def fill_linear(df: DataFrame, key, order: str, column: str, axis: str, out: str) -> DataFrame:
    """Gaps filled by position on `axis` between the known values on either side; held constant beyond the ends."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(axis).alias("x"), F.col(column).alias("y")))
    w = over(key, order)
    before = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = df.withColumns({"__a": before, "__b": after})
    x, a, b = F.col(axis), F.col("__a"), F.col("__b")
    line = a["y"] + (b["y"] - a["y"]) * (x - a["x"]) / (b["x"] - a["x"])
    value = F.when(F.col(column).isNotNull(), F.col(column)).when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).when(b["x"] == a["x"], a["y"]).otherwise(line)
    return rows.withColumn(out, value).drop("__a", "__b")


def fill_chain(df: DataFrame, key, order: str, column: str, axis: str, out: str, reference: DataFrame, by: str, value: str) -> DataFrame:
    """Gaps filled by `fill_linear`; where a group knows no value at all, by the mean of `value` in the reference rows of its `by`.

    Null where the reference has none either. `reference` may have columns of any name beside `by` and `value`.
    """
    means = reference.groupBy(F.col(by).alias("__by")).agg(F.avg(value).alias("__mean"))
    rows = fill_linear(df, key, order, column, axis, out).join(means, F.col(by) == F.col("__by"), "left")
    return rows.withColumn(out, F.coalesce(out, "__mean")).drop("__by", "__mean")


def running_sum(key, order, column: str) -> Column:
    return F.sum(column).over(over(key, order).rowsBetween(Window.unboundedPreceding, 0))


def percent_rank_average(key: str, column: str) -> Column:
    """(rank + (ties - 1) / 2) / count, over non-null values; null for null."""
    rank = F.rank().over(Window.partitionBy(key).orderBy(F.col(column).asc_nulls_last()))
    ties = F.count("*").over(Window.partitionBy(key, column))
    return F.when(F.col(column).isNotNull(), (rank + (ties - 1) / 2) / F.count(column).over(Window.partitionBy(key)))


def min_max(key: str, column: str) -> Column:
    w = Window.partitionBy(key)
    low, high = F.min(column).over(w), F.max(column).over(w)
    return (F.col(column) - low) / (high - low + 1e-8)


def anchors(df: DataFrame, key: str, order: str, known: str, carry: list[str]) -> DataFrame:
    """(key, anchor_*): the last row of each group whose `known` isn't null. Sums up before the shuffle."""
    best = F.max_by(F.struct(order, known, *carry), F.when(F.col(known).isNotNull(), F.col(order)))
    rows = df.where(F.col(known).isNotNull()).groupBy(key).agg(best.alias("a"))
    return rows.select(key, *(F.col(f"a.{c}").alias(f"anchor_{c}") for c in (order, known, *carry)))


def tail(df: DataFrame, key: str, order: str, n: int, where: Column | None = None) -> DataFrame:
    """The last n rows of each group among those that fit `where`."""
    rows = df if where is None else df.where(where)
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def islands(df: DataFrame, key: str, order: str, mask: Column, breaks: Column | None = None) -> DataFrame:
    """`df` where `mask` holds, with `island`: a number for each maximal run of such rows in a group.

    `breaks` starts a new run at rows where it holds.
    """
    w = over(key, order)
    on = F.coalesce(mask, F.lit(False))
    rows = df.withColumn("__on", on)
    new = ~F.coalesce(F.lag("__on").over(w), F.lit(False))
    if breaks is not None:
        new = new | F.coalesce(breaks, F.lit(False))
    rows = rows.withColumn("__new", (F.col("__on") & new).cast("int"))
    return rows.withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__on").drop("__on", "__new")


def run_segments(df: DataFrame, key: str, order: str, donor: str, orientation: str, least: int, stride: int = 1) -> DataFrame:
    """(key, segment, first, last, first_donor, last_donor, orientation, rows, supported): runs of matches that go on side by side.

    A run goes on while `order` grows by `stride`, `orientation` stays, and `donor` moves by as much: up where
    the orientation is `forward`, down where it is `reversed`. Null donors or orientations end a run and are in
    none. A run of at least `least` rows is supported. Segments are numbered from 0 in each group.
    """
    w = over(key, order)
    step = F.when(F.col(orientation) == "reversed", -stride).otherwise(stride)
    back = lambda c: F.lag(c).over(w)
    goes_on = (F.col(order) - back(order) == stride) & (F.col(orientation) == back(orientation)) & (F.col(donor) - back(donor) == step)
    rows = df.where(F.col(donor).isNotNull() & F.col(orientation).isNotNull()).withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("segment", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    ends = {"first": F.min(order), "last": F.max(order), "first_donor": F.min_by(donor, order), "last_donor": F.max_by(donor, order), "orientation": F.first(orientation), "rows": F.count("*")}
    return rows.groupBy(key, "segment").agg(*(c.alias(n) for n, c in ends.items())).withColumn("supported", F.col("rows") >= least)


def episodes(df: DataFrame, key: str, order: str, error: str, threshold: float, least: int) -> DataFrame:
    """(key, island, first, last, rows, median_error, sign_share): runs of at least `least` rows whose error is beyond the threshold."""
    runs = islands(df, key, order, F.abs(error) > threshold).groupBy(key, "island")
    up = F.avg((F.col(error) > 0).cast("double"))
    got = runs.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"), F.median(error).alias("median_error"), F.greatest(up, 1 - up).alias("sign_share"))
    return got.where(F.col("rows") >= least)


def blocks(df: DataFrame, position: str, size: int, stride: int, full: str | None = None) -> DataFrame:
    """Rows with `block`, once for each block of `size` positions every `stride` that holds them.

    With `full`, the column that has a group's row count, only blocks that lie in it wholly are kept;
    else also shorter ones at the end, as long as each holds a row that no block before it does.
    """
    p = F.col(position)
    first = F.greatest(F.lit(0), F.ceil((p - size + 1) / stride)).cast("long")
    rows = df.withColumn("block", F.explode(F.sequence(first, F.floor(p / stride).cast("long"))))
    if full is not None:
        return rows.where(F.col("block") * stride + size <= F.col(full))
    return rows


def equal_segments(position, count, k: int) -> Column:
    """The segment of a row when n rows are cut into k as equal as can be: ceil((position + 1) k / n) - 1."""
    return (F.ceil((F.col(position) + 1) * k / F.col(count)) - 1).cast("int")


def relative_position(key: list[str], order: str) -> Column:
    """From 0 to 1 in a group; 0 for a single row."""
    n = F.count("*").over(Window.partitionBy(key))
    return F.coalesce((F.row_number().over(over(key, order)) - 1) / F.nullif(n - 1, F.lit(0)), F.lit(0.0))


def bucket(column: str, edges: list[float], labels: list[str]) -> Column:
    """The label of the bin [edge, next edge) that holds a value; null beyond all edges."""
    x = F.col(column)
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges[:-1], edges[1:], labels, strict=True):
        out = F.when((x >= low) & (x < high), label).otherwise(out)
    return out


def refractory(df: DataFrame, key: str, order: str, trigger: Column, gap: int) -> DataFrame:
    """(key, order): triggers that are accepted when each silences those within the next `gap` positions.

    The accepted ones follow from each other, so a group's triggers travel as a sorted array, which is passed over once.
    """
    found = df.where(trigger).groupBy(key).agg(F.array_sort(F.collect_list(F.col(order).cast("long"))).alias("t"))

    @F.pandas_udf("array<bigint>")
    def accepted(series: pd.Series) -> pd.Series:
        out = []
        for t in series:
            kept: list[int] = []
            for x in t.tolist():
                if not kept or x - kept[-1] >= gap:
                    kept.append(x)
            out.append(kept)
        return pd.Series(out)

    return found.select(key, F.explode(accepted("t")).alias(order))


def near_boundary(df: DataFrame, key, order: str, segment: str, radius: int, out: str = "near_boundary") -> DataFrame:
    """Whether a change of segment lies within `radius` rows; the change between two rows is nearest to both."""
    w = over(key, order)
    rows = df.withColumn("__change", F.coalesce((F.col(segment) != F.lag(segment).over(w)).cast("int"), F.lit(0)))
    return rows.withColumn(out, F.max("__change").over(w.rowsBetween(1 - radius, radius)) == 1).drop("__change")


def circular_shift(df: DataFrame, key: str, order: str, column: str, offset: Column, out: str) -> DataFrame:
    """`column` moved round by a nonzero offset in each group of more than one row: a control that keeps its values."""
    rows = df.withColumns({"__n": F.count("*").over(Window.partitionBy(key)), "__p": F.row_number().over(over(key, order)) - 1, "__o": offset})
    turn = F.when(F.col("__n") > 1, F.pmod(F.col("__o"), F.col("__n") - 1) + 1).otherwise(0)
    rows = rows.withColumn("__q", F.pmod(F.col("__p") + turn, F.col("__n")))
    donor = rows.select(F.col(key).alias("__k"), F.col("__p").alias("__dp"), F.col(column).alias(out))
    return rows.join(donor, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__q") == F.col("__dp"))).drop("__n", "__p", "__o", "__q", "__k", "__dp")
