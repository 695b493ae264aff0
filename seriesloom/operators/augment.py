"""Changed copies of series, for training and for controls."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import stable_bucket, stable_choice
from seriesloom.operators.joins import interpolate_join
from seriesloom.operators.selection import numbered


def datum_shift(df: DataFrame, chosen: DataFrame, key: str, shift: str, absolute: list[str], suffix: str = "_shifted") -> DataFrame:
    """`df` and a copy of the chosen groups whose absolute columns are moved by their shift; nulls stay null."""
    moved = df.join(chosen.select(key, F.col(shift).alias("__shift")), key)
    moved = moved.withColumns({c: F.col(c) + F.col("__shift") for c in absolute})
    return df.withColumn("augmented", F.lit(False)).unionByName(moved.withColumn(key, F.concat(F.col(key).cast("string"), F.lit(suffix)).cast(df.schema[key].dataType) if df.schema[key].dataType.simpleString() == "string" else F.col(key)).withColumn("augmented", F.lit(True)).drop("__shift"))


def translated(columns: dict[str, float]) -> dict[str, Column]:
    return {c: F.col(c) + F.lit(float(d)) for c, d in columns.items()}


def reflected(column: str, about: float = 0.0) -> dict[str, Column]:
    return {column: 2 * about - F.col(column)}


def rotated(x: str, y: str, degrees: float) -> dict[str, Column]:
    """A turn of the plane; the turn back is that by -degrees."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return {x: c * F.col(x) - s * F.col(y), y: s * F.col(x) + c * F.col(y)}


def stretched_tail(df: DataFrame, axis: str, anchor: str, factor: float) -> DataFrame:
    """The axis stretched beyond its anchor; what is known stays."""
    ahead = F.col(axis) - F.col(anchor)
    return df.withColumn(axis, F.when(ahead > 0, F.col(anchor) + factor * ahead).otherwise(F.col(axis)))


def sheared_tail(df: DataFrame, axis: str, anchor: str, column: str, slope: float) -> DataFrame:
    """A column tilted against the axis beyond the anchor."""
    return df.withColumn(column, F.col(column) + slope * F.greatest(F.lit(0.0), F.col(axis) - F.col(anchor)))


def bends(key: str, part: Column, salt: str, controls: int = 5) -> Column:
    """A line of a few bends for each group: 0 at part 0, from -1 to 1 (by hashes of the group) at evenly spaced parts up to 1, straight between."""
    draw = F.transform(F.sequence(F.lit(1), F.lit(controls)), lambda i: stable_bucket(F.concat(F.lit(f"{salt}::"), F.col(key).cast("string"), F.lit("::"), i.cast("string")), 2001) / 1000 - 1)
    at = F.concat(F.array(F.lit(0.0)), draw)
    place = F.greatest(F.lit(0.0), F.least(part, F.lit(1.0))) * controls
    cell = F.least(F.floor(place), F.lit(controls - 1)).cast("int")
    t = place - cell
    return F.element_at(at, cell + 1) * (1 - t) + F.element_at(at, cell + 2) * t


def _ahead(axis: str, anchor: str, end: str) -> Column:
    """How far beyond the anchor a row lies, as a part of the way to the end; 0 up to the anchor."""
    return F.greatest(F.lit(0.0), F.coalesce((F.col(axis) - F.col(anchor)) / F.nullif(F.col(end) - F.col(anchor), F.lit(0.0)), F.lit(0.0)))


def warped_tail(df: DataFrame, key: str, axis: str, anchor: str, end: str, amount: float, out: str, salt: str = "warp", controls: int = 5) -> DataFrame:
    """`df` with `out`, the axis moved beyond its anchor by a line of a few bends, at most `amount` of the distance between two of them.

    What is known (up to the anchor) stays, and so does the order of rows, for which `amount` must be below one half.
    """
    if not 0 <= amount < 0.5:
        raise ValueError("an amount of one half or more could change the order of rows")
    step = (F.col(end) - F.col(anchor)) / controls
    return df.withColumn(out, F.col(axis) + amount * step * bends(key, _ahead(axis, anchor, end), salt, controls))


def perturbed_tail(df: DataFrame, key: str, axis: str, anchor: str, end: str, scales: dict[str, float], salt: str = "perturb", controls: int = 5) -> DataFrame:
    """`df` with each column of `scales` moved beyond the anchor by a line of a few bends of its own, at most by its scale; up to the anchor it stays."""
    part = _ahead(axis, anchor, end)
    return df.withColumns({c: F.col(c) + F.lit(float(s)) * bends(key, part, f"{salt}::{c}", controls) for c, s in scales.items()})


def resampled(df: DataFrame, key: str, axis: str, moved: str, signal: str, out: str) -> DataFrame:
    """`df` with `out`, the group's own signal over `axis` read at the `moved` places between its rows, its end values beyond them."""
    curve = df.where(F.col(signal).isNotNull()).select(key, F.col(axis).alias("__x"), F.col(signal).alias("__y"))
    curve = curve.groupBy(key, "__x").agg(F.avg("__y").alias("__y"))
    return interpolate_join(df, curve, [key], moved, "__x", "__y", out)


def envelope(df: DataFrame, reference: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, least: float = 0.9) -> DataFrame:
    """(column, inside, ok): the part of each column within the reference's quantiles."""
    bounds = reference.agg(*(F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"__b_{c}") for c in columns))
    one = df.crossJoin(F.broadcast(bounds)).agg(*(F.avg(F.col(c).between(F.col(f"__b_{c}")[0], F.col(f"__b_{c}")[1]).cast("double")).alias(c) for c in columns))  # one row
    rows = one.select(F.explode(F.map_from_arrays(F.array(*(F.lit(c) for c in columns)), F.array(*columns))).alias("column", "inside"))
    return rows.withColumn("ok", F.col("inside") >= least)


def transplanted(df: DataFrame, key: str, position: str, residual: str, size: int, out: str, salt: int = 0) -> DataFrame:
    """`df` with the residuals of another group's block in place of its own, chosen by a hash of the group.

    Blocks of equal number are dealt round in the order of a SHA-256 of salt and group, so none keeps
    its own where there are two; where the donor's block is shorter, the last rows have null.
    """
    block = F.floor(F.col(position) / size)
    rows = df.withColumns({"__b": block, "__o": F.pmod(F.col(position), F.lit(size))})
    heads = rows.select(key, "__b").distinct().withColumn("__h", F.sha2(F.concat_ws("::", F.lit(str(salt)), F.col(key).cast("string")).cast("binary"), 256))
    placed = numbered(heads, ["__b", "__h", key], "__p")
    spans = placed.groupBy("__b").agg(F.min("__p").alias("__low"), F.count("*").alias("__n"))
    next_ = F.col("__low") + F.pmod(F.col("__p") - F.col("__low") + 1, F.col("__n"))
    plan = placed.join(spans, "__b").select(key, "__b", next_.alias("__p")).join(placed.select("__p", F.col(key).alias("__donor")), "__p").select(key, "__b", "__donor")
    given = rows.select(F.col(key).alias("__donor"), "__b", "__o", F.col(residual).alias(out))
    return rows.join(plan, [key, "__b"]).join(given, ["__donor", "__b", "__o"], "left").drop("__b", "__o", "__donor")


def pseudo_starts(df: DataFrame, key: str, order: str, known: str, parts: list[float]) -> DataFrame:
    """A copy of every series for each part of its known prefix that is left known, with `start_part` and `masked`."""
    rows = df.withColumn("start_part", F.explode(F.array(*(F.lit(float(p)) for p in parts))))
    n = F.count(known).over(Window.partitionBy(key, "start_part"))
    place = F.count(known).over(Window.partitionBy(key, "start_part").orderBy(order))
    return rows.withColumn("masked", F.when(place <= F.floor(n * F.col("start_part")), F.col(known)))


def shift_for(key: str, grid: list[float], salt: str = "datum") -> Column:
    """A shift for each group from a grid, by the hash of its key."""
    return stable_choice(F.concat(F.lit(f"{salt}::"), F.col(key).cast("string")), grid)
