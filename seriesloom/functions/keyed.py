"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this, and more than one part in so many of all, is dealt to many tasks: so many keys at most.
HOT_ROWS, HOT_KEYS = 20_000, 1000


def joined(rows: DataFrame, keys: DataFrame, on: list[str], hot_rows: int | None = None) -> DataFrame:
    """`rows` with the columns of the written table `keys`, which has in `n` how many of `rows` have a key; rows without a key go.

    Rows of a hot key are dealt to many tasks, to each of which the key is copied. `hot_rows` in place of HOT_ROWS suits rows
    that are much work each.
    """
    each = keys.select(*on, "n").distinct()
    total, most = each.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS if hot_rows is None else hot_rows, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return rows.join(keys.drop("n"), on)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = each.where(F.col("n") > limit).select(*on, F.lit(True).alias("__hot"))  # at most HOT_KEYS rows
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")).otherwise(0)
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__hot")
    copies = keys.withColumn("__salt", F.explode(F.when(F.col("n") > limit, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("n")
    return dealt.join(copies, [*on, "__salt"]).drop("__salt")
