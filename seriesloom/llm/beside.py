"""Small tables joined with texts, without shuffling the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged

#: Rows of about 100 bytes that are broadcast at most, some 20 MB.
ROWS = 200_000


def beside(df: DataFrame, what: str) -> DataFrame:
    """`df`, written, and to be broadcast where it has at most ROWS narrow rows; else joins with it are shuffled."""
    df = staged(df, what)
    return F.broadcast(df) if df.count() <= ROWS else df


def few_entries(df: DataFrame, lists: str) -> DataFrame:
    """The written table `df`, to be broadcast where its lists have at most ROWS narrow entries in all."""
    return F.broadcast(df) if (df.agg(F.sum(F.size(lists))).first()[0] or 0) <= ROWS else df


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done; else they stay until the driver's JVM next collects its garbage."""
    spark.sparkContext._jvm.System.gc()
