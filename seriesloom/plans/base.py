"""The event table in the role of a depth series, in Spark and in SQL, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.operators import candidates, series, splits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY, ROW = "user_id", "row_idx"

#: s: rows of a user in order, with seconds since the first (md), a signal with gaps (gr), and a running sum (tvt);
#: b: also the part of it that is known, the first 60 % of the rows.
BASE = """
WITH s AS (
  SELECT user_id, event_id, ts, event_type, value,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS row_idx,
         count(*) OVER (PARTITION BY user_id) AS n,
         (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS md,
         CASE WHEN event_type <> 'error' THEN value END AS gr,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) / 100 AS tvt
  FROM events),
b AS (SELECT *, CASE WHEN row_idx * 5 < n * 3 THEN tvt END AS known FROM s)"""
FOLDS = """,
f AS (SELECT user_id, CAST((row_number() OVER (ORDER BY sha256('fold::' || user_id)) - 1) % 5 AS INTEGER) AS fold FROM (SELECT DISTINCT user_id FROM events))"""
#: c: rows of the unknown tail with two candidates; cf: and the user's fold.
CANDIDATES = BASE + """,
a AS (SELECT user_id, arg_max(known, row_idx) FILTER (known IS NOT NULL) AS anchor_known, arg_max(md, row_idx) FILTER (known IS NOT NULL) AS anchor_md FROM b GROUP BY user_id HAVING count(known) > 0),
st AS (
  SELECT user_id, (known - lag(known) OVER w) / nullif(md - lag(md) OVER w, 0) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY row_idx DESC) AS r FROM b WHERE known IS NOT NULL) WHERE r <= 200
  WINDOW w AS (PARTITION BY user_id ORDER BY row_idx)),
sl AS (SELECT user_id, 0.5::DOUBLE * greatest(-0.08::DOUBLE, least(coalesce(median(s), 0), 0.08::DOUBLE)) AS slope FROM st GROUP BY user_id),
c AS (
  SELECT b.*, anchor_known AS last_anchor, anchor_known + slope * (md - anchor_md) AS recent_linear, md - anchor_md AS ahead
  FROM b JOIN a USING (user_id) JOIN sl USING (user_id) WHERE known IS NULL)""" + FOLDS + """,
cf AS (SELECT * FROM c JOIN f USING (user_id))"""


def query(name: str, sql: str | None = None):
    """Registers a query under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`b` of BASE: one shuffle by user, which every window after it shares."""
    rows = series.with_row_idx(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value"), KEY, ["ts", "event_id"])
    whole = series.Window.partitionBy(KEY)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = rows.withColumns({"n": F.count("*").over(whole), "__us": micros, "__cents": F.round(F.col("value") * 100).cast("long")})
    rows = rows.withColumns({"md": (F.col("__us") - F.min("__us").over(whole)) / 1e6, "gr": F.when(F.col("event_type") != "error", F.col("value")), "tvt": F.sum("__cents").over(series.over(KEY, ROW)).cast("double") / 100})
    return rows.withColumn("known", F.when(F.col(ROW) * 5 < F.col("n") * 3, F.col("tvt"))).drop("__us", "__cents")


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sha_folds(table(spark, sf_dir, "events"), KEY, 5, "fold")


def tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`cf` of CANDIDATES."""
    return candidates.baseline_candidates(base(spark, sf_dir), KEY, ROW, "md", "known").join(folds(spark, sf_dir), KEY)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; these columns are compared rounded."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def off_ties(df: DataFrame, *columns: str) -> DataFrame:
    """Means of hundredths may lie just between two rounded values; moved a little, they round alike in any order of summing."""
    return df.withColumns({c: F.col(c) + 3e-8 for c in columns})
