"""Events that arrive in three slices of time: what each stream has given at the end, held against SQL over the whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.plans import series_queries  # noqa: F401  (two of its statements are used here)
from seriesloom.plans.base import BASE, KEY, ORACLES, ROW, base, query, rounded, table
from seriesloom.streaming import episodes, series
from seriesloom.streaming.replay import latest, replayed

RECURSIVE = BASE.replace("WITH s AS", "WITH RECURSIVE s AS", 1)
#: fw: the level of a random walk (steps of variance 30, noise of variance 900) once the rows up to row_idx are known
FORWARD = RECURSIVE + """,
x AS MATERIALIZED (SELECT user_id, row_idx, gr FROM b),
fw AS (
  SELECT DISTINCT user_id, CAST(-1 AS BIGINT) AS row_idx, 0::DOUBLE AS level, 1e6::DOUBLE AS variance FROM x
  UNION ALL
  SELECT user_id, row_idx, level + CASE WHEN gr IS NULL THEN 0 ELSE v / (v + 900) * (gr - level) END, v - CASE WHEN gr IS NULL THEN 0 ELSE v / (v + 900) * v END
  FROM (SELECT x.user_id, x.row_idx, x.gr, fw.level, fw.variance + CASE WHEN x.row_idx = 0 THEN {first} ELSE 30 END AS v FROM fw JOIN x ON x.user_id = fw.user_id AND x.row_idx = fw.row_idx + 1))"""
#: the last watermark in microseconds, one hour behind the latest event; Spark keeps it in milliseconds
MARK = "(SELECT (max(epoch_us(ts)) // 1000 - 3600000) * 1000 FROM events)"


def _timed(spark, sf_dir):
    return table(spark, sf_dir, "events").select(KEY, F.col("ts").cast("timestamp").alias("ts"), "value")


def _series(spark, sf_dir):
    return base(spark, sf_dir).select(KEY, ROW, F.col("ts").cast("timestamp").alias("ts"), "value", "gr")


@query("stream_running_error", "SELECT user_id, count(value) AS rows, round(sum((value - 50) * (value - 50)), 4) AS sse FROM events GROUP BY user_id")
def stream_running_error(spark, sf_dir):
    """Counts and squared errors of each user that grow with each slice; the last that was said of a user."""
    rows = _timed(spark, sf_dir).withColumn("error", F.col("value") - 50)
    return rounded(latest(replayed(rows, "ts", lambda s: series.running_error(s, KEY, "error"), "update"), [KEY]), "sse", digits=4)


@query("stream_windows", f"""
WITH w AS (SELECT user_id, value, (epoch_us(ts) // 43200000000 - back) * 43200000000 AS start_us FROM events, (VALUES (0), (1)) t(back))
SELECT user_id, start_us, count(*) AS rows, round(avg(value), 6) AS mean FROM w WHERE start_us + 86400000000 <= {MARK} GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Means by days that begin every twelve hours, each given once the watermark has passed its end."""
    got = replayed(_timed(spark, sf_dir), "ts", lambda s: series.windowed(s, KEY, "ts", "value", "24 hours", "12 hours", late="1 hour"))
    return rounded(got.select(KEY, F.unix_micros("start").alias("start_us"), "rows", "mean"), "mean")


@query("stream_sessions", f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS since FROM events),
i AS (SELECT *, sum(CASE WHEN since < 21600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us) AS session FROM e)
SELECT user_id, min(us) AS start_us, max(us) + 21600000000 AS end_us, count(*) AS rows FROM i GROUP BY user_id, session HAVING max(us) + 21600000000 <= {MARK}""")
def stream_sessions(spark, sf_dir):
    """Sessions of events less than six hours apart, each given once the watermark has passed its end."""
    got = replayed(_timed(spark, sf_dir), "ts", lambda s: series.sessions(s, KEY, "ts", "6 hours", late="1 hour"))
    return got.select(KEY, F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "rows")


@query("stream_levels", FORWARD.format(first=30) + """
SELECT user_id, row_idx, round(level, 6) AS level, round(variance, 6) AS variance FROM fw WHERE row_idx >= 0""")
def stream_levels(spark, sf_dir):
    """An online filter's level after each event."""
    got = replayed(_series(spark, sf_dir), "ts", lambda s: series.online_filter(s, KEY, ROW, "gr", 900.0, 30.0))
    return rounded(got, "level", "variance")


@query("stream_fixed_lag", FORWARD.format(first=0) + """,
p AS MATERIALIZED (SELECT * FROM fw WHERE row_idx >= 0),
bw AS (
  SELECT user_id, row_idx - 8 AS row_idx, 8 AS ahead, level, variance FROM p WHERE row_idx >= 8
  UNION ALL
  SELECT bw.user_id, bw.row_idx, bw.ahead - 1, p.level + p.variance / (p.variance + 30) * (bw.level - p.level),
         p.variance + (p.variance / (p.variance + 30)) ** 2 * (bw.variance - p.variance - 30)
  FROM bw JOIN p ON p.user_id = bw.user_id AND p.row_idx = bw.row_idx + bw.ahead - 1 WHERE bw.ahead > 0)
SELECT user_id, row_idx, round(level, 5) AS level, round(variance, 5) AS variance FROM bw WHERE ahead = 0""")
def stream_fixed_lag(spark, sf_dir):
    """Each event's level once eight later ones of its user are known."""
    got = replayed(_series(spark, sf_dir), "ts", lambda s: series.fixed_lag_smoother(s, KEY, ROW, "gr", 900.0, 30.0, lag=8))
    return rounded(got, "level", "variance", digits=5)


@query("stream_triggers", ORACLES["refractory_triggers"])
def stream_triggers(spark, sf_dir):
    """Values above 80, those left out that come less than five rows after one that counted."""
    rows = _series(spark, sf_dir).withColumn("hit", F.col("value") > 80)
    return replayed(rows, "ts", lambda s: series.refractory_triggers(s, KEY, ROW, "hit", 5))


@query("stream_blocks", BASE + """
SELECT user_id, CAST(block AS BIGINT) AS block, count(*) AS rows, round(avg(gr), 6) AS mean
FROM b, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((row_idx - 15) / 8.0) AS BIGINT)), row_idx // 8 + 1)) AS block)
WHERE block * 8 + 16 <= n GROUP BY ALL""")
def stream_blocks(spark, sf_dir):
    """Means of full blocks of 16 rows, one at every eight rows."""
    return rounded(replayed(_series(spark, sf_dir), "ts", lambda s: series.row_blocks(s, KEY, ROW, "gr", 16, 8)), "mean")


@query("stream_episodes", ORACLES["persistent_episodes"] + " AND max(row_idx) < max(n) - 1")
def stream_episodes(spark, sf_dir):
    """Persistent errors, each given by the row that ends it; runs that are open at the end are not given."""
    rows = _series(spark, sf_dir).withColumn("err", F.col("value") - 50)
    got = replayed(rows, "ts", lambda s: episodes.episodes(s, KEY, ROW, "err", 30.0, 3), rocks=True)
    return rounded(got, "median_error", "sign_share")
