import datetime as dt

import pytest
from pyspark.sql import functions as F

from seriesloom.streaming import series
from seriesloom.streaming.replay import PROVIDER, cuts, latest, replayed

SCHEMA = "user long, at timestamp, value double"


def moment(minutes):
    return None if minutes is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def rows(spark, data):
    return spark.createDataFrame([(u, moment(m), v) for u, m, v in data], SCHEMA)


def sums(stream):
    return series.running_error(stream, "user", "value")


def test_cuts_part_the_rows_evenly_and_keep_equal_times_together(spark):
    assert len(cuts(rows(spark, [(1, m, 1.0) for m in range(300)]), "at", 3)) == 2
    assert len(cuts(rows(spark, [(1, 7, 1.0)] * 300), "at", 5)) == 1
    assert cuts(rows(spark, [(1, 7, 1.0)]), "at", 1) == []


@pytest.mark.parametrize("slices", [1, 4])
def test_sums_at_the_end_are_those_of_the_table(spark, slices):
    data = [(i % 3, i * 7 % 100, float(i)) for i in range(100)] + [(5, None, 2.0), (5, None, 2.0), (None, 3, 1.0), (6, 4, None)]
    got = replayed(rows(spark, data), "at", sums, "update", slices)
    assert got.select("batch").distinct().count() >= slices
    want = {}
    for u, _, v in data:
        n, s = want.get(u, (0, None))
        want[u] = (n, s) if v is None else (n + 1, (s or 0.0) + v * v)
    assert {r.user: (r.rows, r.sse) for r in latest(got, ["user"]).collect()} == want


def test_a_table_without_rows(spark):
    assert latest(replayed(rows(spark, []), "at", sums, "update"), ["user"]).collect() == []
    assert replayed(rows(spark, []), "at", lambda s: s.select("user")).collect() == []


def test_every_row_arrives_once_and_the_state_store_is_as_before(spark):
    before = spark.conf.get(PROVIDER)
    data = [(i, i % 10, float(i)) for i in range(50)] + [(99, None, 0.0)]
    got = replayed(rows(spark, data), "at", lambda s: s.select("user", "value"), slices=3, rocks=True)
    assert sorted(r.user for r in got.collect()) == sorted(u for u, _, _ in data)
    assert spark.conf.get(PROVIDER) == before


def test_sessions_end_where_the_gap_is_reached(spark):
    """Rows less than the gap apart share a session; the watermark closes all but the last user's."""
    data = [(1, 0, 1.0), (1, 9, 1.0), (1, 30, 1.0), (2, 5, 1.0), (2, 5, 1.0), (3, 500, 1.0)]
    got = replayed(rows(spark, data), "at", lambda s: series.sessions(s, "user", "at", "10 minutes", late="1 minute"))
    start = dt.datetime(2024, 1, 1)
    assert sorted((r.user, (r.start - start).seconds // 60, (r.end - start).seconds // 60, r.rows) for r in got.collect()) == [(1, 0, 19, 2), (1, 30, 40, 1), (2, 5, 15, 2)]


def test_levels_do_not_depend_on_the_slices(spark):
    data = [(u, m, float((m * 37 + u) % 50)) for u in range(3) for m in range(40)]
    table = rows(spark, data).withColumn("i", (F.unix_micros("at") / 60_000_000).cast("long"))
    levels = [sorted(map(tuple, replayed(table, "at", lambda s: series.online_filter(s, "user", "i", "value", 9.0, 1.0), slices=n).collect())) for n in (1, 5)]
    assert len(levels[0]) == 120 and levels[0] == levels[1]
