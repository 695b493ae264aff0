from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import governance, uniqueness
from seriesloom.sources import published
from seriesloom.sources.published import Expected


@pytest.mark.parametrize("most", [12, 30])
def test_repeats_are_exact_and_few_rows_are_shuffled(spark, monkeypatch, most):
    monkeypatch.setattr(uniqueness, "MOST_BITS", most)  # 12: a filter far too small lets all through
    rng = np.random.default_rng(3)
    rows = [(int(k), int(s)) for k, s in zip(range(20_000), rng.integers(0, 5, 20_000), strict=True)]
    rows += [(int(k), int(s)) for k, s in zip(rng.integers(0, 20_000, 100), rng.integers(0, 5, 100), strict=True)] + [(None, 1), (None, 2), (77_777, 3), (77_777, 3)]
    got = uniqueness.repeated_keys(spark.createDataFrame(rows, "k long, shard int").repartition(6), ["k"], "shard")
    counts = Counter(k for k, _ in rows)
    want = {(k, n, tuple(sorted({s for j, s in rows if j == k}))) for k, n in counts.items() if n > 1}
    assert {(r.k, r.rows, tuple(r.shards)) for r in got.repeats.collect()} == want
    assert got.rows == len(rows) and (got.shuffled < 0.05 * len(rows) or most == 12)


def test_shards_that_share_a_key_are_refused(spark):
    a, b = spark.range(5).withColumn("v", F.lit(1)), spark.range(4, 9).withColumn("v", F.lit(2))
    with pytest.raises(ValueError, match="repeat"):
        uniqueness.unique_across([a, b], ["id"])
    assert uniqueness.unique_across([a, b.where("id > 4")], ["id"]).count() == 9
    assert governance.merge_shards([a, b.where("id > 4")], spark.range(9), ["id"]).count() == 9
    assert uniqueness.repeated_keys(a.limit(0), ["id"], "v").repeats.count() == 0


def orders(spark):
    return spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, None, 3.0), (3, None, 3.0)], "k long, g string, v double")


def test_what_is_expected_is_published(spark, tmp_path):
    df, path = orders(spark), f"{tmp_path}/out"
    got = published.publish(df, path, Expected(4, {"g": {"a": 2, None: 2}}, ("v",), published.digest(df.orderBy(F.desc("k")).repartition(3))))
    assert got["__rows"] == 4 and spark.read.parquet(path).count() == 4
    with pytest.raises(FileExistsError):
        published.publish(df, path, Expected())


@pytest.mark.parametrize(
    ("expected", "message"),
    [
        (Expected(rows=5), "4 rows instead of 5"),
        (Expected(rows=(1, 3)), "instead of 1 to 3"),
        (Expected(groups={"g": {"a": 1, None: 2}}), "2 rows of g 'a' instead of 1"),
        (Expected(groups={"g": {"a": 2}}), "2 rows of other values of g"),
        (Expected(rows=4, digest="0:0:0:0:0"), "rows that differ"),
    ],
)
def test_nothing_unexpected_is_published(spark, tmp_path, expected, message):
    with pytest.raises(published.UnexpectedTable, match=message):
        published.publish(orders(spark), f"{tmp_path}/out", expected)
    assert list(tmp_path.iterdir()) == []


def test_values_that_are_not_finite_and_rows_that_differ(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.0)], "k long, v double")
    with pytest.raises(published.UnexpectedTable, match="2 values of v"):
        published.publish(df, f"{tmp_path}/out", Expected(3, {}, ("v",)))
    base = orders(spark)
    assert published.digest(base) != published.digest(base.distinct()) != published.digest(base.withColumn("v", F.col("v") + 1))
    assert published.digest(base.limit(0)) == "0:0:0:0:0"


def test_counting_and_writing_are_one_scan(spark, tmp_path):
    orders(spark).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    metrics = published._metrics(df, Expected(4, {"g": {"a": 2}}, ("v",), "x"))
    plan = df.observe("seen", *metrics)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan and "Exchange" not in plan
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("publish", "publish")
    published.publish(df, f"{tmp_path}/out", Expected(4))
    assert len(jobs.getJobIdsForGroup("publish")) == 1
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
