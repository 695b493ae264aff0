import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import series
from seriesloom.streaming import episodes as streamed

SCHEMA = "user long, at long, error double"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows_of(seed):
    rng = np.random.default_rng(seed)
    out = []
    for user in range(4):
        sign = np.repeat(rng.choice([-1, 0, 1], 30), rng.integers(1, 6, 30))[:60]
        error = sign * rng.uniform(31, 60, len(sign)) + (sign == 0) * rng.uniform(-29, 29, len(sign))
        error[5:7] = np.nan if user else error[5:7]
        out += [(user, i, None if np.isnan(e) else float(e)) for i, e in enumerate(error)] + [(user, len(error), 0.0)]
    return sorted(out, key=lambda r: r[1])


def start(spark, folder, **how):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = streamed.episodes(stream, "user", "at", "error", 30.0, 3, **how)
    return out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").option("path", f"{folder}/out")


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(0.05)  # files are read in the order of their times


def plain(df):
    return sorted((r.user, r.island, r.first, r.last, r.rows, round(r.median_error, 9), round(r.sign_share, 9)) for r in df.collect())


@pytest.mark.parametrize("cuts", [[20], [3, 4, 90, 150]])
def test_equals_the_batch_form_over_any_split(rocks, tmp_path, cuts):
    rows, folder = rows_of(1), str(tmp_path)
    want = plain(series.episodes(rocks.createDataFrame(rows, SCHEMA), "user", "at", "error", 30.0, 3))
    edges = [0, *cuts, len(rows)]
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        add(rocks, folder, rows[a:b])
        if i == 0 or b == len(rows):  # the second start goes on from the checkpoint
            start(rocks, folder).trigger(availableNow=True).start().awaitTermination(120)
    assert want and plain(rocks.read.parquet(f"{folder}/out")) == want


def test_a_silent_key_closes_its_episode(rocks, tmp_path):
    folder = str(tmp_path)
    add(rocks, folder, [(1, i, 40.0) for i in range(5)] + [(2, 0, 40.0)])
    query = start(rocks, folder, idle_ms=1500).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            time.sleep(1)
            if query.lastProgress and rocks.read.schema("user long, island long, first long, last long, rows long, median_error double, sign_share double").parquet(f"{folder}/out").where(F.col("user") == 1).count():
                break
        got = plain(rocks.read.parquet(f"{folder}/out"))
    finally:
        query.stop()
    assert got == [(1, 1, 0, 4, 5, 40.0, 1.0)]
