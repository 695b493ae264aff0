import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import governance
from seriesloom.sources import files
from seriesloom.streaming import series as streaming


def table(spark, rows, schema="id string, value double"):
    return spark.createDataFrame(rows, schema)


def test_content_hash_ignores_layout_and_sees_values(spark):
    rows = [(f"r{i}", float(i)) for i in range(50)]
    a = governance.content_hash(table(spark, rows), ["id"])
    assert a == governance.content_hash(table(spark, rows[::-1]).repartition(7), ["id"])
    assert a != governance.content_hash(table(spark, [*rows[:-1], ("r49", 49.5)]), ["id"]) != governance.content_hash(table(spark, rows + rows[:1]), ["id"])
    assert governance.content_hash(table(spark, [("", 1.0)]), ["id"]) != governance.content_hash(table(spark, [(None, 1.0)]), ["id"])


def test_ledger(spark):
    p, truth = table(spark, [("a", 1.0), ("b", 2.0)]), table(spark, [("a", 5.0), ("b", 6.0)], "id string, t double")
    ledger = governance.Ledger()
    with pytest.raises(governance.LeakError):
        ledger.attach_truth(p, truth, ["id"])
    ledger.freeze(p, ["id"])
    with pytest.raises(governance.LeakError):
        ledger.attach_truth(p.withColumn("value", F.col("value") + 1), truth, ["id"])
    assert ledger.attach_truth(p, truth, ["id"]).count() == 2 and ledger.reads == 1
    with pytest.raises(governance.LeakError):
        ledger.freeze(p.withColumnRenamed("value", "oracle_value"), ["id"])


def test_shards_and_submissions(spark):
    a, b = table(spark, [("a", 1.0)]), table(spark, [("b", 2.0)])
    both = a.union(b)
    assert governance.merge_shards([a, b], both, ["id"]).count() == 2
    for bad in ([a, a], [a]):
        with pytest.raises(ValueError):
            governance.merge_shards(bad, both, ["id"])
    assert governance.validate_submission(both, both, "id", "value") is both
    with pytest.raises(ValueError, match="finite"):
        governance.validate_submission(a.withColumn("value", F.lit(float("nan"))), a, "id", "value")
    assert governance.markdown(both.orderBy("id")).splitlines()[2] == "| a | 1.0 |"


def test_files(spark, tmp_path):
    df = table(spark, [("a", 1.5), ("b", None)])
    files.write_csv(df.coalesce(1), f"{tmp_path}/x", "gzip")
    back = files.read_csv(spark, f"{tmp_path}/x", "id string, value double", "file", r"^(part)")
    assert sorted(map(tuple, back.collect()), key=str) == [("part", "a", 1.5), ("part", "b", None)]
    with pytest.raises(Exception, match="exist"):
        files.write_csv(df, f"{tmp_path}/x")
    files.write_parquet(df.withColumn("fold", F.lit(0)), f"{tmp_path}/p", ["fold"])
    assert files.read_parquet(spark, f"{tmp_path}/p/fold=0").columns == ["id", "value"]
    with pytest.raises(ValueError, match="lacks"):
        files.read_parquet(spark, f"{tmp_path}/p", expect={"value": "int"})
    template = table(spark, [("b", 0.0), ("a", 1.0)], "id string, position double")
    files.write_submission(df, template, "id", "value", "position", f"{tmp_path}/s")
    rows = [line for p in sorted(tmp_path.glob("s/part*")) for line in p.read_text().splitlines() if line != "id,value"]
    assert [r.split(",")[0] for r in rows] == ["b", "a"]


def stream(spark, df, tmp_path):
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def drain(spark, out, tmp_path, mode):
    q = out.writeStream.format("memory").queryName("got").outputMode(mode).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("got").collect()


def test_streaming_sums_equal_batch(spark, tmp_path):
    df = table(spark, [("a", float(i)) for i in range(20)] + [("b", 1.0)])
    got = {r.id: (r.rows, r.sse) for r in drain(spark, streaming.running_error(stream(spark, df, tmp_path), "id", "value"), tmp_path, "complete")}
    assert got == {"a": (20, sum(i * i for i in range(20))), "b": (1, 1.0)}


def test_streaming_sessions_and_windows(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    batch = streaming.sessions(e, "user_id", "ts", "6 hours")
    assert batch.agg(F.sum("rows")).first()[0] == e.count()
    got = drain(spark, streaming.windowed(stream(spark, e, tmp_path), "user_id", "ts", "value", "1 day", late="365 days"), tmp_path, "complete")
    assert sum(r.rows for r in got) == e.count()


def test_online_filter_emits_a_row_for_each_observation(spark, tmp_path):
    df = spark.createDataFrame([("a", i, 5.0) for i in range(12)], "id string, i long, value double")
    got = drain(spark, streaming.online_filter(stream(spark, df, tmp_path), "id", "i", "value", 1.0, 0.01), tmp_path, "append")
    assert len(got) == 12 and abs(got[-1].level - 5) < 0.01


def in_order(spark, df, tmp_path):
    """Three batches, each after the one before."""
    last = df.agg(F.max("i")).first()[0] + 1
    for k in range(3):
        df.where((F.col("i") * 3 >= k * last) & (F.col("i") * 3 < (k + 1) * last)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # the source orders files by the second
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_fixed_lag_smoother_equals_smoothing_each_window(spark, tmp_path):
    values = [5.0, 6.0, None, 9.0, 8.0, 7.5, None, 7.0, 3.0, 2.0]
    df = spark.createDataFrame([(k, i, v) for k in ("a", "b") for i, v in enumerate(values)], "id string, i long, value double")
    got = drain(spark, streaming.fixed_lag_smoother(in_order(spark, df, tmp_path), "id", "i", "value", 1.0, 0.5, lag=3), tmp_path, "append")
    assert sorted((r.id, r.i) for r in got) == [(k, i) for k in ("a", "b") for i in range(7)]
    n = len(values)
    for r in got:
        # the level of row i by the normal equations of rows 0 to i + 3
        m = r.i + 4
        a, b = np.zeros((m, m)), np.zeros(m)
        a[0, 0] += 1 / 1e6
        for j in range(m):
            if values[j] is not None:
                a[j, j] += 1.0
                b[j] += values[j]
            if j:
                a[j - 1 : j + 1, j - 1 : j + 1] += np.array([[1, -1], [-1, 1]]) / 0.5
        assert m <= n and abs(np.linalg.solve(a, b)[r.i] - r.level) < 1e-3 and abs(np.linalg.inv(a)[r.i, r.i] - r.variance) < 1e-3


def test_refractory_and_row_blocks_over_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", i, i in (1, 3, 6, 7, 13), float(i)) for i in range(20)], "id string, i long, hit boolean, value double")
    got = drain(spark, streaming.refractory_triggers(in_order(spark, df, tmp_path), "id", "i", "hit", 5), tmp_path / "x", "append")
    assert sorted(r.i for r in got) == [1, 6, 13]
    got = drain(spark, streaming.row_blocks(in_order(spark, df, tmp_path / "y"), "id", "i", "value", 8, 4), tmp_path / "y", "append")
    assert sorted((r.block, r.rows, r["mean"]) for r in got) == [(0, 8, 3.5), (1, 8, 7.5), (2, 8, 11.5), (3, 8, 15.5)]
