"""A table replayed as a stream that arrives in slices of time, and the stream's rows as a table again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.staging import drop_staged, new_path, staged

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cuts(rows: DataFrame, time: str, slices: int) -> list[int]:
    """Microseconds at which slices of about equal row counts begin, the first one's left out; fewer where times repeat."""
    shares = [i / slices for i in range(1, slices)]
    if not shares:
        return []
    found = rows.agg(F.percentile_approx(F.unix_micros(time), shares, 10_000).alias("at")).first()["at"]
    return sorted(set(found or []))


def latest(batches: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that came again in later batches, the last of each key: what an update stream says at its end."""
    rest = [c for c in batches.columns if c not in (*keys, "batch")]
    last = batches.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last"))
    return last.select(*keys, *(F.col("__last")[c].alias(c) for c in rest))


def replayed(rows: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", slices: int = 3, rocks: bool = False) -> DataFrame:
    """What `build(stream)` has given once `rows` have arrived slice by slice, in the order of `time`.

    Each slice is one arrival: its files are added to the source's folder, and the stream is started anew from its checkpoint
    for all that is there. So state passes from slice to slice through the checkpoint only, as after a lost driver, and rows of
    a slice are all later than those before it (equal times stay together; rows without a time come first).
    In mode `append` files are written once each by the file sink's log. In mode `update` or `complete` each batch is a folder
    that a repeated batch overwrites, and the result has its number in `batch`; see `latest`.
    All folders lie in the shared folder. With `rocks` the state store is RocksDB, which list state and timers need.
    """
    spark = rows.sparkSession
    held = staged(rows, "replay")
    edges = [None, *cuts(held, time, slices), None]
    source, state, out = (new_path(spark, f"stream-{what}") for what in ("in", "state", "out"))
    at = F.unix_micros(time)
    schema = None
    for low, high in zip(edges, edges[1:], strict=False):
        part = held if low is None else held.where(at >= low)
        if high is not None:
            part = part.where((at < high) | F.col(time).isNull()) if low is None else part.where(at < high)
        part.write.mode("append").parquet(source)
        given = build(spark.readStream.schema(held.schema).parquet(source))
        schema = given.schema
        writer = given.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        if mode == "append":
            writer = writer.format("parquet").option("path", out)
        else:
            writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"))
        before = spark.conf.get(PROVIDER)
        if rocks:
            spark.conf.set(PROVIDER, ROCKS)
        try:
            query = writer.start()  # takes the settings with it
        finally:
            spark.conf.set(PROVIDER, before)
        query.awaitTermination()
    drop_staged(held)
    return spark.read.schema(schema if mode == "append" else schema.add("batch", "long")).parquet(out)
