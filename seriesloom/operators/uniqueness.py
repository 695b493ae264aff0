"""Keys that repeat anywhere in a table of shards, without shuffling the keys that can't."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.staging import drop_staged, staged

#: Bits of the filter for a row, and the most in all, as powers of 2: 128 MB to each executor.
ROW_BITS, MOST_BITS = 4, 30
#: Bits of a piece of the filter, as a power of 2.
PIECE_BITS = 15


class Repeats(NamedTuple):
    repeats: DataFrame  # (keys..., rows, shards): each key of two rows or more, with its shards in order
    rows: int  # of the table
    shuffled: int  # of them, rows whose key could repeat


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places in a filter of 2 ** bits for each hash."""
    h = hashes.view(np.uint64)
    return np.stack([h & np.uint64((1 << bits) - 1), h >> np.uint64(64 - bits)]).astype(np.int64)


def _twice(hashes: DataFrame, bits: int) -> np.ndarray:
    """A filter of the places that two rows or more have, as bytes.

    Every task marks the places that its rows have once, and twice or more; pieces of these marks meet by their number,
    so what is shuffled is at most two filters a task, and less where a task has few rows.
    """
    size = 1 << min(PIECE_BITS, bits)

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, more = (np.zeros(1 << (bits - 3), np.uint8) for _ in range(2))
        for b in batches:
            places = _places(b.column(0).to_numpy(), bits)
            for own in places:  # the two kinds of places are marked in one filter
                own, n = np.unique(own, return_counts=True)
                bit = (1 << (own & 7)).astype(np.uint8)
                seen = (once[own >> 3] & bit) > 0
                np.bitwise_or.at(more, own[seen | (n > 1)] >> 3, bit[seen | (n > 1)])
                np.bitwise_or.at(once, own >> 3, bit)
        pieces = once.reshape(-1, size // 8)
        used = np.flatnonzero(pieces.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 1000)):
            yield pa.record_batch([pa.array(part), *(pa.array([x.tobytes() for x in f.reshape(-1, size // 8)[part]], pa.binary()) for f in (once, more))], names=["piece", "once", "more"])

    def fold(parts: pd.DataFrame) -> pd.DataFrame:
        once, more = (np.zeros(size // 8, np.uint8) for _ in range(2))
        for a, b in zip(parts["once"], parts["more"], strict=True):
            own = np.frombuffer(a, np.uint8)
            more |= np.frombuffer(b, np.uint8) | (once & own)
            once |= own
        return pd.DataFrame({"piece": [parts["piece"].iloc[0]], "more": [more.tobytes()]})

    marked = hashes.mapInArrow(marks, "piece long, once binary, more binary")
    parts = marked.groupBy("piece").applyInPandas(fold, "piece long, more binary").toArrow()  # a filter at most
    out = np.zeros((max(1, (1 << bits) // size), size // 8), np.uint8)
    for piece, more in zip(parts.column("piece").to_pylist(), parts.column("more"), strict=True):
        out[piece] = np.frombuffer(more.as_buffer(), np.uint8)
    return out.ravel()


def repeated_keys(table: DataFrame, keys: list[str], shard: str) -> Repeats:
    """The keys that two rows or more have, in one shard or in several, exactly. Null keys equal each other.

    Only rows whose key has both its places in the filter of places that repeat are shuffled: the repeats themselves and,
    at 16 bits a row, about one other row in sixty; above 67 million rows the filter grows no more and lets more through.
    """
    hashed = staged(table.select(*keys, shard, F.xxhash64(*keys).alias("__h")), "hashed")
    rows = hashed.count()
    bits = min(MOST_BITS, max(12, int(rows).bit_length() + ROW_BITS))
    sent = table.sparkSession.sparkContext.broadcast(_twice(hashed.select("__h"), bits))

    @F.pandas_udf("boolean")
    def may_repeat(hashes: pd.Series) -> pd.Series:
        full, places = sent.value, _places(hashes.to_numpy(), bits)
        return pd.Series(((full[places >> 3] >> (places & 7).astype(np.uint8)) & 1).all(axis=0))

    some = staged(hashed.where(may_repeat("__h")).drop("__h"), "some")
    drop_staged(hashed)
    repeats = some.groupBy(*keys).agg(F.count("*").alias("rows"), F.array_sort(F.collect_set(shard)).alias("shards")).where("rows > 1")
    return Repeats(repeats, rows, some.count())


def unique_across(shards: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of shards, which must not share a key or repeat one."""
    tagged = [s.withColumn("__shard", F.lit(i)) for i, s in enumerate(shards)]
    table = tagged[0]
    for s in tagged[1:]:
        table = table.unionByName(s)
    if twice := repeated_keys(table, keys, "__shard").repeats.head(1):
        raise ValueError(f"shards repeat {keys}, for example {twice[0].asDict()}")
    return table.drop("__shard")
