"""Exact top-k search by inner product, a block of documents at a time.

Vectors become integer weights of terms (their components). A block holds the forward index of a
run of vectors and the largest and smallest weight of each term in it, from which follows a bound
on any of its scores for a query. Blocks are scored in the order of that bound, query by query,
until the bound falls below the k-th score found; a block whose bound equals it is still scored,
for ties. Vectors are laid out by the signs of their first components, so that blocks are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged

#: Vectors of a block, and queries of a chunk.
BLOCK, CHUNK = 128, 256
#: As powers of two: blocks of a range, which a task scores together, and chunks that visit a range together.
RANGE_BITS, GROUP_BITS = 6, 4
_EXACT = float(1 << 53)


def terms(vectors: DataFrame, id_col="vec_id", vector_col="embedding", scale: int = 256) -> DataFrame:
    """(id, terms): floor(scale * x) of each component, of rows without null or non-finite components."""
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("terms"))


def _packed(rows: DataFrame, size: int, width: int) -> DataFrame:
    """(ids, data): every `size` successive rows of a partition as one, vectors padded with 0 to `width` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = np.zeros(0, np.int64), np.zeros((0, width), np.int64)

        def out(n: int) -> pa.RecordBatch:
            return pa.record_batch([pa.array([ids[:n].tobytes()], pa.binary()), pa.array([held[:n].tobytes()], pa.binary())], names=["ids", "data"])

        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            new = np.zeros((len(sizes), width), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            new[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            ids, held = np.concatenate((ids, b.column(0).to_numpy(zero_copy_only=False))), np.concatenate((held, new))
            while len(ids) >= size:
                yield out(size)
                ids, held = ids[size:], held[size:]
        if len(ids):
            yield out(len(ids))

    return rows.select("id", "terms").mapInArrow(run, "ids binary, data binary")


def _numbered(packed: DataFrame, bits: int, name: str, what: str) -> tuple[DataFrame, Column]:
    """`packed`, written, with 2 ** `bits` successive rows of a partition under one number; and an array of all these numbers."""
    rows = staged(packed.withColumn("n", F.monotonically_increasing_id()), what)
    parts, most = rows.agg(F.max(F.shiftright("n", 33)) + 1, F.max(F.col("n").bitwiseAND(F.lit((1 << 33) - 1)))).first()
    wide = (most >> bits) + 1
    numbers = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(parts * wide - 1)), lambda i: F.shiftleft(F.floor(i / wide), 33 - bits) + i % wide)
    return rows.select("ids", "data", F.shiftright("n", bits).alias(name)), numbers


def search_block_order(queries: np.ndarray, query_ids: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, scores, there) of the k best of each query over `blocks` (ids, vectors), and how many scores were computed.

    `there` is false at places for which there is no vector. A query's own id is passed over.
    """
    n, top = len(queries), max([np.abs(queries).max(initial=0), *(np.abs(d).max(initial=0) for _, d in blocks)])
    exact = float(top) ** 2 * max(1, queries.shape[1]) < _EXACT
    kind, least = (np.float64, -np.inf) if exact else (np.int64, np.iinfo(np.int64).min)
    q = queries.astype(kind)
    high, low = (np.stack([f(d, axis=0) for _, d in blocks]).astype(np.float64) for f in (np.max, np.min))
    bound = np.maximum(queries, 0).astype(float) @ high.T + np.minimum(queries, 0).astype(float) @ low.T
    if not exact:
        bound[:] = np.inf
    order = np.argsort(-bound, axis=1, kind="stable")
    best_s, best_i = np.full((n, k), least, kind), np.full((n, k), np.iinfo(np.int64).max)
    scored = 0
    for r in range(len(blocks)):
        at = order[:, r]
        live = np.flatnonzero(bound[np.arange(n), at] >= best_s[:, -1].astype(float))
        if not live.size:
            break
        for block in np.unique(at[live]):
            mine = live[at[live] == block]
            ids, data = blocks[block]
            s = q[mine] @ data.astype(kind).T
            scored += s.size
            s[ids[None, :] == query_ids[mine][:, None]] = least
            near = np.flatnonzero((s >= best_s[mine, -1:]).any(axis=1))
            if near.size:
                mine, s = mine[near], s[near]
                both_s = np.concatenate((best_s[mine], s), axis=1)
                both_i = np.concatenate((best_i[mine], np.broadcast_to(ids, s.shape)), axis=1)
                both_i[both_s == least] = np.iinfo(np.int64).max
                first = np.lexsort((both_i, -both_s if exact else ~both_s), axis=1)[:, :k]
                best_s[mine], best_i[mine] = np.take_along_axis(both_s, first, 1), np.take_along_axis(both_i, first, 1)
    there = best_s != least
    return best_i, np.where(there, best_s, 0).astype(np.int64), there, scored


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col="vec_id", vector_col="embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, id_col, score, scored): the k best of all other vectors for each whose id is divisible by `every`.

    Scores are integer inner products; ties go to the smaller id; fewer than k others give fewer
    rows. Vectors that are null or hold a null or non-finite component take no part, nor do those
    of a null id. A shorter vector counts as padded with zeros. Rows of the query's own id are passed over;
    rows that repeat an id are separate candidates, and a query's repeated rows are one query where
    they are equal. `scored` is the number of scores computed for the query's chunk of the range
    that gave the row. No vectors: no rows.
    """
    rows = staged(terms(vectors, id_col, vector_col, scale).where("id is not null"), "terms")
    width, total = rows.agg(F.max(F.size("terms")), F.count("*")).first()
    if not total:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.col("id").alias("score"), F.col("id").alias("scored"))
    alike = F.aggregate(F.slice("terms", 1, 12), F.lit(0).cast("long"), lambda a, x: a * 2 + F.when(x > 0, 1).otherwise(0))
    parts = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), (total >> RANGE_BITS) // BLOCK + 1))
    laid = rows.withColumn("alike", alike).repartitionByRange(parts, "alike", "id").sortWithinPartitions("alike", "id")
    blocks, ranges = _numbered(_packed(laid, BLOCK, width), RANGE_BITS, "range", "blocks")
    asked = rows.where(F.col("id") % every == 0).distinct().repartition(max(1, total // (every * CHUNK * 4)), "id")
    chunks, groups = _numbered(_packed(asked, CHUNK, width), GROUP_BITS, "group", "chunks")
    left, right = blocks.withColumn("group", F.explode(groups)), chunks.withColumn("range", F.explode(ranges))

    def score(docs: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if docs.num_rows and asks.num_rows:
            take = lambda t, i: (np.frombuffer(t.column("ids")[i].as_py(), np.int64), np.frombuffer(t.column("data")[i].as_py(), np.int64).reshape(-1, width))
            index = [take(docs, i) for i in range(docs.num_rows)]
            for i in range(asks.num_rows):
                ids, data = take(asks, i)
                found, scores, there, scored = search_block_order(data, ids, index, k)
                real = there.ravel()
                for column, values in zip(out, (np.repeat(ids, k), found.ravel(), scores.ravel(), np.full(found.size, scored)), strict=True):
                    column.append(values[real])
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in zip(("query_id", id_col, "score", "scored"), out, strict=True)})

    found = left.groupBy("range", "group").cogroup(right.groupBy("range", "group")).applyInArrow(score, f"query_id long, `{id_col}` long, score long, scored long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score", "scored")


def op9_block_at_a_time_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("scored")


OP9_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
