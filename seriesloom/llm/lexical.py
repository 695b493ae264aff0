"""Exact ranked search for words, by range maxima over posting lists.

Documents are indexed where they are read: a task turns some thousand documents into posting lists
of the queries' terms, with each posting's impact, and lays a sparse table over them that tells the
largest impact in any stretch of a list in two look-ups. For a query, an interval of documents can
score no more than the sum of its terms' largest impacts there. Intervals are taken in the order of
that bound, each is split at the document of its largest impact, which is scored, and those whose
bound falls below the k-th score found are left. Intervals of few documents are scored whole.
Thresholds are kept from one part of a task's documents to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged
from seriesloom.llm.tokens import ALNUM, ascii_lowered, runs

#: Postings that a task indexes together, documents of an interval that is scored whole, and intervals that are split at once.
POSTINGS, LEAF, BATCH = 1 << 20, 64, 64
#: Terms, repeats included, of the queries that are sent to the tasks together: about 16 bytes each.
CHUNK_TERMS = 500_000
_TIE = 20  # bits below an impact that part equal ones by chance, so that splits stay even


class Query(NamedTuple):
    item: int | None
    terms: np.ndarray  # places in the chunk's vocabulary
    weights: np.ndarray  # of a term, times its repeats


class ImpactIndex:
    """Posting lists one after another, by term and document, under one sparse table of range maxima."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, terms: int):
        # documents in an order by chance: lists whose impacts rise with the document would be split unevenly
        rng = np.random.Generator(np.random.Philox(13))
        self.order = rng.permutation(docs)
        place = np.empty(docs, np.int64)
        place[self.order] = np.arange(docs)
        key = term * docs + place[doc]
        by = np.argsort(key)
        self.docs, self.key, self.impact = docs, key[by], impact[by]
        self.starts = np.searchsorted(self.key, np.arange(terms + 1) * docs)
        rank = (self.impact << _TIE) | rng.integers(0, 1 << _TIE, len(key))
        longest = int(np.diff(self.starts).max(initial=1))
        self.log = np.floor(np.log2(np.maximum(np.arange(longest + 1), 1))).astype(np.int64)
        self.table = np.empty((int(self.log[-1]) + 1, len(key)), np.int32)
        self.table[0] = np.arange(len(key))
        for j in range(1, len(self.table)):
            half, n = 1 << (j - 1), len(key) - (1 << j) + 1
            a, b = self.table[j - 1, :n], self.table[j - 1, half : half + n]
            self.table[j, :n] = np.where(rank[b] > rank[a], b, a)
        self.rank = rank

    def largest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the largest impact lies in each stretch of postings from `low` to `high`, which aren't empty."""
        level = self.log[high - low]
        a, b = self.table[level, low], self.table[level, high - (1 << level)]
        return np.where(self.rank[b] > self.rank[a], b, a)


def best_first(index: ImpactIndex, query: Query, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, scored): all documents that may be among the query's k best, none below `least`; and how many were scored."""
    lists = index.starts[query.terms + 1] > index.starts[query.terms]
    terms, weights = query.terms[lists][:, None], query.weights[lists][:, None]
    low, high = index.starts[terms], index.starts[terms + 1]
    first, last = np.zeros(1, np.int64), np.full(1, index.docs)
    bound, split = _bounds(index, weights, low, high)
    found_docs, found, scored = [], np.zeros(0, np.int64), 0
    while len(bound):
        live = np.flatnonzero(bound >= least)
        if not len(live):
            break
        take = live if len(live) <= BATCH else live[np.argpartition(-bound[live], BATCH)[:BATCH]]
        small = take[last[take] - first[take] <= LEAF]
        large = take[last[take] - first[take] > LEAF]
        docs, scores = _scored(index, terms, weights, low[:, small], high[:, small])
        at = split[large]
        spot = np.searchsorted(index.key, terms * index.docs + at)
        there = spot < high[:, large]
        there &= index.key[np.minimum(spot, len(index.key) - 1)] == terms * index.docs + at
        own = (weights * np.where(there, index.impact[np.minimum(spot, len(index.key) - 1)], 0)).sum(axis=0)
        scored += len(docs) + len(at)
        found_docs.append(np.concatenate((docs, at)))
        found = np.concatenate((found, scores, own))
        if len(found) >= k:
            least = max(least, int(np.partition(found, len(found) - k)[len(found) - k]))
        child_low, child_high = np.concatenate((low[:, large], spot + there), axis=1), np.concatenate((spot, high[:, large]), axis=1)
        child_bound, child_split = _bounds(index, weights, child_low, child_high)
        rest, new = np.setdiff1d(live, take), child_bound >= least
        join = lambda old, child: np.concatenate((old[..., rest], child[..., new]), axis=-1)
        low, high, bound, split = join(low, child_low), join(high, child_high), join(bound, child_bound), join(split, child_split)
        first, last = join(first, np.concatenate((first[large], at + 1))), join(last, np.concatenate((at, last[large])))
    docs = np.concatenate(found_docs) if found_docs else np.zeros(0, np.int64)
    keep = found >= least
    return index.order[docs[keep]], found[keep], scored


def _bounds(index: ImpactIndex, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval (a column of posting stretches) the sum of its terms' largest impacts, and the document of the largest."""
    if not low.size:
        return np.full(low.shape[1], -1), np.zeros(low.shape[1], np.int64)
    some = high > low
    at = np.zeros(low.shape, np.int64)
    at[some] = index.largest(low[some], high[some])
    gain = np.where(some, weights * index.impact[at], -1)
    top = at[gain.argmax(axis=0), np.arange(gain.shape[1])]
    return np.where(some.any(axis=0), np.maximum(gain, 0).sum(axis=0), -1), index.key[top] % index.docs


def _scored(index: ImpactIndex, terms: np.ndarray, weights: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents of some intervals that hold a term, with their scores."""
    sizes = (high - low).ravel()
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(sizes.sum()) + np.repeat(low.ravel() - np.cumsum(sizes) + sizes, sizes)
    doc = index.key[at] - np.repeat(np.broadcast_to(terms * index.docs, low.shape).ravel(), sizes)
    gain = index.impact[at] * np.repeat(np.broadcast_to(weights, low.shape).ravel(), sizes)
    by = np.argsort(doc, kind="stable")
    heads = np.flatnonzero(np.diff(doc[by], prepend=-1))
    return doc[by][heads], np.add.reduceat(gain[by], heads)


def _postings(column: pa.Array, vocabulary: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, terms of each text, and by text and term: text, place in `vocabulary`, occurrences) for successive texts."""
    for w in runs(column, ALNUM, ascii_lowered):
        n = np.diff(w.bounds)
        at = np.minimum(np.searchsorted(vocabulary, w.hashes), max(0, len(vocabulary) - 1))
        hit = np.flatnonzero(vocabulary[at] == w.hashes) if len(vocabulary) else np.zeros(0, np.int64)
        pair, tf = np.unique(np.repeat(np.arange(len(n)), n)[hit] * max(1, len(vocabulary)) + at[hit], return_counts=True)
        yield w.first, n, pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary)), tf


def _queries(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, text_hash, terms): the terms of each different item, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in runs(b.column(2), ALNUM, ascii_lowered):
                rows = len(w.bounds) - 1
                lists = pa.ListArray.from_arrays(pa.array(w.bounds, pa.int32()), pa.array(w.hashes.view(np.int64)))
                yield pa.record_batch([b.column(0).slice(w.first, rows), b.column(1).slice(w.first, rows), lists], names=["item", "part", "terms"])

    rows = items.select(F.col(item_col).cast("long").alias("item"), F.xxhash64(item_col, text_col).alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.distinct().mapInArrow(run, "item long, part long, terms array<long>").where(F.size("terms") > 0)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """(item_col, rank, id_col, score, scored): the k highest-scoring documents of each item, exactly.

    A term is a run of ASCII letters and digits and all other characters beyond ASCII, A-Z in lower case. With N
    documents that hold a term, L terms in all, n in a document, df documents with a term and tf occurrences in a document,
    a document scores for each of the item's terms, repeats included, w * (10^9 tf div (1000 tf + 12 m)), where
    w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 75 + 25 n N div L. Scores above 0 count; ties go to the smaller id.

    Items that are null or have no term find nothing; equal rows of `items` are one, different texts of
    one id are ranked apart. Null texts have no terms. Rows that repeat an id are candidates of their own; rows of a null id count in
    the statistics but aren't found. `scored` is the number of documents that the row's task scored for the item.
    No documents, or no items: no rows.
    """
    spark = docs.sparkSession
    asked = staged(_queries(items, item_col, item_text), "queries")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for chunk in _chunks(asked):
        vocabulary, queries = _chunk(chunk)
        stats = _statistics(rows, vocabulary)
        whole, total = stats.pop(-1, 0), stats.pop(-2, 0)
        df = np.array([stats.get(i, 0) for i in range(len(vocabulary))])
        weight = np.floor(1000 * np.log((2 * whole + 2) / (2 * df + 1))).astype(np.int64)
        ready = [(item, part, Query(item, terms, weight[terms] * repeats)) for item, part, terms, repeats in queries]
        parts.append(rows.mapInArrow(_searcher(spark.sparkContext.broadcast((vocabulary, ready, whole, total)), k), "item long, part long, id long, score long, scored long"))
    if not parts:
        return rows.limit(0).select(F.col("id").alias(item_col), F.lit(0).alias("rank"), F.col("id").alias(id_col), F.col("id").alias("score"), F.col("id").alias("scored"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    # each task gives k rows an item: the best of many tasks in two steps
    dealt = F.pmod(F.xxhash64("id", "score"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = [F.desc("score"), F.col("id"), F.col("scored")]
    some = found.withColumn("dealt", dealt).withColumn("place", F.row_number().over(Window.partitionBy("item", "part", "dealt").orderBy(*order))).where(F.col("place") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score", "scored")


def _chunks(asked: DataFrame) -> Iterator[DataFrame]:
    """`asked` in parts of at most CHUNK_TERMS terms, or of one item."""
    total, items = asked.agg(F.sum(F.size("terms")), F.count("*")).first()
    n = -(-2 * (total or 0) // CHUNK_TERMS)
    while n:
        dealt = asked.withColumn("chunk", F.pmod(F.xxhash64("item", "part"), F.lit(n)))
        if n > 8 * items or not dealt.groupBy("chunk").agg(F.sum(F.size("terms")).alias("t"), F.count("*").alias("c")).where((F.col("t") > CHUNK_TERMS) & (F.col("c") > 1)).head(1):
            break
        n *= 2
    return (dealt.where(F.col("chunk") == i) for i in range(n))


def _chunk(chunk: DataFrame) -> tuple[np.ndarray, list[tuple]]:
    """(vocabulary, queries): the different terms of a chunk; and item, part, places of its terms there, and their repeats."""
    t = chunk.select("item", "part", "terms").toArrow().combine_chunks()  # at most CHUNK_TERMS terms
    lists = [np.unique(x.values.to_numpy().view(np.uint64), return_counts=True) for x in t.column("terms")]
    vocabulary = np.unique(np.concatenate([x for x, _ in lists])) if lists else np.zeros(0, np.uint64)
    return vocabulary, [(i, p, np.searchsorted(vocabulary, x), n) for i, p, (x, n) in zip(t.column("item").to_pylist(), t.column("part").to_pylist(), lists, strict=True)]


def _statistics(rows: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Documents that hold each term, by its place in `vocabulary`; -1: that hold any term, -2: all their terms."""
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        df, whole, total = np.zeros(len(known), np.int64), 0, 0
        for b in batches:
            for _first, n, _doc, term, _tf in _postings(b.column(0), known):
                df += np.bincount(term, minlength=len(known))
                whole, total = whole + int((n > 0).sum()), total + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((df[some], [whole, total])))], names=["term", "n"])

    counts = rows.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in counts.collect()}  # a row for each term of the chunk


def _searcher(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, queries, whole, total = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        scored = np.zeros(len(queries), np.int64)
        held, size = [], 0

        def visit() -> None:
            ids, n, term, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1, 3, 4))
            heads = np.cumsum([0, *(len(h[0]) for h in held)])
            doc = np.concatenate([h[2] + a for h, a in zip(held, heads, strict=False)])
            m = 75 + 25 * n.astype(np.int64) * whole // max(1, total)
            index = ImpactIndex(term, doc, 1_000_000_000 * tf // (1000 * tf + 12 * m[doc]), len(ids), len(vocabulary))
            for i, (_item, _part, query) in enumerate(queries):
                old_ids, old = best[i]
                docs, scores, count = best_first(index, query, k, max(1, int(old[-1])) if len(old) == k else 1)
                scored[i] += count
                if len(docs):
                    all_ids, every = np.concatenate((old_ids, ids[docs])), np.concatenate((old, scores))
                    first = np.lexsort((all_ids, -every))[:k]
                    best[i] = all_ids[first], every[first]

        for b in batches:
            there = b.column(0).is_valid()
            b = pa.RecordBatch.from_arrays([b.column(0).filter(there), b.column(1).filter(there)], names=["id", "text"])
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, n, doc, term, tf in _postings(b.column(1), vocabulary):
                held.append((ids[first : first + len(n)], n, doc, term, tf))
                size += len(term)
                if size >= POSTINGS:
                    visit()
                    held, size = [], 0
        if size:
            visit()
        sizes = [len(s) for _, s in best]
        columns = [pa.array(np.repeat(np.arange(len(queries)), sizes)), *(np.concatenate([x[i] for x in best]) if best else np.zeros(0, np.int64) for i in (0, 1))]
        item, part = (pa.array([q[i] for q in queries], pa.int64()).take(columns[0]) for i in (0, 1))
        yield pa.record_batch([item, part, pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(np.repeat(scored, sizes), pa.int64())], names=["item", "part", "id", "score", "scored"])

    return run


def op13_range_maximum_search(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("scored")


OP13_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS whole, sum(len(w)) AS total FROM t WHERE len(w) > 0),
p AS (SELECT d, doc_id, len(w) AS n, unnest(w) AS term FROM t),
tf AS (SELECT d, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(whole) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term),
im AS (SELECT d, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * CAST(whole AS BIGINT)) // CAST(total AS BIGINT))) AS impact FROM tf, s),
q AS (
  SELECT item_id, text, term, count(*) AS repeats
  FROM (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{term}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL),
r AS (
  SELECT item_id, text, doc_id, d, CAST(sum(repeats * w * impact) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN im USING (term) WHERE doc_id IS NOT NULL GROUP BY item_id, text, doc_id, d),
k AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
""".replace("{term}", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
