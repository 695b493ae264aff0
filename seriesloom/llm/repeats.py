"""Stretches of words that an earlier document holds too, by seeds that are extended.

Of every window of `length` words the smallest hash of its runs of `seed` words is an anchor
(winnowing), so equal windows have an equal anchor at an equal place. Anchors of two documents or
more are seeds. A seed is extended both ways, by as many words as any window through it can reach:
all documents with the same surroundings form a class, and in all but the class's first document
every window there is a repeat. What is left are the first documents of classes whose anchor has other
surroundings elsewhere; the windows around these are compared one by one. Windows that touch or
overlap make up a maximal repeat. Nothing pairs documents: classes and windows know their smallest id only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.keyed import joined
from seriesloom.functions.staging import drop_staged, staged
from seriesloom.llm.beside import few_entries, forget_shuffles
from seriesloom.llm.tokens import NO_SPACE, Words, runs

#: Words of the shortest repeat, and of an anchor.
LENGTH, SEED = 13, 6
_RNG = np.random.Generator(np.random.Philox(11))
_FACTORS = _RNG.integers(0, 1 << 63, (4, 256), np.uint64) * np.uint64(2) + np.uint64(1)


def _sum(hashes: np.ndarray, at: np.ndarray, words: int, kind: int) -> np.ndarray:
    """A hash of the `words` words from each place on; kinds are independent."""
    out = np.zeros(len(at), np.uint64)
    for j in range(words):
        out += hashes[at + j] * (_FACTORS[kind, j & 255] + np.uint64(2 * (j >> 8)))
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return out ^ (out >> np.uint64(28))


def anchors(hashes: np.ndarray, bounds: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first, last, text) of the anchors of texts whose words lie between `bounds`.

    The windows that start from `first` to `last` chose the anchor at `place`; every window chose one.
    """
    n, wide = len(hashes) - length + 1, length - seed + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    gram = _sum(hashes, np.arange(n + wide - 1), seed, 0)
    least, pick = gram[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, wide):
        less = gram[j : j + n] < least
        least[less] = gram[j : j + n][less]
        pick[less] = j
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.flatnonzero(text[:n] == text[length - 1 :])
    at = start + pick[start]
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], gram[at[new]], start[new], start[np.append(new[1:], len(start)) - 1] if len(new) else start, text[at[new]]


def surroundings(hashes: np.ndarray, bounds: np.ndarray, at: np.ndarray, text: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """A hash of all words that a window through each anchor can hold, as far as its text goes."""
    reach = length - seed
    padded = np.insert(hashes, np.repeat(bounds, reach), np.uint64(0))  # blanks around every text
    return _sum(padded, at + text * reach, seed + 2 * reach, 1)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    return docs.select(ident.alias("id"), F.xxhash64(ident, text).alias("row"), text.alias("text"))


def _seeds(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(anchor, around, id, row, at) of every anchor of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in runs(b.column(2), NO_SPACE):
                at, gram, _first, _last, text = anchors(w.hashes, w.bounds, length, seed)
                around = surroundings(w.hashes, w.bounds, at, text, length, seed)
                of = pa.array(text + w.first)
                yield pa.record_batch([pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), b.column(0).take(of), b.column(1).take(of), pa.array(at - w.bounds[text], pa.int32())], names=["anchor", "around", "id", "row", "at"])

    return rows.where("id is not null").mapInArrow(run, "anchor long, around long, id long, row long, at int")


def _flat(lists: pa.Array, w: Words, part: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, entry) of the lists of a slice's rows."""
    mine = lists.slice(w.first, len(w.bounds) - 1)
    sizes = pc.fill_null(pc.list_value_length(mine), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(mine)
    flat = pc.struct_field(flat, part) if part else flat
    return np.repeat(np.arange(len(sizes)), sizes), flat.to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """(a, b, id, row, at): hashes and places of the windows that chose the anchors in the list `open`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in runs(batch.column(2), NO_SPACE):
                place, _gram, first, last, text = anchors(w.hashes, w.bounds, length, seed)
                own, at = _flat(batch.column(3), w)
                mine = np.flatnonzero(np.isin(place, w.bounds[own] + at))
                sizes = last[mine] - first[mine] + 1
                start = np.arange(sizes.sum()) + np.repeat(first[mine] - np.cumsum(sizes) + sizes, sizes)
                text = np.repeat(text[mine], sizes)
                of = pa.array(text + w.first)
                hashes = [pa.array(_sum(w.hashes, start, length, kind).view(np.int64)) for kind in (2, 3)]
                yield pa.record_batch([*hashes, batch.column(0).take(of), batch.column(1).take(of), pa.array(start - w.bounds[text], pa.int32())], names=["a", "b", "id", "row", "at"])

    return rows.mapInArrow(run, "a long, b long, id long, row long, at int")


def repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(row, spans): stretches, by words from 0 with the end left out, of windows that start in a document of a smaller id too.

    `row` is the xxhash64 of id (as a long) and text (null: empty). Spans may overlap and reach over the text's ends;
    together they cover what repeats. Rows of a null id, which is not smaller or larger than any, have none.
    """
    spark, rows, reach = docs.sparkSession, _rows(docs, id_col, text_col), length - seed
    found = _seeds(rows, length, seed)
    shared = found.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("around").alias("low"), F.max("around").alias("high"), F.count("*").alias("n"))
    shared = staged(shared.where(F.col("first") < F.col("last")).select("anchor", "first", (F.col("low") != F.col("high")).alias("parts"), "n"), "shared")
    forget_shuffles(spark)
    seeds = joined(found, shared, ["anchor"]).where(F.col("parts") | (F.col("id") > F.col("first"))).drop("first")
    seeds = staged(seeds, "seeds")
    drop_staged(shared)
    forget_shuffles(spark)
    several = seeds.where("parts").drop("parts")
    classes = staged(several.groupBy("anchor", "around").agg(F.min("id").alias("first"), F.count("*").alias("n")), "classes")
    known = joined(several, classes, ["anchor", "around"]).select("row", "at", (F.col("id") > F.col("first")).alias("later"))
    known = staged(known.unionAll(seeds.where(~F.col("parts")).select("row", "at", F.lit(True))), "known")
    drop_staged(classes)
    drop_staged(seeds)
    opened = staged(known.where(~F.col("later")).groupBy("row").agg(F.collect_set("at").alias("open")), "open")
    forget_shuffles(spark)
    windows = staged(_windows(rows.where("id is not null").join(few_entries(opened, "open"), "row").select("id", "row", "text", "open"), length, seed), "windows")
    forget_shuffles(spark)
    equal = windows.groupBy("a", "b").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    equal = staged(equal.where(F.col("first") < F.col("last")).select("a", "b", "first", "n"), "equal")
    single = joined(windows, equal, ["a", "b"]).where(F.col("id") > F.col("first")).select("row", _span(F.col("at"), F.col("at") + length))
    spans = known.where("later").select("row", _span(F.col("at") - reach, F.col("at") + length)).unionAll(single)
    spans = staged(spans.groupBy("row").agg(F.collect_set("span").alias("spans")), "spans")
    for done in (opened, known, windows, equal):
        drop_staged(done)
    forget_shuffles(spark)
    return spans


def _span(low: Column, high: Column) -> Column:
    return F.struct(low.alias("from"), high.alias("to")).alias("span")


def without_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(id_col, n_words, n_removed, kept, repeats) for every row of `docs`.

    Words are runs of anything but ASCII white space. `repeats` are the maximal stretches (from word, to word, end left out) covered by
    windows of `length` words whose words also stand in a row in a document of a smaller id; `kept` has all
    other words, joined by one space. Texts are judged as they came, not by what is left of others. A null text has no words; a null id is
    neither smaller nor larger than another; rows of one id don't count for each other. No rows: no result rows.
    """
    spans = few_entries(repeats(docs, id_col, text_col, length, seed), "spans")
    rows = _rows(docs, id_col, text_col).join(spans, "row", "left").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in runs(b.column(1), NO_SPACE):
                texts, words = len(w.bounds) - 1, len(w.hashes)
                sizes = np.diff(w.bounds)
                of, low = _flat(b.column(2), w, "from")
                high = _flat(b.column(2), w, "to")[1]
                step = np.zeros(words + 1, np.int64)
                np.add.at(step, w.bounds[of] + np.clip(low, 0, sizes[of]), 1)
                np.add.at(step, w.bounds[of] + np.clip(high, 0, sizes[of]), -1)
                gone = np.cumsum(step)[:-1] > 0
                text = np.repeat(np.arange(texts), sizes)
                edge = np.diff(text, prepend=-1) != 0
                head = np.flatnonzero(gone & (edge | ~np.append(False, gone)[:-1]))
                tail = np.flatnonzero(gone & ~np.append(gone & ~edge, False)[1:]) + 1
                whose = text[head]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(whose, np.arange(texts + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(head - w.bounds[whose]), pa.array(tail - w.bounds[whose])], names=["from", "to"]))
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[w.bounds])
                kept = np.flatnonzero(~gone)
                before = kept[:-1][text[kept[:-1]] == text[kept[1:]]]  # kept words that another one follows
                data = w.data.copy()
                data[w.ends[before]] = 32
                take = np.zeros(len(data), bool)
                take[np.flatnonzero(NO_SPACE[w.data])] = np.repeat(~gone, w.ends - w.starts)
                take[w.ends[before]] = True
                ends = np.concatenate(([0], np.cumsum(take)))[w.offsets].astype(np.int32)
                string = pa.StringArray.from_buffers(texts, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[take].tobytes()))
                yield pa.record_batch([b.column(0).slice(w.first, texts), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), string, lists], names=["id", "n_words", "n_removed", "kept", "repeats"])

    out = rows.mapInArrow(run, "id long, n_words long, n_removed long, kept string, repeats array<struct<from:long,to:long>>")
    return out.withColumnRenamed("id", id_col)


def op11_seed_and_extend_repeats(spark, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT d, doc_id, w[i] AS word, i, CASE WHEN i <= len(w) - 12 THEN hash(list_slice(w, i, i + 12)) END AS h, CASE WHEN i <= len(w) - 12 THEN md5(array_to_string(list_slice(w, i, i + 12), ' ')) END AS g
      FROM (SELECT d, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
f AS (SELECT h, g, min(doc_id) AS first FROM p WHERE h IS NOT NULL GROUP BY h, g),
c AS (
  SELECT d, word, i, max(CASE WHEN first < doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM p LEFT JOIN f USING (h, g)),
k AS (SELECT d, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (d)
"""
