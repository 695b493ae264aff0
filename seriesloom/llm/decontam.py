"""Documents that hold passages of a benchmark, found by spaced seeds.

A seed is a window of 8 words of which a fixed mask leaves out two, so that a hit survives
replaced words at those places. The masks are chosen such that every accepted overlap with an item
of 8 to 17 words has a seed in common (by enumeration). Items of fewer words are sought whole.
Documents' seeds are sifted by a filter that the benchmark's seeds fill; what passes is joined with
them exactly. Around every hit the two word sequences are laid side by side and compared, replaced
words allowed. Of a short item only its first place in a text is looked at, as all others say the same.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.keyed import joined
from seriesloom.functions.staging import staged
from seriesloom.llm.beside import beside
from seriesloom.llm.tokens import words

#: Words of a window, and the two places that each mask leaves out.
SPAN = 8
LEFT_OUT = [(2, 3), (5, 6), (2, 4), (5, 7), (2, 5), (1, 5), (0, 5)]
#: Windows by kind: the masks, and for items of fewer than SPAN words whole windows of their length.
MASKS = [tuple(p for p in range(SPAN) if p not in out) for out in LEFT_OUT] + [tuple(range(n)) for n in range(1, SPAN)]
SPANS = [SPAN] * len(LEFT_OUT) + list(range(1, SPAN))
#: An item counts as held if this many of its words stand in order with at least this part of them in place; of items below that, that part of all words, and of those below SPAN all.
MIN_WORDS, MIN_SHARE = 13, 0.8
#: Bits of the filter for each seed of the benchmark, and the most in all, as powers of 2: 32 MB to each executor.
SEED_BITS, FILTER_BITS = 8, 28
_FACTORS = np.random.Generator(np.random.Philox(8)).integers(0, 1 << 63, (len(MASKS), SPAN), np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(27))


def seeds(hashes: np.ndarray, kinds: list[int]) -> list[np.ndarray]:
    """For each of `kinds` the seed at each window of a word sequence."""
    out = []
    for k in kinds:
        n = max(0, len(hashes) - SPANS[k] + 1)
        h = np.zeros(n, np.uint64)
        for p in MASKS[k] if n else ():
            h += hashes[p : p + n] * _FACTORS[k, p]
        out.append(_mixed(h))
    return out


def kinds_of(n: int) -> list[int]:
    """The kinds of windows by which an item of `n` words is sought."""
    return list(range(len(LEFT_OUT))) if n >= SPAN else [len(LEFT_OUT) + n - 1] if n else []


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def benchmark_items(benchmark: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """(item_id, words, seeds, at): each item that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in words(b.column(1)):
                for i in range(len(w.bounds) - 1):
                    h = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    if len(h):
                        found = seeds(h, kinds_of(len(h)))
                        yield pa.record_batch([b.column(0).slice(w.first + i, 1), _lists([h.view(np.int64)], pa.int64()), _lists([np.concatenate(found).view(np.int64)], pa.int64()), _lists([np.tile(np.arange(len(found[0])), len(found))], pa.int32())], names=["item_id", "words", "seeds", "at"])

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, words array<long>, seeds array<long>, at array<int>")


def _places(h, bits: int):
    """Three places in a filter of 2 ** bits for each seed."""
    return [((h >> np.uint64(s)) & np.uint64((1 << bits) - 1)).astype(np.int64) for s in _shifts(bits)]


def _shifts(bits: int) -> tuple[int, int, int]:
    """Where in a seed the places are read, with as few bits in common as can be."""
    return 0, (64 - bits) // 2, 64 - bits


def _filter(items: DataFrame, bits: int) -> np.ndarray:
    """The filter, filled in Spark; 2 ** (bits - 3) bytes reach the driver."""
    seed = items.select(F.explode("seeds").alias("s"))
    place = F.explode(F.array(*(x.bitwiseAND(F.lit((1 << bits) - 1)) + 1 for x in (F.shiftrightunsigned("s", k) for k in _shifts(bits))))).alias("p")
    parts = seed.select(place).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("part")).toArrow()
    size = 4096  # bytes of a bucket
    out = np.zeros(max(size, 1 << (bits - 3)), np.uint8)
    for bucket, part in zip(parts.column("bucket").to_pylist(), parts.column("part"), strict=True):
        out[(bucket - 1) * size : bucket * size] = np.frombuffer(part.as_buffer(), np.uint8)
    return out


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text") -> DataFrame:
    """(id_col, item_id, matched, aligned, doc_from, doc_to): each document that holds an item, with the longest such stretch.

    Of `aligned` words from `doc_from` to `doc_to` of the document (counted from 0, the end left
    out) `matched` equal the item's. Words are compared in lower case without punctuation, over
    whole texts. Of an item of fewer than SPAN words all must stand in a row. Null and empty texts and items hold nothing. Rows that repeat an id give one row per item;
    a null id stays null. Extra columns play no part. Without benchmark or documents: no rows.
    """
    items = benchmark_items(benchmark, item_col, item_text).withColumn("item", F.struct(F.xxhash64("item_id", "words").alias("a"), F.xxhash64(F.lit(2), "words", "item_id").alias("b")))
    items = staged(items.dropDuplicates(["item"]), "items")
    sc = docs.sparkSession.sparkContext
    about = items.agg(F.max(F.size("words")).alias("longest"), F.sum(F.size("seeds")).alias("seeds"), F.collect_set(F.least(F.size("words"), F.lit(SPAN))).alias("lengths")).first()
    longest, kinds = about["longest"] or 0, sorted({k for n in about["lengths"] for k in kinds_of(n)})
    bits = min(FILTER_BITS, max(15, int(about["seeds"] or 0).bit_length() + SEED_BITS))
    sieve = sc.broadcast(_filter(items, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = sieve.value

        def has(at: np.ndarray) -> np.ndarray:
            return (full[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        for b in batches:
            for w in words(b.column(1)) if kinds else ():
                # a blank before, between and after texts, so that a mask may leave out what a text lacks at its ends
                padded = np.insert(w.hashes, w.bounds, np.uint64(0))
                heads = w.bounds + np.arange(len(w.bounds))
                where, kind, seed = [], [], []
                for k, h in zip(kinds, seeds(padded, kinds), strict=True):
                    first, *rest = _places(h, bits)
                    i = np.flatnonzero(has(first))
                    for at in rest:
                        i = i[has(at[i])]
                    where.append(i)
                    kind.append(np.full(len(i), k))
                    seed.append(h[i])
                where, kind, seed = np.concatenate(where), np.concatenate(kind), np.concatenate(seed)
                text = np.minimum(np.searchsorted(heads, where, "right") - 1, len(heads) - 2)
                good = np.flatnonzero(where + np.array(SPANS)[kind] <= heads[text + 1] + 1)  # windows inside one text
                good = good[np.lexsort((where[good], text[good]))]
                where, kind, seed, text = where[good], kind[good], seed[good], text[good]
                where = where - text - 1  # the place among all words; one less for the blank before a text
                out = [[] for _ in range(5)]

                def add(t: int, low: int, high: int, hits: slice) -> None:
                    for values, v in zip(out, (w.first + t, low - w.bounds[t], w.hashes[low:high].view(np.int64), seed[hits].view(np.int64), where[hits] - w.bounds[t]), strict=True):  # noqa: B023
                        values.append(v)

                short = np.flatnonzero(kind >= len(LEFT_OUT))
                first = np.lexsort((where[short], seed[short], text[short]))
                head = (np.diff(text[short][first], prepend=-1) != 0) | np.append(True, seed[short][first][1:] != seed[short][first][:-1])[: len(first)]
                for i in short[first[head]]:
                    add(text[i], where[i], where[i] + SPANS[kind[i]], slice(i, i + 1))
                long = kind < len(LEFT_OUT)
                where, seed, text = where[long], seed[long], text[long]
                new = np.flatnonzero((np.diff(text, prepend=-1) != 0) | (np.diff(where, prepend=0) > 2 * longest))
                for a, z in zip(new, [*new[1:], len(where)], strict=False):
                    t = text[a]
                    add(t, max(w.bounds[t], where[a] - longest), min(w.bounds[t + 1], where[z - 1] + SPAN + longest), slice(a, z))
                if not out[0]:
                    continue
                yield pa.record_batch([b.column(0).take(pa.array(out[0])), pa.array(out[1], pa.int64()), _lists(out[2], pa.int64()), _lists(out[3], pa.int64()), _lists(out[4], pa.int32())], names=["id", "start", "words", "seeds", "at"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    regions = rows.mapInArrow(run, "id long, start long, words array<long>, seeds array<long>, at array<int>")
    regions = staged(regions.withColumn("region", F.struct(F.xxhash64("id", "start", "words").alias("a"), F.xxhash64(F.lit(2), "words", "start", "id").alias("b"))), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("seeds", "at")).alias("h")).select("region", "h.seeds", "h.at")
    known = items.select("item", F.size("words").alias("size"), F.explode(F.arrays_zip("seeds", "at")).alias("h")).select("item", "size", "h.seeds", F.col("h.at").alias("item_at"))
    known = staged(known.join(hits.groupBy("seeds").agg(F.count("*").alias("n")), "seeds"), "known")
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    pairs = joined(hits, known, ["seeds"]).groupBy("region", "item", "size").agg(F.collect_set(shift).alias("shifts"))  # an item's places in a region
    texts = regions.select("region", "id", "start", F.col("words").alias("doc_words")).dropDuplicates(["region"])
    low = F.greatest(F.array_min("shifts") - F.col("start"), F.lit(0)).cast("int")  # of the region's words those on which the item can lie
    part = F.slice("doc_words", low + 1, (F.array_max("shifts") - F.col("start")).cast("int") + F.col("size") - low)
    sides = pairs.join(texts, "region").select("item", "id", (F.col("start") + low).alias("start"), "shifts", part.alias("doc_words"))
    sides = sides.join(items.select("item", "item_id", "words"), "item").select("id", "item_id", "start", "shifts", "doc_words", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, rest = [], [[], [], [], []]
            for i in range(b.num_rows):
                start = b.column(2)[i].as_py()
                shifts, doc, item = (b.column(c)[i].values.to_numpy() for c in (3, 4, 5))
                found = [f for f in (stretch(doc, item, s) for s in (shifts - start).tolist()) if f]
                if found:
                    matched, low, high = max(found, key=lambda f: (f[0], f[1] - f[2], -f[1]))
                    keep.append(i)
                    for x, v in zip(rest, (matched, high - low, low + start, high + start), strict=True):
                        x.append(v)
            yield pa.record_batch([b.column(0).take(pa.array(keep, pa.int64())), b.column(1).take(pa.array(keep, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)], names=["id", "item_id", "matched", "aligned", "doc_from", "doc_to"])

    held = sides.mapInArrow(verify, "id long, item_id long, matched long, aligned long, doc_from long, doc_to long")
    best = held.groupBy("id", "item_id").agg(F.max(F.struct("matched", F.negate("aligned").alias("a"), F.negate("doc_from").alias("f"), "aligned", "doc_from", "doc_to")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.matched", "b.aligned", "b.doc_from", "b.doc_to")


def stretch(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(matched, from, to) of the best run of `doc` that lies on `item` at `shift`, or None if it is too short or too different."""
    low, high = max(0, shift), min(len(doc), shift + len(item))
    if low >= high:
        return None
    same = doc[low:high] == item[low - shift : high - shift]
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
    floor = np.minimum.accumulate(score)
    to = int(np.argmax(score - floor))
    start = int(np.flatnonzero(score[: to + 1] == floor[to])[-1])
    matched = int(same[start:to].sum())
    need = len(item) if len(item) < SPAN else min(MIN_WORDS, int(np.ceil(MIN_SHARE * len(item))))
    if matched < need or matched < MIN_SHARE * (to - start):
        return None
    return matched, low + start, low + to


def op8_spaced_seed_decontamination(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """`docs` without the documents that hold a benchmark item; every row of such an id goes."""
    found = beside(overlaps(docs, benchmark, id_col, text_col).select(F.col(id_col).alias("__leak_id")).distinct(), "leaks")
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["__leak_id"]), "left_anti")


#: Capitals that `tokens.lowered` puts in lower case.
_UPPER = string.ascii_uppercase + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
OP8_SQL = """
WITH l AS (SELECT {lower} AS t, doc_id FROM documents),
d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(t, '{word}') AS w FROM l),
i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
-- every accepted stretch holds three words of the item in a row; of an item of one or two words all of them
di AS (SELECT d, w, unnest(range(1, len(w) + 1)) AS p FROM d),
ii AS (SELECT i, w, unnest(range(1, len(w) + 1)) AS p FROM i),
dg AS (SELECT d, p, list_slice(w, p, p + 2) AS g FROM di WHERE p <= len(w) - 2 UNION ALL SELECT d, p, list_slice(w, p, p + 1) FROM di WHERE p <= len(w) - 1 UNION ALL SELECT d, p, list_slice(w, p, p) FROM di),
ig AS (SELECT i, p, list_slice(w, p, p + least(3, len(w)) - 1) AS g FROM ii WHERE p <= len(w) - least(3, len(w)) + 1),
c AS (SELECT DISTINCT d, i, dg.p - ig.p AS shift FROM ig JOIN dg USING (g)),
-- item word n stands beside word n + shift
a AS (
  SELECT d, i, shift, item_id, doc_id, len(iw) AS size, unnest(range(greatest(1, 1 - shift), least(len(iw), len(dw) - shift) + 1)) AS n, iw, dw
  FROM (SELECT c.*, item_id, doc_id, i.w AS iw, d.w AS dw FROM c JOIN i USING (i) JOIN d USING (d))),
s AS (
  SELECT d, i, shift, item_id, doc_id, size, n, CAST(iw[n] = dw[n + shift] AS INT) AS same,
         sum(CASE WHEN iw[n] = dw[n + shift] THEN 1 ELSE -2 END) OVER (PARTITION BY d, i, shift ORDER BY n) AS score,
         sum(CAST(iw[n] = dw[n + shift] AS INT)) OVER (PARTITION BY d, i, shift ORDER BY n) AS hits,
         min(n) OVER (PARTITION BY d, i, shift) AS first
  FROM a),
f AS (SELECT *, least(0, min(score) OVER (PARTITION BY d, i, shift ORDER BY n)) AS floor FROM s),
e AS (SELECT d, i, shift, item_id, doc_id, size, first, arg_max(struct_pack(n := n, floor := floor, hits := hits), (score - floor, -n)) AS b FROM f GROUP BY ALL),
o AS (
  SELECT e.d, e.i, e.shift, any_value(e.item_id) AS item_id, any_value(e.doc_id) AS doc_id, any_value(e.size) AS size, any_value(b.n) AS upto, any_value(b.hits) AS hits, any_value(e.first) AS first,
         max(struct_pack(n := f.n, hits := f.hits)) AS low
  FROM e LEFT JOIN f ON f.d = e.d AND f.i = e.i AND f.shift = e.shift AND f.n <= b.n AND f.score = b.floor GROUP BY e.d, e.i, e.shift),
r AS (
  SELECT d, i, doc_id, item_id, size, CAST(hits - coalesce(low.hits, 0) AS BIGINT) AS matched, CAST(upto - coalesce(low.n, first - 1) AS BIGINT) AS aligned,
         CAST(coalesce(low.n, first - 1) + shift AS BIGINT) AS doc_from, CAST(upto + shift AS BIGINT) AS doc_to
  FROM o),
k AS (SELECT * FROM r WHERE matched >= 0.8 * aligned AND matched >= CASE WHEN size < 8 THEN size ELSE least(13, ceil(0.8 * size)) END)
SELECT doc_id, item_id, b.matched AS matched, b.aligned AS aligned, b.doc_from AS doc_from, b.doc_to AS doc_to
FROM (
  SELECT doc_id, item_id, max(struct_pack(matched := matched, a := -aligned, f := -doc_from, aligned := aligned, doc_from := doc_from, doc_to := doc_to)) AS b
  FROM k GROUP BY doc_id, item_id)
""".replace("{lower}", f"translate(text, '{_UPPER}', '{_UPPER.lower()}')").replace("{word}", r"[0-9A-Za-z_\x{80}-\x{10FFFF}]+")
