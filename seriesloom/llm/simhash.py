"""Near-duplicate documents by 64-bit SimHash fingerprints.

Fingerprints that differ in at most 3 bits share at least 5 of their 8 bytes in place. The
inverted index has one posting list for each choice of 4 byte positions from a Steiner system and
each content of these: 14 choices of positions meet every set of 5 shared positions, so no link
is lost, and a list holds the few fingerprints that agree in 32 bits. In each list the shared
bytes of a pair are tallied, as zero bytes of the pair's XOR rather than by counting the lists that
both stand in; pairs with at least 5 go on to the exact bit count.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged
from seriesloom.llm.beside import beside
from seriesloom.llm.components import connected_components

SEED = 42
#: The 14 planes of the affine space over two elements: each set of 3 positions lies in one of them, and its complement is another.
PLANES = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Fingerprints of a posting list that one task compares; longer lists are cut into blocks of this size and compared block by block.
BLOCK = 16_384
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """The unsigned fingerprint of a text's UTF-8 bytes. No words, or no text: 0."""
    words = (data or b"").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    if n < width:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - width])).tolist()
        joined = b" ".join(words)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    votes, step = np.zeros(64, np.int64), 32_768
    for at in range(0, len(hashes), step):
        raw = np.frombuffer(b"".join(hashes[at : at + step]), np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x, width) for x in b.column(1).cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item that it is joined to by the links (a, b)."""
    label = np.arange(n)
    while a.size:
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, nxt := label[label]):
            label = nxt
    return label


def _links(groups: np.ndarray, fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints, and another of the same posting list that they hang on; rows come sorted by list."""
    n, size, held = len(fps), 0, []
    for d in range(1, n):
        i = np.flatnonzero(groups[d:] == groups[:-d])
        if not i.size:
            break
        x = fps[i] ^ fps[i + d]
        near = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - bits
        near &= np.bitwise_count(x) <= bits
        held.append((i[near], i[near] + d))
        size += int(near.sum())
        if size > 500_000:  # all that matters so far is what hangs together
            label = _forest(n, *map(np.concatenate, zip(*held, strict=True)))
            i = np.flatnonzero(label != np.arange(n))
            held, size = [(i, label[i])], i.size
    if not held:
        return fps[:0], fps[:0]
    label = _forest(n, *map(np.concatenate, zip(*held, strict=True)))
    i = np.flatnonzero(label != np.arange(n))
    return fps[i], fps[label[i]]


def fingerprint_links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """(src, dst): links that join all distinct values of column `fp` differing in at most `bits` <= 3 bits.

    Of the pairs of one list a spanning forest is returned, not every pair.
    """
    masks = [sum(0xFF << 8 * p for p in plane) for plane in PLANES]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(signed))))
    index = fps.select("fp", keys.alias("key")).select("fp", "key.k", "key.part")
    longer = index.groupBy("k", "part").agg(F.count("*").alias("n")).where("n > 1")
    blocks = (
        index.join(longer, ["k", "part"])
        .withColumn("blocks", F.expr(f"cast(ceil(n / {BLOCK}) as int)"))
        .withColumn("own", F.expr("cast(pmod(xxhash64(fp, 7), blocks) as int)"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select(F.xxhash64("k", "part", F.least("own", "other"), F.greatest("own", "other")).alias("list"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            groups, values = (np.concatenate(x) for x in zip(*held, strict=True))
            a, b = _links(groups, values.view(np.uint64), bits)
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

        for batch in batches:
            groups, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cut = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0
            if cut or held and len(groups) and groups[0] != held[-1][0][-1]:
                held.append((groups[:cut], values[:cut]))
                yield out()
                held = []
            held.append((groups[cut:], values[cut:]))
        if held:
            yield out()

    return blocks.repartition("list").sortWithinPartitions("list", "fp").mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """(id_col, fingerprint, component_id, fp): each document with the smallest id that its links reach.

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows stay,
    each with its component. Null ids stay too and never name a component unless it has no other.
    An empty table gives an empty result; other columns of `docs` play no part.
    """
    prints = staged(fingerprints(docs, id_col, text_col, width), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct, bits))
    roots = staged(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    names = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    table = roots.join(names, "root").select("fp", "component_id")
    return prints.join(table, "fp").select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), "component_id", "fp")


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each near-duplicate group: that whose id names the group.

    Of rows that share the id of a kept document, equal or not, one stays. A null id stays only
    where its group has no other, once in all. The ids to drop, far fewer than those to keep, are
    what is joined with the texts; texts are shuffled only where those are too many to broadcast.
    """
    found = near_duplicates(docs, id_col, text_col)
    ids = found.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__rows"), F.max(F.col(id_col).eqNullSafe(F.col("component_id"))).alias("__named"))
    odd = beside(ids.where("__rows > 1 or not __named"), "odd")
    key = docs[id_col].cast("long")
    once = docs.join(odd, key.eqNullSafe(odd["__id"]), "left_anti")
    again = beside(odd.where("__named").select("__id"), "again")
    return once.unionByName(docs.join(again, key.eqNullSafe(again["__id"]), "left_semi").dropDuplicates([id_col]))
