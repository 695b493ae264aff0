"""Fill-in-the-middle texts: a text cut in three and put in another order between sentinels.

Cuts fall between units, counted in bytes of the UTF-8 text. A text's code points are found from
them by a sparse index of exceptions: only characters of several bytes are kept, with the bytes
that they have beyond one. Between two of them bytes and code points advance together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.tokens import NO_SPACE, slices

#: What goes before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


class ExceptionIndex:
    """Characters of several bytes in UTF-8 `data`, and what they add to the number of bytes."""

    def __init__(self, data: np.ndarray):
        head = np.flatnonzero(data >= 0xC0)
        size = 1 + (data[head] >= 0xC0).astype(np.int64) + (data[head] >= 0xE0) + (data[head] >= 0xF0)
        self.excess = np.concatenate(([0], np.cumsum(size - 1)))
        self.bytes_at = head  # the byte at which each such character begins
        self.points_at = head - self.excess[:-1]  # and its place in code points

    def points(self, at) -> np.ndarray:
        """Code points before byte `at`, which begins a character or is the end."""
        return at - self.excess[np.searchsorted(self.bytes_at, at, "left")]

    def bytes(self, at) -> np.ndarray:
        """Bytes before code point `at`."""
        return at + self.excess[np.searchsorted(self.points_at, at, "left")]


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, bounds): where units end in `data`; those of text i are ends[bounds[i]:bounds[i + 1]].

    A unit is a run of other bytes with the white space before it; white space at a text's end is one of its own.
    """
    word = NO_SPACE[data]
    last = np.zeros(len(data), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    follows = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(last | (word & ~follows)) + 1
    return ends, np.searchsorted(ends, offsets, "right")


def _drawn(seed: int, key: Column, i: int) -> Column:
    """The i-th 8-digit group of the SHA-256 of seed and key, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, id_col="doc_id", text_col="text", seed: int = 42, rate: int = 50, spm: int = 80, sentinels: tuple[str, str, str] = SENTINELS, unit: str = "word") -> DataFrame:
    """(id_col, n, form, output, prefix_chars, middle_chars, prefix_bytes, middle_bytes) for every row of `docs`.

    `output` is the text cut in prefix, middle and suffix after two numbers of units out of its n, drawn by the id (units
    are words with the white space before them, or with `unit="char"` code points): of form
    `psm` (sentinels before prefix, suffix and middle, in this order), `spm` (suffix, prefix, middle) or `plain`, the
    text as it was. Plain stay `100 - rate` of 100 ids, empty and null texts (null is empty), and texts that hold a sentinel, so that
    an output can be read back; of the others `spm` of 100 are of that form. A null id draws as an empty one;
    rows that repeat an id are each cut at that id's numbers. Cuts of plain texts are null. No rows: no result rows.
    """
    if not all(sentinels) or len(set(sentinels)) < 3 or any(b.startswith(a[i:]) and (i or a != b) for a in sentinels for b in sentinels for i in range(len(a))):
        raise ValueError("sentinels must differ, and none may end like another begins")
    marks = [s.encode() for s in sentinels]
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("text"), *(_drawn(seed, F.col(id_col), i).alias(f"h{i + 1}") for i in range(4)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drawn = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False) for i in range(4)])
            for first, offsets, data in slices(b.column(1)):
                rows = len(offsets) - 1
                h, index = drawn[:, first : first + rows], ExceptionIndex(data)
                if unit == "word":
                    ends, bounds = unit_ends(data, offsets)
                    n = np.diff(bounds)
                    at = np.sort(h[:2] % (n + 1), axis=0)
                    cut = np.where(at > 0, np.concatenate((ends, [0]))[bounds[:-1] + at - 1], offsets[:-1])
                else:
                    bounds = index.points(offsets)
                    n = np.diff(bounds)
                    at = np.sort(h[:2] % (n + 1), axis=0)
                    cut = index.bytes(bounds[:-1] + at)
                whole = data.tobytes()
                held = np.zeros(rows, bool)
                for m in marks:
                    p = whole.find(m)
                    while p >= 0:
                        t = int(np.searchsorted(offsets, p, "right")) - 1
                        held[t] |= p + len(m) <= offsets[t + 1]
                        p = whole.find(m, p + 1)
                plain = (n == 0) | held | (h[2] % 100 >= rate)
                form = np.where(plain, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
                points = index.points(np.stack((offsets[:-1], cut[0], cut[1])))
                out = []
                for i in range(rows):
                    a, z, (x, y) = offsets[i], offsets[i + 1], cut[:, i]
                    if plain[i]:
                        out.append(whole[a:z])
                    elif form[i] == "psm":
                        out.append(b"".join((marks[0], whole[a:x], marks[1], whole[y:z], marks[2], whole[x:y])))
                    else:
                        out.append(b"".join((marks[1], whole[y:z], marks[0], whole[a:x], marks[2], whole[x:y])))
                sizes = [np.diff(points, axis=0), np.diff(np.stack((offsets[:-1], cut[0], cut[1])), axis=0)]
                lengths = [pa.array(s[j], pa.int64(), mask=plain) for s in sizes for j in range(2)]
                yield pa.record_batch([b.column(0).slice(first, rows), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(out, pa.binary()).view(pa.string()), *lengths], names=["id", "n", "form", "output", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes"])

    out = rows.mapInArrow(run, "id long, n long, form string, output string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long")
    return out.withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which `output` of `form` was made."""
    first, second, third = sentinels
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, third, -1)
    psm = F.concat(between(first, second), middle, between(second, third))
    spm = F.concat(between(first, third), middle, between(second, first))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_sparse_index_fim(spark, sf_dir: str) -> DataFrame:
    made = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
