"""The language of a text, by how its most frequent n-grams rank.

A language's profile lists the n-grams of 1 to 3 letters that are most frequent in all texts
known to be in it. A text's own list is held against each profile: every n-gram costs the number
of places by which its ranks differ, or the most if the profile lacks it. The least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged
from seriesloom.llm.quality import fold
from seriesloom.llm.tokens import slices

#: N-grams of a profile, and of a text's own list.
PROFILE, OWN = 400, 300
#: Bits of a letter, a code point in lower case, in the number of an n-gram; three of them fit into 63.
_BITS = 21


def _numbers() -> np.ndarray:
    """For each code point that is a letter its lower case, and 0 for any other."""
    chars = np.arange(0x110000, dtype=np.uint32).view("<U1")
    out = np.zeros(len(chars), np.int64)
    at = np.flatnonzero(np.strings.isalpha(chars))
    out[at] = np.strings.lower(chars[at]).astype("<U1").view(np.uint32)
    return out


_NUMBER = _numbers()


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each character of UTF-8 bytes that is a letter its number, and 0 for any other; and at which byte it begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    end = np.append(at[1:], len(data))
    lead, size = data[at].astype(np.int64), end - at
    code = np.where(size == 1, lead, lead & (0x7F >> np.minimum(size, 7)))
    for k in (1, 2, 3):
        more = size > k
        code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
    return _NUMBER[np.minimum(code, len(_NUMBER) - 1)], at


def count_ngrams(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of each distinct pair in texts, in that order; without `owner` the text's place is its owner.

    Words are runs of letters with a blank on either side. An n-gram's number holds its letters in
    _BITS bits each, the last one lowest; a blank is 1.
    """
    num, at = letters(data)
    text = np.searchsorted(offsets, at, "right") - 1
    # a blank after each text, so that words end with it
    cut = np.searchsorted(at, offsets[1:])
    num, text = np.insert(num, cut, 0), np.insert(text, cut, np.arange(len(offsets) - 1))
    num, text = np.append(0, num), np.append(text[:1], text) if len(text) else np.zeros(1, np.int64)
    if owner is not None:
        text = owner[text]
    # letters in as few bits as those of these texts need, in the same order, so that owner and n-gram sort as one number
    seen = np.zeros(len(_NUMBER), bool)
    seen[num] = True
    seen[0] = False
    alphabet = np.concatenate(([0, 1], np.flatnonzero(seen)))
    bits = int(len(alphabet)).bit_length()
    small = 3 * bits + int(text.max()).bit_length() <= 63
    if small:
        rank = np.zeros(len(_NUMBER), np.int64)
        rank[alphabet[2:]] = np.arange(2, len(alphabet))
        num = rank[num]
    width = bits if small else _BITS
    a, b = num[:-1], num[1:]
    pair = np.flatnonzero((a > 0) | (b > 0))
    one = np.flatnonzero(num > 0)
    three = np.flatnonzero(num[1:-1] > 0) if len(num) > 2 else np.zeros(0, np.int64)
    blank = np.maximum(num, 1)
    codes = np.concatenate((num[one], (blank[pair] << width) | blank[pair + 1], (blank[three] << 2 * width) | (blank[three + 1] << width) | blank[three + 2]))
    who = np.concatenate((text[one], text[pair + (b[pair] > 0)], text[three + 1]))
    if small:
        mixed = np.sort((who << 3 * bits) | codes)
        first = np.flatnonzero(np.diff(mixed, prepend=-1) != 0)
        low, mask = mixed[first] & ((1 << 3 * bits) - 1), (1 << bits) - 1
        code = (alphabet[low >> 2 * bits] << 2 * _BITS) | (alphabet[(low >> bits) & mask] << _BITS) | alphabet[low & mask]
        return mixed[first] >> 3 * bits, code, np.diff(np.append(first, len(mixed)))
    order = np.lexsort((codes, who))
    codes, who = codes[order], who[order]
    first = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(who, prepend=-1) != 0))
    return who[first], codes[first], np.diff(np.append(first, len(codes)))


def ngram_counts(docs: DataFrame, lang_col="lang", text_col="text") -> DataFrame:
    """(lang, code, n) over all rows of `docs`; each task sums up what it reads first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for first, offsets, data in slices(b.column(1)):
                mine = langs[first : first + len(offsets) - 1]
                names, index = np.unique(mine.astype(str), return_inverse=True)
                which, code, n = count_ngrams(data, offsets, index)
                for i, name in enumerate(names):
                    a, z = np.searchsorted(which, [i, i + 1])
                    had = sums.get(name)
                    if had is None:
                        sums[name] = code[a:z], n[a:z]
                    else:
                        both, place = np.unique(np.concatenate((had[0], code[a:z])), return_inverse=True)
                        sums[name] = both, np.bincount(place, np.concatenate((had[1], n[a:z]))).astype(np.int64)
        for name, (code, n) in sums.items():
            yield pa.record_batch([pa.array([name] * len(code), pa.string()), pa.array(code), pa.array(n)], names=["lang", "code", "n"])

    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def profiles(counts: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, code, rank): each language's most frequent n-grams from rank 0, ties by code."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("rank", rank - 1).where(F.col("rank") < size)


class Ranks:
    """Profiles as arrays: a place for each language and n-gram."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.langs = sorted({r[0] for r in rows})
        self.codes = np.array(sorted({r[1] for r in rows}), np.int64)
        self.size = size
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int32)  # the last column: an n-gram that no profile has
        for lang, code, rank in rows:
            self.ranks[self.langs.index(lang), np.searchsorted(self.codes, code)] = rank

    def guess(self, codes: np.ndarray) -> tuple[int, float]:
        """The nearest language (ties: the first by name) to a text's n-grams by rank, and a score from 0 to 1."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        ranks = self.ranks[:, at]
        cost = np.where(ranks >= 0, np.abs(ranks - np.arange(len(codes))), self.size).sum(axis=1)
        best = int(np.argmin(cost))
        return best, 1.0 - float(cost[best]) / (self.size * len(codes))


def top_ngrams(data: np.ndarray, offsets: np.ndarray, own: int = OWN) -> list[np.ndarray]:
    """For each text its most frequent n-grams, ties by code."""
    t, c, n = count_ngrams(data, offsets)
    order = np.lexsort((c, -n, t))
    c = c[order]
    bounds = np.searchsorted(t, np.arange(len(offsets)))
    return [c[a : min(a + own, z)] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def predict(docs: DataFrame, known: DataFrame, id_col="doc_id", text_col="text", size: int = PROFILE, own: int = OWN) -> DataFrame:
    """(id_col, lang_pred, score) of each row of `docs` by the profiles `known`, of which there are `size` rows a language.

    A text without letters, or null, is `und` with score 0; so is any text when nothing was learned.
    """
    ranks = Ranks([tuple(r) for r in known.select("lang", "code", "rank").collect()], size)  # `size` rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for _, offsets, data in slices(b.column(1)):
                for codes in top_ngrams(data, offsets, own):
                    if len(codes) and ranks.langs:
                        best, score = ranks.guess(codes)
                        langs.append(ranks.langs[best])
                        scores.append(score)
                    else:
                        langs.append("und")
                        scores.append(0.0)
            yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def languages(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", folds: int = 3, held: int = 1) -> DataFrame:
    """(id_col, held_out, lang_pred, score): the language of every row, learned outside fold `held`.

    Rows of a null language teach nothing, nor do rows of a null id, which have no fold and count
    as not held out. Null texts and texts without letters are `und` with score 0. Rows that repeat
    an id are predicted each. Other columns are never read.
    """
    known = staged(profiles(ngram_counts(docs.where(fold(F.col(id_col), folds) != held), lang_col, text_col)), "profiles")
    out = predict(docs, known, id_col, text_col)
    return out.select(id_col, F.coalesce(fold(F.col(id_col), folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_rank_order_language(spark, sf_dir: str) -> DataFrame:
    return languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
