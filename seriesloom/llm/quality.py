"""A quality score from positive and unlabelled texts.

Trusted good documents are the positives; the whole corpus is the unlabelled side, which holds
good and bad ones alike. A logistic model of text statistics minimises the non-negative unbiased
risk for the share of good documents (the class prior), which is estimated from how the scores of
both sides lie. No document is ever taken as a known negative. The risk is minimised by Newton
steps; each takes its sums from every document in one distributed pass, at any size of the corpus.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.functions.staging import drop_staged, staged
from seriesloom.llm.tokens import words

#: Newton steps at most, the step below which a model has settled, and the pull of the weights towards 0.
STEPS, SETTLED, DECAY = 30, 1e-4, 1e-4
#: A document counts as good from this score on.
THRESHOLD = 0.3
#: Bins of the score by which the prior is estimated, and the least part of the positives that a bound may rest on.
BINS, LEAST_PART = 200, 0.9
_CLASSES = {
    "letter": [*range(65, 91), *range(97, 123), *range(0xC2, 0x100)],
    "upper": list(range(65, 91)),
    "digit": list(range(48, 58)),
    "space": [9, 10, 11, 12, 13, 32],
    "stop": [ord(c) for c in ".,;:?'\"()-"],
    "bang": [ord("!")],
    "bar": [ord("|")],
    "symbol": [ord(c) for c in string.punctuation if c not in ".,;:?'\"()-!|"],
}
_LUT = {k: np.isin(np.arange(256), v) for k, v in _CLASSES.items()}
FEATURES = ["words", "bytes_per_word", "upper", "digit", "space", "stop", "bang", "bar", "symbol", "same_as_last", "word_repeats", "triple_repeats", "no_words"]


def _repeats(keys: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts how many of its keys stand in it before."""
    mixed = np.sort((text.astype(np.uint64) << np.uint64(44)) | (keys >> np.uint64(20)))
    again = mixed[1:][mixed[1:] == mixed[:-1]] >> np.uint64(44)
    return np.bincount(again.astype(np.int64), minlength=n)[:n]


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; all of them lie between 0 and about 2 for any text."""
    out = []
    for w in words(column):
        n = len(w.offsets) - 1
        counts = {}
        for k, lut in _LUT.items():
            run = np.concatenate(([0], np.cumsum(lut[w.data], dtype=np.int64)))
            counts[k] = (run[w.offsets[1:]] - run[w.offsets[:-1]]).astype(float)
        upper = np.flatnonzero(w.data[:-1] == 0xC3)  # capitals of two bytes
        upper = upper[(w.data[upper + 1] >= 0x80) & (w.data[upper + 1] <= 0x9E)]
        counts["upper"] += np.bincount(np.searchsorted(w.offsets, upper, "right") - 1, minlength=n)[:n]
        size = np.diff(w.offsets).astype(float)
        total = np.diff(w.bounds).astype(float)
        text = np.repeat(np.arange(n), np.diff(w.bounds))
        h = w.hashes
        same = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        last = np.bincount(text[1:][same], minlength=n)[:n]
        triple = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        inside = text[2:] == text[:-2] if len(text) > 2 else np.zeros(0, bool)
        many, wide, drawn = np.maximum(total, 1), np.maximum(size, 1), np.maximum(counts["letter"], 1)
        out.append(
            np.stack(
                [
                    np.log1p(total) / 8,
                    np.minimum(size / many, 40) / 20,
                    np.sqrt(counts["upper"] / drawn),
                    np.sqrt(counts["digit"] / wide),
                    counts["space"] / wide,
                    np.sqrt(np.minimum(counts["stop"] / many, 4)),
                    np.sqrt(np.minimum(counts["bang"] / many, 4)),
                    np.sqrt(np.minimum(counts["bar"] / many, 4)),
                    np.sqrt(np.minimum(counts["symbol"] / many, 4)),
                    np.sqrt(last / many),
                    _repeats(h, text, n) / many,
                    np.sqrt(_repeats(triple[inside], text[2:][inside], n) / many) if len(text) > 2 else np.zeros(n),
                    (total == 0).astype(float),
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def text_features(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, features): one pass over the whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1)).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.record_batch([b.column(0), lists], names=["id", "features"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, features array<float>")


class Side(NamedTuple):
    """Sums over the rows of a side, each taken as a negative."""

    n: float
    loss: float
    score: float
    gradient: np.ndarray
    curvature: np.ndarray


def sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The numbers of a Side for rows of features as `expand` gives them, in a row."""
    g = np.clip(x @ w, -30, 30)
    p = 1 / (1 + np.exp(-g))
    return np.concatenate(([len(x), np.logaddexp(0, g).sum(), g.sum()], x.T @ p, ((x.T * (p * (1 - p))) @ x).ravel()))


def _side(flat: np.ndarray, k: int) -> Side:
    return Side(*flat[:3], flat[3 : 3 + k], flat[3 + k :].reshape(k, k))


def fit(measure: Callable[[np.ndarray], tuple[Side, Side]], start: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights, the constant last, that minimise a risk of the positives and the unlabelled, which `measure` sums up for given weights.

    With a prior: the non-negative risk, prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),
    l the logistic loss. Without: positives against unlabelled, each side with the same weight. As
    l(g) - l(-g) = -g, both are convex while the part under max stays positive. A step that raises the
    risk is halved; one that would turn that part negative is halved and is the last, so that
    fitting ends where the positives begin to be learned by heart.
    """
    k = len(start)
    pull = DECAY * np.append(np.ones(k - 1), 0)

    def risk(w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        p, u = measure(w)
        own = p.loss - p.score  # the loss of positives as positives
        part = p.gradient / p.n
        mean = (p.gradient - p_sum) / p.n  # its gradient
        if prior is None:
            value, negatives = own / p.n + u.loss / u.n, 0.0
            g, h = mean + u.gradient / u.n, p.curvature / p.n + u.curvature / u.n
        else:
            negatives = u.loss / u.n - prior * p.loss / p.n
            value = prior * own / p.n + negatives
            g, h = prior * (mean - part) + u.gradient / u.n, u.curvature / u.n
        return value + (pull * w * w).sum() / 2, negatives, g + pull * w, h + np.diag(pull)

    p_sum = 2 * measure(np.zeros(k))[0].gradient  # at weights 0 every row counts by a half
    w = start
    value, negatives, g, h = risk(w)
    for _ in range(STEPS):
        step = -np.linalg.solve(h + 1e-9 * np.eye(k), g)
        step *= min(1.0, 20 / np.abs(step).max())
        border = False
        while (found := risk(w + step))[0] > value + 1e-12 or found[1] < min(0.0, negatives):
            border = border or found[1] < min(0.0, negatives)
            step = step / 2
            if np.abs(step).max() < SETTLED:
                return w
        w, (value, negatives, g, h) = w + step, found
        if border or np.abs(step).max() < SETTLED:
            break
    return w


def expand(x: np.ndarray) -> np.ndarray:
    """Features, how far each lies above half its range, and a constant."""
    x = np.asarray(x, float)
    return np.concatenate((x, np.maximum(0, x - 0.5), np.ones((len(x), 1))), axis=1)


def score_column(features: Column, w: np.ndarray) -> Column:
    """The model's score of an array column, between 0 and 1."""
    n = len(FEATURES)
    terms = [F.lit(float(w[-1]))]
    for i in range(n):
        x = F.element_at(features, i + 1).cast("double")
        terms += [x * F.lit(float(w[i])), F.greatest(F.lit(0.0), x - 0.5) * F.lit(float(w[n + i]))]
    total = sum(terms[1:], terms[0])
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))


def fold(ident: Column, k: int) -> Column:
    """The CRC-32 of an id written as text, modulo k; null for a null id."""
    return F.crc32(ident.cast("string").cast("binary")) % k


def _measure(rows: DataFrame, w: np.ndarray) -> tuple[Side, Side]:
    """(positives, unlabelled): sums over all of `rows` (features, trusted), of which each task sends one row a side to be added up in Spark."""
    k = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 3 + k + k * k))
        for b in batches:
            x = expand(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)))
            total += sums(x[b.column(1).to_numpy(zero_copy_only=False)], w), sums(x, w)
        yield pa.record_batch([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["at", "value"])

    got = rows.select("features", "trusted").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(2 * (3 + k + k * k))  # as many numbers as rows come back
    flat[got.column("at").to_numpy()] = got.column("value").to_numpy()
    p, u = flat.reshape(2, -1)
    return _side(p, k), _side(u, k)


def _histogram(rows: DataFrame, w: np.ndarray) -> np.ndarray:
    bins = rows.groupBy(F.least(F.floor(score_column(F.col("features"), w) * BINS), F.lit(BINS - 1)).cast("int").alias("b")).count().collect()  # BINS rows at most
    out = np.zeros(BINS)
    for r in bins:
        out[r["b"]] = r["count"]
    return out


def estimate_prior(good: np.ndarray, all_: np.ndarray) -> float:
    """The share of good documents, from histograms of a score of known good ones and of all.

    Above any score there are at least prior * (that part of the good) of all documents; the least
    such bound over scores that keep most of the good ones is taken.
    """
    p, u = np.cumsum(good[::-1]) / max(good.sum(), 1), np.cumsum(all_[::-1]) / max(all_.sum(), 1)
    ok = p >= LEAST_PART
    return float(np.clip((u[ok] / p[ok]).min(), 0.05, 0.99)) if ok.any() else 0.5


def train(rows: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality") -> np.ndarray:
    """Weights from `rows` (id, features) and the positives of `labels`.

    An id with conflicting labels isn't a trusted positive. All positives and all rows are fitted
    on; a table that repeats all its rows gives the same weights. They are rounded to 6 places, so
    that the order of sums doesn't show. Without positives all weights are 0 and every score is 0.5.
    """
    trusted = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label")).where("label = 1").select("id", F.lit(True).alias("trusted"))
    rows = staged(rows.join(trusted, "id", "left").select("features", F.coalesce("trusted", F.lit(False)).alias("trusted")), "marked")
    measure = lambda w: _measure(rows, w)
    w = np.zeros(2 * len(FEATURES) + 1)
    if measure(w)[0].n:
        first = np.round(fit(measure, w, None), 6)
        prior = estimate_prior(_histogram(rows.where("trusted"), first), _histogram(rows, first))
        w = np.round(fit(measure, w, prior), 6)
    drop_staged(rows)
    return w


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", folds: int = 5) -> DataFrame:
    """(id_col, held_out, score, predicted): the quality of every row of `docs`, learned outside fold 0.

    held_out: the id's fold is 0, so that its label wasn't seen. score: from 0 to 1, higher where
    good is likelier; null and empty texts score as texts without words. predicted: 1 from
    THRESHOLD on, else 0. Rows that repeat an id are scored each; a null id has no fold and counts
    as not held out. Columns other than id and text are never read. No rows: no result rows.
    """
    rows = staged(text_features(docs, id_col, text_col), "features")
    w = train(rows, labels.where(fold(F.col(id_col), folds) != 0), id_col, label_col)
    out = rows.select(F.col("id").alias(id_col), F.coalesce(fold(F.col("id"), folds) == 0, F.lit(False)).alias("held_out"), score_column(F.col("features"), w).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def op3_pu_quality(spark, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality") -> DataFrame:
    """The rows of `docs` whose text scores at least THRESHOLD, with all their columns.

    Learned from all labels. Texts are read a second time to be scored where they lie, so that no
    text is shuffled.
    """
    rows = staged(text_features(docs, id_col, text_col), "features")
    w = train(rows, labels, id_col, label_col)
    drop_staged(rows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = 1 / (1 + np.exp(-np.clip(expand(features(b.column(at))) @ w, -30, 30)))
            yield b.filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
