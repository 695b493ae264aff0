import zlib

import numpy as np
import pyarrow as pa
import pytest

from seriesloom.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op3_pu_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    rows = got.merge(labels, on="doc_id")
    held = rows[rows.held_out]
    assert len(held) > 30 and (held.predicted == held.quality).mean() >= 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()


def test_features_match_a_plain_count():
    texts = ["Hello hello WORLD!! a|b 12", "", None, "É É É", "x\ny\nx y x"]
    f = dict(zip(quality.FEATURES, quality.features(pa.array(texts)).T, strict=True))
    assert f["no_words"].tolist() == [0, 1, 1, 0, 0]
    assert np.isclose(f["same_as_last"][0] ** 2, 1 / 6) and np.isclose(f["same_as_last"][3] ** 2, 2 / 3)
    assert np.isclose(f["upper"][3], 1) and np.isclose(f["word_repeats"][4], 3 / 5)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    good, bad = rng.beta(8, 2, 200_000), rng.beta(2, 8, 40_000)
    h = lambda x: np.histogram(x, quality.BINS, (0, 1))[0]
    assert abs(quality.estimate_prior(h(good[:50_000]), h(np.concatenate((good[50_000:], bad)))) - 150 / 190) < 0.03


def test_non_negative_risk_finds_the_negatives():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 0.3, (2000, 1)), rng.normal(-1, 0.3, (500, 1))
    one = lambda x: np.append(x, np.ones((len(x), 1)), axis=1)
    everything = np.concatenate((good[1000:], bad))
    k = 2
    measure = lambda w: tuple(quality._side(quality.sums(x, w), k) for x in (one(good[:1000]), one(everything)))
    w = quality.fit(measure, np.zeros(k), 2 / 3)
    assert ((one(good) @ w > 0).mean() > 0.97) and ((one(bad) @ w < 0).mean() > 0.9)


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "a b", 0.5), (2, "x " * 40_000, 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and {r.score for r in got.collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4


def test_the_model_minimises_the_risk_over_every_row(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").toPandas(), spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    x = quality.expand(quality.features(pa.array(docs.text)).astype(np.float32))
    learned = labels[(labels.quality == 1) & (labels.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5) != 0)]
    p = x[docs.doc_id.isin(learned.doc_id).to_numpy()]
    pull = lambda w: quality.DECAY * (w[:-1] ** 2).sum() / 2
    loss = lambda z: np.logaddexp(0, -z).mean()
    plain = lambda w: loss(p @ w) + loss(-(x @ w)) + pull(w)

    def non_negative(w):
        return prior * loss(p @ w) + max(0.0, loss(-(x @ w)) - prior * loss(-(p @ w))) + pull(w)

    def least(risk, w):
        """Whether no weight does better a little to either side."""
        at = risk(w)
        return all(risk(w + d * e) >= at - 1e-9 for e in np.eye(len(w)) for d in (-0.02, 0.02))

    found, fit = [], quality.fit
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "fit", lambda *a: found.append((a[2], fit(*a))) or found[-1][1])
        got = quality.op3_pu_quality(spark, sf).toPandas().set_index("doc_id").score
    (_, first), (prior, w) = found
    assert least(plain, first) and least(non_negative, w)
    scores = 1 / (1 + np.exp(-np.clip(x @ np.round(first, 6), -30, 30)))
    cut = lambda rows: np.histogram(rows, quality.BINS, (0, 1))[0]
    assert abs(prior - quality.estimate_prior(cut(scores[docs.doc_id.isin(learned.doc_id)]), cut(scores))) < 0.01
    want = 1 / (1 + np.exp(-np.clip(x @ np.round(w, 6), -30, 30)))
    assert np.abs(got.loc[docs.doc_id].to_numpy() - want).max() < 1e-6


def test_repeating_every_row_changes_no_score(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    many = docs.crossJoin(spark.range(5).select("id")).drop("id")
    once = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    got = quality.quality_scores(many, labels).collect()
    assert len(got) == 5 * len(once) and max(abs(r.score - once[r.doc_id]) for r in got) < 1e-4
