import zlib
from collections import Counter

import numpy as np
import pytest

from seriesloom.llm import langid


def plain_ngrams(text):
    out, runs, run = Counter(), [], ""
    for ch in (text or "") + " ":
        if ch.isalpha():
            run += ch.lower()[0]
        elif run:
            runs.append(run)
            run = ""
    for word in runs:
        padded = f" {word} "
        out.update(word)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def test_ngram_counts_match_a_plain_count(spark):
    texts = ["Été, naïve: a", "", "l'été über 3x", None, "aa aa b"]
    rows = spark.createDataFrame([("xx", t) for t in texts], "lang string, text string")
    got = Counter(r.n for r in langid.ngram_counts(rows).collect())
    assert got == Counter(sum((plain_ngrams(t) for t in texts), Counter()).values())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op5_rank_order_language(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    rows = got.merge(docs, on="doc_id")
    held = rows[rows.held_out]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() >= 0.99 and got.score.between(0, 1).all()


def test_distance_is_out_of_place():
    ranks = langid.Ranks([("a", 1, 0), ("a", 2, 1), ("b", 2, 0), ("b", 3, 1)], 10)
    best, score = ranks.guess(np.array([1, 2, 9]))
    assert ranks.langs[best] == "a" and abs(score - (1 - 10 / 30)) < 1e-12


def test_edge_cases(spark):
    rows = [(i, "the cat and the dog " * 20, "en", 1) for i in range(12)] + [(i, "der hund und die katze " * 20, "de", 1) for i in range(20, 32)] + [(40, None, "en", 1), (41, "123 !!", "de", 1), (42, "", None, 1), (None, "the cat", "en", 1), (43, "the " * 100_000, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert len(got) == len(rows) and got[40].lang_pred == got[41].lang_pred == got[42].lang_pred == "und" and got[41].score == 0
    assert got[43].lang_pred == "en" and got[25].lang_pred == "de" and got[None].lang_pred == "en" and not got[None].held_out
    assert langid.languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.languages(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}


def number(gram):
    """The order in which n-grams of one count are listed."""
    out = 0
    for ch in gram:
        out = out << 21 | (1 if ch == " " else ord(ch))
    return out


def test_letters_of_other_scripts_stay_apart():
    texts = ["а丰 Жж", "丰", "ß"]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    who, code, n = langid.count_ngrams(np.frombuffer(b"".join(data), np.uint8), offsets)
    want = [(i, number(g), k) for i, t in enumerate(texts) for g, k in plain_ngrams(t).items()]
    assert list(zip(who.tolist(), code.tolist(), n.tolist(), strict=True)) == sorted(want)


@pytest.mark.parametrize("distinct", [3000, 90_000])
def test_large_alphabets_sort_alike(distinct):
    rng = np.random.default_rng(0)
    alphabet = [chr(c) for c in range(0x110000) if chr(c).isalpha() and len(chr(c).lower()) == 1][:distinct]
    texts = ["".join(rng.permutation(alphabet)), "".join(rng.choice(alphabet, 500))] + ["ab"] * 9000
    data = [t.encode() for t in texts]
    got = langid.count_ngrams(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    want = sorted((i, number(g), k) for i, t in enumerate(texts) for g, k in plain_ngrams(t).items())
    assert [tuple(x) for x in np.stack(got, axis=1).tolist()] == want


def test_the_whole_query_equals_plain_profiles_and_distances(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    totals = {}
    for r in docs:
        if r.lang is not None and not held[r.doc_id]:
            totals.setdefault(r.lang, Counter()).update(plain_ngrams(r.text))
    first = lambda counts, k: sorted(counts, key=lambda g: (-counts[g], number(g)))[:k]
    ranks = {lang: {g: i for i, g in enumerate(first(c, langid.PROFILE))} for lang, c in totals.items()}
    got = {r.doc_id: r for r in langid.op5_rank_order_language(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        own = first(plain_ngrams(r.text), langid.OWN)
        cost = {lang: sum(abs(known[g] - i) if g in known else langid.PROFILE for i, g in enumerate(own)) for lang, known in ranks.items()}
        best = min(sorted(cost), key=cost.get) if own else "und"
        score = 1 - cost[best] / (langid.PROFILE * len(own)) if own else 0.0
        assert (got[r.doc_id].held_out, got[r.doc_id].lang_pred) == (held[r.doc_id], best) and abs(got[r.doc_id].score - score) < 1e-12
