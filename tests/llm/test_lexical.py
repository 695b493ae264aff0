import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from seriesloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    """(item, rank, id, score) by the formula, every document for every item."""
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    whole, total = sum(n > 0 for *_, n in held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c, n in held:
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * (75 + 25 * n * whole // total)))
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return out


def run(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, i, "x") for i, t in docs], "doc_id long, text string, score long, item string").repartition(3)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, id int")
    return [(r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(d, q, k).collect()]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many parts, intervals down to single documents, several chunks; workers take these by value with the closure's module only where forked
        monkeypatch.setattr(lexical, "CHUNK_TERMS", 60)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "日本", "A1", "a_b", "x-y", "The", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(400)]
    docs += [(i + 1000, docs[7][1]) for i in range(60)] + [(3, "w1 w2"), (3, "w1 w2"), (3, "w9 other"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, "-- __"), (903, "w5 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 25)))) for i in range(25)]
    items += [(1, items[1][1]), (2, "w3 w3 w3 w4"), (None, "w1 w7"), (30, None), (31, ""), (32, "unknown"), (33, "w50")]
    assert sorted(run(spark, docs, items, 20), key=str) == sorted(plain_search(docs, items, 20), key=str)


def test_parts_and_leaves(monkeypatch):
    """Small intervals, batches and parts, in this process."""
    for name, value in (("LEAF", 1), ("BATCH", 2), ("POSTINGS", 50)):
        monkeypatch.setattr(lexical, name, value)
    import pyarrow as pa

    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices("abcdefghijkl", k=rng.randrange(1, 12)))) for i in range(200)]
    items = [(i, " ".join(rng.choices("abcdefghijkl", k=4))) for i in range(10)]
    words = np.unique(np.concatenate([w.hashes for w in lexical.runs(pa.array([t for _, t in items]), lexical.ALNUM)]))
    df, whole, total = np.zeros(len(words), np.int64), 0, 0
    for _, n, _, term, _ in lexical._postings(pa.array([t for _, t in docs]), words):
        df, whole, total = df + np.bincount(term, minlength=len(words)), whole + int((n > 0).sum()), total + int(n.sum())
    weight = np.floor(1000 * np.log((2 * whole + 2) / (2 * df + 1))).astype(np.int64)
    queries = []
    for i, t in items:
        h, c = np.unique(next(lexical.runs(pa.array([t]), lexical.ALNUM)).hashes, return_counts=True)
        at = np.searchsorted(words, h)
        queries.append((i, 0, lexical.Query(i, at, weight[at] * c)))

    class Sent:
        value = (words, queries, whole, total)

    batches = [pa.record_batch([pa.array([i for i, _ in docs[a : a + 30]]), pa.array([t for _, t in docs[a : a + 30]])], names=["id", "text"]) for a in range(0, 200, 30)]
    (out,) = lexical._searcher(Sent, 5)(iter(batches))
    got = sorted(zip(out.column(0).to_pylist(), [-s for s in out.column(3).to_pylist()], out.column(2).to_pylist(), strict=True))
    assert got == sorted((q, -s, i) for q, _, i, s in plain_search(docs, items, 5))


def test_bounds_leave_documents_unscored():
    """Where few documents hold a rare term often, most are never scored."""
    rng = np.random.default_rng(2)
    docs, each = 20_000, 3000
    doc = np.concatenate([rng.choice(docs, each, replace=False) for _ in range(4)])
    term = np.repeat(np.arange(4), each)
    impact = rng.pareto(1.2, 4 * each).clip(0, 1000).astype(np.int64) + 1
    index = lexical.ImpactIndex(term, doc, impact, docs, 4)
    query = lexical.Query(0, np.arange(4), np.array([5, 4, 3, 2]))
    found, scores, scored = lexical.best_first(index, query, 10, 1)
    truth = np.bincount(doc, impact * query.weights[term], docs).astype(np.int64)
    assert sorted(scores)[-10:] == sorted(truth)[-10:] and (truth[found] == scores).all()
    assert scored < len(np.unique(doc)) / 3


def test_empty(spark):
    assert run(spark, [], [(1, "a")], 20) == [] and run(spark, [(1, "a")], [], 20) == [] and run(spark, [(1, None)], [(1, "a")], 20) == []
    assert run(spark, [(1, "a"), (2, "b")], [(1, "a")], 20) == [(1, 1, 1, 693 * (1_000_000_000 // (1000 + 12 * 100)))]
