import random
import re

import numpy as np
import pytest

from seriesloom.functions import keyed
from seriesloom.llm import beside, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_repeats(rows, length=13):
    """(id, words, removed, kept, spans) by looking up every window."""
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            if i is not None and first.get(tuple(w[p : p + length]), i) < i:
                gone[p : p + length] = [True] * length
        spans = [(a, next((b for b in range(a, len(w)) if not gone[b]), len(w))) for a in range(len(w)) if gone[a] and (a == 0 or not gone[a - 1])]
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g), spans))
    return sorted(out, key=str)


def corpus(rng, n=120):
    words = [f"w{i}" for i in range(40)] + ["é", "日本", "x" * 90, "."]
    passages = [" ".join(rng.choices(words, k=k)) for k in (12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, k=rng.randrange(0, 40))) for _ in range(rng.randrange(0, 6))]
        rows.append((rng.randrange(0, n), rng.choice([" ", "\n", "\t "]).join(parts)))
    for i in range(20):  # near copies: one word replaced, cut at either end
        w = rows[i][1].split()
        if len(w) > 20:
            k = rng.randrange(len(w))
            rows += [(rng.randrange(0, 500), " ".join(w[:k] + ["new"] + w[k + 1 :])), (rng.randrange(0, 500), " ".join(w[3:-2]))]
    few = "a b a b b a a a b b a b"  # many ties of equal words
    rows += [(600 + i, " ".join(rng.choices(few.split(), k=rng.randrange(10, 60)))) for i in range(30)]
    return rows + [(None, passages[4]), (None, passages[4] + " more"), (5, None), (6, ""), (7, " \n "), (8, passages[5]), (8, passages[5]), (8, passages[5] + " " + passages[5])]


def run(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 1, "x", [1]) for i, t in rows], "doc_id long, text string, id int, row string, spans array<int>").repartition(4)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept, [(s["from"], s["to"]) for s in r.repeats]) for r in repeats.without_repeats(docs, **how).collect()), key=str)


@pytest.mark.parametrize("hot", [False, True])
def test_equals_every_window(spark, monkeypatch, hot):
    if hot:  # hot keys are dealt, and lists joined by a shuffle
        monkeypatch.setattr(keyed, "HOT_ROWS", 2)
        monkeypatch.setattr(keyed, "HOT_KEYS", 40)
        monkeypatch.setattr(beside, "ROWS", 0)
    rows = corpus(random.Random(3 + hot))
    assert run(spark, rows) == plain_repeats(rows)


def test_other_lengths(spark):
    rows = corpus(random.Random(9), 40)
    assert run(spark, rows, length=5, seed=3) == plain_repeats(rows, 5)
    assert run(spark, rows, length=4, seed=4) == plain_repeats(rows, 4)


def test_long_text_and_empty_table(spark):
    rows = [(1, "same " * 30_000), (2, "same " * 30_000 + "end"), (3, " ".join(f"u{i}" for i in range(30_000)))]
    (_, n1, r1, *_), (_, n2, r2, k2, s2), (_, n3, r3, *_) = run(spark, rows)
    assert (n1, r1, n2, r2, k2, s2, n3, r3) == (30_000, 0, 30_001, 30_000, "end", [(0, 30_000)], 30_000, 0)
    assert run(spark, []) == []


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 9, 500).astype(np.uint64)
    bounds = np.array([0, 0, 5, 18, 18, 300, 500])
    at, gram, first, last, text = repeats.anchors(hashes, bounds)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last, strict=True)])
    wanted = [p for t in range(6) for p in range(bounds[t], bounds[t + 1] - 12)]
    assert sorted(covered) == wanted and ((first <= at) & (at <= first + 7) & (last <= at)).all() and (bounds[text] <= at).all()
    for p, q in zip(*np.nonzero((np.lib.stride_tricks.sliding_window_view(hashes, 13)[:, None] == np.lib.stride_tricks.sliding_window_view(hashes, 13)[None]).all(axis=2)), strict=True):
        if p in wanted and q in wanted:  # equal windows choose equal anchors
            i, j = (int(np.searchsorted(last, x)) for x in (p, q))
            assert at[i] - p == at[j] - q and gram[i] == gram[j]
