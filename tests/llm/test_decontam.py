import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seriesloom.functions import keyed
from seriesloom.llm import decontam, tokens


def words_of(text):
    return re.findall(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+", text or "")


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB_9 .,é\n€", max_size=40)), max_size=12))
@settings(max_examples=150, deadline=None)
def test_words_match_a_plain_split(texts):
    got = []
    for w in tokens.words(pa.array(texts, pa.string())):
        for i in range(len(w.bounds) - 1):
            got.append([bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.bounds[i] : w.bounds[i + 1]], w.ends[w.bounds[i] : w.bounds[i + 1]], strict=True)])
    assert got == [words_of(t) for t in texts]


def test_hashes_follow_words_in_lower_case():
    w = next(tokens.words(pa.array(["Été ÉTÉ été ete a ab ba"])))
    assert len(set(w.hashes[:3])) == 1 and len(set(w.hashes[3:])) == 4


def brute(docs, items):
    """Pairs of a document and an item by trying every alignment."""
    ids: dict[str, int] = {}
    code = lambda t: np.array([ids.setdefault(x.lower(), len(ids)) for x in words_of(t)])
    out = {}
    for d, text in docs:
        a = code(text)
        for i, item in items:
            b = code(item)
            best = [s for k in range(-len(b), len(a)) if (s := decontam.stretch(a, b, k))]
            if best:
                out[d, i] = max(x[0] for x in best)
    return out


def test_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.op8_spaced_seed_decontamination(spark, sf).collect()}
    assert got == brute(docs, items) and got


def test_replaced_words_are_tolerated(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    rows = []
    for i, every in enumerate((4, 6, 8, 13, 1000)):
        leaked = [word() if k % every == every - 1 else w for k, w in enumerate(item)]
        rows.append((i, " ".join([word() for _ in range(30)] + leaked + [word() for _ in range(30)]).upper()))
    rows += [(10, " ".join(word() for _ in range(200))), (11, " ".join(item[:10])), (12, " ".join(item[5:25])), (13, None), (14, ""), (None, " ".join(item))]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, ", ".join(item)), (2, "too short"), (3, None), (1, ", ".join(item))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.overlaps(docs, bench).collect()}
    assert set(got) == {1, 2, 3, 4, 12, None} and got[4].matched == 40 and (got[4].doc_from, got[4].doc_to) == (30, 70)
    kept = decontam.without_overlaps(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 10, 11, 13, 14}
    assert decontam.overlaps(docs.limit(0), bench).count() == 0 == decontam.overlaps(docs, bench.limit(0)).count()


def test_a_long_text_is_read_whole(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " * 300_000 + item)], "doc_id long, text string")
    got = decontam.overlaps(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (got.matched, got.doc_from) == (20, 300_000)


def meet(doc, item):
    """Whether a document's words, blanks around them, and an item's have a window of one kind and alignment in common."""
    kinds = decontam.kinds_of(len(item))
    return any((a[1 : len(b) + 1] == b[: len(a) - 1]).any() for a, b in zip(decontam.seeds(np.insert(doc, [0, len(doc)], np.uint64(0)), kinds), decontam.seeds(item, kinds), strict=True))


@pytest.mark.parametrize("length", range(1, 18))
def test_every_accepted_replacement_is_found(length):
    rng = np.random.default_rng(length)
    item = rng.integers(1, 1 << 63, length).astype(np.uint64)
    accepted = missed = 0
    for k in range(5 if length <= 12 else 4):
        for places in itertools.combinations(range(length), k):
            doc = item.copy()
            doc[list(places)] = rng.integers(1, 1 << 63, k).astype(np.uint64)
            if decontam.stretch(doc, item, 0):
                accepted += 1
                missed += not meet(doc, item)
    assert accepted and missed == 0


def test_longer_items_with_a_fifth_replaced_are_found():
    rng = np.random.default_rng(0)
    accepted = missed = 0
    for _ in range(20_000):
        length = int(rng.integers(18, 60))
        item = rng.integers(1, 1 << 63, length).astype(np.uint64)
        doc = np.where(rng.random(length) < rng.uniform(0.1, 0.3), rng.integers(1, 1 << 63, length).astype(np.uint64), item)
        if decontam.stretch(doc, item, 0):
            accepted += 1
            missed += not meet(doc, item)
    assert accepted > 5000 and missed == 0


def test_short_items_are_found_whole_and_passages_at_the_ends_of_a_text(spark):
    bench = spark.createDataFrame([(1, "One"), (2, "two three"), (3, "a b c d e f g"), (4, "p q r s t u v w"), (5, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "q r s t u v w"), (2, "x. p q r s t u v"), (3, "p q r s t u v"), (4, "three two three; ONE"), (5, "a b c d e f"), (6, "z a b c d e f g"), (7, "q r s t u v"), (8, "two-three")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched, r.doc_from, r.doc_to) for r in decontam.overlaps(docs, bench).collect()}
    assert got == {(1, 4, 7, 0, 7), (2, 4, 7, 1, 8), (3, 4, 7, 0, 7), (4, 2, 2, 1, 3), (4, 1, 1, 3, 4), (6, 3, 7, 1, 8), (8, 2, 2, 0, 2)}


def test_one_word_repeated_over_a_long_text(spark, monkeypatch):
    """A benchmark word that a text repeats makes one hit of a short item; a long item lies at many places of one region. Hot seeds are dealt."""
    monkeypatch.setattr(keyed, "HOT_ROWS", 5)
    monkeypatch.setattr(keyed, "HOT_KEYS", 100)
    bench = spark.createDataFrame([(1, "same"), (2, "same same"), (3, "same " * 12), (4, "same " * 12 + "end of it")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "same " * 40_000), (2, "other " + "same " * 12 + "end of it " + "same " * 30), (3, "same"), *((10 + i, f"u{i} same v{i}") for i in range(30))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched, r.doc_from, r.doc_to) for r in decontam.overlaps(docs, bench).collect()}
    want = {(1, 1, 1, 0, 1), (1, 2, 2, 0, 2), (1, 3, 12, 0, 12), (1, 4, 12, 0, 12), (2, 1, 1, 1, 2), (2, 2, 2, 1, 3), (2, 3, 12, 1, 13), (2, 4, 15, 1, 16), (3, 1, 1, 0, 1)}
    assert got == want | {(10 + i, 1, 1, 1, 2) for i in range(30)}
