from itertools import combinations

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.llm import simhash


def brute(text):
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.one_of(st.none(), st.text(alphabet="aB é\t\n\r\x0b\x0c ", max_size=60)))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_majority_of_hashes(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute(text)


def components(fps):
    """doc ids -> smallest reachable id."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(fps), 2):
        if bin(fps[a] ^ fps[b]).count("1") <= 3:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in fps}


def test_components_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in simhash.op1_simhash_near_dedup(spark, sf).collect()}
    fps = {i: brute(t) for i, t in text.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == components(fps)
    assert len(set(components(fps).values())) < len(fps)


def test_links_are_complete_within_three_bits(spark):
    base = 0x0123456789ABCDEF
    flips = [base] + [base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in list(combinations(range(0, 64, 5), 3))[:120]]
    fps = {i: f for i, f in enumerate(flips)} | {500: base ^ 0b1111, 501: 0, 502: (1 << 64) - 1}
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in set(fps.values())]
    links = simhash.fingerprint_links(spark.createDataFrame(rows, "fp long")).collect()
    mask = (1 << 64) - 1
    assert all(bin((r.src ^ r.dst) & mask).count("1") <= 64 for r in links)
    from seriesloom.llm.components import connected_components

    roots = {r.node & mask: r.root & mask for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    want = components(fps)
    for a, b in combinations(fps, 2):
        same = roots.get(fps[a], fps[a]) == roots.get(fps[b], fps[b])
        assert same == (want[a] == want[b])


def test_blocks_of_a_long_list_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rows = [(1 << i,) for i in range(40)] + [(0,)]
    from seriesloom.llm.components import connected_components

    roots = connected_components(simhash.fingerprint_links(spark.createDataFrame(rows, "fp long"))).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 41


def test_edge_cases(spark):
    rows = [(1, None, 9), (2, "", 9), (3, " \t ", 9), (4, "one two", 9), (4, "one two", 9), (None, "one two", 9), (5, "x " * 50_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(docs).drop("fp").collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[None] == 4 and by[5] == 5
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]


def test_hex():
    assert len(simhash.PLANES) == 14
    assert all(any(set(p) <= set(s) for p in simhash.PLANES) for s in combinations(range(8), 5))
    assert str(simhash.hex_of(F.lit(1)))
