from collections import Counter

import corpus_pipeline
from seriesloom.functions.staging import staged
from seriesloom.llm import mixing, quality, simhash
from tests.llm.test_decontam import brute as leaks


def test_stages_do_their_work_on_what_they_are_given(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, bench = docs.columns, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = staged(stage(spark, docs, sf), name)
        after = docs.collect()
        if name == "quality_filter":
            kept = {r.doc_id for r in after}
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert sum(labels.get(r.doc_id) == 1 and r.doc_id not in kept for r in before) <= 2
            assert sum(labels.get(i) == 0 for i in kept) <= sum(q == 0 for q in labels.values()) / 2 and len(kept) < len(before)
        if name == "near_dedup":
            groups = {r.component_id for r in simhash.near_duplicates(spark.createDataFrame(before)).collect()}
            assert Counter(r.doc_id for r in after) == Counter(groups)
        if name == "decontaminate":
            bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in before], bench)}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - bad
        if name == "mix":
            taken = {r.doc_id: r.taken for r in mixing.mixture(spark.createDataFrame(before)).collect()}
            words = Counter()
            for r in after:
                words[r.doc_id] += len(r.text.encode().split())
            assert words == {i: n for i, n in taken.items() if n}
        if name == "shard":
            assert len(after) == len(before) and {r.shard for r in after} <= set(range(40))
        else:
            assert docs.columns == columns
    assert quality.THRESHOLD == 0.3


def test_an_empty_table_passes_through(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf):
    """Every stage keeps the columns of what it gets, extra ones too, and treats null and repeated rows as its operator does."""
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    good = next(r for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and 300 < len(r.text) < 2000 and not any(i in r.text for i in items))
    leak = items[0]
    rows = [(1, None, None, None, 0), (1, None, None, None, 0), (None, good.text, "en", "a", 1), (2, good.text, "en", "a", 2), (2, good.text, "en", "a", 2), (3, "", None, "b", 3), (4, good.text + " " + leak, "en", "b", 4), (5, "word " * 20_000, None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").selectExpr("*", "1 as item_id", "'x' as id", "0.5D as score", "7 as shard", "8 as size", "9 as words", "doc_id as label", "0 as taken", "1 as component_id")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf)
        out = got.collect()
        kept[name] = out
        if name != "shard":
            assert got.columns == docs.columns
        if name not in ("mix", "shard"):
            assert {tuple(r) for r in out} <= {tuple(r) for r in docs.collect()}
    assert sum(r.text == good.text for r in kept["quality_filter"]) in (0, 3)
    assert all(any(t is None or t.startswith(r.text) for t in (x[1] for x in rows)) for r in kept["mix"])
    assert sum(r.text == good.text for r in kept["near_dedup"]) == 1
    assert [r.doc_id for r in kept["decontaminate"] if r.text and leak in r.text] == [] and len(kept["decontaminate"]) == 7
    assert len(kept["shard"]) == len(rows) and all(r.text_crc32 is not None for r in kept["shard"])
