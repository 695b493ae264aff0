import duckdb
import numpy as np

from seriesloom.llm import topk


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    by = ["query_id", "rank", "vec_id", "score"]
    got = topk.op9_block_at_a_time_top_k(spark, sf).toPandas().sort_values(by)[by].reset_index(drop=True)
    want = con.sql(topk.OP9_SQL).df().sort_values(by)[by].reset_index(drop=True)
    assert got.equals(want.astype(got.dtypes.to_dict()))


def test_pruning_is_exact_and_saves_work():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (40, 16))
    data = np.concatenate([c + rng.integers(-3, 4, (64, 16)) for c in centres])
    ids = np.arange(len(data))
    blocks = [(ids[i : i + 64], data[i : i + 64]) for i in range(0, len(data), 64)]
    q = data[::50]
    found, scores, there, scored = topk.search_block_order(q, ids[::50], blocks, 5)
    for i, (v, own) in enumerate(zip(q, ids[::50], strict=True)):
        s = data @ v
        want = sorted((-x, j) for j, x in zip(ids, s, strict=True) if j != own)[:5]
        assert [(-x, j) for x, j in zip(scores[i], found[i], strict=True)] == want
    assert there.all() and scored < 0.3 * q.shape[0] * len(data)


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (2, [1.0], 0), (3, [nan, 1.0], 0), (4, None, 0), (5, [None, 1.0], 0), (6, [inf, 0.0], 0), (None, [1.0, 1.0], 0), (50, [-1.0, 0.5], 0), (7, [1.0, 2.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(vectors).collect()}
    assert got == {(0, 1): (1, 5 * 65536), (0, 2): (7, 5 * 65536), (0, 3): (2, 65536), (0, 4): (50, 0), (50, 1): (0, 0), (50, 2): (1, 0), (50, 3): (7, 0), (50, 4): (2, -65536)}
    assert topk.top_k(vectors.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [3e9, 1.0]), (1, [1e9, 1.0])], "vec_id long, embedding array<double>")
    assert topk.top_k(big, scale=1).first().score == 3 * 10**18 + 1
