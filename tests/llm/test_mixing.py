import duckdb

from seriesloom.llm import mixing


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(f"select doc_id, size, source_size, target, taken from ({mixing.OP10_SQL})").fetchall()
    assert rows_of(mixing.op10_capped_water_filling(spark, sf)) == sorted(want, key=str)


def test_targets_and_taken_words(spark, sf):
    got = mixing.mixture(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "max"), size=("source_size", "max"))
    assert ((by.taken - by.target).abs() <= 1).all() and (by.target <= 2 * by["size"] + 1e-9).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (got.taken <= 2 * got["size"]).all()


def test_water_filling_by_hand(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 100), (None, 90)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(sizes).collect()}
    # 450 words by weights 3, 1, 2, 3; a stops at 20, then null at 180
    assert got["a"] == 20 and got[None] == 180 and abs(got["b"] - 250 / 3) < 1e-9 and abs(got["c"] - 500 / 3) < 1e-9
    assert {r.target for r in mixing.water_fill(sizes, epochs=1).collect()} == {10, 100, 90}


def test_rows_are_repeated_as_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = {r.doc_id: r.taken for r in mixing.mixture(docs).collect()}
    out = mixing.repeat_rows(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.withColumn("w", mixing.words_of(out.text)).collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + r.w
    assert {i: n for i, n in plan.items() if n} == words


def test_edge_cases(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "x y z", None, 1), (3, "x y z", None, 1), (4, "w " * 100_000, "b", 1), (None, "q", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mixture(docs)
    assert got.count() == len(rows) and {r.taken for r in got.where("source = 'a'").collect()} == {0}
    assert all(r.taken <= 2 * r["size"] for r in got.collect())
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mixture(docs.repartition(5)).collect()))
    assert mixing.mixture(docs.limit(0)).count() == 0 == mixing.repeat_rows(docs.limit(0)).count()
