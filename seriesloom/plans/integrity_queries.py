"""Queries of checks over whole tables: repeats across shards, published expectations, what a table holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesloom.functions.staging import new_path, staged
from seriesloom.operators import augment, governance, joins, selection, uniqueness
from seriesloom.plans.base import query, rounded, table
from seriesloom.sources import files, published


@query("shard_repeats", """
SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS rows, array_to_string(list_sort(list(DISTINCT l_orderkey % 8)), ',') AS shards
FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def shard_repeats(spark, sf_dir):
    """Pairs of supplier and day that come twice in eight shards of order lines."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), (F.col("l_orderkey") % 8).alias("shard"))
    got = uniqueness.repeated_keys(rows, ["l_suppkey", "day"], "shard").repeats
    return got.withColumn("shards", F.array_join(F.transform("shards", lambda x: x.cast("string")), ","))


@query("published_orders", "SELECT o_orderstatus, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL")
def published_orders(spark, sf_dir):
    """Orders published in parts by status against a manifest of their counts and digest, and read back."""
    orders = table(spark, sf_dir, "orders")
    counts = {r["o_orderstatus"]: r["n"] for r in orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).collect()}  # a row a status
    expected = published.Expected(sum(counts.values()), {"o_orderstatus": counts}, ("o_totalprice",), published.digest(orders))
    path = new_path(spark, "published")
    published.publish(orders, path, expected, ("o_orderstatus",))
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("table_digest", """
WITH r AS (
  SELECT sha256(array_to_string(['v' || to_base64(encode(CAST(o_orderkey AS VARCHAR))), 'v' || to_base64(encode(CAST(o_custkey AS VARCHAR))), coalesce('v' || to_base64(encode(o_orderstatus)), 'n')], ',')) AS h FROM orders),
s AS (SELECT h[1:3] AS p, count(*) AS n, sum(CAST('0x' || h[1:12] AS HUGEINT)) AS a, sum(CAST('0x' || h[13:24] AS HUGEINT)) AS b, sum(CAST('0x' || h[25:36] AS HUGEINT)) AS c, sum(CAST('0x' || h[37:48] AS HUGEINT)) AS d, sum(CAST('0x' || h[49:60] AS HUGEINT)) AS e FROM r GROUP BY p),
t AS (SELECT list(p || ':' || n || ':' || a || ':' || b || ':' || c || ':' || d || ':' || e) AS l FROM s)
SELECT sha256('o_orderkey,o_custkey,o_orderstatus|' || coalesce(array_to_string(list_sort(l), ';'), '')) AS digest FROM t""")
def table_digest(spark, sf_dir):
    """A table's digest, whatever the order of its rows and their files."""
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey", "o_orderkey")
    return spark.createDataFrame([(governance.content_hash(rows, ["o_orderkey", "o_custkey"]),)], "digest string")


@query("truth_after_freeze", """
SELECT o_orderkey, o_custkey * 7.0::DOUBLE AS guess, round(CAST(o_totalprice AS DOUBLE), 4) AS price FROM orders""")
def truth_after_freeze(spark, sf_dir):
    """Predictions that are fixed by their digest, and only then meet the truth, of which every row is there once."""
    orders = table(spark, sf_dir, "orders")
    guesses = staged(governance.allowed(orders, ["o_orderkey", "o_custkey"]).select("o_orderkey", (F.col("o_custkey") * 7.0).alias("guess")), "guesses")
    ledger = governance.Ledger()
    ledger.freeze(guesses, ["o_orderkey"])
    truth = orders.select("o_orderkey", F.round(F.col("o_totalprice").cast("double"), 4).alias("price"))
    return ledger.attach_truth(guesses, truth, ["o_orderkey"])


@query("merged_shards", "SELECT o_orderkey % 4 AS shard, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY ALL")
def merged_shards(spark, sf_dir):
    """Orders put together again from four shards that share no key and leave none out."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    merged = governance.merge_shards([orders.where(F.col("o_orderkey") % 4 == i) for i in range(4)], orders, ["o_orderkey"])
    return merged.groupBy((F.col("o_orderkey") % 4).alias("shard")).agg(F.count("*").alias("rows"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("submission_round_trip", """
SELECT user_id || '_' || event_id AS id, round(value + 1, 2) AS tvt, row_number() OVER (ORDER BY user_id, event_id) - 1 AS place FROM events""")
def submission_round_trip(spark, sf_dir):
    """A checked submission written in the order of its template, and read back with the place of each row over all part files."""
    events = table(spark, sf_dir, "events")
    ident = F.concat_ws("_", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    template = selection.numbered(events.select("user_id", "event_id", ident.alias("id")), ["user_id", "event_id"])
    guesses = events.select(ident.alias("id"), F.round(F.col("value") + 1, 2).alias("tvt"))
    path = new_path(spark, "submission")
    files.write_submission(governance.validate_submission(guesses, template, "id", "tvt"), template, "id", "tvt", "position", path)
    read = files.read_csv(spark, path, "id string, tvt double")
    rows = read.select("id", "tvt", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("at"))
    return selection.numbered(rows, ["file", "at"], "place").select("id", "tvt", "place")


@query("first_groups", "SELECT * EXCLUDE (props) REPLACE (epoch_us(ts) AS ts) FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 12)")
def first_groups(spark, sf_dir):
    """The whole rows of the first twelve users."""
    rows = files.first_groups(table(spark, sf_dir, "events").drop("props"), "user_id", 12)
    return rows.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


@query("manifests_equal", """
SELECT CAST((SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) = 0 AS INT) AS orders_known,
       CAST((SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)) + (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS INT) AS same_customers,
       CAST((SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) + (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) = 0 AS INT) AS same_orders""")
def manifests_equal(spark, sf_dir):
    """Which tables name just the same keys."""
    side = lambda name, column: table(spark, sf_dir, name).select(F.col(column).alias("k"))
    buyers, customers = side("orders", "o_custkey"), side("customer", "c_custkey")
    known = not joins.coverage(customers, buyers, ["k"]).where("status = 'extra'").limit(1).count()
    same = joins.same_keys(customers, buyers, ["k"]), joins.same_keys(side("orders", "o_orderkey"), side("lineitem", "l_orderkey"), ["k"])
    return spark.createDataFrame([(int(known), *map(int, same))], "orders_known int, same_customers int, same_orders int")


@query("turned_vectors", """
WITH e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
r AS (SELECT vec_id, cos(radians(30)) * x - sin(radians(30)) * y AS x, sin(radians(30)) * x + cos(radians(30)) * y AS y FROM e)
SELECT vec_id, round(2 - x + 0.5, 6) AS x, round(y - 0.25, 6) AS y FROM r""")
def turned_vectors(spark, sf_dir):
    """Two coordinates turned by 30 degrees, the first reflected, both moved."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", at(1).alias("x"), at(2).alias("y")).withColumns(augment.rotated("x", "y", 30.0))
    return rounded(rows.withColumns(augment.reflected("x", 1.0)).withColumns(augment.translated({"x": 0.5, "y": -0.25})), "x", "y")
