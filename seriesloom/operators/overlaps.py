"""Stretches that series have in common: classes of equal windows, and overlaps verified to their full length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.keyed import joined
from seriesloom.functions.staging import staged


def _code(code: str) -> Column:
    """The code as text, a null one as a text that no code is."""
    return F.coalesce(F.concat(F.lit("="), F.col(code).cast("string")), F.lit("-"))


def window_classes(rows: DataFrame, key: str, order: str, code: str, k: int) -> DataFrame:
    """(gram, rep_key, rep_place, key, place): windows of k successive codes that more than one place holds.

    A class is a content; its representative is the first of its places by key and order, and every place of the class is
    a row, the representative's own included. `order` counts the rows of a series from 0. Null codes
    equal each other. No pairs are made, so the result grows with the windows, however many hold one content.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, k - 1)
    grams = rows.withColumn("__g", F.collect_list(_code(code)).over(w)).where(F.size("__g") == k)
    grams = staged(grams.select(F.sha2(F.concat_ws(",", F.transform("__g", lambda x: F.sha2(x, 256))).cast("binary"), 256).alias("gram"), F.col(key).alias("key"), F.col(order).alias("place")), "grams")
    classes = grams.groupBy("gram").agg(F.min(F.struct("key", "place")).alias("r"), F.count("*").alias("n")).where("n > 1")
    classes = staged(classes.select("gram", F.col("r.key").alias("rep_key"), F.col("r.place").alias("rep_place"), "n"), "classes")
    return joined(grams, classes, ["gram"]).select("gram", "rep_key", "rep_place", "key", "place")


def verified_overlaps(rows: DataFrame, key: str, order: str, code: str, k: int) -> DataFrame:
    """(rep_key, rep_from, key, from, length): maximal equal stretches of a series with representatives of its windows.

    Windows of a series that follow one another, and whose representatives do so in one other series (or earlier in
    the same), lie on one diagonal and are one hit. A hit is extended to both sides as long as the
    codes of both series are equal. Hits that grow into the same stretch are one row. Every window that isn't
    its class's representative is in an overlap with that.
    """
    members = window_classes(rows, key, order, code, k).where("key <> rep_key or place <> rep_place")
    diagonal = ["rep_key", "key", "shift"]
    hits = members.withColumn("shift", F.col("place") - F.col("rep_place"))
    hits = hits.withColumn("__run", F.col("place") - F.row_number().over(Window.partitionBy(*diagonal).orderBy("place")))
    hits = staged(hits.groupBy(*diagonal, "__run").agg(F.min("place").alias("low"), (F.max("place") + k).alias("high")).drop("__run"), "hits")
    whole = rows.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), _code(code).alias("c")))).alias("s")).select("key", F.col("s.c").alias("codes"))
    whole = staged(whole, "codes")

    def with_codes(df: DataFrame, of: str, out: str) -> DataFrame:
        counts = df.groupBy(of).agg(F.count("*").alias("n"))
        return joined(df, staged(counts.join(whole.select(F.col("key").alias(of), F.col("codes").alias(out)), of), "codes"), [of])

    both = with_codes(with_codes(hits, "key", "own"), "rep_key", "others")
    ahead = _equal_heads(_rest(F.col("own"), F.col("high")), _rest(F.col("others"), F.col("high") - F.col("shift")))
    behind = _equal_heads(F.reverse(F.slice("own", 1, F.col("low").cast("int"))), F.reverse(F.slice("others", 1, (F.col("low") - F.col("shift")).cast("int"))))
    grown = both.select("rep_key", "key", "shift", (F.col("low") - behind).alias("from"), (F.col("high") + ahead).alias("to")).distinct()
    return grown.select("rep_key", (F.col("from") - F.col("shift")).alias("rep_from"), "key", "from", (F.col("to") - F.col("from")).alias("length"))


def _rest(codes: Column, low: Column) -> Column:
    return F.slice(codes, low.cast("int") + 1, F.greatest(F.size(codes) - low.cast("int"), F.lit(0)))


def _equal_heads(a: Column, b: Column) -> Column:
    """How many entries two arrays have in common from their heads on."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a).cast("long"))
