"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated a limited number of times. Sources whose share is
above that limit are held at it, and what they can't take is dealt to the others by weight, until
none is above. A source is then taken in whole repetitions, and in one fractional repetition: its
documents in a seeded order up to the missing words, the document at the border in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
#: The place in the seeded order at which a source is cut is narrowed down by so many bits a pass: a source has 256 sums a
#: pass, and only about one part in 16 million of it is sorted by the whole key.
LEVEL_BITS, LEVELS = 8, 3
_KEY_BITS = 60


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(ident: Column, seed: int) -> Column:
    """A place in the seeded order: 60 bits that depend on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def water_fill(sizes: DataFrame, cycle: tuple[float, ...] = (3, 1, 2), share: float = 1.5, epochs: float = 2) -> DataFrame:
    """(source, source_size, target) for `sizes` (source, source_size), which has a row for each source.

    Weights repeat `cycle` over the sources by code point, null last. Rounds go on until no source
    is above its limit; each sees one row of sums. Where all limits together are below the wanted
    words, every source ends at its limit. Without rows the result has none.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # a row for each source, not for each document
    weights = F.element_at(F.array(*(F.lit(float(w)) for w in cycle)), (place % len(cycle) + 1).cast("int"))
    sources = staged(sizes.withColumn("weight", weights).withColumn("limit", F.col("source_size") * F.lit(float(epochs))), "sources")
    wanted = (sources.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, held = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("limit") < F.lit(level) * F.col("weight")
        free = F.when(~above, F.col("weight"))
        n, taken, rest = sources.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("limit"))), F.sum(free)).first()
        if n == held or not rest:
            break
        held, level = n, (wanted - (taken or 0.0)) / rest
    target = F.col("limit") if level is None else F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_of(F.col(text_col)).alias("size"), order_key(F.col(id_col), seed).alias("key"))


def _border(sums: DataFrame, goal: DataFrame, by: str) -> DataFrame:
    """(source, by, words, left): the row of `sums` at which a source's running sum reaches `left` of `goal`, and what is left for it."""
    upto = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sums.withColumn("upto", F.sum("words").over(upto)).alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
    summed = summed.where("upto >= left and upto - words < left")
    return summed.select(F.col("g.source").alias("source"), by, "words", (F.col("left") - F.col("upto") + F.col("words")).alias("left"))


def plan(sized: DataFrame, cycle=(3, 1, 2), share: float = 1.5, epochs: float = 2) -> DataFrame:
    """For each source of `sized` (source, size, key): how its documents are taken.

    whole: repetitions of every document. cut, part, tie: documents whose key is below `cut` are
    taken once more; at `cut`, `part` of the `tie` words there are; above it, nothing.
    """
    shift = _KEY_BITS - LEVEL_BITS
    sums = staged(sized.groupBy("source", F.shiftright("key", shift).alias("part")).agg(F.sum("size").alias("words")), "sums")
    targets = staged(water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, share, epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("missing", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    goal = targets.select("source", F.col("missing").alias("left"))
    for level in range(LEVELS):
        border = staged(_border(sums, goal, "part"), "border")
        if level == LEVELS - 1:
            break
        inside = sized.alias("d").join(border.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.shiftright("d.key", shift) == F.col("b.part")))
        shift -= LEVEL_BITS
        sums = inside.groupBy(F.col("b.source").alias("source"), F.shiftright("d.key", shift).alias("part")).agg(F.sum("d.size").alias("words"))
        goal = border.select("source", "left")
    inside = sized.alias("d").join(border.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.shiftright("d.key", shift) == F.col("b.part")))
    keys = inside.groupBy(F.col("b.source").alias("source"), "key").agg(F.sum("d.size").alias("words"))
    cuts = _border(keys, border.select("source", "left"), "key").withColumnRenamed("words", "tie").withColumnRenamed("key", "cut").withColumnRenamed("left", "part")
    cuts = cuts.withColumnRenamed("source", "at")
    found = targets.join(cuts, F.col("source").eqNullSafe(F.col("at")), "left")
    return staged(found.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("tie", F.lit(1)).alias("tie")), "plan")


def extra_words(size: Column, key: Column) -> Column:
    """Words of a document that the fractional repetition takes; documents that share the border's key split it by size."""
    part = F.floor(F.col("part") * size / F.col("tie"))
    return F.when(key < F.col("cut"), size).when(key == F.col("cut"), part).otherwise(F.lit(0)).cast("long")


def mixture(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", cycle=(3, 1, 2), share=1.5, epochs=2, seed=17) -> DataFrame:
    """(id_col, source, size, source_size, target, taken): the words that the mix takes of each document.

    A source's taken words equal its rounded target (below it by less than the number of rows that
    share the id at the border). A document is taken at most ceil(epochs) times. Null and blank
    texts have no words and nothing is taken; null sources form a source, sorted last; rows that
    repeat an id count separately. The result depends on ids, sizes and the seed, not on the order of rows.
    """
    sized = staged(_sized(docs, id_col, text_col, source_col, seed), "sized")
    how = plan(sized, cycle, share, epochs)
    both = sized.alias("d").join(how.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    taken = F.col("whole") * F.col("size") + extra_words(F.col("size"), F.col("key"))
    return both.select(F.col("id").alias(id_col), F.col("d.source").alias("source"), "size", "source_size", "target", taken.alias("taken"))


def op10_capped_water_filling(spark, sf_dir: str) -> DataFrame:
    return mixture(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim,
         (SELECT sum(source_size) FROM src) * 1.5::DOUBLE AS wanted,
         coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM src WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
lev AS (SELECT max((wanted - below) / rest) AS level FROM ranked),
tgt AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN lim ELSE least(lim, level * weight) END AS target FROM ranked, lev),
t2 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM tgt),
t3 AS (SELECT *, round(target - whole * source_size)::BIGINT AS missing FROM t2),
keys AS (SELECT source, key, sum(size)::BIGINT AS tie FROM sized GROUP BY ALL),
cum AS (SELECT *, sum(tie) OVER (PARTITION BY source ORDER BY key)::BIGINT AS upto FROM keys)
SELECT s.doc_id, s.size, t.source_size, t.target,
       t.whole * s.size + CAST(CASE WHEN c.tie = 0 THEN 0 ELSE floor(greatest(0, least(c.tie, t.missing - c.upto + c.tie)) * s.size::DOUBLE / c.tie) END AS BIGINT) AS taken
FROM sized s
JOIN t3 t ON s.source IS NOT DISTINCT FROM t.source
JOIN cum c ON s.source IS NOT DISTINCT FROM c.source AND s.key = c.key
"""


def repeat_rows(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", cycle=(3, 1, 2), share=1.5, epochs=2, seed=17) -> DataFrame:
    """The mixed documents themselves, with the columns of `docs`: each row as often as it is taken.

    The row at a source's border that is taken in part is one more row whose text ends after the
    words taken. The decisions need ids, sizes and sources only; texts are read once more and not
    shuffled where the plan, a row for each source, is small enough to be broadcast.
    """
    how = plan(staged(_sized(docs, id_col, text_col, source_col, seed), "sized"), cycle, share, epochs)
    how = how.select(*(F.col(c).alias(f"__mix_{c}") for c in how.columns))
    size, key = words_of(F.col(text_col)), order_key(F.col(id_col), seed)
    part = F.floor(F.col("__mix_part") * F.col("__mix_size") / F.col("__mix_tie"))
    extra = F.when(F.col("__mix_key") < F.col("__mix_cut"), F.col("__mix_size")).when(F.col("__mix_key") == F.col("__mix_cut"), part).otherwise(F.lit(0)).cast("int")
    rows = docs.withColumn("__mix_size", size).withColumn("__mix_key", key)
    rows = rows.join(how, F.col(source_col).eqNullSafe(F.col("__mix_source"))).withColumn("__mix_extra", extra)
    full = F.col("__mix_whole") + F.when((F.col("__mix_extra") > 0) & (F.col("__mix_extra") == F.col("__mix_size")), 1).otherwise(0)
    copies = F.expr("concat(array_repeat(-1, cast(__mix_full as int)), if(__mix_extra > 0 and __mix_extra < __mix_size, array(__mix_extra), cast(array() as array<int>)))")
    rows = rows.withColumn("__mix_full", full).withColumn("__mix_copy", F.explode(copies))
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(pieces, 1, F.col("__mix_copy")), "")
    text = F.when(F.col("__mix_copy") < 0, F.col(text_col)).otherwise(head)
    return rows.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns))
