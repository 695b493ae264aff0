"""Folds, shards and samples that depend on keys alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import stable_bucket
from seriesloom.functions.staging import staged
from seriesloom.operators.selection import numbered


def _sha(key: str, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}::"), F.col(key).cast("string")).cast("binary"), 256)


def sha_folds(groups: DataFrame, key: str, k: int, salt: str) -> DataFrame:
    """(key, fold): groups by the SHA-256 of their key, dealt round; sizes differ by one at most.

    `groups` has a row for each group. Ranks come from counts of hash prefixes and a sort within each, so no task ranks all.
    """
    rows = groups.select(key).distinct().withColumn("__h", _sha(key, salt)).withColumn("__p", F.substring("__h", 1, 2))
    counts = rows.groupBy("__p").agg(F.count("*").alias("n"))  # 256 rows at most
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__p").orderBy("__h")) - 1
    return rows.withColumn("__i", place).join(before, "__p").select(key, F.pmod(F.col("before") + F.col("__i"), F.lit(k)).cast("int").alias("fold"))


def hash_fold(key: str, k: int, salt: str = "fold") -> Column:
    return stable_bucket(F.concat(F.lit(f"{salt}::"), F.col(key).cast("string")), k)


def group_kfold(sizes: DataFrame, key: str, rows: str, k: int) -> DataFrame:
    """(key, fold): the largest groups first, each to the fold with the fewest rows, then the lowest fold.

    Groups of one size are alike, so the greedy step deals whole classes of equal size; only the distinct
    sizes with their numbers of groups come to the driver, few beside the groups. Which fold a group of a class
    goes to follows from its place in the class by key hash: the first so many to fold 0, the next to fold 1.
    """
    groups = sizes.select(key, F.col(rows).cast("long").alias("__rows"))
    loads, plan = [0] * k, []
    for size, n in groups.groupBy("__rows").count().orderBy(F.desc("__rows")).toLocalIterator():
        low = 0
        for fold, part in enumerate(_dealt(loads, size or 0, n)):
            loads[fold] += part * (size or 0)
            plan.append((size, low, low + part, fold))
            low += part
    plan = sizes.sparkSession.createDataFrame(plan, "__size long, __low long, __high long, fold int").where("__low < __high")
    rows_ = groups.withColumn("__h", _sha(key, "kfold")).withColumn("__p", F.substring("__h", 1, 2))
    counts = rows_.groupBy("__rows", "__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("__rows").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("__rows").alias("__r"), F.col("__p").alias("__q"), "__before")
    place = F.row_number().over(Window.partitionBy("__rows", "__p").orderBy("__h", key)) - 1
    placed = rows_.withColumn("__i", place).join(before, F.col("__rows").eqNullSafe(F.col("__r")) & F.col("__p").eqNullSafe(F.col("__q"))).withColumn("__at", F.col("__before") + F.col("__i"))
    return placed.join(plan, F.col("__rows").eqNullSafe(F.col("__size")) & (F.col("__at") >= F.col("__low")) & (F.col("__at") < F.col("__high"))).select(key, "fold")


def _dealt(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each fold gets, each going to the fold with the least load, then the lowest."""
    if size <= 0:
        return [n if i == min(range(len(loads)), key=lambda f: (loads[f], f)) else 0 for i in range(len(loads))]
    # the last group goes where the load is at most `top`: the i-th group of a fold is placed at load + i * size
    held = lambda top: [max(0, (top - x) // size + 1) for x in loads]
    low, high = min(loads) - 1, max(loads) + size * n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if sum(held(mid)) >= n else (mid, high)
    out, full = held(low), held(high)
    for i in range(len(loads)):
        if sum(out) < n and full[i] > out[i]:
            out[i] += 1
    return out


lpt_shards = group_kfold

#: Groups with a hash prefix in common that are sorted together.
CUT_ROWS = 10_000


def stable_sample(groups: DataFrame, key: str, fraction: float, salt: str) -> DataFrame:
    """The round(n * fraction) groups whose hash comes first, halves to even; equal hashes by key.

    The last hash of the sample is found by counts of hash prefixes, three more digits at a time, so all that is ever
    sorted are the CUT_ROWS groups or fewer that share a prefix with it; the sample is then a filter.
    """
    rows = staged(groups.select(key).distinct().select(key, F.coalesce(_sha(key, salt), F.lit("")).alias("__h")), "hashed")
    n = rows.agg(F.bround(F.count("*") * F.lit(float(fraction))).cast("long")).first()[0]
    if not n:
        return rows.select(key).limit(0)
    prefix, left = "", n
    while True:
        inside = rows.where(F.col("__h").startswith(prefix))
        counts = inside.groupBy(F.substring("__h", 1, len(prefix) + 3).alias("p")).agg(F.count("*").alias("c")).collect()  # 4096 rows at most
        for r in sorted(counts):
            if r["c"] >= left:
                prefix, within = r["p"], r["c"]
                break
            left -= r["c"]
        else:  # every group is in the sample
            return rows.select(key)
        if within <= CUT_ROWS or len(prefix) >= 60:
            break
    last = rows.where(F.col("__h").startswith(prefix)).orderBy("__h", key).limit(left).agg(F.max(F.struct("__h", key)).alias("m")).select("m.*").first()
    before = (F.col("__h") < last["__h"]) | ((F.col("__h") == last["__h"]) & F.coalesce(F.col(key) <= F.lit(last[key]), F.lit(True)))
    return rows.where(before).select(key)


def capped_rows(df: DataFrame, key: str, row_key: str, cap: int, salt: str = "cap") -> DataFrame:
    """At most `cap` rows of each group, those whose hash comes first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(_sha(row_key, salt), row_key))
    return df.withColumn("__r", rank).where(F.col("__r") <= cap).drop("__r")


def stratified_holdout(groups: DataFrame, key: str, features: list[str], bins: int, fraction: float, salt: str) -> DataFrame:
    """(key, stratum, held): in each stratum of quantile bins of the features, the part of the groups whose hash comes first."""
    edges = groups.agg(*(F.percentile(f, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias(f"__e_{f}") for f in features))
    rows = groups.crossJoin(F.broadcast(edges))  # one row
    stratum = F.concat_ws("-", *(_bin(f) for f in features))
    rows = rows.withColumn("stratum", stratum)
    w = Window.partitionBy("stratum")
    rank = F.row_number().over(w.orderBy(_sha(key, salt), key))
    return rows.select(key, "stratum", (rank <= F.bround(F.count("*").over(w) * F.lit(float(fraction)))).alias("held"))


def _bin(feature: str) -> Column:
    return F.size(F.filter(f"__e_{feature}", lambda e: F.col(feature) > e)).cast("string")


def pseudo_mask(df: DataFrame, key: str, order: str, known: str, keep: float, out: str) -> DataFrame:
    """`df` with the known prefix cut to a part of itself: an artificial tail whose truth is known."""
    n = F.count(known).over(Window.partitionBy(key))
    place = F.count(known).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(out, F.when(place <= F.floor(n * keep), F.col(known)))


def sampled_positions(df: DataFrame, key: str, order: str, stride: int, always: Column) -> DataFrame:
    """Every stride-th row of a group, its last, and those where `always` holds."""
    last = F.max(order).over(Window.partitionBy(key))
    return df.withColumn("__last", last).where((F.pmod(F.col(order), F.lit(stride)) == 0) | always | (F.col(order) == F.col("__last"))).drop("__last")


def shuffled_within(df: DataFrame, key: str, order: str, column: str, out: str, salt: str = "control") -> DataFrame:
    """A column's values dealt anew within each group by hash: the same values, other rows."""
    a = df.withColumn("__p", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    donor_rank = F.row_number().over(Window.partitionBy(key).orderBy(_sha(order, salt), order))
    b = df.select(F.col(key).alias("__k"), donor_rank.alias("__q"), F.col(column).alias(out))
    return a.join(b, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q"))).drop("__p", "__k", "__q")


def shuffled_labels(groups: DataFrame, key: str, label: str, out: str, salt: str = "labels") -> DataFrame:
    """(key, label, out): each group's label, and that of another: the same labels with their numbers, dealt anew over all groups by hash.

    `groups` has one row a key. Places are counted by ranges, so no task sorts all groups; null labels are dealt like others.
    """
    here = numbered(groups.select(key, label), [key], "__at")
    there = numbered(groups.select(F.col(label).alias(out), _sha(key, salt).alias("__h"), F.col(key).alias("__k")), ["__h", "__k"], "__at")
    return here.join(there.select("__at", out), "__at").select(key, label, out)


def nested_plan(folds: DataFrame, key: str, fold: str, k: int) -> DataFrame:
    """(outer, inner, key, role): for every two different folds, which groups train, validate and test."""
    pairs = F.explode(F.array(*(F.struct(F.lit(o).alias("outer"), F.lit(i).alias("inner")) for o in range(k) for i in range(k) if i != o)))
    rows = folds.select(key, fold, pairs.alias("p"))
    role = F.when(F.col(fold) == F.col("p.outer"), "test").when(F.col(fold) == F.col("p.inner"), "validate").otherwise("train")
    return rows.select("p.outer", "p.inner", key, role.alias("role"))
