"""Joins with a contract, and joins against reference curves and nearest rows."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.keyed import HOT_KEYS, HOT_ROWS
from seriesloom.functions.scalars import is_finite
from seriesloom.functions.staging import staged


def require_unique(df: DataFrame, keys: list[str], what: str) -> None:
    """Fails if `keys` repeat in `df`."""
    twice = df.groupBy(keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: {keys} repeat, for example {twice[0].asDict()}")


def validated_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", validate: str = "one_to_one", complete: bool = False) -> DataFrame:
    """An equi-join whose sides are unique as `validate` says; `complete` asks that every left row finds a partner."""
    if validate.startswith("one"):
        require_unique(left, keys, "left")
    if validate.endswith("one"):
        require_unique(right, keys, "right")
    if complete and left.join(right, keys, "left_anti").limit(1).count():
        raise ValueError(f"rows without a partner on {keys}")
    return left.join(right, keys, how)


def positional_join(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> DataFrame:
    """Rows of both sides at the same place in their group."""
    number = lambda df, o: df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(o)) - 1)
    return number(left, left_order).join(number(right, right_order), [key, "position"])


def coverage(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): keys that are `missing` from `seen` or `extra` in it."""
    a, b = expected.select(keys).distinct(), seen.select(keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("status", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("status", F.lit("extra")))


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    return coverage(a, b, keys).limit(1).count() == 0


def collapse_curve(curve: DataFrame, key: list[str], x: str, y: str) -> DataFrame:
    """A reference curve with one point for each x: the median of its y."""
    return curve.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*key, x).agg(F.median(y).alias(y))


#: Rows that a task sorts, about: with more rows there are more tasks, not larger ones.
SORTED = 100_000


def _dealt(a: DataFrame, b: DataFrame, left: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    """Queries and points together with `__query`, and the key to sort them by.

    Queries of a key that has many, by the measure of `keyed`, are dealt to many sorts, each with a copy of the key's points; so many
    that a copy has no more points than the sort has queries.
    """
    a, b = a.withColumn("__query", F.lit(True)), b.withColumn("__query", F.lit(False))
    asked = left.groupBy(*key).agg(F.count("*").alias("n"))
    total, most = asked.agg(F.sum("n"), F.max("n")).first()
    limit = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) / SORTED))
    spread = lambda rows, by: rows.repartition(tasks, *by) if (total or 0) > SORTED else rows
    if (most or 0) <= limit:
        return spread(a.unionByName(b).withColumn("__salt", F.lit(0)), key), key
    held = b.groupBy(*key).agg(F.count("*").alias("points"))
    same = lambda x, y: reduce(lambda p, q: p & q, (x[c].eqNullSafe(y[f"__k_{c}"]) for c in key))
    hot = asked.where(F.col("n") > limit).withColumnsRenamed({c: f"__k_{c}" for c in key})  # at most HOT_KEYS rows
    hot = hot.join(held, same(held, hot), "left")
    hot = hot.select(*(f"__k_{c}" for c in key), F.ceil(F.col("n") / F.greatest(F.lit(HOT_ROWS), F.coalesce("points", F.lit(0)))).cast("int").alias("__salts"))
    hot = F.broadcast(staged(hot, "hot"))
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__salts")), F.lit(0)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    a = a.join(hot, same(a, hot), "left").select(*a.columns, salt.alias("__salt"))
    b = b.join(hot, same(b, hot), "left").select(*b.columns, every.alias("__salt"))
    return spread(a.unionByName(b), [*key, "__salt"]), [*key, "__salt"]


def _merged(left: DataFrame, right: DataFrame, key: list[str], x: str, rx: str, payload: list[str]) -> DataFrame:
    """Left rows with the last curve point at or before x, and the first at or after it, from one sort of both sides."""
    point = F.struct(F.col(rx).alias("x"), *(F.col(c).alias(c) for c in payload))
    a = left.select(*left.columns, F.lit(None).cast(right.select(point.alias("p")).schema["p"].dataType).alias("__point"), F.col(x).alias("__x"))
    b = right.select(*((F.col(c) if c in key else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns), point.alias("__point"), F.col(rx).alias("__x"))
    rows, key = _dealt(a, b, left, key)
    # at equal x points stand before queries on the way up, and so after them on the way down
    up = Window.partitionBy(key).orderBy("__x", "__query")
    down = Window.partitionBy(key).orderBy(F.desc("__x"), "__query")
    rows = rows.withColumn("__before", F.last("__point", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__after", F.last("__point", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("__query").drop("__point", "__x", "__query", "__salt")


def asof_join(left: DataFrame, right: DataFrame, key: list[str], x: str, right_x: str, payload: list[str], direction: str = "backward", tolerance: float | None = None) -> DataFrame:
    """Left rows with `payload` and `matched_x` of the curve point nearest on x: `backward`, `forward` or `nearest` (ties backward).

    Both sides are sorted once together; no row meets all points. Equal points: any one, so make x unique first.
    """
    rows = _merged(left, right, key, x, right_x, payload)
    a, b, q = F.col("__before"), F.col("__after"), F.col(x)
    nearest = F.when(a.isNull(), b).when(b.isNull(), a).when(q - a["x"] <= b["x"] - q, a).otherwise(b)
    best = {"backward": a, "forward": b, "nearest": nearest}[direction]
    if tolerance is not None:
        best = F.when(F.abs(best["x"] - q) <= tolerance, best)
    rows = rows.withColumn("__best", best)
    return rows.select(*left.columns, F.col("__best.x").alias("matched_x"), *(F.col(f"__best.{c}").alias(c) for c in payload))


def interpolate_join(left: DataFrame, curve: DataFrame, key: list[str], x: str, curve_x: str, y: str, out: str, clamp: bool = True) -> DataFrame:
    """Left rows with `y` of a piecewise linear curve at x; beyond its ends the end's value, or null without `clamp`."""
    rows = _merged(left, curve, key, x, curve_x, [y])
    a, b, q = F.col("__before"), F.col("__after"), F.col(x)
    line = a[y] + (b[y] - a[y]) * (q - a["x"]) / (b["x"] - a["x"])
    end = lambda p: p[y] if clamp else F.lit(None).cast("double")
    value = F.when(q.isNull() | (a.isNull() & b.isNull()), F.lit(None).cast("double")).when(a.isNull(), end(b)).when(b.isNull(), end(a)).when(b["x"] == a["x"], a[y]).otherwise(line)
    return rows.select(*left.columns, value.alias(out))


def rounded_lookup(left: DataFrame, right: DataFrame, key: list[str], x: str, right_x: str, payload: list[str], digits: int = 3) -> DataFrame:
    """The row of equal rounded x, else the nearest; `exact` says which."""
    exact = right.withColumn("__rx", F.round(right_x, digits)).groupBy(*key, "__rx").agg(F.min_by(F.struct(*payload), right_x).alias("__exact"))
    rows = asof_join(left, right, key, x, right_x, payload, "nearest").withColumn("__rx", F.round(x, digits))
    rows = rows.join(exact, [*key, "__rx"], "left")
    return rows.select(*left.columns, *(F.coalesce(F.col(f"__exact.{c}"), F.col(c)).alias(c) for c in payload), F.col("__exact").isNotNull().alias("exact"))


def squared_distance(a: list[Column], b: list[Column]) -> Column:
    terms = [(x - y) * (x - y) for x, y in zip(a, b, strict=True)]
    return sum(terms[1:], terms[0])


def _fewest(rows: DataFrame, place: list[str], id_col: str, n: int, salts: int = 64) -> DataFrame:
    """Of rows at one place those of the n smallest ids, in two steps, so that no task sorts all rows of a place."""
    first = lambda keys: F.row_number().over(Window.partitionBy(keys).orderBy(id_col))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(id_col), F.lit(salts)))
    dealt = dealt.withColumn("__n", first([*place, "__salt"])).where(F.col("__n") <= n)
    return dealt.withColumn("__n", first(place)).where(F.col("__n") <= n).drop("__n", "__salt")


#: Rows of cells that a query is compared with one by one; comparisons that are made at once whatever they are of; and pairs of cells that a round may come to if all are parted.
COMPARED, AT_ONCE, PAIRS = 256, 20_000_000, 200_000


def _cell(prefix: str, coords: list[str], bits: int, level: int) -> Column:
    """The number of a row's cell after `level` halvings of the whole, from its places at the finest level."""
    parts = [F.shiftleft(F.shiftright(f"{prefix}{i}", bits - level), bits * i) for i in range(len(coords))]
    return reduce(lambda a, b: a + b, parts)


def _box(prefix: str, coords: list[str], out: str) -> list[Column]:
    return [f(f"{prefix}{c}").alias(f"{out}{n}{i}") for i, c in enumerate(coords) for n, f in (("low", F.min), ("high", F.max))]


def nearest_rows(queries: DataFrame, rows: DataFrame, coords: list[str], id_col: str, group: str, k: int, cell: float | None = None, same_group: bool = False, payload: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, neighbour, distance, rank, payload...): for each query the k nearest rows of other groups, ties by id.

    Exact, and never all pairs. Space is halved along all coordinates, again and again. The queries of a group in one cell
    keep a list of cells of rows: those whose rows can be among the k nearest of any of the queries, as told by the least and
    largest distance between the boxes around both and by how many rows of other groups (with `same_group` of the own one) each cell holds.
    Once the cells of a list hold few rows, own-group rows included, they are compared one by one, or once all lists that are left
    come to few comparisons; else both sides are parted further. So rows of the own group are left behind by the cell, and where groups lie far apart only the near
    side of a group is looked at. Of rows at one place in one group only the first k + 1 by id can be among the nearest.
    Rows and queries of a null group, or with a coordinate that isn't finite, take no part. `cell` is the width of the first cells.
    """
    good = reduce(lambda a, b: a & b, (is_finite(F.col(c)) for c in coords), F.col(group).isNotNull())
    q = queries.where(good).select(F.col(id_col), F.col(group).alias("__group"), *(F.col(c).cast("double").alias(f"__q_{c}") for c in coords))
    r = rows.where(good).select(F.col(id_col).alias("neighbour"), F.col(group).alias("__other"), *(F.col(c).cast("double").alias(f"__r_{c}") for c in coords), *payload)
    r = _fewest(r, ["__other", *(f"__r_{c}" for c in coords)], "neighbour", k + 1)
    bits = min(24, 60 // len(coords))
    ends = r.agg(*_box("__r_", coords, "r_")).crossJoin(q.agg(*_box("__q_", coords, "q_"))).first()  # one row each
    ends = {n: v for n, v in ends.asDict().items() if v is not None}
    low = [min((ends[f"{s}_low{i}"] for s in "rq" if f"{s}_low{i}" in ends), default=0.0) for i in range(len(coords))]
    extent = max((ends[f"{s}_high{i}"] - low[i] for s in "rq" for i in range(len(coords)) if f"{s}_high{i}" in ends), default=0.0) or 1.0
    place = lambda p, i, c: F.least(F.floor((F.col(f"{p}{c}") - F.lit(low[i])) / F.lit(extent) * F.lit(float(1 << bits))), F.lit((1 << bits) - 1)).cast("long")
    r = staged(r.select("*", *(place("__r_", i, c).alias(f"__t{i}") for i, c in enumerate(coords))), "rows")
    q = staged(q.select("*", *(place("__q_", i, c).alias(f"__c{i}") for i, c in enumerate(coords))), "queries")
    of_rows, of_queries = (lambda level: _cell("__t", coords, bits, level)), (lambda level: _cell("__c", coords, bits, level))
    pairs = q.select("__group").distinct().select("__group", F.lit(0).cast("long").alias("qc"), F.lit(0).cast("long").alias("tc"))
    gap = lambda i: F.greatest(F.col(f"t_low{i}") - F.col(f"q_high{i}"), F.col(f"q_low{i}") - F.col(f"t_high{i}"), F.lit(0.0))
    reach = lambda i: F.greatest(F.col(f"t_high{i}") - F.col(f"q_low{i}"), F.col(f"q_high{i}") - F.col(f"t_low{i}"))
    length = lambda f: F.sqrt(reduce(lambda a, b: a + b, (f(i) * f(i) for i in range(len(coords)))))
    own = Window.partitionBy("__group", "qc")
    first = max(1, min(bits, math.ceil(math.log2(max(extent / cell, 1.0))))) if cell else max(1, 6 // len(coords))
    level, step, levels, ready = 0, first, [], []
    while level < bits:
        above, level = level, min(bits, level + step)
        levels.append(level)
        cells = r.groupBy(of_rows(above).alias("tc"), of_rows(level).alias("t")).agg(F.count("*").alias("rows"), *_box("__r_", coords, "t_"))
        mine = r.groupBy(of_rows(level).alias("t"), F.col("__other").alias("__group")).agg(F.count("*").alias("mine"))
        asked = q.groupBy("__group", of_queries(above).alias("qc"), of_queries(level).alias("q")).agg(F.count("*").alias("asks"), *_box("__q_", coords, "q_"))
        finer = pairs.join(asked, ["__group", "qc"]).join(cells, "tc").drop("qc", "tc").withColumnsRenamed({"q": "qc", "t": "tc"})
        finer = finer.join(mine.withColumnRenamed("t", "tc"), ["tc", "__group"], "left").withColumn("mine", F.coalesce("mine", F.lit(0)))
        finer = finer.withColumn("able", F.col("mine") if same_group else F.col("rows") - F.col("mine")).where("able > 0")
        finer = finer.select("__group", "qc", "tc", "asks", "rows", "able", length(gap).alias("near"), length(reach).alias("far"))
        upto = F.sum("able").over(own.orderBy("far").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        enough = F.min(F.when(F.col("upto") > k, F.col("far"))).over(own)  # one more than k: a query may be among the rows itself
        finer = finer.withColumn("upto", upto).withColumn("enough", F.coalesce(enough, F.lit(float("inf"))))
        finer = finer.where(F.col("near") <= F.col("enough") * (1 + 1e-9))
        finer = finer.withColumn("few", (F.sum("rows").over(own) <= COMPARED + 4 * k) | F.lit(level == bits))
        finer = staged(finer.select("__group", "qc", "tc", "asks", "rows", "few"), "pairs")
        left, work = finer.where(~F.col("few")).agg(F.count("*"), F.sum(F.col("asks") * F.col("rows"))).first()
        over = (work or 0) > AT_ONCE
        ready.append((finer.where("few") if over else finer).select(F.lit(level).alias("level"), "__group", "qc", "tc"))
        pairs = finer.where(~F.col("few")).select("__group", "qc", "tc")
        if not over:
            break
        step = max(1, int(math.log2(max(1, PAIRS // left)) / (2 * len(coords))))  # few pairs: several halvings in a round
    ready = reduce(lambda a, b: a.unionAll(b), ready)
    at = lambda of: F.explode(F.array(*(F.struct(F.lit(x).alias("level"), of(x).alias("c")) for x in levels)))
    held = r.withColumn("__at", at(of_rows)).select("*", F.col("__at.level").alias("level"), F.col("__at.c").alias("tc")).drop("__at", *(f"__t{i}" for i in range(len(coords))))
    held = held.join(ready.select("level", "tc").distinct(), ["level", "tc"], "left_semi")
    asks = q.withColumn("__at", at(of_queries)).select("*", F.col("__at.level").alias("level"), F.col("__at.c").alias("qc")).drop("__at", *(f"__c{i}" for i in range(len(coords))))
    other = F.col("__group") == F.col("__other") if same_group else F.col("__group") != F.col("__other")
    d2 = squared_distance([F.col(f"__q_{c}") for c in coords], [F.col(f"__r_{c}") for c in coords])
    near = asks.join(ready, ["level", "__group", "qc"]).join(held, ["level", "tc"]).where(other & (F.col(id_col) != F.col("neighbour"))).withColumn("distance", F.sqrt(d2))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy("distance", "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(id_col, "neighbour", "distance", "rank", *payload)


def knn_summary(neighbours: DataFrame, id_col: str, value: str) -> DataFrame:
    """Mean and deviation of the neighbours' values, and their mean distance."""
    return neighbours.groupBy(id_col).agg(F.avg(value).alias("knn_mean"), F.stddev_pop(value).alias("knn_std"), F.avg("distance").alias("knn_distance"))


def standardised(df: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    """`df` with each column's distance from its mean in standard deviations of all rows; 0 where a column doesn't vary."""
    sums = df.agg(*(f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop))))  # one row
    rows = df.crossJoin(F.broadcast(sums))
    z = {f"{c}{suffix}": F.when(F.col(f"__sd_{c}") > 0, (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__sd_{c}")).when(F.col(c).isNotNull(), 0.0) for c in columns}
    return rows.withColumns(z).drop(*sums.columns)


def surface_moves(df: DataFrame, key: str, order: str, x: str, y: str, slope_x: str, slope_y: str, out: str = "move") -> DataFrame:
    """`df` with `out`: how much a surface with these slopes rises from the row before to each row; 0 at a group's first row.

    It is the part of a path's move that the surface explains, and the `shift` of a decoder's transition.
    A null slope or coordinate moves nothing.
    """
    w = Window.partitionBy(key).orderBy(order)
    d = lambda c: F.col(c) - F.lag(c).over(w)
    return df.withColumn(out, F.coalesce(F.col(slope_x) * d(x) + F.col(slope_y) * d(y), F.lit(0.0)))


def local_plane(neighbours: DataFrame, queries: DataFrame, id_col: str, x: str, y: str, value: str, bandwidth: float, ridge: float = 1e-6) -> DataFrame:
    """(id_col, plane, slope_x, slope_y): a kernel-weighted linear fit around each query, at the query itself, from sums of moments.

    `neighbours` has (id_col, distance, x, y, value). Solves the ridged 3 x 3 normal equations in closed form.
    """
    n = neighbours.join(queries.select(id_col, F.col(x).alias("__x0"), F.col(y).alias("__y0")), id_col)
    w = F.exp(-0.5 * F.pow(F.col("distance") / bandwidth, 2))
    dx, dy, v = (F.col(x) - F.col("__x0")) / bandwidth, (F.col(y) - F.col("__y0")) / bandwidth, F.col(value)
    m = n.groupBy(id_col).agg(*(F.sum(w * e).alias(a) for a, e in {"s": F.lit(1.0), "sx": dx, "sy": dy, "sxx": dx * dx, "sxy": dx * dy, "syy": dy * dy, "sv": v, "sxv": dx * v, "syv": dy * v}.items()))
    c = {a: F.col(a) for a in ("s", "sx", "sy", "sxy", "sv", "sxv", "syv")} | {"sxx": F.col("sxx") + ridge, "syy": F.col("syy") + ridge}
    det = c["s"] * (c["sxx"] * c["syy"] - c["sxy"] ** 2) - c["sx"] * (c["sx"] * c["syy"] - c["sxy"] * c["sy"]) + c["sy"] * (c["sx"] * c["sxy"] - c["sxx"] * c["sy"])
    top = c["sv"] * (c["sxx"] * c["syy"] - c["sxy"] ** 2) - c["sx"] * (c["sxv"] * c["syy"] - c["sxy"] * c["syv"]) + c["sy"] * (c["sxv"] * c["sxy"] - c["sxx"] * c["syv"])
    top_x = c["s"] * (c["sxv"] * c["syy"] - c["sxy"] * c["syv"]) - c["sv"] * (c["sx"] * c["syy"] - c["sxy"] * c["sy"]) + c["sy"] * (c["sx"] * c["syv"] - c["sxv"] * c["sy"])
    top_y = c["s"] * (c["sxx"] * c["syv"] - c["sxv"] * c["sxy"]) - c["sx"] * (c["sx"] * c["syv"] - c["sxv"] * c["sy"]) + c["sv"] * (c["sx"] * c["sxy"] - c["sxx"] * c["sy"])
    ok = F.abs(det) > 1e-12
    slopes = {n: F.when(ok, t / det / bandwidth).otherwise(0.0) for n, t in (("slope_x", top_x), ("slope_y", top_y))}
    return m.select(id_col, F.when(ok, top / det).otherwise(c["sv"] / c["s"]).alias("plane"), *(s.alias(n) for n, s in slopes.items()))


#: Pairs of equal windows that one task compares at a time, about 100 bytes each.
PAIRS_TOGETHER = 3_000_000


def kgram_pairs(rows: DataFrame, key: str, order: str, code: str, k: int, together: int | None = None) -> DataFrame:
    """(left_key, right_key, shared): groups that share k successive codes, and how many distinct such windows, over all windows.

    The groups are dealt into blocks, and each two blocks meet in a task of their own, which
    counts what their groups share. Only windows are shuffled, once for each block, never pairs. There are so many blocks
    that two of them have about `together` pairs of equal windows, however many the holders of one window are.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, k - 1)
    grams = rows.where(F.col(key).isNotNull()).withColumn("g", F.collect_list(code).over(w)).where(F.size("g") == k)
    grams = grams.select(key, F.unhex(F.sha2(F.concat_ws(",", F.transform("g", lambda x: x.cast("string"))).cast("binary"), 256)).alias("gram")).distinct()
    grams = staged(grams, "grams")
    common = staged(grams.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram", "n", F.monotonically_increasing_id().alias("id")), "common")
    pairs = common.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0
    blocks = max(1, math.ceil(math.sqrt(2 * pairs / (together or PAIRS_TOGETHER))))
    held = grams.join(common.select("gram", "id"), "gram").groupBy(key).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    every = held.withColumn("own", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = every.select(key, "ids", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kind = rows.schema[key].dataType.simpleString()

    def shared(part: pd.DataFrame) -> pd.DataFrame:
        part, i, j = part.sort_values(key), part["i"].iloc[0], part["j"].iloc[0]
        names, sizes, window = part[key].to_numpy(), part["ids"].map(len), np.concatenate(part["ids"].to_list())
        group, own = np.repeat(np.arange(len(part)), sizes), np.repeat(part["own"].to_numpy(), sizes)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        right = right[np.argsort(window[right], kind="stable")]
        low, high = (np.searchsorted(window[right], window[left], side) for side in ("left", "right"))
        left = np.repeat(left, high - low)
        a, b = group[left], group[right[np.arange(len(left)) + np.repeat(low - np.cumsum(high - low) + high - low, high - low)]]
        pair = (np.minimum(a, b) * len(names) + np.maximum(a, b))[(a < b) if i == j else slice(None)]
        pair, n = np.unique(pair, return_counts=True)
        return pd.DataFrame({"left_key": names[pair // len(names)], "right_key": names[pair % len(names)], "shared": n})

    return met.groupBy("i", "j").applyInPandas(shared, f"left_key {kind}, right_key {kind}, shared long")
