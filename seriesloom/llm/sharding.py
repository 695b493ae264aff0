"""Shards of near-equal bytes by a k-d tree over document metadata.

The tree splits a range of shards in two, at the weighted median (more exactly, the quantile that
the two parts of the range need) along the dimension in which the node's units spread most. A
unit is a group of equal texts, so that copies stay together; a group larger than a shard is cut
into pieces of successive rows. Medians come from sums over bins of the coordinate, refined once, over all
units; no node's rows are ever gathered. Every unit is placed by the tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.staging import drop_staged, staged

#: Bits of a coordinate that each of the two passes resolves, and those of them that break ties.
BITS, TIE = 15, 18
#: A group larger than a shard is cut into pieces of about a shard's bytes over this.
PIECES = 50
#: Units that may cross a node's cut to make up for what a cut between two units leaves over, if that is above this part of a shard.
MOVES, EVEN = 3, 0.001
#: Rows that one task numbers.
SLOT_ROWS = 200_000


def _coordinate(value: Column, tie: Column) -> Column:
    """12 bits of a value in [0, 1), then TIE bits of the unit's hash, so that units of one value still part evenly."""
    high = F.greatest(F.lit(0), F.least(F.lit(4095), F.floor(value * 4096))).cast("long")
    return F.shiftleft(high, TIE) + tie


def level_bytes(total: int, largest: list[int], n: int) -> float:
    """The size that each of n shards would have if single rows above it took a shard each: the mean, less what they exceed it by.

    `largest`: the sizes of the n largest rows, which must hold all rows above the result.
    """
    room, rest = n, float(total)
    for size in sorted(largest, reverse=True):
        if room > 1 and size > rest / room:
            room, rest = room - 1, rest - size
    return rest / room


def _pick(values: list, kind: str) -> Column:
    """The entry of `values` for the row's node."""
    return F.element_at(F.lit(list(values) or [0]).cast(f"array<{kind}>"), F.col("node") + 1)


def _one_of(units: list[int]) -> Column:
    return F.array_contains(F.lit(units).cast("array<bigint>"), F.col("unit")) if units else F.lit(False)


def _borders(seen: DataFrame, dims: list[str], parts: list[float]) -> dict[int, dict]:
    """For each node its weight, its widest dimension, and the two unit borders around the wanted part of its weight.

    A border is (coordinate from which units lie right of it, weight left of it). What reaches the
    driver is a row for each node and dimension.
    """
    spots = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(d).alias("at")) for i, d in enumerate(dims))))
    long = seen.select("node", "weight", spots.alias("s")).select("node", "weight", "s.dim", "s.at")
    bins = long.groupBy("node", "dim", F.shiftright("at", BITS).alias("bin")).agg(F.sum("weight").alias("weight"), F.min("at").alias("low"), F.max("at").alias("high"))
    whole = Window.partitionBy("node", "dim")
    summed = bins.withColumn("upto", F.sum("weight").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summed = summed.select("*", F.sum("weight").over(whole).alias("total"), (F.max("high").over(whole) - F.min("low").over(whole)).alias("spread"))
    first = summed.where(F.col("upto") >= F.col("total") * _pick(parts, "double") * (1 - 1e-12))
    found = first.groupBy("node", "dim").agg(F.min(F.struct("bin", "upto", "weight", "total", "spread")).alias("b")).select("node", "dim", "b.*").collect()
    nodes: dict[int, dict] = {}
    for r in sorted(found, key=lambda r: (r["node"], -r["spread"], r["dim"])):
        nodes.setdefault(r["node"], {"dim": r["dim"], "total": r["total"], "bin": r["bin"], "below": r["upto"] - r["weight"], "borders": []})
    of = lambda key, default: [nodes.get(i, {}).get(key, default) for i in range(len(parts))]
    at = F.element_at(F.array(*dims), _pick(of("dim", 0), "int") + 1)
    fine = seen.select("node", "weight", at.alias("at")).where(F.shiftright("at", BITS) == _pick(of("bin", -1), "long"))
    fine = fine.groupBy("node", "at").agg(F.sum("weight").alias("weight"))
    upto = F.sum("weight").over(Window.partitionBy("node").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) + _pick(of("below", 0.0), "double")
    want = _pick([p * w for p, w in zip(parts, of("total", 0.0), strict=True)], "double") * (1 - 1e-12)
    near = fine.withColumn("upto", upto).where(F.col("upto") >= want).groupBy("node").agg(F.min(F.struct("at", "upto", "weight")).alias("b")).select("node", "b.*")
    for r in near.collect():
        nodes[r["node"]]["borders"] = [(r["at"], r["upto"] - r["weight"]), (r["at"] + 1, r["upto"])]
    return nodes


def _tree(units: DataFrame, dims: list[str], n: int) -> DataFrame:
    """`units` (unit, *dims, weight, ...) with `shard`, the leaf of each."""
    level, seen = [(0, n)], units.select("*", F.lit(0).alias("node"), F.lit(0 if n == 1 else None).cast("int").alias("shard"))
    while any(b - a > 1 for a, b in level):
        active = seen.where("shard is null")
        nodes = _borders(active, dims, [((b - a) // 2) / (b - a) for a, b in level])
        cuts, dim, lack, following = [0] * len(level), [0] * len(level), [0.0] * len(level), []
        for i, (a, b) in enumerate(level):
            m = (b - a) // 2
            if node := nodes.get(i):
                each = node["total"] / (b - a)
                tried = [(max(1, min(b - a - 1, round(left / each))), at, left) for at, left in node["borders"]]
                m, cuts[i], left = min(tried, key=lambda x: (max(x[2] / x[0], (node["total"] - x[2]) / (b - a - x[0])), x))
                dim[i], lack[i] = node["dim"], m * each - left
            following += [(a, a + m), (a + m, b)]
        right = F.element_at(F.array(*dims), _pick([d + 1 for d in dim], "int")) >= _pick(cuts, "long")
        moved: list[int] = []
        for _ in range(MOVES):
            gaps = [abs(x) if i in nodes and abs(x) > EVEN * nodes[i]["total"] / (level[i][1] - level[i][0]) else 0.0 for i, x in enumerate(lack)]
            if not any(gaps):
                break
            gap = _pick(gaps, "double")
            heavier = F.when(_pick(lack, "double") > 0, right).otherwise(~right)
            fits = active.where(heavier & ~_one_of(moved) & (F.col("weight") < 2 * gap)).select("node", F.struct(F.abs(F.col("weight") - gap).alias("off"), "unit", "weight").alias("u"))
            found = fits.groupBy("node").agg(F.min("u").alias("u")).select("node", "u.*").collect()  # a row for each node
            if not found:
                break
            for r in found:
                moved.append(r["unit"])
                lack[r["node"]] += -r["weight"] if lack[r["node"]] > 0 else r["weight"]
        side = right != _one_of(moved)
        child = F.when(F.col("shard").isNull(), 2 * F.col("node") + side.cast("int")).alias("node")
        grown = seen.select(*units.columns, "shard", child)
        leaf = F.coalesce("shard", _pick([a if b - a == 1 else None for a, b in following], "int")).alias("shard")
        inner = [i for i, (a, b) in enumerate(following) if b - a > 1]
        place = {i: k for k, i in enumerate(inner)}
        grown = grown.select(*units.columns, leaf, _pick([place.get(i) for i in range(len(following))], "int").alias("node"))
        before, seen = seen, staged(grown, "level")
        if len(level) > 1:
            drop_staged(before)
        level = [following[i] for i in inner]
    return seen.drop("node")


def shards(docs: DataFrame, n: int = 40, id_col="doc_id", text_col="text", meta: tuple[str, ...] = ("lang", "source"), overhead: int = 16) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs`.

    Size is the text's UTF-8 bytes plus `overhead`; the bytes of shards are near equal (law
    `bytes`). A cut lies between two units, and at most MOVES units cross it to even out the rest,
    so a shard is off the mean by no more than about its largest unit; a row larger than
    what is left for a shard counts as a full shard. A null text has no bytes, CRC 0, and is
    equal to other null texts only. Dimensions: the logarithm of the size, and each column of
    `meta`, of which a unit takes the least value; null counts as a value. Slots count each shard's rows from
    0 without gaps. `grown_shard` is null under this law. Rows that repeat an id have a slot each.
    No rows: no result rows.
    """
    meta = tuple(m for m in meta if m in docs.columns)
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.when(text.isNull(), F.lit(-1)).otherwise(F.xxhash64(text)).alias("same"),
        *(F.col(m).cast("string").alias(f"meta{i}") for i, m in enumerate(meta)),
    )
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()), "rows")
    group = ["same", "crc", "size"]
    groups = rows.groupBy(*group).agg(F.count("*").alias("copies"))
    largest = groups.orderBy(F.desc(F.col("copies") * F.col("size")), *group).limit(n).collect()  # as many rows as shards
    total = rows.agg(F.sum("size")).first()[0] or 0
    target = max(1.0, level_bytes(total, [r["size"] for r in largest if r["copies"] == 1], n))
    hot = [(r["same"], r["crc"], r["size"], r["copies"], -int(-r["copies"] * r["size"] * PIECES // target)) for r in largest if r["copies"] > 1 and r["copies"] * r["size"] > target]
    pieced = _pieced(rows, group, hot)
    key = [*group, "piece"]
    sums = pieced.groupBy(*key).agg(F.sum("size").alias("bytes"), *(F.min(f"meta{i}").alias(f"meta{i}") for i in range(len(meta))))
    tie = F.shiftrightunsigned(F.xxhash64(*key), 64 - TIE)
    spot = [F.log2(F.col("size") + 1) / 40, *(F.coalesce(F.crc32(F.col(f"meta{i}").cast("binary")) / F.lit(float(1 << 32)), F.lit(0.0)) for i in range(len(meta)))]
    dims = [f"d{i}" for i in range(len(spot))]
    units = sums.select(*key, F.xxhash64(*key, F.lit(7)).alias("unit"), *(_coordinate(v, tie).alias(d) for v, d in zip(spot, dims, strict=True)), F.least(F.col("bytes").cast("double"), F.lit(float(target))).alias("weight"))
    leaves = _tree(staged(units, "units"), dims, n).select(*key, "shard")
    out = pieced.select("id", "at", *key).join(leaves, key).select("id", "size", "crc", "shard", "at")
    return _slots(out, n).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _pieced(rows: DataFrame, group: list[str], hot: list[tuple]) -> DataFrame:
    """`rows` with `piece`: for rows of a group in `hot` (its key, rows and pieces) which of its pieces of near equal rows, else 0.

    A row's place in its group counts the rows of it that earlier tasks wrote, and those before it of its own task.
    """
    if not hot:
        return rows.withColumn("piece", F.lit(0))
    cut = F.broadcast(rows.sparkSession.createDataFrame(hot, "same long, crc long, size long, copies long, pieces long"))  # at most as many rows as shards
    all_rows = rows.join(cut, group, "left")
    own = all_rows.where("pieces is not null").withColumn("task", F.shiftright("at", 33))
    counts = own.groupBy(*group, "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*group, "task").orderBy("at")) - 1
    placed = own.join(counts.select(*group, "task", before.alias("before")), [*group, "task"])
    placed = placed.withColumn("piece", F.floor(place * F.col("pieces") / F.col("copies")).cast("int")).select(*rows.columns, "piece")
    return all_rows.where("pieces is null").select(*rows.columns, F.lit(0).alias("piece")).unionAll(placed)


def _slots(rows: DataFrame, n: int) -> DataFrame:
    """`rows` (id, shard, at, ...) with a gapless number in each shard; a task numbers a part of a shard, chosen by `at`, which tells rows apart."""
    rows = staged(rows, "placed")
    parts = 1 + rows.count() // (n * SLOT_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "size", "crc", "at"))
    return rows.withColumn("own", own).join(counts, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("own") - 1)


def op7_kd_tree_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
