"""Fixed alternatives of a path, and scoring candidate paths by what was observed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import correlation
from seriesloom.operators import series

#: Jumps of a reset in feet, and for how many rows each is held.
JUMPS, HOLDS = (-6.3, 6.3, -12.6, 12.6), (128, 256, 512)


def _kept(path: Column, low: float | None, high: float | None) -> Column:
    path = path if low is None else F.greatest(F.lit(float(low)), path)
    return path if high is None else F.least(F.lit(float(high)), path)


def signed_paths(df: DataFrame, key: str, order: str, axis: str, depth: str, last_axis: str, last_depth: str, last: str, rate: str, signs: tuple[int, ...] = (-1, 0, 1), momentum: float = 0.998, drift: float = 0.005 / 512, low: float | None = None, high: float | None = None) -> DataFrame:
    """`df` once for each sign, with `sign` and `path`: a rate that keeps `momentum` of itself each row and drifts by sign * drift.

    The path starts at `last`, adds rate * step of `axis` and loses what `depth` gains; it is kept
    between `low` and `high`. The rate of row t has a closed form, so a path is one running sum.
    """
    over = Window.partitionBy(key).orderBy(order)
    t = F.row_number().over(over)
    rows = df.withColumns({"__kept": F.pow(F.lit(momentum), t), "__step": F.col(axis) - F.coalesce(F.lag(axis).over(over), F.col(last_axis))})
    run = lambda c: F.sum(c).over(series.over(key, order))
    gained = F.lit(float(drift)) * (1 - F.col("__kept")) / (1 - momentum) if momentum != 1 else F.lit(float(drift)) * t
    rows = rows.withColumns({"__base": run(F.col(rate) * F.col("__kept") * F.col("__step")), "__bend": run(gained * F.col("__step"))})
    rows = rows.withColumn("sign", F.explode(F.array(*(F.lit(s) for s in signs))))
    path = F.col(last) + F.col("__base") + F.col("sign") * F.col("__bend") - (F.col(depth) - F.col(last_depth))
    return rows.withColumn("path", _kept(path, low, high)).drop("__kept", "__step", "__base", "__bend")


def branch_specs(jumps: tuple[float, ...] = JUMPS, holds: tuple[int, ...] = HOLDS) -> list[tuple[str, float, int]]:
    """(branch, jump, rows): the base first, then each jump with each hold."""
    name = lambda j, h: f"jump_{'m' if j < 0 else 'p'}{str(abs(j)).replace('.', 'p')}_h{h}"
    return [("base", 0.0, 0), *((name(j, h), j, h) for j in jumps for h in holds)]


def reset_branches(df: DataFrame, key: str, order: str, base: str, specs: list[tuple[str, float, int]] | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """`df` once for each branch, with `branch` and `path`: the base, moved by the jump in the first rows of its hold."""
    specs = branch_specs() if specs is None else specs
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("branch"), F.lit(float(j)).alias("jump"), F.lit(h).alias("hold")) for b, j, h in specs)))
    rows = df.withColumn("__at", at).withColumn("__b", each)
    path = F.when(F.col("__at") <= F.col("__b.hold"), _kept(F.col(base) + F.col("__b.jump"), low, high)).otherwise(F.col(base))
    return rows.withColumns({"branch": F.col("__b.branch"), "path": path}).drop("__at", "__b")


def shift_branches(df: DataFrame, key: str, order: str, safe: str, shifts: tuple[float, ...], ahead: int = 512) -> DataFrame:
    """The next `ahead` rows of each series once for each shift, with `future_offset` from 1, `shift` and `path`; the safe path itself is shift 0."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(order))
    rows = df.withColumn("future_offset", at).where(F.col("future_offset") <= ahead)
    rows = rows.withColumn("shift", F.explode(F.array(*(F.lit(float(s)) for s in dict.fromkeys((0.0, *shifts))))))
    return rows.withColumn("path", F.col(safe) + F.col("shift"))


def robust_z(df: DataFrame, scope: list[str], columns: list[str]) -> DataFrame:
    """`df` with `z_<column>`: the distance from the scope's median by 1.4826 * MAD; 0 where that is 0."""
    over = Window.partitionBy(scope)
    rows = df.withColumns({f"__d_{c}": F.col(c) - F.median(c).over(over) for c in columns})
    mads = {c: F.median(F.abs(F.col(f"__d_{c}"))).over(over) * 1.4826 for c in columns}
    rows = rows.withColumns({f"z_{c}": F.when(mads[c] > 0, F.col(f"__d_{c}") / mads[c]).otherwise(F.when(F.col(f"__d_{c}").isNotNull(), 0.0)) for c in columns})
    return rows.drop(*(f"__d_{c}" for c in columns))


def horizon_scores(df: DataFrame, scope: list[str], order: str, observed: str, expected: dict[str, str], rows: int, sigma: float, least: int = 16) -> DataFrame:
    """(scope, candidate, position, pairs, fit, agreement, eligible, composite): how well each candidate's expected values meet the next `rows` observations.

    Only rows where the observation and all expectations are known count. fit: the mean Gaussian
    log-likelihood, agreement: the correlation; composite: the mean of their robust z among the
    scope's candidates. Not eligible: fewer than `least` pairs, or no variation.
    """
    at = F.row_number().over(Window.partitionBy(scope).orderBy(order))
    near = df.withColumn("__at", at).where(F.col("__at") <= rows)
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in (observed, *expected.values())))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("candidate"), F.lit(i).alias("position"), F.col(c).cast("double").alias("e")) for i, (n, c) in enumerate(expected.items()))))
    long = near.where(known).select(*scope, F.col(observed).cast("double").alias("__o"), each.alias("c")).select(*scope, "__o", "c.*")
    miss = (F.col("__o") - F.col("e")) / F.lit(float(sigma))
    got = long.groupBy(*scope, "candidate", "position").agg(F.count("*").alias("pairs"), F.avg(-0.5 * F.least(miss * miss, F.lit(600.0))).alias("fit"), correlation("__o", "e").alias("agreement"))
    got = robust_z(got, scope, ["fit", "agreement"])
    eligible = (F.col("pairs") >= least) & F.col("agreement").isNotNull()
    return got.withColumns({"eligible": eligible, "composite": (F.col("z_fit") + F.coalesce("z_agreement", F.lit(0.0))) / 2}).drop("z_fit", "z_agreement")


def target_free_choice(scores: DataFrame, scope: list[str], safe: str, score: str = "composite") -> DataFrame:
    """(scope, selected, selected_score): the eligible candidate of the highest score; at ties the safe one, then the first. The safe one where none is eligible."""
    rank = F.struct(F.col(score).alias("s"), (F.col("candidate") == safe).alias("safe"), F.negate("position").alias("p"), F.col("candidate").alias("c"))
    got = scores.groupBy(scope).agg(F.max(F.when(F.col("eligible"), rank)).alias("b"))
    return got.select(*scope, F.coalesce("b.c", F.lit(safe)).alias("selected"), F.col("b.s").alias("selected_score"))


def best_labels(errors: DataFrame, scope: list[str], candidate: str, loss: str, tolerance: float = 1e-9) -> DataFrame:
    """`errors` with `best`: whether the loss is the scope's least, up to `tolerance`; all that tie are best."""
    return errors.withColumn("best", F.col(loss) <= F.min(loss).over(Window.partitionBy(scope)) + tolerance)


def shifted_similarity(curves: DataFrame, pairs: DataFrame, key: str, at: str, value: str, points: int, most: int = 32, overlap: float = 0.7) -> DataFrame:
    """(left, right, similarity, shift) for stated `pairs` (left, right) of curves of `points` values at 0, 1, ...

    The highest correlation over shifts up to `most` at which at least that part of the points
    overlaps; of equal ones the smaller shift, then the negative one. Curves without variation have none.
    """
    a = curves.select(F.col(key).alias("left"), F.col(at).alias("i"), F.col(value).alias("a"))
    b = curves.select(F.col(key).alias("right"), F.col(at).alias("j"), F.col(value).alias("b"))
    shifted = pairs.join(a, "left").withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("j", F.col("i") + F.col("shift"))
    sums = shifted.join(b, ["right", "j"]).groupBy("left", "right", "shift").agg(F.count("*").alias("n"), F.round(correlation("a", "b"), 9).alias("r"))
    good = sums.where((F.col("n") >= overlap * points) & F.col("r").isNotNull())
    best = good.groupBy("left", "right").agg(F.max(F.struct("r", F.negate(F.abs("shift")).alias("near"), F.negate("shift").alias("negative"), "shift")).alias("b"))
    return best.select("left", "right", F.col("b.r").alias("similarity"), F.col("b.shift").alias("shift"))
