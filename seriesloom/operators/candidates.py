"""Candidate paths for the unknown tail of a series, and choosing among them."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.scalars import clip, correlation, finite_or_null, gaussian_log_emission, is_finite, row_argmin
from seriesloom.operators import joins, series


def recent_slope(df: DataFrame, key: str, order: str, axis: str, known: str, n: int = 200, bound: float = 0.08, shrink: float = 0.5) -> DataFrame:
    """(key, slope): the median step slope of a group's last n known rows, bounded and drawn to 0."""
    last = series.tail(df, key, order, n, F.col(known).isNotNull())
    w = series.over(key, order)
    step = (F.col(known) - F.lag(known).over(w)) / F.nullif(F.col(axis) - F.lag(axis).over(w), F.lit(0.0))
    slopes = last.withColumn("s", step).groupBy(key).agg(F.median("s").alias("m"))
    return slopes.select(key, (shrink * clip(F.coalesce("m", F.lit(0.0)), -bound, bound)).alias("slope"))


def initial_rate(df: DataFrame, key: str, order: str, axis: str, known: str, z: str, n: int = 64, least: int = 3) -> DataFrame:
    """(key, rate, steps): median of (change of known + change of z) per unit of the axis over the last n known rows; 0 below `least` steps."""
    last = series.tail(df, key, order, n, F.col(known).isNotNull())
    w = series.over(key, order)
    d = lambda c: F.col(c) - F.lag(c).over(w)
    steps = last.withColumn("s", finite_or_null(F.when(d(axis) > 0, (d(known) + d(z)) / d(axis))))
    got = steps.groupBy(key).agg(F.count("s").alias("steps"), F.median("s").alias("m"))
    return got.select(key, F.when(F.col("steps") >= least, F.col("m")).otherwise(0.0).alias("rate"), "steps")


def baseline_candidates(df: DataFrame, key: str, order: str, axis: str, known: str) -> DataFrame:
    """Tail rows with `last_anchor` and `recent_linear`: the last known value, and it carried on by the recent slope."""
    anchor = series.anchors(df, key, order, known, [axis])
    rows = df.where(F.col(known).isNull()).join(anchor, key).join(recent_slope(df, key, order, axis, known), key)
    ahead = F.col(axis) - F.col(f"anchor_{axis}")
    return rows.withColumns({"last_anchor": F.col(f"anchor_{known}"), "recent_linear": F.col(f"anchor_{known}") + F.col("slope") * ahead, "ahead": ahead})


def noise_scale(df: DataFrame, key: str, observed: str, reference: str, low: float = 10.0, high: float = 60.0, factor: float = 1.0) -> DataFrame:
    """(key, sigma): the deviation of observed from reference within bounds, times a factor that is applied last."""
    return df.groupBy(key).agg((factor * clip(F.stddev_pop(F.col(observed) - F.col(reference)), low, high)).alias("sigma"))


def shift_scan(df: DataFrame, curve: DataFrame, key: str, curve_key: list[str], x: str, observed: str, curve_x: str, curve_y: str, shifts: list[float], sigma: float) -> DataFrame:
    """(key, shift, n, likelihood, zncc, place): constant shifts of the path held against a reference curve.

    likelihood: mean Gaussian log-emission; zncc: correlation, -1 where either side hardly varies.
    place: rank by likelihood, ties to the smaller shift, then to the negative one. The parameter table is small; rows meet
    each shift, and the curve once, by a merged sort.
    """
    rows = df.withColumn("shift", F.explode(F.array(*(F.lit(float(s)) for s in shifts)))).withColumn("__sx", F.col(x) + F.col("shift"))
    met = joins.interpolate_join(rows, curve, curve_key, "__sx", curve_x, curve_y, "__ref", clamp=False)
    both = F.col("__ref").isNotNull() & F.col(observed).isNotNull()
    got = met.where(both).groupBy(key, "shift").agg(F.count("*").alias("n"), F.avg(gaussian_log_emission(observed, "__ref", sigma)).alias("likelihood"), correlation(observed, "__ref").alias("c"), F.stddev_pop(observed).alias("so"), F.stddev_pop("__ref").alias("sr"))
    valid = (F.col("so") > 1e-9) & (F.col("sr") > 1e-9)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("likelihood"), F.abs("shift"), "shift"))
    return got.select(key, "shift", "n", "likelihood", F.when(valid, F.col("c")).otherwise(-1.0).alias("zncc"), place.alias("place"))


def local_maxima(df: DataFrame, key: str, slot: str, score: str, eligible: Column | None = None) -> DataFrame:
    """Eligible slots whose score is above that of each eligible neighbour; end slots count; there may be none."""
    rows = df if eligible is None else df.where(eligible)
    w = series.over(key, slot)
    above = lambda n: F.coalesce(F.col(score) > n, F.lit(True))
    return rows.withColumn("__peak", above(F.lag(score).over(w)) & above(F.lead(score).over(w))).where("__peak").drop("__peak")


def persistent_leaders(df: DataFrame, key: str, candidate: str, checkpoint: str, score: str, anchor: str) -> DataFrame:
    """(key, candidate): candidates other than the anchor whose score is above its at every checkpoint."""
    base = df.where(F.col(candidate) == anchor).select(key, checkpoint, F.col(score).alias("__base"))
    rows = df.where(F.col(candidate) != anchor).join(base, [key, checkpoint])
    return rows.groupBy(key, candidate).agg(F.every(F.col(score) > F.col("__base")).alias("leads")).where("leads").select(key, candidate)


def oracle(df: DataFrame, scope: list[str], truth: str, candidates: list[str]) -> DataFrame:
    """`df` with the candidate of least squared error in each scope, `oracle` and `oracle_name`; the first wins ties."""
    sse = df.groupBy(scope).agg(*(F.sum(F.pow(F.col(c) - F.col(truth), 2)).alias(f"__s_{c}") for c in candidates))
    at, _ = row_argmin([f"__s_{c}" for c in candidates])
    best = sse.select(*scope, at.alias("__at"))
    names, values = F.array(*(F.lit(c) for c in candidates)), F.array(*candidates)
    return df.join(best, scope).withColumns({"oracle_name": F.element_at(names, F.col("__at") + 1), "oracle": F.element_at(values, F.col("__at") + 1)}).drop("__at")


def _required(ok: Column, message: str, value: Column) -> Column:
    """`value` where `ok` holds; any other row ends the query with an error."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def bounded_nudge(df: DataFrame, scores: dict[str, str], prior: dict[str, str], coef: float = 1.0, weight: float = 0.5, bound: float = 0.25, domain: list[str] | None = None) -> DataFrame:
    """`df` with `parent`, `parent_name`, `leaning_name`, `nudge` and `policy`: the candidate of least score, moved a bounded part towards that of least score + coef * prior.

    `scores` and `prior` map a candidate's column to those of its predicted error and of its fold's
    RMSE. Only candidates of `domain` are chosen (all, if it isn't given); the first in its order
    wins ties. It must name known candidates, each once. A row with a candidate, score or RMSE that
    is null or not finite, an RMSE not above 0, or a fold without RMSEs ends the query with an error.
    """
    names = list(scores)
    domain = names if domain is None else list(domain)
    if not domain or len(domain) != len(set(domain)) or not set(domain) <= set(names) or set(prior) != set(names):
        raise ValueError("the domain must name known candidates, each once, and every candidate needs a prior")
    if not (math.isfinite(coef) and coef >= 0 and 0 <= weight <= 1 and math.isfinite(bound) and bound > 0):
        raise ValueError("coef must be at least 0, weight from 0 to 1 and bound above 0")
    ok = reduce(lambda a, b: a & b, [*(is_finite(F.col(c)) for c in (*names, *scores.values(), *prior.values())), *(F.col(c) > 0 for c in prior.values())])
    at, parent = row_argmin([scores[c] for c in domain], domain)
    rows = df.withColumns({f"__t_{c}": F.col(scores[c]) + coef * F.col(prior[c]) for c in domain})
    to, leaning = row_argmin([f"__t_{c}" for c in domain], domain)
    name = lambda i: F.element_at(F.array(*(F.lit(c) for c in domain)), i + 1)
    rows = rows.withColumns({"parent": _required(ok, "a candidate, score or RMSE isn't a valid number", parent), "parent_name": name(at), "leaning_name": name(to), "__leaning": leaning})
    nudge = clip(weight * (F.col("__leaning") - F.col("parent")), -bound, bound)
    return rows.withColumns({"nudge": nudge, "policy": F.col("parent") + nudge}).drop("__leaning", *(f"__t_{c}" for c in domain))


def truth_from_errors(values: list[str], errors: list[str], tolerance: float | None = 1e-6) -> tuple[Column, Column]:
    """(truth, residual): what the first candidate and its absolute error imply.

    Of both signs the one with the least mean misfit over all candidates counts, at a tie the
    upper one. `residual` is its largest misfit; above `tolerance` a row ends the query with an
    error, as do values that aren't finite and errors below 0. None: such rows stay.
    """

    def misfits(t: Column) -> list[Column]:
        return [F.abs(F.abs(F.col(v) - t) - F.col(e)) for v, e in zip(values, errors, strict=True)]

    low, high = F.col(values[0]) - F.col(errors[0]), F.col(values[0]) + F.col(errors[0])
    upper = sum(misfits(high)[1:], misfits(high)[0]) <= sum(misfits(low)[1:], misfits(low)[0])
    most = lambda t: F.greatest(*misfits(t), F.lit(0.0))
    truth, residual = F.when(upper, high).otherwise(low), F.when(upper, most(high)).otherwise(most(low))
    if tolerance is None:
        return truth, residual
    ok = reduce(lambda a, b: a & b, [*(is_finite(F.col(c)) for c in (*values, *errors)), *(F.col(e) >= 0 for e in errors), residual <= tolerance])
    return _required(ok, "candidates and errors don't agree on a truth", truth), residual


def rmse_certificate(df: DataFrame, key: list[str], parent: str, policy: str, truth: str, bound: float) -> DataFrame:
    """(key, parent_rmse, policy_rmse, moved_rms, holds, within): by Minkowski the policy's RMSE is at most the parent's plus the move's."""
    e, p, m = F.col(parent) - F.col(truth), F.col(policy) - F.col(truth), F.col(policy) - F.col(parent)
    got = df.groupBy(key).agg(*(F.sqrt(F.avg(x * x)).alias(n) for x, n in ((e, "parent_rmse"), (p, "policy_rmse"), (m, "moved_rms"))), F.max(F.abs(m)).alias("moved_max"))
    return got.select(*key, "parent_rmse", "policy_rmse", "moved_rms", (F.col("policy_rmse") <= F.col("parent_rmse") + F.col("moved_rms") + 1e-9).alias("holds"), (F.col("moved_max") <= bound + 1e-9).alias("within"))


def pair_targets(df: DataFrame, block: str, candidate: str, order: str, loss: str) -> DataFrame:
    """(block, left, right, left_wins, weight): candidate pairs of a block in both orientations, ties left out, weights summing to 1 a block.

    A block has a fixed small number of candidates.
    """
    l = df.select(block, F.col(candidate).alias("left"), F.col(order).alias("lo"), F.col(loss).alias("ll"))
    r = df.select(block, F.col(candidate).alias("right"), F.col(order).alias("ro"), F.col(loss).alias("rl"))
    pairs = l.join(r, block).where("lo <> ro and ll <> rl")
    gap = F.abs(F.col("ll") - F.col("rl"))
    return pairs.select(block, "left", "right", (F.col("ll") < F.col("rl")).cast("int").alias("left_wins"), (gap / F.sum(gap).over(Window.partitionBy(block))).alias("weight"))


def pair_features(df: DataFrame, block: str, candidate: str, features: list[str], context: list[str]) -> DataFrame:
    """Ordered pairs of a block's candidates with the difference (changes sign when swapped) and mean (doesn't) of each feature."""
    side = lambda s: df.select(block, F.col(candidate).alias(s), *(F.col(f).alias(f"__{s}_{f}") for f in features), *([] if s == "right" else context))
    rows = side("left").join(side("right"), block).where("left <> right")
    return rows.select(block, "left", "right", *context, *((F.col(f"__left_{f}") - F.col(f"__right_{f}")).alias(f"diff_{f}") for f in features), *(((F.col(f"__left_{f}") + F.col(f"__right_{f}")) / 2).alias(f"mean_{f}") for f in features))


def borda(df: DataFrame, block: str, left: str, right: str, probability: str, order: str, anchor: str) -> DataFrame:
    """(block, selected, borda, beats_anchor, final): the candidate of most summed win probability; ties to the anchor, then by order.

    Falls back to the anchor where the selected one beats it with no more than one half.
    """
    score = df.groupBy(block, F.col(left).alias("c")).agg(F.round(F.sum(probability), 12).alias("borda"), F.min(order).alias("o"), F.max(F.when(F.col(right) == anchor, F.col(probability))).alias("beats_anchor"))
    best = score.groupBy(block).agg(F.max_by(F.struct("c", "borda", "beats_anchor"), F.struct("borda", (F.col("c") == anchor).cast("int"), -F.col("o"))).alias("b"))
    final = F.when(F.coalesce(F.col("b.beats_anchor"), F.lit(1.0)) <= 0.5, anchor).otherwise(F.col("b.c"))
    return best.select(block, F.col("b.c").alias("selected"), F.col("b.borda").alias("borda"), F.col("b.beats_anchor").alias("beats_anchor"), final.alias("final"))


def rank_compact(df: DataFrame, block: str, score: str, value: str, temperature: float = 1.0) -> DataFrame:
    """(block, entropy, mean, variance, top_weight) of candidates weighted by the softmax of their scores."""
    top = F.max(score).over(Window.partitionBy(block))
    rows = df.withColumn("__w", F.exp((F.col(score) - top) / temperature))
    rows = rows.withColumn("__w", F.col("__w") / F.sum("__w").over(Window.partitionBy(block)))
    got = rows.groupBy(block).agg(F.sum(-F.col("__w") * F.log("__w")).alias("entropy"), F.sum(F.col("__w") * F.col(value)).alias("mean"), F.sum(F.col("__w") * F.col(value) * F.col(value)).alias("second"), F.max("__w").alias("top_weight"))
    return got.select(block, "entropy", "mean", F.greatest(F.lit(0.0), F.col("second") - F.col("mean") * F.col("mean")).alias("variance"), "top_weight")


def other_folds_choice(df: DataFrame, fold: str, policy: str, sse: str) -> DataFrame:
    """(fold, policy, other_sse): for each fold the policy of least squared error on all other folds, ties by name."""
    sums = df.groupBy(fold, policy).agg(F.sum(sse).alias("s"))
    rest = sums.withColumn("other_sse", F.sum("s").over(Window.partitionBy(policy)) - F.col("s"))
    return rest.groupBy(fold).agg(F.min(F.struct(F.round("other_sse", 6).alias("o"), F.col(policy).alias("p"))).alias("b")).select(fold, F.col("b.p").alias(policy), F.col("b.o").alias("other_sse"))


def bucket_shrink(df: DataFrame, table: DataFrame, bucket: str, correction: str, alpha: str) -> DataFrame:
    """`df` with its correction times the bucket's factor; buckets that the table lacks keep it whole."""
    return df.join(table, bucket, "left").withColumn(correction, F.col(correction) * F.coalesce(alpha, F.lit(1.0))).drop(alpha)


def gate(condition: Column, chosen: str, fallback: str) -> Column:
    """The chosen value where the condition holds and the value is finite, else the fallback."""
    return F.when(F.coalesce(condition, F.lit(False)) & is_finite(chosen), F.col(chosen)).otherwise(F.col(fallback))


def clip_at_quantile(df: DataFrame, fit: DataFrame, column: str, q: float) -> DataFrame:
    """`df` with a column held within plus and minus the q-quantile of its size in `fit`."""
    bound = fit.agg(F.percentile(F.abs(column), q).alias("__b"))
    return df.crossJoin(F.broadcast(bound)).withColumn(column, clip(column, -F.col("__b"), F.col("__b"))).drop("__b")  # one row


def clip_to_reference(df: DataFrame, key: str, column: str, reference: DataFrame, value: str, out: str) -> DataFrame:
    """`df` with `out`: `column` within the range of `value` in the reference rows of the same key; as it is where there are none."""
    ends = reference.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    rows = df.join(ends, F.col(key) == F.col("__key"), "left")
    inside = F.when(F.col(column).isNotNull(), F.least(F.greatest(F.col(column), F.col("__low")), F.col("__high")))
    return rows.withColumn(out, inside).drop("__key", "__low", "__high")


def restore_order(template: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """The template's rows in its order with their predictions; unknown and missing keys are errors."""
    problems = joins.coverage(template, predictions, [key]).limit(3).collect()
    if problems:
        raise ValueError(f"keys don't match: {[r.asDict() for r in problems]}")
    return joins.validated_join(template, predictions.select(key, value), [key])


def pair_means(candidates: list[str]) -> dict[str, Column]:
    """The mean of every two candidates, by name."""
    return {f"mean_{a}_{b}": (F.col(a) + F.col(b)) / 2 for a, b in combinations(candidates, 2)}


def interval_mass(grid: str, mass: str, centre, radius: float) -> Column:
    """The mass of an array on grid points within `radius` of the centre."""
    c = F.col(centre) if isinstance(centre, str) else F.lit(float(centre))
    near = F.filter(F.arrays_zip(F.col(grid).alias("g"), F.col(mass).alias("m")), lambda p: F.abs(p["g"] - c) <= radius + 1e-12)
    return F.aggregate(near, F.lit(0.0), lambda a, p: a + p["m"])


def grid_bounds(anchor, low, high, pad: float, outer: float, step: float) -> dict[str, Column]:
    """Ends and number of steps of a position grid: the anchor ± pad, within the reference ± outer."""
    a, lo, hi = F.col(anchor), F.col(low), F.col(high)
    start, end = F.greatest(a - pad, lo - outer), F.least(a + pad, hi + outer)
    return {"grid_start": start, "grid_end": end, "grid_points": (F.floor((end - start) / step + 1e-9) + 1).cast("long")}
