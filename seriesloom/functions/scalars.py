"""Column expressions: guards, numeric transforms, hashing, strings and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x) -> Column:
    """Neither null nor NaN nor infinite; never null itself."""
    x = _c(x)
    return F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(x) -> Column:
    return F.when(is_finite(x), _c(x))


def scrub(x, value: float = 0.0) -> Column:
    """`value` in place of null, NaN and infinities."""
    return F.when(is_finite(x), _c(x)).otherwise(F.lit(value))


def clip(x, low, high) -> Column:
    """`x` within bounds; null stays null."""
    x, low, high = _c(x), low if isinstance(low, Column) else F.lit(low), high if isinstance(high, Column) else F.lit(high)
    return F.when(x.isNotNull(), F.greatest(low, F.least(x, high)))


def to_number(x) -> Column:
    """A double, or null for text that is none."""
    return _c(x).try_cast("double")


def fade(distance, tau: float) -> Column:
    """1 - exp(-distance / tau); with tau 0 it is 1. A negative distance is an error."""
    d = _c(distance)
    good = F.lit(1.0) if tau == 0 else 1 - F.exp(-d / tau)
    return F.when(d < 0, F.raise_error(F.lit("fade: negative distance")).cast("double")).when(d.isNotNull(), good)


def fade_blend(parent, candidate, distance, tau: float) -> Column:
    return _c(parent) + fade(distance, tau) * (_c(candidate) - _c(parent))


def half_life(delta, span) -> Column:
    """2 ** (-delta / span)."""
    return F.pow(F.lit(2.0), -_c(delta) / _c(span))


def blend(weights: dict[str, float]) -> Column:
    """A weighted sum of columns."""
    terms = [F.lit(float(w)) * F.col(c) for c, w in weights.items()]
    return sum(terms[1:], terms[0])


def shrunk_sigma(sigma, prior, n, k: float, low: float, high: float) -> Column:
    """sqrt((1 - a) prior² + a sigma²) with a = n / (n + k), within bounds."""
    a = _c(n) / (_c(n) + k)
    return clip(F.sqrt((1 - a) * _c(prior) * _c(prior) + a * _c(sigma) * _c(sigma)), low, high)


def gaussian_log_emission(observed, reference, sigma, cap: float = 600.0) -> Column:
    """-z² / 2 with z² at most `cap`; a null observation is neutral, 0."""
    z = (_c(observed) - _c(reference)) / (_c(sigma) if isinstance(sigma, (str, Column)) else F.lit(float(sigma)))
    return F.when(z.isNotNull(), -0.5 * F.least(z * z, F.lit(cap))).otherwise(0.0)


def robust_z(x, median, mad) -> Column:
    """(x - median) / (1.4826 mad); all 0 where the spread is 0."""
    return F.when(_c(mad) == 0, 0.0).otherwise((_c(x) - _c(median)) / (1.4826 * _c(mad)))


def monotone_risk(x, centre, half) -> Column:
    """0 up to the centre, one half at `half` above it, rising to 1."""
    above = F.greatest(F.lit(0.0), _c(x) - _c(centre))
    return above / (above + _c(half))


def stable_seed(key) -> Column:
    """int(sha256(key)[:16], 16) mod (2³¹ - 1) + 1."""
    wide = F.conv(F.substring(F.sha2(_c(key).cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (F.pmod(wide, F.lit(2147483647).cast("decimal(20,0)")) + 1).cast("long")


def stable_bucket(key, n: int) -> Column:
    """A place from 0 to n - 1 by the first 15 hex digits of the key's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(_c(key).cast("binary"), 256), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def stable_choice(key, grid: list) -> Column:
    """The entry of `grid` that the key's hash selects."""
    return F.element_at(F.array(*(F.lit(g) for g in grid)), stable_bucket(key, len(grid)) + 1)


def one_hot(x, values: list, prefix: str) -> list[Column]:
    """A 0/1 column for each value, in the declared order; unknown and null are all 0."""
    return [F.coalesce((_c(x) == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in values]


def row_argmin(scores: list[str], values: list[str] | None = None) -> tuple[Column, Column]:
    """(position, value) of the least score of a row; the first wins ties, nulls never win."""
    values = values or scores
    packed = F.array(*(F.struct(F.col(s).isNull().alias("none"), F.col(s).alias("s"), F.lit(i).alias("i"), F.col(v).alias("v")) for i, (s, v) in enumerate(zip(scores, values, strict=True))))
    best = F.array_min(packed)
    return F.when(~best["none"], best["i"]), F.when(~best["none"], best["v"])


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """The names of a table's columns that begin with `prefix`, in its order."""
    return [c for c in df.columns if c.startswith(prefix)]


def row_mean(columns: list[str]) -> Column:
    """The mean of a row's non-null values."""
    n = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns[1:]), F.coalesce(F.col(columns[0]), F.lit(0.0)))
    return F.when(n > 0, total / n)


def slug(x) -> Column:
    """Lower case, with one hyphen for every run of other characters than letters and digits."""
    return F.btrim(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]+", "-"), F.lit("-"))


def row_id(key, position, width: int = 0) -> Column:
    """`key_position`, the position padded with zeros to `width`."""
    number = F.lpad(_c(position).cast("string"), width, "0") if width else _c(position).cast("string")
    return F.concat_ws("_", _c(key).cast("string"), number)


def id_key(x) -> Column:
    """What stands before the last underscore of a row id."""
    return F.regexp_extract(_c(x), "^(.*)_[^_]*$", 1)


def id_position(x) -> Column:
    return F.substring_index(_c(x), "_", -1).try_cast("long")


def is_sha256(x) -> Column:
    return F.rlike(_c(x), F.lit("^[0-9a-f]{64}$"))


def shown(x, empty: str = "-") -> Column:
    """Text for display: null and empty as a dash."""
    return F.coalesce(F.nullif(_c(x).cast("string"), F.lit("")), F.lit(empty))


def dotted(json, path: str, default: str | None = None) -> Column:
    """The value at a dotted path of JSON text; the default where it is missing or null."""
    return F.coalesce(F.get_json_object(_c(json), f"$.{path}"), F.lit(default))


def geometry(x: str, y: str, z: str, md: str) -> dict[str, Column]:
    """Products and angles of a position; a zero radius has azimuth 0."""
    x, y, z, md = map(F.col, (x, y, z, md))
    radius = F.sqrt(x * x + y * y)
    return {
        "radius": radius,
        "xy": x * y,
        "xz": x * z,
        "yz": y * z,
        "md_minus_z": md - z,
        "tortuosity": F.when(radius > 0, md / radius).otherwise(0.0),
        "azimuth_sin": F.when(radius > 0, y / radius).otherwise(0.0),
        "azimuth_cos": F.when(radius > 0, x / radius).otherwise(1.0),
    }


def correlation(a, b) -> Column:
    """Pearson's, null where one side doesn't vary."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
