"""Sequential decoders of a path against a reference curve.

Spark groups and deals out the series; each kernel is a small function of arrays. What is a sum or a
softmax over paths afterwards (ensembles, interval masses) stays a DataFrame plan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.functions.keyed import joined
from seriesloom.functions.staging import staged

#: Points of all curves together, 16 bytes each, that are broadcast at most.
CURVE_POINTS = 500_000
#: Beyond that, a curve with more series than this is copied to many tasks, among which its series are dealt.
CURVE_SERIES = 64


def decode(series: DataFrame, curve: DataFrame, key: str, curve_key: str, order: str, kernel: Callable[[pd.DataFrame, np.ndarray, np.ndarray], dict[str, np.ndarray]], columns: str, curve_x: str, curve_y: str, together: int = 0, each_row: bool = True) -> DataFrame:
    """Runs `kernel(rows, curve x, curve y)` on each group of `series`, in the order of `order`, with the points of its curve.

    A series travels as one row of sorted arrays and meets its curve, one row a curve key, only
    then. The kernel gives one value a row for each of `columns`. A series is in one task, as a path
    is sequential; series are dealt to as many tasks as there are shuffle partitions. With `together`
    the kernel gets lists of up to so many series, and gives a list. Without `each_row` it gives one
    value a series for each of `columns`, and nothing a row is sent on.
    """
    point = F.struct(F.col(curve_x).cast("double").alias("x"), F.col(curve_y).cast("double").alias("y"))
    packed = curve.where(F.col(curve_x).isNotNull() & F.col(curve_y).isNotNull()).groupBy(F.col(curve_key)).agg(F.array_sort(F.collect_list(point)).alias("__c"))
    packed = staged(packed.select(curve_key, F.col("__c.x").alias("__cx"), F.col("__c.y").alias("__cy")), "curves")
    inner = [order, *(c for c in series.columns if c not in (key, curve_key, order))]
    whole = series.groupBy(key).agg(F.first(curve_key).alias(curve_key), F.array_sort(F.collect_list(F.struct(*inner))).alias("__s"))
    whole = whole.select(key, curve_key, *(F.col(f"__s.{c}").alias(c) for c in inner))
    if (packed.agg(F.sum(F.size("__cx"))).first()[0] or 0) <= CURVE_POINTS:
        tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, but much work a series: not to be put together
        dealt = F.xxhash64(key)  # by the key itself they lie already, and would not be dealt anew
        whole = whole.repartition(tasks, dealt).join(F.broadcast(packed), curve_key)
    else:  # series are shuffled by their curve
        counts = series.groupBy(curve_key).agg(F.count_distinct(key).alias("n"))
        whole = joined(whole, staged(packed.join(counts, curve_key), "curves"), [curve_key], CURVE_SERIES)
    names = [c.split()[0] for c in columns.split(", ")]
    kept = [key, order] if each_row else [key]
    schema = ", ".join([*(f"{c} {series.schema[c].dataType.simpleString()}" for c in kept), columns])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            records = part.to_dict("records")
            for some in (records[i : i + max(1, together)] for i in range(0, len(records), max(1, together))):
                rows = [pd.DataFrame({c: np.asarray(row[c]) for c in inner} | {key: row[key]}) for row in some]
                curves = [[np.asarray(row[c], float) for row in some] for c in ("__cx", "__cy")]
                got = kernel(rows, *curves) if together else [kernel(rows[0], curves[0][0], curves[1][0])]
                if each_row:
                    whole_of = lambda parts: parts[0] if len(parts) == 1 else np.concatenate(parts)  # noqa: E731  # one frame for all: a frame costs more than its rows
                    yield pd.DataFrame({c: whole_of([x[c] for x in rows]) for c in kept} | {n: whole_of([values[n] for values in got]) for n in names})
                else:
                    yield pd.DataFrame({key: [row[key] for row in some]} | {n: [values[n] for values in got] for n in names})

    return whole.mapInPandas(run, schema)


def _reader(cx: np.ndarray, cy: np.ndarray, scale: float = 1.0, offset: float = 0.0) -> Callable[[np.ndarray, float, np.ndarray], None]:
    """Puts a curve's values at scale * x + base + offset to `out`, by linear interpolation, its end values beyond it; by direct places where the points are evenly spaced."""
    gaps = np.diff(cx)
    if len(cx) < 2 or not np.allclose(gaps, gaps[0], rtol=1e-9, atol=0):
        return lambda x, base, out: np.copyto(out, np.interp(x * scale + (base + offset), cx, cy), casting="same_kind")
    both = np.stack((cy, np.append(np.diff(cy), 0.0)), axis=1).astype(np.float32).view(np.complex64)[:, 0]  # a value and its rise, fetched together
    low, per, last = float(cx[0]) - offset, 1 / float(gaps[0]), np.float32(len(cx) - 1)
    at, got, whole = np.empty(0, np.intp), np.empty(0, np.complex64), np.empty(0, np.float32)

    def read(x: np.ndarray, base: float, out: np.ndarray) -> None:
        nonlocal at, got, whole
        if at.shape != x.shape:  # fresh memory for each row would cost more than the row's sums
            at, got, whole = np.empty(x.shape, np.intp), np.empty(x.shape, np.complex64), np.empty(x.shape, np.float32)
        np.multiply(x, np.float32(scale * per), out=out)
        out += np.float32((base - low) * per)
        np.clip(out, np.float32(0), last, out=out)
        np.copyto(at, out, casting="unsafe")
        both.take(at, mode="clip", out=got)
        out -= np.floor(out, out=whole)
        out *= got.imag
        out += got.real

    return read


class Lagged:
    """Positions of the last `lag` rows, as today's particles descend from them.

    Draws are kept as maps and followed back once a block of `lag` rows, so that the work of a row doesn't grow with the lag.
    """

    def __init__(self, s: int, n: int, lag: int):
        self.lag, self.own = lag, np.arange(s * n, dtype=np.int32).reshape(s, n)
        self.rows, self.maps = [], []  # of this block
        self.done, self.since = [], None  # the block before, by the particles at its end, and what was drawn since

    def add(self, x: np.ndarray) -> None:
        if len(self.rows) == self.lag:
            self.done, self.since, self.rows, self.maps = self._by_now(), None, [], []
        self.rows.append(x.copy())
        self.maps.append(None)

    def draw(self, few: np.ndarray, at: np.ndarray) -> None:
        """The seeds `few` go on with the particles `at`, counted over all seeds."""
        to = self.own.copy()
        to[few] = at
        self.maps[-1] = to
        self.since = to if self.since is None else self.since.take(to)

    def oldest(self) -> np.ndarray:
        """The positions `lag` rows ago."""
        return self._since(self.done[len(self.rows) - 1])

    def rest(self) -> list[np.ndarray]:
        """The positions of the last `lag` rows, or of all if there are fewer."""
        return [self._since(x) for x in self.done[len(self.rows) :]] + self._by_now()

    def _since(self, x: np.ndarray) -> np.ndarray:
        return x if self.since is None else x.take(self.since)

    def _by_now(self) -> list[np.ndarray]:
        out, at = [], None
        for x, to in zip(reversed(self.rows), reversed(self.maps), strict=True):
            if to is not None:
                at = to if at is None else to.take(at)
            out.append(x if at is None else x.take(at))
        return out[::-1]


#: Seeds that go on side by side: their arrays stay near a core, and each of NumPy's calls has much to do.
SIDE_BY_SIDE = 64


def particle_bank(step: np.ndarray, observed: np.ndarray, cx: np.ndarray, cy: np.ndarray, seeds: list[int], start: float, rate: float, sigma: float, n: int = 500, momentum: float = 0.998, noise: tuple[float, float] = (0.01, 0.002), outlier: float = 0.0, wide: tuple[float, float] = (0.0, 1.0), lag: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(paths, log-likelihoods) of all seeds, a row of `paths` each; every seed's are those of a run of its own, bit for bit.

    Positions move by rate * step plus noise. Particles are weighted by a Gaussian likelihood of
    the observation against the curve, and drawn anew systematically when fewer than half are
    effective. A missing observation moves them only. Options: `outlier`, the share of observations
    that may be anything (likelihood exp(-8) of the best); `wide`, the share of particles whose
    position noise is larger, and by which factor; `lag`, how many later rows a position may still learn from.
    """
    k = np.sqrt(0.5) / sigma  # the curve is read in units in which half a square is a likelihood's logarithm
    read, parts = _reader(cx, cy * k, noise[0] or 1.0, start), range(0, len(seeds), SIDE_BY_SIDE)
    got = [_particle_bank(step, observed * k, read, seeds[i : i + SIDE_BY_SIDE], start, rate, n, momentum, noise, outlier, wide, lag) for i in parts]
    return np.concatenate([paths for paths, _ in got]), np.concatenate([total for _, total in got])


def _particle_bank(step, observed, read, seeds, start, rate, n, momentum, noise, outlier, wide, lag) -> tuple[np.ndarray, np.ndarray]:
    """`particle_bank` of seeds side by side. Positions are kept as their distance from start + rate * steps in units of their noise, rates as theirs from `rate` in units of theirs: draws are used as they come."""
    s, rows, chunk = len(seeds), len(step), 4
    normal, uniform = [np.random.Generator(np.random.PCG64(k)) for k in seeds], {}
    f = np.float32  # single precision is far finer than the noise, and twice as fast
    unit, calm, drift = noise[0] or 1.0, n - int(wide[0] * n), rate * np.cumsum(step)
    x, v, w, total = np.zeros((s, n), f), np.zeros((s, n), f), np.full((s, n), 1 / n, f), np.zeros(s)
    z, t, fine, drawn = np.empty((s, chunk, 2, n), f), np.empty((s, n), f), np.empty((s, n)), np.empty((s, n))
    paths, lagged = np.empty((s, rows)), Lagged(s, n, lag) if lag else None
    firsts = np.arange(s)[:, None]

    def mean(x: np.ndarray, i: int) -> np.ndarray:
        np.multiply(w, x, out=t)
        np.copyto(fine, t)
        return fine.sum(axis=1) * unit + (start + drift[i])

    def uniforms(k: int) -> np.ndarray:
        if k not in uniform:  # few seeds are ever drawn anew
            uniform[k] = np.random.Generator(np.random.PCG64(np.random.SeedSequence([int(seeds[k]), 1]))).random(rows)
        return uniform[k]

    for i in range(rows):
        j = i % chunk
        if not j:
            for g, to in zip(normal, z[:, : min(chunk, rows - i)], strict=True):
                g.standard_normal(dtype=f, out=to)
        push = z[:, j, 1]
        v *= f(momentum)
        v += z[:, j, 0]
        x += np.multiply(v, f(step[i] * noise[1] / unit), out=t)
        if noise[0]:
            if calm < n:
                push[:, calm:] *= f(wide[1])
            x += push
        if np.isfinite(observed[i]):
            read(x, drift[i], t)
            t -= f(observed[i])
            np.multiply(t, t, out=t)
            np.minimum(t, f(300), out=t)
            if outlier:  # a sum of likelihoods is never far from its best one
                np.exp(np.negative(t, out=t), out=t)
                t *= f(1 - outlier)
                t += f(outlier * np.exp(-8.0))
                w *= t
                top = f(0)
            else:
                top = t.min(axis=1, keepdims=True)
                w *= np.exp(np.subtract(top, t, out=t), out=t)
            mass = w.sum(axis=1, keepdims=True)
            some = np.maximum(mass, f(1e-37))
            total += (np.log(some) - top).astype(float)[:, 0]
            w *= 1 / some
            w[~(mass[:, 0] > 0)] = f(1 / n)
        if lagged is None:
            paths[:, i] = mean(x, i)
        else:
            lagged.add(x)
            if i >= lag:
                paths[:, i - lag] = mean(lagged.oldest(), i - lag)
        few = np.flatnonzero(np.vecdot(w, w) > 2 / n)
        if len(few):
            ends = drawn[: len(few)]
            np.cumsum(w[few], axis=1, dtype=float, out=ends)
            ends *= n
            ends -= np.array([uniforms(k)[i] for k in few])[:, None]
            np.floor(ends, out=ends)
            ends += 1
            np.clip(ends, 0, n, out=ends)
            ends[:, -1] = n
            ends += firsts[: len(few)] * (n + 1)
            held = np.bincount(ends.astype(np.intp).ravel(), minlength=len(few) * (n + 1)).reshape(len(few), n + 1)  # draws that end before each place
            at = held[:, :n].cumsum(axis=1)
            at += few[:, None] * n
            if lagged is not None:
                lagged.draw(few, at)
            for a in (x, v):
                a[few] = a.take(at, mode="clip")
            w[few] = f(1 / n)
    if lagged is not None:
        for i, old in enumerate(lagged.rest(), max(0, rows - lag)):
            paths[:, i] = mean(old, i)
    return paths, total


def particle_filter(rows: pd.DataFrame, cx: np.ndarray, cy: np.ndarray, seed: int, start: float, rate: float, sigma: float, **options) -> tuple[np.ndarray, float]:
    """(path, log-likelihood) of rows with `step` and `observed` for one seed; see `particle_bank`."""
    paths, total = particle_bank(rows["step"].to_numpy(float), rows["observed"].to_numpy(float), cx, cy, [seed], start, rate, sigma, **options)
    return paths[0], float(total[0])


def blends(paths: Column, logliks: Column, temperatures: tuple[float, ...], low: Column | None = None, high: Column | None = None) -> dict[str, Column]:
    """`mean` and a `scale_<t>` for each temperature, from arrays of all seeds: the plain mean, and that weighted by the softmax of log-likelihood / t.

    Where `low` and `high` are given, blends are kept between them.
    """
    best = F.array_max(logliks)
    kept = lambda c: F.greatest(low, F.least(c, high)) if low is not None and high is not None else c
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    out = {"mean": kept(total(paths) / F.size(paths))}
    for t in temperatures:
        w = F.transform(logliks, lambda x: F.exp((x - best) / F.lit(float(t))))  # noqa: B023
        out[f"scale_{t:g}"] = kept(total(F.zip_with(paths, w, lambda p, q: p * q)) / total(w))
    return out


def blended(paths: np.ndarray, logliks: np.ndarray, temperatures: tuple[float, ...], low: float, high: float) -> dict[str, np.ndarray]:
    """`blends` of paths that are still arrays, a row a seed: no row has to carry all seeds on."""
    total = lambda a: np.cumsum(a, axis=0)[-1]  # noqa: E731  # seed by seed, as there
    out = {"mean": np.clip(total(paths) / len(paths), low, high)}
    for t in temperatures:
        w = np.exp((logliks - logliks.max()) / t)
        out[f"scale_{t:g}"] = np.clip(total(paths * w[:, None]) / total(w), low, high)
    return out


def ensemble(paths: DataFrame, key: str, order: str, path: str, loglik: str, temperature: float) -> DataFrame:
    """(key, order, mean, tempered): over seeds, the plain mean and that weighted by the softmax of log-likelihood / temperature."""
    w = F.exp((F.col(loglik) - F.max(loglik).over(Window.partitionBy(key, order))) / temperature)
    rows = paths.withColumn("__w", w)
    return rows.groupBy(key, order).agg(F.avg(path).alias("mean"), (F.sum(F.col("__w") * F.col(path)) / F.sum("__w")).alias("tempered"))


def seeds_of(key, count: int, salt: str) -> list[int]:
    """The seeds of a key, from hashes of salt, key and number, as `stable_seed` takes them."""
    return [int(hashlib.sha256(f"{salt}::{key}::{i}".encode()).hexdigest()[:16], 16) % (2**31 - 1) + 1 for i in range(count)]


def rate_mixing(rates: np.ndarray, momentum: float, noise: float) -> np.ndarray:
    """Chances from each rate (row) to each: a Gaussian around momentum * rate, or the nearest rate if all lie too far."""
    z = (rates[None, :] - momentum * rates[:, None]) / noise
    mix = np.exp(-0.5 * (z * z - (z * z).min(axis=1, keepdims=True)))
    return mix / mix.sum(axis=1, keepdims=True)


#: Cells beside the grid in which a move may end that still reaches it, with one to spare, as a pad at either side of a row of states.
PAD = 3


class Lattices:
    """Moves on a grid of positions: by a rate's way, spread over the five nearest cells.

    A cell gets the Gaussian density of its distance from where the move ends, with a deviation of
    `noise` or half a cell if that is more; chances of cells beyond the grid go to the others. With `pull` a
    position first keeps only that part of its distance from `center`. States are arrays of (modes, series, rates, positions)
    with PAD cells of zeros at either side of the positions.
    """

    def __init__(self, grid: np.ndarray, rates: np.ndarray, noise: float):
        self.grid, self.rates, self.size, self.width = grid, rates, len(grid), len(grid) + 2 * PAD
        self.cell = grid[1] - grid[0]
        self.wide = max(noise / self.cell, 0.5)
        to = np.arange(-PAD, self.size + PAD) + np.arange(-2, 3)[:, None]
        self.inside = ((to >= 0) & (to < self.size)).astype(float)  # of the five cells around each
        self.ends = np.flatnonzero(self.inside.min(axis=0) == 0)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.counted = np.arange(0)
        self.rooms: dict[tuple, np.ndarray] = {}

    def room(self, name: tuple | str, shape: tuple[int, ...], kind: type = float) -> np.ndarray:
        """An array that is used again under this name: fresh memory for each row would cost more than the row's sums."""
        size = math.prod(shape)
        if len(self.rooms.get(name, ())) < size:
            self.rooms[name] = np.empty(size, kind)
        return self.rooms[name][:size].reshape(shape)

    def every(self, n: int) -> np.ndarray:
        """0 to n - 1."""
        if len(self.counted) < n:
            self.counted = np.arange(n)
        return self.counted[:n]

    def moves(self, step: np.ndarray, shift: np.ndarray, pull: np.ndarray, center: np.ndarray, slot: int) -> EvenShifts | PulledShifts:
        """Of several series side by side, one value each. Moves of equal `slot` are not used at the same time."""
        way = ((self.rates[None, :] * step[:, None] + shift[:, None]) / self.cell).ravel()
        if (pull == 1.0).all():
            return EvenShifts(way, self)
        pulled = (pull - 1.0)[:, None] * (self.grid[None, :] - center[:, None]) / self.cell
        return PulledShifts(way.reshape(len(step), -1), np.pad(pulled, ((0, 0), (PAD, PAD)), "edge"), self, slot)

    def chances(self, part: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
        """exp(-(k - part)^2 / 2 wide^2) for k of -2 to 2 by powers, but for what is common to all."""
        up = np.exp(part / self.wide**2)
        one, two = np.exp(-0.5 / self.wide**2), np.exp(-2.0 / self.wide**2)
        out = np.empty((5, *part.shape)) if out is None else out
        np.multiply(up, one, out=out[3])
        np.multiply(up, up, out=out[4])
        out[4] *= two
        down = np.divide(1.0, up, out=up)
        np.multiply(down, one, out=out[1])
        np.multiply(down, down, out=out[0])
        out[0] *= two
        out[2] = 1.0
        return out

    def scaled(self, chance: np.ndarray) -> np.ndarray:
        """Chances by the cell (last axis) in which a move ends, so that those inside come to 1."""
        total = chance.sum(axis=0)
        near = (chance[:, :, self.ends] * self.inside[:, None, self.ends]).sum(axis=0)
        total[:, self.ends] = np.where(near > 0, near, np.inf)
        chance *= 1 / total
        return chance

    def padded(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The middle of an array that is 0 elsewhere, and the view of it from each place, (rows, places, width)."""
        if rows not in self.windows:
            flat = np.zeros((rows, 3 * self.width))
            self.windows[rows] = flat[:, self.width : 2 * self.width], np.lib.stride_tricks.sliding_window_view(flat, self.width, axis=1)
        return self.windows[rows]


def _spread(ended: np.ndarray, chance: np.ndarray, out: np.ndarray, term: np.ndarray) -> None:
    """Puts what ended in each cell to five cells. Arrays are flat: what leaves a row comes to the pad of the next one."""
    n, term = len(ended), term[: len(ended) - 4]
    out[:2] = out[-2:] = 0.0
    np.multiply(ended[4:], chance[0, 4:], out=out[2:-2])
    for k in range(1, 5):
        out[2:-2] += np.multiply(ended[4 - k : n - k], chance[k, 4 - k : n - k], out=term)


def _gathered(b: np.ndarray, chance: np.ndarray, out: np.ndarray, term: np.ndarray) -> None:
    """The reverse of `_spread`: for each cell in which a move may end the five cells' values by their chances."""
    n, term = len(b), term[: len(b) - 4]
    out[0] = out[-1] = 0.0
    out[1], out[-2] = chance[1:, 1] @ b[:4], chance[:-1, -2] @ b[-4:]
    np.multiply(b[:-4], chance[0, 2:-2], out=out[2:-2])
    for k in range(1, 5):
        out[2:-2] += np.multiply(b[k : n - 4 + k], chance[k, 2:-2], out=term)


class EvenShifts:
    """Moves that are the same from every position of a row (`way` cells): a shifted copy, spread over five cells."""

    def __init__(self, way: np.ndarray, lattice: Lattices):
        near = np.rint(way)
        self.lattice, self.rows, self.width = lattice, np.arange(len(way)), lattice.width
        self.middle, self.windows = lattice.padded(len(way))
        self.few = lattice.chances(way - near)
        self.few /= self.few.sum(axis=0)
        inside = (self.few[:, :, None] * lattice.inside[:, None, lattice.ends]).sum(axis=0)
        self.scale = np.where(inside > 0, 1 / np.maximum(inside, 1e-300), 0.0)
        self.near = np.clip(near, -lattice.width, lattice.width).astype(np.intp)

    def _room(self) -> tuple[np.ndarray, np.ndarray]:
        chance = self.lattice.room("chance", (5, len(self.rows), self.width))
        chance[:] = self.few[:, :, None]
        chance[:, :, self.lattice.ends] *= self.scale
        return chance.reshape(5, -1), self.lattice.room("term", (len(self.rows) * self.width,))

    def ahead(self, a: np.ndarray, out: np.ndarray) -> np.ndarray:
        chance, term = self._room()
        for m, to in zip(a, out, strict=True):
            self.middle[:] = m.reshape(-1, self.width)
            _spread(self.windows[self.rows, self.width - self.near].reshape(-1), chance, to.reshape(-1), term)
        return out

    def back(self, b: np.ndarray, out: np.ndarray) -> np.ndarray:
        (chance, term), cells = self._room(), self.lattice.room("cells", (len(self.rows) * self.width,))
        for m, to in zip(b, out, strict=True):
            _gathered(m.reshape(-1), chance, cells, term)
            self.middle[:] = cells.reshape(-1, self.width)
            to.reshape(-1, self.width)[:] = self.windows[self.rows, self.width + self.near]
        return out


class PulledShifts:
    """Moves that differ by position: by a rate's `way` (series x rates) and a position's `pulled` (series x positions with their pads), both in cells.

    Where moves of several positions end in one cell, the last has the cell; the others, few unless the pull is strong, are done one by one.
    The chances of the five cells around it are `level` times (down^2, down / one, 1, up / one, up^2): what differs is a product of one
    part for the rate and one for the position, so that no cell needs an exponential, and no cell's five chances are kept. `one` is the chance one cell beside.
    """

    def __init__(self, way: np.ndarray, pulled: np.ndarray, lattice: Lattices, slot: int):
        self.lattice, self.width, self.n = lattice, lattice.width, way.size * lattice.width
        shape, by, self.one = (*way.shape, self.width), 1 / lattice.wide**2, np.exp(-0.5 / lattice.wide**2)
        near, along = np.rint(way), np.rint(pulled)
        way, pulled = way - near, pulled - along
        part = np.add(way[:, :, None], pulled[:, None, :], out=lattice.room("part", shape))
        more = lattice.room("more", shape, np.intp)  # -1, 0 or 1
        np.copyto(more, np.rint(part, out=part), casting="unsafe")
        up = np.multiply(np.exp(way * by - by)[:, :, None], np.exp(pulled * by)[:, None, :], out=part)
        up *= np.exp(np.array([0.0, -by, by])).take(more, mode="wrap", out=lattice.room("factor", shape))
        more += np.clip(near, -3 * self.width, 3 * self.width).astype(np.intp)[:, :, None]
        more += (along.astype(np.intp) + np.arange(self.width))[:, None, :]
        np.clip(more, 0, self.width - 1, out=more)
        self.cell = np.add(more.reshape(-1, self.width), (np.arange(self.n // self.width) * self.width)[:, None], out=lattice.room(("cell", slot), (self.n // self.width, self.width), np.intp)).ravel()
        self.source, every = lattice.room(("source", slot), (self.n,), np.intp), lattice.every(self.n)
        self.source.fill(0)  # where no move ends: a pad, in which nothing is
        self.source[self.cell] = every
        last = self.source.take(self.cell, mode="clip", out=lattice.room("last", (self.n,), np.intp))
        rest = np.flatnonzero(last != every)
        at = self.cell[rest]
        far = at % self.width
        inside = (far > 0) & (far < self.width - 1)  # the others reach no cell of the grid, wherever they are counted
        self.rest, at, up = rest[inside], at[inside], up.reshape(-1)
        self.up, self.down, self.level = (lattice.room((name, slot), (self.n,)) for name in ("up", "down", "level"))
        up.take(self.source, mode="clip", out=self.up)
        np.divide(self.one**4, self.up, out=self.down)
        total = np.add(self.up, self.down, out=self.level)
        square = np.multiply(total, total, out=lattice.room("term", (self.n,)))
        total *= 1 / self.one
        total += square
        total += 1 - 2 * self.one**4
        np.divide(1.0, total, out=total)
        ends = self.level.reshape(-1, self.width)
        few = sum(self._five(self.up.reshape(-1, self.width)[:, lattice.ends], lattice.inside[:, None, lattice.ends]))
        ends[:, lattice.ends] = np.where(few > 0, 1 / np.maximum(few, 1e-300), 0.0)
        each = self._five(up[self.rest], lattice.inside[:, at % self.width])
        few = sum(each)
        self.each, self.to = np.stack(each) * np.where(few > 0, 1 / np.maximum(few, 1e-300), 0.0), np.clip(at + np.arange(-2, 3)[:, None], 0, self.n - 1)

    def _five(self, up: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
        down = self.one**4 / up
        return [down * down * inside[0], down * inside[1] / self.one, inside[2] + 0.0 * up, up * inside[3] / self.one, up * up * inside[4]]

    def ahead(self, a: np.ndarray, out: np.ndarray) -> np.ndarray:
        n = self.n
        here, left, right = (self.lattice.room(name, (n,)) for name in ("term", "left", "right"))
        for m, to in zip(a, out, strict=True):
            m, to = m.reshape(-1), to.reshape(-1)
            rest = m[self.rest]
            m.take(self.source, mode="clip", out=here)
            here *= self.level
            np.multiply(here, self.up, out=right)
            np.multiply(here, self.down, out=left)
            to[:2] = to[-2:] = 0.0
            np.add(right[1:-3], left[3:-1], out=to[2:-2])
            to *= 1 / self.one
            to += here
            right *= self.up
            to[2:] += right[:-2]
            left *= self.down
            to[:-2] += left[2:]
            if len(rest):
                np.add.at(to, self.to, self.each * rest)
        return out

    def back(self, b: np.ndarray, out: np.ndarray) -> np.ndarray:
        n = self.n
        near, term, cells = (self.lattice.room(name, (n,)) for name in ("left", "term", "cells"))
        for m, to in zip(b, out, strict=True):
            m, to = m.reshape(-1), to.reshape(-1)
            np.multiply(m, 1 / self.one, out=near)
            np.copyto(cells, m)
            for way, one, two, all_but in ((self.up, near[1:], m[2:], slice(0, -2)), (self.down, near[:-1], m[:-2], slice(2, None))):
                part = np.multiply(way[all_but], two, out=term[all_but])
                part += one[:-1] if way is self.up else one[1:]
                part *= way[all_but]
                cells[all_but] += part
            cells *= self.level
            cells.take(self.cell, mode="clip", out=to)
            to[self.rest] = (self.each * m[self.to]).sum(axis=0)
        return out


class EvenMoves:
    """EvenShifts of one series, over states without pads, (modes, positions, rates)."""

    def __init__(self, shifts: EvenShifts):
        self.shifts = shifts

    def _turned(self, a: np.ndarray, move: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        padded = np.pad(a.transpose(0, 2, 1), ((0, 0), (0, 0), (PAD, PAD)))[:, None]
        return move(padded, np.empty(padded.shape))[:, 0, :, PAD:-PAD].transpose(0, 2, 1)

    def ahead(self, a: np.ndarray) -> np.ndarray:
        return self._turned(a, self.shifts.ahead)

    def back(self, b: np.ndarray) -> np.ndarray:
        return self._turned(b, self.shifts.back)


class Lattice:
    """Moves of one series without a pull; see Lattices."""

    def __init__(self, grid: np.ndarray, rates: np.ndarray, noise: float):
        self.all = Lattices(grid, rates, noise)

    def moves(self, step: float, shift: float) -> EvenMoves:
        return EvenMoves(self.all.moves(np.array([step]), np.array([shift]), np.ones(1), np.zeros(1), 0))


#: States of series that are decoded side by side, and bytes of the states that are kept of them before some are computed again.
CELLS, KEPT_BYTES = 96_000, 256_000_000


def hmm(step: np.ndarray, emission: np.ndarray, grid: np.ndarray, rates: np.ndarray, start: float, rate: float, shift: np.ndarray | None = None, pull: np.ndarray | None = None, center: float = 0.0, switch: np.ndarray | None = None, start_sd: float = 0.75, rate_sd: float = 0.01, rate_noise: float = 0.002, noise: float = 0.02, momentum: float = 0.998, apart: float = 2.0) -> dict[str, np.ndarray]:
    """`hmm_each` of one series."""
    n = len(step)
    shift, pull = np.zeros(n) if shift is None else shift, np.ones(n) if pull is None else pull
    return hmm_each([step], [emission], grid, rates, [start], [rate], [shift], [pull], [center], switch, start_sd, rate_sd, rate_noise, noise, momentum, apart)[0]


def hmm_each(steps: list[np.ndarray], emissions: list[np.ndarray], grid: np.ndarray, rates: np.ndarray, start: list[float], rate: list[float], shifts: list[np.ndarray] | None = None, pulls: list[np.ndarray] | None = None, center: list[float] | None = None, switch: np.ndarray | None = None, start_sd: float = 0.75, rate_sd: float = 0.01, rate_noise: float = 0.002, noise: float = 0.02, momentum: float = 0.998, apart: float = 2.0) -> list[dict[str, np.ndarray]]:
    """Posteriors of a position x rate lattice by forward-backward: `mean`, `sd`, `loglik` (of the whole series), `first_mode` and `second_peak`, for each of several series.

    emissions: log-likelihood of each row at each grid point, constant where nothing was observed; or
    one such table for each of several modes that follow one another by `switch` (chances from mode to mode,
    the first one at the start). A row's rate is drawn around momentum * the last; its position moves
    by rate * step + shift, after it kept `pull` of its distance from `center`. first_mode: the
    chance of the first mode. second_peak: how high the highest local maximum at least `apart` from
    the highest is, as a part of that. Series are solved side by side, as many as have CELLS states, those of like lengths together. Where states of
    all rows would come to more than KEPT_BYTES, only those at each of about sqrt(rows) rows are kept; those between are computed again.
    """
    steps, emissions = [np.asarray(x, float) for x in steps], [e if e.ndim == 3 else e[None] for e in emissions]
    lattice, mix = Lattices(grid, rates, noise), rate_mixing(rates, momentum, rate_noise)
    out: list = [None] * len(steps)
    order = sorted((i for i in range(len(steps))), key=lambda i: -len(steps[i]))
    many = max(1, CELLS // (max((len(e) for e in emissions), default=1) * len(grid) * len(rates)))
    for at in (order[i : i + many] for i in range(0, len(order), many)):
        some = lambda x, default: [default(len(steps[i])) if x is None else x[i] for i in at]  # noqa: B023, E731
        got = _side_by_side(
            [steps[i] for i in at], [emissions[i] for i in at], lattice, mix, np.array([start[i] for i in at], float), np.array([rate[i] for i in at], float),
            some(shifts, np.zeros), some(pulls, np.ones), np.array(some(center, lambda n: 0.0), float), switch, start_sd, rate_sd, apart,
        )
        for i, g in zip(at, got, strict=True):
            out[i] = g
    return out


def _side_by_side(steps, emissions, lattice: Lattices, mix: np.ndarray, start: np.ndarray, rate: np.ndarray, shifts, pulls, center: np.ndarray, switch: np.ndarray | None, start_sd: float, rate_sd: float, apart: float) -> list[dict[str, np.ndarray]]:
    """`hmm_each` of series in one pass, the longest first; states are (modes, series, rates, positions) of those that have the row."""
    grid, rates = lattice.grid, lattice.rates
    modes, p, r, each, w = len(emissions[0]), len(grid), len(rates), len(steps), lattice.width
    sizes = [len(x) for x in steps]
    n = sizes[0]
    table = lambda x: np.stack([np.pad(np.asarray(v, float), (0, n - len(v))) for v in x])
    step, shift, pull = table(steps), table(shifts), table(pulls)
    top = [e.max(axis=(0, 2)) for e in emissions]
    like = np.zeros((n, modes, each, 1, w))  # none beside the grid
    for i, (e, t) in enumerate(zip(emissions, top, strict=True)):
        like[: sizes[i], :, i, 0, PAD:-PAD] = np.exp(e - t[None, :, None]).transpose(1, 0, 2)
    active = [sum(s > i for s in sizes) for i in range(n)]
    mixed = np.ascontiguousarray(mix.T)

    def switched(a: np.ndarray, chances: np.ndarray, name: str) -> np.ndarray:
        return np.matmul(chances, a.reshape(modes, -1), out=lattice.room(name, (modes, a.size // modes))).reshape(a.shape)

    def moves(i: int) -> EvenShifts | PulledShifts:
        k = active[i]
        return lattice.moves(step[:k, i], shift[:k, i], pull[:k, i], center[:k], i % block)

    def forward(a: np.ndarray, i: int, way: EvenShifts | PulledShifts, name: tuple) -> tuple[np.ndarray, np.ndarray]:
        a = a[:, : active[i]]
        a = switched(a, switch.T, "switched") if switch is not None and modes > 1 else a
        a = way.ahead(np.matmul(mixed, a, out=lattice.room("mixed", a.shape)), lattice.room(name, a.shape))
        a *= like[i, :, : active[i]]
        a -= 1e-200  # numbers that small are slow, and count for nothing
        np.maximum(a, 0.0, out=a)
        mass = a.sum(axis=(0, 2, 3))
        lost = mass <= 0
        a *= 1 / np.where(lost, 1.0, mass)[:, None, None]
        if lost.any():
            a[:, lost] = 0.0
            a[:, lost, :, PAD:-PAD] = 1 / (modes * r * p)
        return a, np.where(lost, -690.0, np.log(np.where(lost, 1.0, mass)))

    first = ((grid[None, :] - start[:, None]) / start_sd)[:, None, :] ** 2 + ((rates[None, :] - rate[:, None]) / rate_sd)[:, :, None] ** 2
    first = np.exp(-0.5 * (first - first.min(axis=(1, 2), keepdims=True)))  # a start beyond the lattice begins at its edge
    a = np.zeros((modes, each, r, w))
    a[0, :, :, PAD:-PAD] = first / first.sum(axis=(1, 2), keepdims=True)
    block = n if 6 * n * a.nbytes <= KEPT_BYTES else max(1, int(np.ceil(np.sqrt(n))))
    kept, loglik = [], np.array([float(t.sum()) for t in top])
    for i in range(0 if block < n else n, n):
        if i % block == 0:
            kept.append(a.copy())
        a, gain = forward(a, i, moves(i), ("state", i % 2))
        loglik[: active[i]] += gain
    if block >= n:
        kept = [a]
    post, of_first = np.zeros((n, each, p)), np.zeros((n, each))
    b = np.ones((modes, 0, r, w))
    for k in range(len(kept) - 1, -1, -1):
        rows = range(k * block, min(n, (k + 1) * block))
        ways = [moves(i) for i in rows]
        a, ahead = kept[k], []
        for i in rows:
            a, gain = forward(a, i, ways[i - rows[0]], ("states", i - rows[0]))
            ahead.append(a)
            if block >= n:
                loglik[: active[i]] += gain
        for i in reversed(rows):
            b = np.concatenate((b, np.ones((modes, active[i] - b.shape[1], r, w))), axis=1) if b.shape[1] < active[i] else b
            joint = ahead.pop()
            both = np.multiply(joint, b, out=lattice.room("both", joint.shape))
            mass = both.sum(axis=(0, 2, 3))
            joint = np.where((mass > 0)[:, None, None], both, joint) if (mass <= 0).any() else both
            by_mode = joint.sum(axis=2)[:, :, PAD:-PAD]
            by_mode = by_mode / np.where(mass > 0, mass, 1.0)[:, None]
            post[i, : active[i]], of_first[i, : active[i]] = by_mode.sum(axis=0), by_mode[0].sum(axis=1)
            seen = np.multiply(b, like[i, :, : active[i]], out=lattice.room("seen", b.shape))
            b = np.matmul(mix, ways[i - rows[0]].back(seen, lattice.room("back", b.shape)), out=lattice.room("b", b.shape))
            b = switched(b, switch, "switched back") if switch is not None and modes > 1 else b
            b *= 1 / np.maximum(b[..., PAD:-PAD].max(axis=(0, 2, 3)), 1e-300)[:, None, None]
    out = []
    for i, size in enumerate(sizes):
        mass = post[:size, i]
        mean = mass @ grid
        sd = np.sqrt(np.maximum(0.0, mass @ grid**2 - mean**2))
        out.append({"mean": mean, "sd": sd, "first_mode": of_first[:size, i], "second_peak": second_peaks(mass, grid, apart), "loglik": np.full(size, loglik[i])})
    return out


def second_peaks(mass: np.ndarray, grid: np.ndarray, apart: float) -> np.ndarray:
    """Of each row of `mass` the height of the highest local maximum at least `apart` from the highest one, as a part of it; 0 if there is none."""
    edge = np.pad(mass, ((0, 0), (1, 1)), constant_values=-1.0)
    best = mass.argmax(axis=1)
    far = (edge[:, 1:-1] > edge[:, :-2]) & (edge[:, 1:-1] >= edge[:, 2:]) & (np.abs(grid[None, :] - grid[best][:, None]) >= apart)
    high = mass[np.arange(len(mass)), best]
    return np.where(high > 0, np.where(far, mass, 0.0).max(axis=1, initial=0.0) / np.where(high > 0, high, 1.0), 0.0)


def second_peak(mass: np.ndarray, grid: np.ndarray, apart: float) -> float:
    """`second_peaks` of one row."""
    return float(second_peaks(mass[None], grid, apart)[0])


def gaussian_moments(step: float, sigma: float, phases: int = 101, cells: int = 5) -> np.ndarray:
    """(phase, bias, variance) of a Gaussian dealt to the nearest `cells` grid points by its density, for places from -1/2 to 1/2 of a step beside one."""
    phase = np.linspace(-0.5, 0.5, phases)
    at = (np.arange(cells) - cells // 2) * step
    w = np.exp(-0.5 * ((at[None, :] - phase[:, None] * step) / sigma) ** 2)
    w /= w.sum(axis=1, keepdims=True)
    mean = w @ at
    return np.stack((phase, mean - phase * step, w @ at**2 - mean**2), axis=1)


def beam(step: np.ndarray, observed: np.ndarray, cx: np.ndarray, cy: np.ndarray, start: float, moves: np.ndarray, width: int = 32, move_cost: float = 15.0, scale: float = 100.0) -> np.ndarray:
    """The cheapest path when each row adds a move to the rate-free position: |move| * move_cost and squared error / scale.

    After every row the `width` cheapest states are kept, ties to the lower position; a missing observation costs nothing.
    """
    x, cost, trail = np.array([start]), np.zeros(1), []
    for s, seen in zip(step, observed, strict=True):
        nx = (x[:, None] + moves[None, :] * s).ravel()
        c = (cost[:, None] + np.abs(moves)[None, :] * move_cost).ravel()
        if np.isfinite(seen):
            c = c + (seen - np.interp(nx, cx, cy)) ** 2 / scale
        top = np.lexsort((nx, c))[:width]
        trail.append((top // len(moves), nx[top]))
        x, cost = nx[top], c[top]
    out, at = np.empty(len(step)), 0
    for i in range(len(step) - 1, -1, -1):
        out[i] = trail[i][1][at]
        at = trail[i][0][at]
    return out


def dtw(a: np.ndarray, b: np.ndarray, band: float = 0.12) -> float:
    """The banded warping distance of two series by absolute difference, a step's cost summed along the path."""
    n, m = len(a), len(b)
    w = max(int(np.ceil(band * max(n, m))), abs(n - m))
    last = np.full(m + 1, np.inf)
    last[0] = 0
    for i in range(1, n + 1):
        now = np.full(m + 1, np.inf)
        for j in range(max(1, i - w), min(m, i + w) + 1):
            now[j] = abs(a[i - 1] - b[j - 1]) + min(last[j], last[j - 1], now[j - 1])
        last = now
    return float(last[m])


def dtw_each(a: np.ndarray, bs: np.ndarray, band: float = 0.12) -> np.ndarray:
    """`dtw` of a series to each row of `bs`, a diagonal of the table at a time."""
    n, m = len(a), bs.shape[1]
    w = max(int(np.ceil(band * max(n, m))), abs(n - m))
    before, last, now = (np.full((len(bs), n + 1), np.inf) for _ in range(3))
    before[:, 0] = 0
    for d in range(2, n + m + 1):
        low, high = max(1, d - m, -((w - d) // 2)), min(n, d - 1, (d + w) // 2)
        now[:, max(0, low - 2) : high + 3] = np.inf
        if low <= high:
            cost = np.abs(a[low - 1 : high] - bs[:, d - high - 1 : d - low][:, ::-1])
            now[:, low : high + 1] = cost + np.minimum(np.minimum(last[:, low - 1 : high], last[:, low : high + 1]), before[:, low - 1 : high])
        before, last, now = last, now, before
    return last[:, n].copy()


def rts(axis: np.ndarray, seen: np.ndarray, noise: float, drift: float) -> dict[str, np.ndarray]:
    """A level and its rate smoothed both ways (Rauch-Tung-Striebel), with the level's variance; missing values are bridged."""
    axis, seen = np.asarray(axis, float).tolist(), np.asarray(seen, float).tolist()
    m0, m1, v00, v01, v11 = next((x for x in seen if math.isfinite(x)), 0.0), 0.0, 1e6, 0.0, 1.0
    before, known = [], []  # each row's state before and after its value
    last = axis[0] if axis else 0.0
    for at, y in zip(axis, seen, strict=True):
        d, last = at - last, at
        m0, v00, v01, v11 = m0 + d * m1, v00 + 2 * d * v01 + d * d * v11 + drift * d**3 / 3, v01 + d * v11 + drift * d**2 / 2, v11 + drift * d
        before.append((d, m0, m1, v00, v01, v11))
        if math.isfinite(y):
            k0, k1, e = v00 / (v00 + noise), v01 / (v00 + noise), y - m0
            m0, m1, v00, v01, v11 = m0 + k0 * e, m1 + k1 * e, v00 - k0 * v00, v01 - k0 * v01, v11 - k1 * v01
        known.append((m0, m1, v00, v01, v11))
    level, variance = np.zeros(len(axis)), np.zeros(len(axis))
    for i in range(len(axis) - 1, -1, -1):
        if i < len(axis) - 1:
            d, s0, s1, s00, s01, s11 = before[i + 1]
            p0, p1, p00, p01, p11 = known[i]
            a0, a1 = p00 + d * p01, p01 + d * p11
            det = s00 * s11 - s01 * s01
            if det > 1e-15 * (s00 + s11) ** 2:
                i00, i01, i11 = s11 / det, -s01 / det, s00 / det
            else:
                (i00, i01), (_, i11) = np.linalg.pinv(np.array([[s00, s01], [s01, s11]])).tolist()
            g00, g01, g10, g11 = a0 * i00 + p01 * i01, a0 * i01 + p01 * i11, a1 * i00 + p11 * i01, a1 * i01 + p11 * i11
            e0, e1, w00, w01, w11 = m0 - s0, m1 - s1, v00 - s00, v01 - s01, v11 - s11
            m0, m1 = p0 + g00 * e0 + g01 * e1, p1 + g10 * e0 + g11 * e1
            v00 = p00 + g00 * g00 * w00 + 2 * g00 * g01 * w01 + g01 * g01 * w11
            v01 = p01 + g00 * g10 * w00 + (g00 * g11 + g01 * g10) * w01 + g01 * g11 * w11
            v11 = p11 + g10 * g10 * w00 + 2 * g10 * g11 * w01 + g11 * g11 * w11
        level[i], variance[i] = m0, v00
    return {"level": level, "variance": variance}


def switching_path(cost: np.ndarray, switch: float) -> np.ndarray:
    """The candidate of each row (rows x candidates of cost) on the cheapest path when every change costs `switch`; the first wins ties."""
    n, k = cost.shape
    back, total = np.zeros((n, k), int), cost[0].copy()
    for i in range(1, n):
        best = int(np.argmin(total))
        stay = total <= total[best] + switch
        back[i] = np.where(stay, np.arange(k), best)
        total = np.where(stay, total, total[best] + switch) + cost[i]
    out = np.empty(n, int)
    out[-1] = int(np.argmin(total))
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def huber_line(x: np.ndarray, y: np.ndarray, rounds: int = 10, delta: float = 1.345) -> tuple[float, float]:
    """(slope, intercept) by a fixed number of reweighted least squares; the slope is 1 where all of x is equal."""
    w = np.ones(len(x))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        var = np.average((x - mx) ** 2, weights=w)
        a = np.average((x - mx) * (y - my), weights=w) / var if var > 1e-18 * (1 + mx * mx) else 1.0  # equal values differ from their mean by rounding
        b = my - a * mx
        e = np.abs(y - a * x - b)
        s = 1.4826 * np.median(e)
        w = np.ones(len(x)) if s == 0 else np.minimum(1.0, delta * s / np.maximum(e, 1e-12))
    return float(a), float(b)


def affine_calibration(df: DataFrame, key: str, x: str, y: str, least: int, k: float) -> DataFrame:
    """(key, n, valid, slope, intercept): a robust line of y on x for each group, drawn to the identity by n / (n + k)."""

    def grouped(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part[np.isfinite(part[x].to_numpy(float)) & np.isfinite(part[y].to_numpy(float))]
        n = len(part)
        a, b = huber_line(part[x].to_numpy(float), part[y].to_numpy(float)) if n >= least else (1.0, 0.0)
        s = n / (n + k)
        return pd.DataFrame({key: [group[0]], "n": [n], "valid": [n >= least], "slope": [1 + s * (a - 1)], "intercept": [s * b]})

    return df.groupBy(key).applyInPandas(grouped, f"{key} {df.schema[key].dataType.simpleString()}, n long, valid boolean, slope double, intercept double")


def savgol(key: str, order: str, column: str):
    """A quadratic smoothed over 5 rows by its fixed weights; null within 2 rows of an end."""
    w = Window.partitionBy(key).orderBy(order)
    weights = {-2: -3, -1: 12, 0: 17, 1: 12, 2: -3}
    return sum((c / 35 * F.lag(column, -k).over(w) for k, c in weights.items()), F.lit(0.0))


def savgol_weights(width: int, degree: int) -> np.ndarray:
    """Row p: the weights by which `width` values give their least-squares polynomial's value at place p."""
    x = np.linspace(-1, 1, width)
    powers = np.vander(x, degree + 1)
    return powers @ np.linalg.pinv(powers)


def savgol_groups(df: DataFrame, key: str, order: str, column: str, window: int = 17, degree: int = 3, least: int = 5) -> DataFrame:
    """(key, order, smooth): each series smoothed by polynomials over `window` rows, or the largest odd number of rows that it has.

    A row is the middle of its window; near an end it lies where it does in the first or last window. Series with a window of fewer than
    `least` rows stay as they are; a window with a missing value gives null. A series travels as one sorted array, as its windows overlap.
    """
    widths = range(least, window + 1, 2)
    table = F.array(*(F.array(*(F.array(*(F.lit(float(w)) for w in row)) for row in savgol_weights(n, degree))) for n in widths))
    whole = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).cast("double").alias("y")))).alias("s")).select(key, F.col("s.o").alias("o"), F.col("s.y").alias("y"))
    n = F.size("y")
    width = F.least(F.lit(window), n - 1 + n % 2)
    whole = whole.withColumn("w", width).withColumn("t", F.when(F.col("w") >= least, F.element_at(table, F.greatest((F.col("w") - least) / 2 + 1, F.lit(1)).cast("int"))))

    def value(y: Column, i: Column) -> Column:
        start = F.greatest(F.lit(0), F.least(i - (F.col("w") - 1) / 2, F.size("y") - F.col("w"))).cast("int")
        terms = F.zip_with(F.slice("y", start + 1, F.col("w")), F.element_at("t", (i - start + 1).cast("int")), lambda a, b: a * b)
        return F.when(F.col("t").isNull(), y).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))

    smooth = whole.select(key, "o", F.transform("y", value).alias("v"))
    return smooth.select(key, F.explode(F.arrays_zip("o", "v")).alias("r")).select(key, F.col("r.o").alias(order), F.col("r.v").alias("smooth"))


def detail_energy(key: str, order: str, column: str, sizes=(4, 8, 16)) -> dict:
    """The squared difference of successive rolling means, scale by scale."""
    w = Window.partitionBy(key).orderBy(order)
    means = [F.avg(column).over(w.rowsBetween(1 - s, 0)) for s in (1, *sizes)]
    return {f"detail_{s}": F.pow(b - a, 2) for s, a, b in zip(sizes, means[:-1], means[1:], strict=True)}


def sticky_filter(df: DataFrame, key: str, order: str, good: str, bad: str, stay: tuple[float, float], start: float) -> DataFrame:
    """(key, order, p_good): the forward filter of a two-state chain with log-likelihoods `good` and `bad`.

    The state is one number. A series travels as sorted arrays and is passed over once.
    """
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(good).cast("double").alias("g"), F.col(bad).cast("double").alias("b")))).alias("s"))

    @F.pandas_udf("array<double>")
    def chances(goods: pd.Series, bads: pd.Series) -> pd.Series:
        out = []
        for g, b in zip(goods, bads, strict=True):
            ratio = np.exp(np.clip(np.asarray(b, float) - np.asarray(g, float), -700, 700)).tolist()
            p, path = float(start), []
            for x in ratio:
                prior = p * stay[0] + (1 - p) * (1 - stay[1])
                p = prior / (prior + (1 - prior) * x)
                path.append(p)
            out.append(path)
        return pd.Series(out)

    filtered = rows.select(key, F.col("s.o").alias("o"), chances("s.g", "s.b").alias("p"))
    return filtered.select(key, F.explode(F.arrays_zip("o", "p")).alias("f")).select(key, F.col("f.o").alias(order), F.col("f.p").alias("p_good"))
