"""Streaming forms: running state, sessions, windows, and a filter that emits one estimate an observation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def columns_of(parts: Iterator[pd.DataFrame], order: str, *names: str) -> list[list]:
    """Values of a key's rows by `order`, of `order` itself first, and then of `names`; a frame is made only if rows came in several."""
    parts = list(parts)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    at = rows[order].to_numpy()
    values = [at, *(rows[n].to_numpy() for n in names)]
    if len(at) > 1 and not (at[1:] >= at[:-1]).all():
        by = np.argsort(at, kind="stable")
        values = [v[by] for v in values]
    return [v.tolist() for v in values]


def running_error(stream: DataFrame, key: str, error: str) -> DataFrame:
    """(key, rows, sse): sums that grow with the stream; complete or update mode."""
    return stream.groupBy(key).agg(F.count(error).alias("rows"), F.sum(F.col(error) * F.col(error)).alias("sse"))


def windowed(stream: DataFrame, key: str, time: str, value: str, size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """(start, key, rows, mean) by tumbling or sliding windows; rows later than `late` are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("rows"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "rows", "mean")


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str = "1 day") -> DataFrame:
    """(key, start, end, rows): runs of rows less than `gap` apart."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), key).agg(F.count("*").alias("rows")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "rows")


def online_filter(stream: DataFrame, key: str, order: str, value: str, noise: float, drift: float) -> DataFrame:
    """(key, order, level, variance): a scalar Kalman filter of each series over micro-batches; state is two numbers a key."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, var = state.get if state.exists else (0.0, 1e6)
        orders, values = columns_of(parts, order, value)
        levels, variances = [], []
        for x in values:
            var += drift
            if x is not None and x == x:
                k = var / (var + noise)
                level, var = level + k * (x - level), (1 - k) * var
            levels.append(level)
            variances.append(var)
        state.update((level, var))
        yield pd.DataFrame({key: group[0], order: orders, "level": levels, "variance": variances})

    kind = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {order} {kind[order]}, level double, variance double", "level double, variance double", "append", GroupStateTimeout.NoTimeout)


def _kinds(stream: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in stream.schema}


def smoothed(means: list[float], variances: list[float], drift: float) -> tuple[list[float], list[float]]:
    """Levels of a random walk and their variances, learned from all rows, from those each learned from the rows before it and its own."""
    level, var = list(means), list(variances)
    for i in range(len(means) - 2, -1, -1):
        ahead = variances[i] + drift
        gain = variances[i] / ahead
        level[i] = means[i] + gain * (level[i + 1] - means[i])
        var[i] = variances[i] + gain * gain * (var[i + 1] - ahead)
    return level, var


def fixed_lag_smoother(stream: DataFrame, key: str, order: str, value: str, noise: float, drift: float, lag: int = 192, idle_ms: int | None = None) -> DataFrame:
    """(key, order, level, variance): each row's level once `lag` later rows are known, which it learns from too.

    State is `lag` rows a key. With `idle_ms`, a key that is silent so long gives its last rows with what is known;
    without, they wait. Rows of a key come in order from batch to batch.
    """

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        orders, means, variances = (list(x) for x in state.get) if state.exists else ([], [], [])
        out = []
        if state.hasTimedOut:
            out = list(zip(orders, *smoothed(means, variances, drift), strict=True))
            state.remove()
        else:
            for o, x in zip(*columns_of(parts, order, value), strict=True):
                level, var = (means[-1], variances[-1] + drift) if means else (0.0, 1e6)
                if x is not None and x == x:
                    gain = var / (var + noise)
                    level, var = level + gain * (x - level), (1 - gain) * var
                orders.append(o)
                means.append(float(level))
                variances.append(float(var))
                if len(orders) > lag:
                    levels, spreads = smoothed(means, variances, drift)
                    out.append((orders.pop(0), levels[0], spreads[0]))
                    means.pop(0)
                    variances.pop(0)
            state.update((orders, means, variances))
            if idle_ms:
                state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame([(group[0], *r) for r in out], columns=[key, order, "level", "variance"])

    kind = _kinds(stream)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {order} {kind[order]}, level double, variance double", f"orders array<{kind[order]}>, means array<double>, variances array<double>", "append", timeout)


def refractory_triggers(stream: DataFrame, key: str, order: str, trigger: str, gap: int) -> DataFrame:
    """(key, order) of the triggers that are accepted: the first, and each at least `gap` after the last accepted one. State is one number a key."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for o, hit in zip(*columns_of(parts, order, trigger), strict=True):
            if hit is not None and hit == hit and hit and (last is None or o - last >= gap):
                last = o
                out.append(o)
        if out:
            state.update((last,))
            yield pd.DataFrame({key: group[0], order: out})

    kind = _kinds(stream)
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind[key]}, {order} {kind[order]}", f"last {kind[order]}", "append", GroupStateTimeout.NoTimeout)


def row_blocks(stream: DataFrame, key: str, order: str, value: str, size: int = 512, step: int = 256) -> DataFrame:
    """(key, block, rows, mean) of every full block of `size` rows, one starting at every `step` rows of a key. State is a count and a sum for each open block."""

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, counts, sums = (state.get[0], list(state.get[1]), list(state.get[2])) if state.exists else (0, [], [])
        out = []
        for x in columns_of(parts, order, value)[1]:
            if at % step == 0:
                counts.append(0)
                sums.append(0.0)
            if x is not None and x == x:
                counts = [c + 1 for c in counts]
                sums = [s + float(x) for s in sums]
            at += 1
            first = (at - size) // step if at >= size else -1
            if first >= 0 and (at - size) % step == 0:
                n, total = counts.pop(0), sums.pop(0)
                out.append((group[0], first, size, total / n if n else None))
        state.update((at, counts, sums))
        if out:
            yield pd.DataFrame(out, columns=[key, "block", "rows", "mean"])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {_kinds(stream)[key]}, block long, rows long, mean double", "at long, counts array<long>, sums array<double>", "append", GroupStateTimeout.NoTimeout)
