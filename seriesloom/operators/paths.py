"""The cheapest paths on a grid, several at once, and what they say together."""

from __future__ import annotations

import numpy as np


def running_mean(seen: np.ndarray, radius: int) -> np.ndarray:
    """The mean of the values within `radius` rows that are there; none where the row itself has none."""
    there = np.isfinite(seen)
    sums, counts = (np.concatenate(([0.0], np.cumsum(x))) for x in (np.where(there, seen, 0.0), there))
    low, high = np.maximum(np.arange(len(seen)) - radius, 0), np.minimum(np.arange(len(seen)) + radius + 1, len(seen))
    return np.where(there, (sums[high] - sums[low]) / np.maximum(counts[high] - counts[low], 1), np.nan)


def cheapest_paths(seen: np.ndarray, values: np.ndarray, start: int, moves: np.ndarray, k: int = 8, width: int = 32, move_cost: float = 15.0, scale: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """(cells, costs) of the k cheapest different paths over a grid of `values`, cheapest first.

    Before each row a path moves by one of `moves` (whole cells), for |move| * move_cost; at the row it pays the squared
    difference of seen and its cell's value over `scale`, or nothing where none was seen. Paths that meet in a cell
    go on together: of a cell the k cheapest ways to it are kept, and after each row of the cells those `width`
    whose cheapest way costs least. Of equal costs the way by the earlier of `moves` counts, then that
    which was cheaper before; of cells the lower. Without the limit of `width` the paths are the cheapest of all. Fewer than k
    paths come back if there are no more.
    """
    return cheapest_paths_each([seen], [values], [start], moves, k, width, move_cost, scale)[0]


#: Rows of the series that go side by side at most, so that what is kept of their ways stays small.
ROWS_TOGETHER = 20_000


def cheapest_paths_each(seen: list[np.ndarray], values: list[np.ndarray], starts: list[int], moves: np.ndarray, k: int = 8, width: int = 32, move_cost: float = 15.0, scale: float = 100.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """`cheapest_paths` of several series over grids of one size, side by side; each one's are those of a run of its own, bit for bit."""
    order = sorted(range(len(seen)), key=lambda s: -len(seen[s]))
    out, at = {}, 0
    while at < len(order):  # series of like lengths
        some = order[at : at + max(1, ROWS_TOGETHER // max(1, len(seen[order[at]])))]
        got = _side_by_side([seen[s] for s in some], np.stack([values[s] for s in some]), np.array([starts[s] for s in some]), moves, k, width, move_cost, scale)
        out |= dict(zip(some, got, strict=True))
        at += len(some)
    return [out[s] for s in range(len(seen))]


def _side_by_side(seen: list[np.ndarray], values: np.ndarray, low: np.ndarray, moves: np.ndarray, k: int, width: int, move_cost: float, scale: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Series from the longest to the shortest. Costs are (series, cells from `low`, ways); beyond the cells that hold a path they are infinite."""
    lengths, size, m = np.array([len(x) for x in seen]), values.shape[1], len(moves)
    rows, first_move, reach = int(lengths[0]), int(moves.min()), int(np.ptp(moves))
    signal = np.full((len(seen), rows), np.nan)
    for s, x in enumerate(seen):
        signal[s, : len(x)] = x
    active = [int((lengths > i).sum()) for i in range(rows)] + [0]
    pay, every = np.abs(moves) * move_cost, np.arange(len(seen))[:, None]
    cost = np.full((len(seen), 1, k), np.inf)
    cost[:, 0, 0] = 0.0
    came, lows = [], []
    at, way, ends, counts = np.zeros((len(seen), k), np.int64), np.zeros((len(seen), k), np.int64), np.full((len(seen), k), np.inf), np.zeros(len(seen), int)

    def close(these: slice) -> None:
        flat = cost[these].reshape(len(cost[these]), cost.shape[1] * k)
        best = np.argsort(flat, axis=1, kind="stable")[:, :k]
        n = best.shape[1]
        ends[these, :n] = np.take_along_axis(flat, best, axis=1)
        counts[these] = np.isfinite(ends[these]).sum(axis=1)
        at[these, :n], way[these, :n] = low[these, None] + best // k, best % k

    for i in range(rows):
        n = active[i]
        close(slice(n, len(cost)))
        cost, low = cost[:n], low[:n]
        wide = cost.shape[1]
        ways = np.full((n, wide + reach, m, k), np.inf)
        for j, move in enumerate(moves):
            np.add(cost, pay[j], out=ways[:, move - first_move : move - first_move + wide, j])
        low = low + first_move
        ways = ways.reshape(n, wide + reach, m * k)
        first = np.argsort(ways, axis=2, kind="stable")[:, :, :k].astype(np.int16)
        now = np.take_along_axis(ways, first, axis=2)
        cells = low[:, None] + np.arange(wide + reach)
        there = np.isfinite(signal[:n, i])[:, None]
        now += np.where(there, (signal[:n, i, None] - values[every[:n], np.clip(cells, 0, size - 1)]) ** 2 / scale, 0.0)[:, :, None]
        now[(cells < 0) | (cells >= size)] = np.inf
        if wide + reach > width:
            now[every[:n], np.argsort(now[:, :, 0], axis=1, kind="stable")[:, width:]] = np.inf
        came.append(first)
        lows.append(low)
        held = np.isfinite(now[:, :, 0])
        lead, last = held.argmax(axis=1), wide + reach - held[:, ::-1].argmax(axis=1)
        kept = lead[:, None] + np.arange(int((last - lead).max()))
        cost = now[every[:n], np.minimum(kept, wide + reach - 1)]
        cost[kept >= last[:, None]] = np.inf
        low = low + lead
    close(slice(0, len(cost)))
    cells = np.empty((len(seen), k, rows), np.int64)
    for i in range(rows - 1, -1, -1):
        n = active[i]
        cells[:n, :, i] = at[:n]
        got = came[i][every[:n], np.clip(at[:n] - lows[i][:, None], 0, came[i].shape[1] - 1), way[:n]]
        way[:n] = got % k
        at[:n] -= moves[got // k]
    return [(cells[s, :c, : lengths[s]], ends[s, :c]) for s, c in enumerate(counts)]


def path_posterior(places: np.ndarray, costs: np.ndarray, temperatures: tuple[float, ...]) -> dict[str, np.ndarray]:
    """Blends of whole paths (rows of `places`) by the softmax of -cost / temperature.

    `blend_<t>` and `entropy_<t>` (of the weights, in nats) for each temperature; `top`, the cheapest path; `spread`, from the
    lowest to the highest path at a row; `gap`, by how much the second path costs more (null without one).
    """
    n = places.shape[1]
    out = {"top": places[0], "spread": places.max(axis=0) - places.min(axis=0), "gap": np.full(n, costs[1] - costs[0] if len(costs) > 1 else np.nan)}
    for t in temperatures:
        w = np.exp(-(costs - costs[0]) / t)
        w /= w.sum()
        out[f"blend_{t:g}"] = w @ places
        out[f"entropy_{t:g}"] = np.full(n, -(w * np.log(np.maximum(w, 1e-300))).sum())
    return out
