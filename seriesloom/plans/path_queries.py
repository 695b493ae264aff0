"""Queries of several paths at once. SQL can't express them; tests hold them against all paths there are."""

from __future__ import annotations

import numpy as np
import pandas as pd

from seriesloom.operators import decoders, paths
from seriesloom.plans.base import KEY, ROW, query
from seriesloom.plans.decoder_queries import GRID, TOGETHER, _calibrated, _curve

#: Paths that are kept, moves in cells of the grid, the temperatures of their blends, and the radius of the running mean with the cells kept, for each variant.
TOP, MOVES, TEMPERATURES = 8, np.array([0, -1, 1, -2, 2]), (1.0, 2.0, 4.0, 8.0, 16.0)
VARIANTS = {"raw": (0, 32), "sm5": (5, 32), "sm11": (11, 64)}
_COLUMNS = ["top", "spread", "gap", *(f"{w}_{t:g}" for t in TEMPERATURES for w in ("blend", "entropy"))]


@query("beam_top_paths")
def beam_top_paths(spark, sf_dir):
    """For each tail row the cheapest path, and blends of the eight cheapest by temperature, over observations as they are and smoothed."""

    def kernel(rows: list[pd.DataFrame], cx: list[np.ndarray], cy: list[np.ndarray]) -> list[dict]:
        seen, values = [x["observed"].to_numpy(float) for x in rows], [np.interp(GRID, *c) for c in zip(cx, cy, strict=True)]
        starts = [int(np.argmin(np.abs(GRID - float(x["start"][0])))) for x in rows]
        out = [{} for _ in rows]
        for name, (radius, width) in VARIANTS.items():
            got = paths.cheapest_paths_each([paths.running_mean(x, radius) for x in seen], values, starts, MOVES, TOP, width)
            for one, (cells, costs) in zip(out, got, strict=True):
                one |= {f"{name}_{c}": v for c, v in paths.path_posterior(GRID[cells], costs, TEMPERATURES).items()}
        return out

    columns = ", ".join(f"{name}_{c} double" for name in VARIANTS for c in _COLUMNS)
    return decoders.decode(_calibrated(spark, sf_dir), _curve(spark, sf_dir), KEY, "curve", ROW, kernel, columns, "cx", "cy", TOGETHER)
