"""Ground classification by cloth simulation (Zhang et al. 2016): the cloud is turned upside down, a cloth falls on it, and points near
where it comes to rest are ground. A tile at a time; the cloth has one particle per cell, so a task's memory goes with the tile's area."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cloth(xyz: np.ndarray, cell: float = 500.0, rigidness: int = 3, iterations: int = 500, step: float = 0.65, settled: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """(lowest cell, heights of the settled cloth in mm by cell): gravity moves free particles down, then neighbours in a row or column
    are drawn together `rigidness` times, by half their difference between two free ones, by all of it beside a particle at rest."""
    at = np.floor(xyz[:, :2] / cell).astype(np.int64)
    low = at.min(0) - 1
    shape = tuple(np.ptp(at, axis=0) + 3)
    z = -xyz[:, 2].astype(np.float64)
    rest = np.full(shape, -np.inf)
    np.maximum.at(rest, tuple((at - low).T), z)
    for _ in range(sum(shape)):  # cells without points take the highest of their neighbours
        empty = np.isinf(rest)
        if not empty.any():
            break
        wide = np.pad(rest, 1, constant_values=-np.inf)
        around = np.max([wide[1 + a : 1 + a + shape[0], 1 + b : 1 + b + shape[1]] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        rest = np.where(empty, around, rest)
    height = np.full(shape, z.max() + 50.0)
    before, free = height.copy(), np.ones(shape, bool)
    fall = 9.8 * 1000 * step**2 / 100
    for _ in range(iterations):
        new = height + np.where(free, 0.99 * (height - before) - fall, 0.0)
        before, height = height, new
        for _ in range(rigidness):
            for axis in (0, 1):
                for start in (0, 1):
                    h, f = np.moveaxis(height, axis, 0), np.moveaxis(free, axis, 0)
                    n = (len(h) - start) // 2
                    a, b = slice(start, start + 2 * n, 2), slice(start + 1, start + 2 * n, 2)
                    d = h[b] - h[a]
                    move = np.where(f[a] & f[b], 0.5, 1.0) * d * 0.5
                    h[a] += np.where(f[a], move, 0.0)
                    h[b] -= np.where(f[b], move, 0.0)
        hit = height <= rest
        height = np.where(hit, rest, height)
        free &= ~hit
        if np.abs(height - before)[free].max(initial=0.0) < settled:
            break
    return low, -height


def classify_ground(points: DataFrame, cell: int = 500, rigidness: int = 3, iterations: int = 500, within: int = 500) -> DataFrame:
    """points with classification 2 where the settled cloth of the tile is at most `within` mm away, 1 elsewhere; all other columns are kept."""

    def tile(rows: pd.DataFrame) -> pd.DataFrame:
        xyz = rows[["x_mm", "y_mm", "z_mm"]].to_numpy()
        low, height = cloth(xyz, cell, rigidness, iterations)
        at = np.floor(xyz[:, :2] / cell).astype(np.int64) - low
        near = np.abs(xyz[:, 2] - height[tuple(at.T)]) <= within
        return rows[["tile_id", "point_id"]].assign(_class=np.where(near, 2, 1).astype(np.int32))

    found = points.select("tile_id", "point_id", "x_mm", "y_mm", "z_mm").groupBy("tile_id").applyInPandas(tile, "tile_id string, point_id long, _class int")
    return points.join(found, ["tile_id", "point_id"]).withColumn("classification", F.col("_class")).drop("_class").select(*points.columns)
