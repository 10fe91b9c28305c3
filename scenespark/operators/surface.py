"""A surface mesh of a point cloud: a raster of median heights, freed of spikes, filled and smoothed.

The raster has a bounded number of cells whatever the cloud, so its morphology is one task's numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from .cloud import finite, percentile_trim
from .mesh import cell_means, grid_triangles, supported, surface_cell
from .quantiles import quantiles


def nearest_valid(valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each cell the row and column of a nearest valid one (Euclidean): along rows first, then the
    best of a column's rows."""
    if valid.shape[0] > valid.shape[1]:
        y, x = nearest_valid(valid.T)
        return x.T, y.T
    ny, nx = valid.shape
    at = np.arange(nx)
    left = np.maximum.accumulate(np.where(valid, at, -(10**9)), 1)
    right = np.minimum.accumulate(np.where(valid, at, 10**9)[:, ::-1], 1)[:, ::-1]
    col = np.where(at - left <= right - at, left, right)
    gap = np.minimum(np.abs(col - at), 10**9).astype(np.float64)
    rows = np.arange(ny)
    apart = (rows[:, None] - rows[None]) ** 2.0
    best = np.stack([(apart + gap[:, x] ** 2).argmin(1) for x in range(nx)], 1)
    return best, np.clip(np.take_along_axis(col, best, 0), 0, nx - 1)


def median_filter(a: np.ndarray, size: int) -> np.ndarray:
    half = size // 2
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(a, half, mode="symmetric"), (size, size))
    return np.median(windows.reshape(*a.shape, -1), axis=-1)


def gaussian(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        padded = np.pad(a, [(r, r) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), axis, padded)
    return a


def dilate(m: np.ndarray, rounds: int, corners: bool) -> np.ndarray:
    for _ in range(rounds):
        p = np.pad(m, 1)
        m = m | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
        if corners:
            m = m | p[:-2, :-2] | p[:-2, 2:] | p[2:, :-2] | p[2:, 2:]
    return m


def close_gaps(m: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Grown and shrunk again by squares; what lies beyond the edge counts as empty."""
    grown = np.pad(dilate(m, rounds, True), 1)
    for _ in range(rounds):
        grown = ~dilate(~grown, 1, True)
        grown[[0, -1]] = grown[:, [0, -1]] = False
    return grown[1:-1, 1:-1]


def fill_holes(m: np.ndarray) -> np.ndarray:
    """With all empty cells that cannot reach the edge through empty ones filled."""
    outside = np.zeros(np.add(m.shape, 2), bool)
    outside[[0, -1]] = outside[:, [0, -1]] = True
    free = np.pad(~m, 1, constant_values=True)
    while True:
        grown = outside
        for _ in range(16):
            grown = dilate(grown, 1, False) & free
        if (grown == outside).all():
            return ~outside[1:-1, 1:-1]
        outside = grown


def smooth_raster(height: np.ndarray, colour: np.ndarray, valid: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask, height, colour): spikes against medians of 5 x 5 and 3 x 3 go, small gaps are closed with the
    nearest values, heights smoothed by a median and a masked Gaussian."""
    for size in (5, 3):
        near = nearest_valid(valid)
        valid = valid & (np.abs(height - median_filter(height[near], size)) <= max(2.0 * cell, 1.5))
    mask = fill_holes(close_gaps(valid) | valid) & dilate(valid, 4, False)
    near = nearest_valid(valid)
    height, colour = np.where(valid, height, height[near]), np.where(valid[..., None], colour, colour[near])
    height = median_filter(height, 3)
    weight = gaussian(mask.astype(float))
    height = np.where(weight > 1e-6, gaussian(np.where(mask, height, 0.0)) / np.maximum(weight, 1e-6), height)
    return mask, height, colour


def surface_mesh(points: DataFrame) -> tuple[DataFrame, DataFrame, float] | None:
    """vertices (vid, x, y, z, r, g, b), faces (fid, a, b, c) and the cell size of a surface over points (id,
    e, n, u, r, g, b); None if there are fewer than 50 finite points, 16 cells or 8 faces."""
    ok = written(points.where(finite("e", "n", "u")), "points")
    if ok.count() < 50:
        return None
    lo = quantiles(ok, [("e", 0.005), ("n", 0.005)])
    inside = written(percentile_trim(ok), "points")
    cell = surface_cell(inside)
    key = [F.floor((F.col(a) - o) / cell).cast("int").alias(k) for a, o, k in zip("en", lo, ("ix", "iy"))]
    cells = inside.groupBy(*key).agg(F.median("u").alias("h"), *[F.median(c).alias(c) for c in "rgb"], F.count(F.lit(1)).alias("points"))
    cells = written(supported(cells), "cells")
    if cells.count() < 16:
        return None

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        nx, ny = int(pdf["ix"].max()) + 1, int(pdf["iy"].max()) + 1
        height, colour, valid = np.full((ny, nx), np.nan), np.zeros((ny, nx, 3)), np.zeros((ny, nx), bool)
        at = pdf["iy"].to_numpy(), pdf["ix"].to_numpy()
        height[at], colour[at], valid[at] = pdf["h"], pdf[["r", "g", "b"]].to_numpy(), True
        with np.errstate(invalid="ignore"):
            mask, height, colour = smooth_raster(height, colour, valid, cell)
        y, x = np.nonzero(mask)
        c = np.clip(colour[y, x], 0, 255).astype(np.int32)
        return pd.DataFrame({"vid": np.arange(len(x)), "ix": x.astype(np.int32), "iy": y.astype(np.int32), "x": lo[0] + (x + 0.5) * cell, "y": lo[1] + (y + 0.5) * cell, "z": height[y, x], "r": c[:, 0], "g": c[:, 1], "b": c[:, 2]})

    v = cells.groupBy(F.lit(0).alias("__all")).applyInPandas(lambda pdf: finish(pdf.drop(columns="__all", errors="ignore")), "vid long, ix int, iy int, x double, y double, z double, r int, g int, b int")
    v = written(v, "vertices")
    corners = F.explode(F.array(*[F.struct((F.col("ix") - dx).alias("ix"), (F.col("iy") - dy).alias("iy"), F.lit(2 * dx + dy).alias("k")) for dx in (0, 1) for dy in (0, 1)]))
    squares = v.select(corners.alias("c"), F.struct("vid", "z").alias("v")).groupBy("c.iy", "c.ix").agg(*[F.max(F.when(F.col("c.k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])
    squares = squares.where(" and ".join(f"v{k} is not null" for k in range(4)))
    # corners 0 to 3: here, above, beside, beside and above
    triangle = lambda half, p, q, r: F.struct(F.lit(half).alias("half"), *[F.col(f"v{k}.vid").alias(c) for c, k in zip("abc", (p, q, r))], (F.greatest(*[F.col(f"v{k}.z") for k in (p, q, r)]) - F.least(*[F.col(f"v{k}.z") for k in (p, q, r)])).alias("stretch"))
    faces = squares.select("iy", "ix", F.explode(F.array(triangle(0, 0, 2, 3), triangle(1, 0, 3, 1))).alias("f")).where(F.col("f.stretch") <= max(5.0 * cell, 3.0))
    faces = written(faces.select(((F.col("iy").cast("long") * (1 << 20) + F.col("ix")) * 2 + F.col("f.half")).alias("fid"), "f.a", "f.b", "f.c"), "faces")
    return None if faces.count() < 8 else (v.drop("ix", "iy"), faces, cell)


def plain_mesh(points: DataFrame, cell: float = 1.4) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of the plain grid of cell means."""
    cells = cell_means(points, cell)
    code = lambda x, y: ((x + (1 << 30)) * F.lit(1 << 31).cast("long") + (y + (1 << 30))).cast("long")
    v = cells.select(code(F.col("ix"), F.col("iy")).alias("vid"), F.col("e").alias("x"), F.col("n").alias("y"), F.col("u").alias("z"), "r", "g", "b")
    t = grid_triangles(cells)
    at = lambda dx, dy: code(F.col("ix") + dx, F.col("iy") + dy)
    first = F.col("half") == 0
    return v, t.select((code(F.col("ix"), F.col("iy")) * 2 + F.col("half")).alias("fid"), F.when(first, at(0, 0)).otherwise(at(1, 0)).alias("a"), F.when(first, at(1, 0)).otherwise(at(1, 1)).alias("b"), at(0, 1).alias("c"))


def mesh_from_points(points: DataFrame) -> dict:
    """status, method and the tables of a mesh: the smoothed surface, else the plain grid; skipped, with the
    reason, for fewer than 30 points or 8 faces."""
    if points.limit(30).count() < 30:
        return {"status": "skipped", "reason": "too few points"}
    made = surface_mesh(points)
    if made:
        v, f, cell = made
        return {"status": "ok", "method": "dsm25d", "cell_m": round(cell, 3), "vertices": v, "faces": f}
    v, f = plain_mesh(points)
    if f.limit(8).count() < 8:
        return {"status": "skipped", "reason": "mesh too thin"}
    return {"status": "ok", "method": "grid25d", "fallback_from": "surface grid too sparse", "vertices": v, "faces": f}
