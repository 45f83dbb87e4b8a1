"""Morphology of a peak's mask: set algebra on its cells, and array kernels on its box where order matters."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.operators import kernels
from ridgeline.operators.regions import mask_components
from ridgeline.operators.stencil import offsets


def ball(ndim: int, radius: int = 3) -> list[tuple[int, ...]]:
    """Offsets of a structuring element: a disk or ball in two and three dimensions, else a cube."""
    every = itertools.product(range(-radius, radius + 1), repeat=ndim)
    return [o for o in every if ndim not in (2, 3) or sum(x * x for x in o) <= radius * radius]


def _shifted(members: DataFrame, grid: Grid, element: list[tuple[int, ...]], sign: int = 1) -> DataFrame:
    """Members repeated at every offset of an element, inside the grid."""
    moves = F.array(*(F.struct(*(F.lit(sign * x).alias(f"o{d}") for d, x in enumerate(o))) for o in element))
    rows = members.select("grid_id", "peak_id", *grid.axes, F.explode(moves).alias("m"))
    moved = rows.select("grid_id", "peak_id", *((F.col(a) + F.col(f"m.o{d}")).alias(a) for d, a in enumerate(grid.axes)))
    return moved.where(grid.valid(grid.index()))


def dilate(members: DataFrame, grid: Grid, element: list[tuple[int, ...]]) -> DataFrame:
    return _shifted(members, grid, element).distinct()


def erode(members: DataFrame, grid: Grid, element: list[tuple[int, ...]]) -> DataFrame:
    """Cells all of whose element lies in the mask; outside the grid counts as outside the mask."""
    met = _shifted(members, grid, element, -1).groupBy("grid_id", "peak_id", *grid.axes).agg(F.count("*").alias("_k"))
    return met.where(F.col("_k") == len(element)).drop("_k")


def _size(cells: DataFrame, name: str) -> DataFrame:
    return cells.groupBy("grid_id", "peak_id").agg(F.count("*").alias(name))


def responses(members: DataFrame, grid: Grid, radius: int = 3) -> DataFrame:
    """Erosion, dilation, opening and closing: ratios to the area and cells lost or gained."""
    e = ball(grid.ndim, radius)
    cells = members.select("grid_id", "peak_id", *grid.axes)
    area = _size(cells, "_n")
    eroded, dilated = erode(cells, grid, e), dilate(cells, grid, e)
    out = area
    for name, got in (("_e", eroded), ("_d", dilated), ("_o", dilate(eroded, grid, e)), ("_c", erode(dilated, grid, e))):
        out = out.join(_size(got, name), ["grid_id", "peak_id"], "left")
    out = out.na.fill(0, ["_e", "_d", "_o", "_c"])
    n = F.col("_n")
    return out.select(
        "grid_id", "peak_id",
        (F.col("_e") / n).alias("erosion_ratio"),
        (F.col("_d") / n).alias("dilation_ratio"),
        (F.col("_d") - n).alias("dilation_gain"),
        (F.col("_o") / n).alias("opening_ratio"),
        (n - F.col("_o")).alias("opening_loss"),
        (F.col("_c") / n).alias("closing_ratio"),
        (F.col("_c") - n).alias("closing_gain"),
    )


def inner_boundary(members: DataFrame, grid: Grid) -> DataFrame:
    """Mask cells with a face neighbour in the grid that is outside the mask."""
    element = offsets(grid.ndim, 1)
    cells = members.select("grid_id", "peak_id", *grid.axes)
    inside = _shifted(cells, grid, element, -1).groupBy("grid_id", "peak_id", *grid.axes).agg(F.count("*").alias("_k"))
    possible = sum((F.when(grid.valid([i + s for i, s in zip(grid.index(), o, strict=True)]), 1).otherwise(0) for o in element), F.lit(0))
    met = cells.join(inside, ["grid_id", "peak_id", *grid.axes], "left").withColumn("_p", possible)
    return met.where(F.coalesce("_k", F.lit(0)) < F.col("_p")).select("grid_id", "peak_id", *grid.axes)


def boundary_complexity(members: DataFrame, grid: Grid) -> DataFrame:
    """Inner boundary length, its ratio to the root of the area, and a dimension from the boundary's ranges."""
    edge = inner_boundary(members, grid)
    ranges = [(F.max(a) - F.min(a)).alias(f"_r{d}") for d, a in enumerate(grid.axes)]
    agg = edge.groupBy("grid_id", "peak_id").agg(F.count("*").alias("boundary_length"), *ranges)
    rows = _size(members, "_n").join(agg, ["grid_id", "peak_id"], "left").na.fill(0)
    r = [F.col(f"_r{d}").cast("double") for d in range(grid.ndim)]
    total = sum(r[1:], r[0])
    if grid.ndim == 2:
        dim = F.when((F.col("boundary_length") < 2) | (total == 0), 1.0).otherwise(1 + F.least(F.col("boundary_length") / (2 * total), F.lit(1.0)))
    else:
        top = F.greatest(*r) if grid.ndim > 1 else r[0]
        dim = F.when((F.col("boundary_length") < 2) | (top == 0), 1.0).otherwise(1 + total / grid.ndim / top)
    return rows.select("grid_id", "peak_id", "boundary_length", (F.col("boundary_length") / F.sqrt("_n")).alias("boundary_complexity"), dim.alias("fractal_dimension"))


def concavity(members: DataFrame, grid: Grid) -> DataFrame:
    """Share of right turns between consecutive steps along the inner boundary in row-major order (2-D)."""
    if grid.ndim != 2:
        raise ValueError("concavity along the boundary needs two axes")
    w = Window.partitionBy("grid_id", "peak_id").orderBy("i0", "i1")
    at = lambda a, k: F.lag(a, k).over(w) if k > 0 else F.lead(a, -k).over(w)
    rows = inner_boundary(members, grid).withColumns({"_a0": F.col("i0") - at("i0", 1), "_a1": F.col("i1") - at("i1", 1), "_b0": at("i0", -1) - F.col("i0"), "_b1": at("i1", -1) - F.col("i1")})
    turn = F.col("_a0") * F.col("_b1") - F.col("_a1") * F.col("_b0")
    agg = rows.groupBy("grid_id", "peak_id").agg(F.count("*").alias("_n"), F.count_if(turn < 0).alias("_c"))
    every = members.select("grid_id", "peak_id").distinct().join(agg, ["grid_id", "peak_id"], "left")
    return every.select("grid_id", "peak_id", F.when(F.col("_n") >= 3, F.col("_c") / F.col("_n")).otherwise(0.0).alias("concavity"))


def solidity(members: DataFrame, grid: Grid) -> DataFrame:
    """Share of the bounding box that the mask fills; 1 for fewer than three cells in two dimensions."""
    box = None
    for a in grid.axes:
        e = F.max(a) - F.min(a) + 1
        box = e if box is None else box * e
    ratio = F.count("*") / box
    return members.groupBy("grid_id", "peak_id").agg((F.when(F.count("*") < 3, 1.0).otherwise(ratio) if grid.ndim == 2 else ratio).alias("solidity"))


def connectivity_pattern(members: DataFrame, grid: Grid) -> DataFrame:
    """Components of the mask under full connectivity: count, largest share, population variance of their sizes."""
    sizes = mask_components(members, grid.ndim, grid.ndim).groupBy("grid_id", "peak_id", "component").agg(F.count("*").alias("s"))
    agg = sizes.groupBy("grid_id", "peak_id").agg(F.count("*").alias("components"), F.max("s").alias("_m"), F.sum("s").alias("_n"), F.var_pop("s").alias("size_variance"), F.sort_array(F.collect_list("s"), False).alias("component_sizes"))
    return agg.select("grid_id", "peak_id", "components", (F.col("_m") / F.col("_n")).alias("largest_share"), "size_variance", "component_sizes")


def euler_number(members: DataFrame, grid: Grid) -> DataFrame:
    """Components less holes in two dimensions (faces connect both), components in others."""
    steps, axes = offsets(grid.ndim, 1), grid.axes

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[axes].to_numpy()
        parts = len(np.unique(kernels.label_equal(at, np.zeros(len(at)), steps)))
        holes = 0
        if len(axes) == 2:
            low, high = at.min(axis=0) - 1, at.max(axis=0) + 1  # a frame of outside cells around the box
            shape = high - low + 1
            mask = np.zeros(shape, bool)
            mask[tuple((at - low).T)] = True
            back = np.argwhere(~mask)
            holes = len(np.unique(kernels.label_equal(back, np.zeros(len(back)), steps))) - 1
        return pd.DataFrame({"grid_id": [pdf["grid_id"].iloc[0]], "peak_id": [pdf["peak_id"].iloc[0]], "euler_number": [parts - holes]})

    return members.select("grid_id", "peak_id", *axes).groupBy("grid_id", "peak_id").applyInPandas(count, "grid_id string, peak_id long, euler_number long")


def erosion_depth(members: DataFrame, grid: Grid, most: int = 50) -> DataFrame:
    """``(grid_id, peak_id, erosion_iterations)``: erosions by the 3^n cube until nothing is left."""
    axes = grid.axes

    def depth(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[axes].to_numpy()
        low = at.min(axis=0) - 1
        mask = np.zeros(at.max(axis=0) - low + 2, bool)
        mask[tuple((at - low).T)] = True
        n = 0
        while mask.any() and n < most:
            for axis in range(mask.ndim):
                mask = mask & np.roll(mask, 1, axis) & np.roll(mask, -1, axis)
            n += 1
        return pd.DataFrame({"grid_id": [pdf["grid_id"].iloc[0]], "peak_id": [pdf["peak_id"].iloc[0]], "erosion_iterations": [n]})

    return members.select("grid_id", "peak_id", *axes).groupBy("grid_id", "peak_id").applyInPandas(depth, "grid_id string, peak_id long, erosion_iterations long")


def _thin(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning; the mask has a frame of empty cells."""
    while True:
        changed = False
        for phase in (0, 1):
            n = [np.roll(mask, (-a, -b), (0, 1)) for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
            around = sum(x.astype(int) for x in n)
            turns = sum((~n[i] & n[(i + 1) % 8]).astype(int) for i in range(8))
            north, east, south, west = n[0], n[2], n[4], n[6]
            free = ~(north & east & south) & ~(east & south & west) if phase == 0 else ~(north & east & west) & ~(north & south & west)
            gone = mask & (around >= 2) & (around <= 6) & (turns == 1) & free
            if gone.any():
                mask = mask & ~gone
                changed = True
        if not changed:
            return mask


def skeleton(members: DataFrame, grid: Grid) -> DataFrame:
    """Length of the thinned mask, its ratio to the area, cells with more than two and with one neighbour (2-D)."""
    if grid.ndim != 2:
        raise ValueError("a skeleton needs two axes")
    axes, shape = grid.axes, grid.shape

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[axes].to_numpy()
        low = at.min(axis=0) - 1
        mask = np.zeros(at.max(axis=0) - low + 2, bool)
        mask[tuple((at - low).T)] = True
        thin = _thin(mask)
        near = sum(np.roll(thin, s, (0, 1)).astype(int) for s in itertools.product((-1, 0, 1), repeat=2) if s != (0, 0))
        i, j = np.indices(thin.shape)
        inside = (i + low[0] > 0) & (i + low[0] < shape[0] - 1) & (j + low[1] > 0) & (j + low[1] < shape[1] - 1)
        length = int(thin.sum())
        cells = (length, length / len(at), int((thin & inside & (near > 2)).sum()), int((thin & inside & (near == 1)).sum()))
        return pd.DataFrame([(pdf["grid_id"].iloc[0], pdf["peak_id"].iloc[0], *cells)], columns=["grid_id", "peak_id", "skeleton_length", "skeleton_ratio", "branch_points", "end_points"])

    return members.select("grid_id", "peak_id", *axes).groupBy("grid_id", "peak_id").applyInPandas(trace, "grid_id string, peak_id long, skeleton_length long, skeleton_ratio double, branch_points long, end_points long")


def watershed(peaks: DataFrame, grid: Grid, radius: int = 20) -> DataFrame:
    """Catchments in the box around each peak: their number, the cells that drain to the same low as the peak.

    Cells drain by steepest descent over faces; the catchments of one low plateau are one.
    """
    from ridgeline.features.topographic import around

    steps, axes = offsets(grid.ndim, 1), grid.axes

    def drain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id", ignore_index=True)
        at, value = pdf[axes].to_numpy(), pdf["value"].to_numpy()
        root = kernels.label_equal(at, value, steps)
        u, v = kernels.neighbour_edges(at, steps)
        apart = root[u] != root[v]
        low = kernels.basins(len(pdf), -value, root[u[apart]], root[v[apart]])[root]
        home = (at == pdf[[f"m{d}" for d in range(len(axes))]].iloc[0].to_numpy()).all(axis=1)
        regions = len(np.unique(low))
        mine = int((low == low[np.flatnonzero(home)[0]]).sum()) if home.any() else 0
        return pd.DataFrame([(pdf["grid_id"].iloc[0], pdf["peak_id"].iloc[0], regions, mine, regions / (len(pdf) / 100))], columns=["grid_id", "peak_id", "watershed_regions", "drainage_area", "watershed_complexity"])

    return around(peaks, grid, radius).groupBy("grid_id", "peak_id").applyInPandas(drain, "grid_id string, peak_id long, watershed_regions long, drainage_area long, watershed_complexity double")

