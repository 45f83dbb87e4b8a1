"""Geometry of a peak's plateau: one aggregation over its cells, and its boundary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.operators.stencil import neighbour_pairs


def peak_cells(cells: DataFrame, peaks: DataFrame) -> DataFrame:
    """Plateau cells of the given peaks, with ``peak_id``."""
    return cells.withColumnRenamed("plateau_id", "peak_id").join(peaks.select("grid_id", "peak_id"), ["grid_id", "peak_id"])


def boundary_cells(members: DataFrame, grid: Grid) -> DataFrame:
    """``(grid_id, peak_id, boundary)``: distinct cells outside a plateau that share a face with it."""
    out = neighbour_pairs(grid, 1).join(members.select("grid_id", "cell_id", "peak_id"), ["grid_id", "cell_id"]).where("other <> value")
    near = out.select("grid_id", "peak_id", "other_id").distinct().groupBy("grid_id", "peak_id").agg(F.count("*").alias("boundary"))
    alone = members.select("grid_id", "peak_id").distinct()
    return alone.join(near, ["grid_id", "peak_id"], "left").na.fill(0, ["boundary"])


def boundary_ref(members: DataFrame, grid: Grid) -> DataFrame:
    """``(grid_id, peak_id, boundary_ref)``: like ``boundary`` with one outside cell for each plateau cell at most.

    That is the first one, axis by axis, backward before forward.
    """
    weights = [math.prod(grid.shape[d + 1 :]) for d in range(grid.ndim)]
    pairs = neighbour_pairs(grid, 1).join(members.select("grid_id", "cell_id", "peak_id"), ["grid_id", "cell_id"]).where("other <> value")
    rank = F.lit(99)
    for j, step in enumerate(s * w for w in weights for s in (-1, 1)):
        rank = F.when(F.col("other_id") - F.col("cell_id") == step, j).otherwise(rank)
    first = pairs.groupBy("grid_id", "peak_id", "cell_id").agg(F.min(F.struct(rank.alias("r"), "other_id")).alias("f"))
    return first.select("grid_id", "peak_id", F.col("f.other_id").alias("o")).distinct().groupBy("grid_id", "peak_id").agg(F.count("*").alias("boundary_ref"))


def geometry(members: DataFrame, grid: Grid) -> DataFrame:
    """Area, volumes, weighted centroid, box, extent and ratio of extents, second moments."""
    axes, vox = grid.axes, F.lit(grid.mapping.voxel_volume)
    value = F.col("value").cast("double")
    moments = [m for d, a in enumerate(axes) for m in _moments(a, d)]
    cov = [F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"_cov_{i}_{j}") for i, a in enumerate(axes) for j, b in enumerate(axes) if i <= j]
    agg = members.groupBy("grid_id", "peak_id").agg(
        F.count("*").alias("cells"),
        F.first("value").alias("height"),
        (F.count("*") * vox).alias("area"),
        (F.sum(value) * vox).alias("volume"),
        ((F.sum(value) - F.count("*") * F.min(value)) * vox).alias("relief_volume"),
        *((F.sum(F.col(a) * value) / F.nullif(F.sum(value), F.lit(0.0))).alias(f"centroid_{d}") for d, a in enumerate(axes)),
        *(F.min(a).alias(f"box_min_{d}") for d, a in enumerate(axes)),
        *(F.max(a).alias(f"box_max_{d}") for d, a in enumerate(axes)),
        *moments,
        *cov,
    )
    extents = [F.col(f"box_max_{d}") - F.col(f"box_min_{d}") + 1 for d in range(grid.ndim)]
    box = extents[0]
    for e in extents[1:]:
        box = box * e
    agg = agg.withColumns({f"extent_{d}": e for d, e in enumerate(extents)}).withColumn("box_volume", box)
    longest = F.greatest(*extents) if grid.ndim > 1 else extents[0]
    shortest = F.least(*extents) if grid.ndim > 1 else extents[0]
    ratios = {f"aspect_ratio_{i}_{j}": extents[i] / extents[j] for i in range(grid.ndim) for j in range(i + 1, grid.ndim)}
    agg = agg.withColumns({**ratios, "aspect_ratio": longest / shortest, "extent": F.col("cells") / F.col("box_volume")})
    return agg.withColumn("elongation", elongation(grid.ndim)).drop(*(f"_cov_{i}_{j}" for i in range(grid.ndim) for j in range(i, grid.ndim)))


def _moments(axis: str, d: int) -> list[Column]:
    return [
        F.avg(axis).alias(f"mean_{d}"),
        F.var_pop(axis).alias(f"var_{d}"),
        F.stddev_pop(axis).alias(f"std_{d}"),
        F.when(F.var_pop(axis) > 0, F.skewness(axis)).alias(f"skew_{d}"),
        F.when(F.var_pop(axis) > 0, F.kurtosis(axis)).alias(f"kurtosis_{d}"),
    ]


def elongation(ndim: int) -> Column:
    """Largest by smallest eigenvalue of the sample covariance of the indices; 1 for one cell, null if flat."""
    c = lambda i, j: F.col(f"_cov_{min(i, j)}_{max(i, j)}")
    if ndim == 1:
        ratio = F.lit(1.0)
    elif ndim == 2:
        mean, diff = (c(0, 0) + c(1, 1)) / 2, (c(0, 0) - c(1, 1)) / 2
        root = F.sqrt(diff * diff + c(0, 1) * c(0, 1))
        ratio = F.when(mean - root > 1e-10, (mean + root) / (mean - root))
    elif ndim == 3:  # the trigonometric roots of the characteristic cubic
        q = (c(0, 0) + c(1, 1) + c(2, 2)) / 3
        off = c(0, 1) ** 2 + c(0, 2) ** 2 + c(1, 2) ** 2
        p = F.sqrt(((c(0, 0) - q) ** 2 + (c(1, 1) - q) ** 2 + (c(2, 2) - q) ** 2 + 2 * off) / 6)
        a, b, e = c(0, 0) - q, c(1, 1) - q, c(2, 2) - q
        det = a * (b * e - c(1, 2) ** 2) - c(0, 1) * (c(0, 1) * e - c(1, 2) * c(0, 2)) + c(0, 2) * (c(0, 1) * c(1, 2) - b * c(0, 2))
        r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / F.nullif(2 * p * p * p, F.lit(0.0))))
        phi = F.acos(r) / 3
        high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
        ratio = F.when(p == 0, F.lit(1.0)).when(low > 1e-10, high / low)
    else:
        raise ValueError("elongation is defined for up to three axes")
    return F.when(F.col("cells") == 1, F.lit(1.0)).otherwise(ratio)


def perimeter(members: DataFrame, grid: Grid) -> DataFrame:
    """``(grid_id, peak_id, boundary, perimeter, compactness)``.

    In two dimensions a boundary cell counts the shorter cell side, otherwise the product of all but the last;
    compactness is the squared boundary count by the number of cells.
    """
    scale = grid.mapping.scale
    unit = min(scale) if grid.ndim == 2 else math.prod(scale[:-1])
    size = members.groupBy("grid_id", "peak_id").agg(F.count("*").alias("_n"))
    out = boundary_cells(members, grid).join(size, ["grid_id", "peak_id"])
    return out.select("grid_id", "peak_id", "boundary", (F.col("boundary") * unit).alias("perimeter"), (F.col("boundary") * F.col("boundary") / F.col("_n")).alias("compactness"))
