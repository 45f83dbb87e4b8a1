"""Topography around peaks: rings, boxes, slopes, curvature, ruggedness, isolation."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.mapping import distance
from ridgeline.operators.stencil import gradient, name_of, neighbour_pairs, offsets, with_neighbours

RADII = (10, 25, 50, 100)


def centre(ndim: int) -> list[Column]:
    """The cell that a peak's mean index falls in (truncated)."""
    return [F.floor(F.col(f"c{d}")).cast("long") for d in range(ndim)]


def around(peaks: DataFrame, grid: Grid, radius: int) -> DataFrame:
    """Each peak with the cells of its box (Chebyshev radius) as ``grid_id, peak_id, height, m0 .., i0 .., value``.

    Peaks are exploded to rows of their box along the first axis, which meet cells in an equi-join; the other axes
    are filtered in it.
    """
    box = peaks.select("grid_id", "peak_id", "height", *(c.alias(f"m{d}") for d, c in enumerate(centre(grid.ndim))))
    first = F.sequence(F.greatest(F.lit(0), F.col("m0") - radius), F.least(F.lit(grid.shape[0] - 1), F.col("m0") + radius))
    rows = box.withColumn("i0", F.explode(first)).join(grid.cells.select("grid_id", *grid.axes, "cell_id", "value"), ["grid_id", "i0"])
    for d in range(1, grid.ndim):
        rows = rows.where(F.abs(F.col(f"i{d}") - F.col(f"m{d}")) <= radius)
    return rows


def box_prominence(peaks: DataFrame, grid: Grid) -> DataFrame:
    """Height above the lowest cell on the faces of the box of radius ``min(shape) // 4``, at least 0."""
    r = min(grid.shape) // 4
    on_face = F.lit(False)
    for d, n in enumerate(grid.shape):
        m, i = F.col(f"m{d}"), F.col(f"i{d}")
        on_face = on_face | (i == F.greatest(F.lit(0), m - r)) | (i == F.least(F.lit(n - 1), m + r))
    low = around(peaks, grid, r).where(on_face).groupBy("grid_id", "peak_id").agg(F.first("height").alias("h"), F.min("value").alias("low"))
    return low.select("grid_id", "peak_id", F.greatest(F.col("h") - F.col("low"), F.lit(0)).alias("box_prominence"))


def relative_height(peaks: DataFrame, grid: Grid, radii: Sequence[int] = RADII) -> DataFrame:
    """Height above the mean of a ring (half a cell to both sides) for each radius below ``min(shape) // 4``.

    Without cells in the ring the centre cell stands for it.  ``local_rel_height`` is above the mean of the +-5 box.
    """
    use = [r for r in radii if r < min(grid.shape) // 4]
    rows = around(peaks, grid, max([5, *(r + 1 for r in use)]))
    gap = F.sqrt(sum((((F.col(f"i{d}") - F.col(f"m{d}")).cast("double")) ** 2 for d in range(1, grid.ndim)), (F.col("i0") - F.col("m0")).cast("double") ** 2))
    near = F.lit(True)
    for d in range(grid.ndim):
        near = near & (F.abs(F.col(f"i{d}") - F.col(f"m{d}")) <= 5)
    rows = rows.withColumn("_d", gap).groupBy("grid_id", "peak_id").agg(
        F.first("height").alias("h"),
        F.first(F.when(F.col("_d") == 0, F.col("value")), True).alias("_c"),
        F.avg(F.when(near, F.col("value"))).alias("_box"),
        *(F.avg(F.when((F.col("_d") >= r - 0.5) & (F.col("_d") <= r + 0.5), F.col("value"))).alias(f"_r{r}") for r in use),
    )
    return rows.select("grid_id", "peak_id", *((F.col("h") - F.coalesce(f"_r{r}", "_c")).alias(f"rel_height_{r}") for r in use), (F.col("h") - F.col("_box")).alias("local_rel_height"))


def first_cells(members: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("grid_id", "peak_id").orderBy("cell_id")
    return members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def slopes(members: DataFrame, grid: Grid) -> DataFrame:
    """Gradient length over the first ten plateau cells (mean, max, min, std), slope angle, drainage figures."""
    n = grid.ndim
    g = gradient(grid).select("grid_id", "cell_id", *(f"g{d}" for d in range(n)))
    length = F.sqrt(sum((F.col(f"g{d}") ** 2 for d in range(1, n)), F.col("g0") ** 2))
    w = Window.partitionBy("grid_id", "peak_id").orderBy("cell_id")
    rows = first_cells(members, 20).withColumn("_r", F.row_number().over(w)).join(g, ["grid_id", "cell_id"]).withColumn("_g", length)
    ten = F.col("_r") <= 10
    moving = ten & (F.col("_g") > 1e-10)
    directions = [F.stddev_pop(F.when(moving, F.col(f"g{d}") / F.col("_g"))) for d in range(n)]
    agg = rows.groupBy("grid_id", "peak_id").agg(
        F.avg(F.when(ten, F.col("_g"))).alias("gradient_mean"),
        F.max(F.when(ten, F.col("_g"))).alias("gradient_max"),
        F.min(F.when(ten, F.col("_g"))).alias("gradient_min"),
        F.stddev_pop(F.when(ten, F.col("_g"))).alias("gradient_std"),
        F.avg("_g").alias("drainage_density"),
        F.count_if(moving).alias("_n"),
        (sum(directions[1:], directions[0]) / n).alias("_s"),
    )
    return agg.select(
        "grid_id", "peak_id", "gradient_mean", "gradient_max", "gradient_min", "gradient_std",
        F.degrees(F.atan("gradient_mean")).alias("slope_angle"),
        "drainage_density",
        F.when(F.col("_n") >= 2, 1 / (1 + F.col("_s"))).otherwise(1.0).alias("flow_consistency"),
    )


def at_centre(peaks: DataFrame, columns: DataFrame, grid: Grid) -> DataFrame:
    """Peaks with the columns of the cell that their centre falls in."""
    at = peaks.select("grid_id", "peak_id", *(c.alias(f"i{d}") for d, c in enumerate(centre(grid.ndim))))
    return at.join(columns, ["grid_id", *grid.axes])


def aspect(peaks: DataFrame, grid: Grid) -> DataFrame:
    """Compass direction of the gradient at the centre; null where it is flat.  Further planes in 3-D."""
    if grid.ndim < 2:
        raise ValueError("aspect needs two axes")
    g = gradient(grid).select("grid_id", *grid.axes, *(f"g{d}" for d in range(grid.ndim)))
    rows = at_centre(peaks, g, grid)

    def angle(a: int, b: int) -> Column:
        turn = F.pmod(F.lit(90.0) - F.degrees(F.atan2(F.col(f"g{b}"), F.col(f"g{a}"))), F.lit(360.0))
        return F.when((F.col(f"g{a}") != 0) | (F.col(f"g{b}") != 0), turn)

    planes = [] if grid.ndim < 3 else [angle(a, b).alias(f"aspect_{x}") for x, a, b in (("xy", 0, 1), ("xz", 0, 2), ("yz", 1, 2))]
    return rows.select("grid_id", "peak_id", angle(0, 1).alias("aspect_angle"), *planes)


def curvature(peaks: DataFrame, grid: Grid) -> DataFrame:
    """Mean curvature (half the Laplacian), sharpness (minus the Laplacian) and, in 2-D, Gaussian and principal ones.

    A second difference needs both neighbours and is 0 at a face.
    """
    n = grid.ndim
    wanted = offsets(n, min(2, n))
    near = with_neighbours(grid, wanted)
    value = F.col("value").cast("double")
    unit = lambda d, s: tuple(s * int(e == d) for e in range(n))
    second = []
    for d in range(n):
        a, b = F.col(name_of(unit(d, 1))), F.col(name_of(unit(d, -1)))
        second.append(F.when(a.isNotNull() & b.isNotNull(), a + b - 2 * value).otherwise(0.0))
    cols = [s.alias(f"_s{d}") for d, s in enumerate(second)]
    if n == 2:
        corner = {o: F.col(name_of(o)).cast("double") for o in itertools.product((-1, 1), repeat=2)}
        cross = F.when(
            corner[1, 1].isNotNull() & corner[1, -1].isNotNull() & corner[-1, 1].isNotNull() & corner[-1, -1].isNotNull(),
            (corner[1, 1] - corner[1, -1] - corner[-1, 1] + corner[-1, -1]) / 4,
        ).otherwise(0.0)
        cols.append(cross.alias("_x"))
    rows = at_centre(peaks, near.select("grid_id", *grid.axes, *cols), grid)
    laplacian = sum((F.col(f"_s{d}") for d in range(1, n)), F.col("_s0"))
    out = [(laplacian / 2).alias("mean_curvature"), (-laplacian).alias("sharpness")]
    if n == 2:
        a, b, x = F.col("_s0"), F.col("_s1"), F.col("_x")
        root = F.sqrt(((a - b) / 2) * ((a - b) / 2) + x * x)
        out += [(a * b - x * x).alias("gaussian_curvature"), ((a + b) / 2 + root).alias("principal_1"), ((a + b) / 2 - root).alias("principal_2")]
    return rows.select("grid_id", "peak_id", *out)


def directional_slopes(peaks: DataFrame, grid: Grid) -> DataFrame:
    """Gradient along each axis at the centre, the Laplacian there, and the spread of the slopes to face neighbours."""
    n = grid.ndim
    g = gradient(grid).select("grid_id", *grid.axes, *(F.col(f"g{d}").alias(f"slope_{d}") for d in range(n)))
    near = neighbour_pairs(grid, 1).withColumn("_d", (F.col("other") - F.col("value")).cast("double"))
    spread = near.groupBy("grid_id", "cell_id").agg(F.stddev_pop("_d").alias("slope_variability"), F.sum("_d").alias("laplacian"))
    cells = grid.cells.select("grid_id", "cell_id", *grid.axes).join(spread, ["grid_id", "cell_id"]).join(g, ["grid_id", *grid.axes])
    return at_centre(peaks, cells, grid).select("grid_id", "peak_id", *(f"slope_{d}" for d in range(n)), "laplacian", "slope_variability")


def roughness(members: DataFrame) -> DataFrame:
    return members.groupBy("grid_id", "peak_id").agg(F.stddev_pop("value").alias("roughness"))


def topographic_position(peaks: DataFrame, grid: Grid, radius: int = 20) -> DataFrame:
    """Height above the mean of the box of the given radius."""
    rows = around(peaks, grid, radius).groupBy("grid_id", "peak_id").agg((F.first("height") - F.avg("value")).alias("tpi"))
    return rows.select("grid_id", "peak_id", "tpi")


def ruggedness(members: DataFrame, grid: Grid) -> DataFrame:
    """Root of the mean squared difference to face neighbours, over the first 20 plateau cells."""
    pairs = neighbour_pairs(grid, 1).withColumn("_d", (F.col("other") - F.col("value")).cast("double"))
    rows = first_cells(members, 20).select("grid_id", "peak_id", "cell_id").join(pairs, ["grid_id", "cell_id"])
    return rows.groupBy("grid_id", "peak_id").agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("tri"))


def isolation(peaks: DataFrame, grid: Grid, p: float = 2.0) -> DataFrame:
    """Distance to the nearest other peak of at least the same height.

    ``isolation`` is 0 without one; ``topographic_isolation`` is then the distance to the farthest peak.
    """
    from ridgeline.features.spread import nearest_pairs

    near = nearest_pairs(peaks, grid, 1, p, F.col("other_height") >= F.col("height")).select("grid_id", "peak_id", F.col("d").alias("_near"))
    rows = peaks.select("grid_id", "peak_id", "height", *(f"c{d}" for d in range(grid.ndim))).join(near, ["grid_id", "peak_id"], "left")
    # Only a grid's highest peak can be without one; its distances to all others are looked at.
    alone, others = rows.where("_near is null").alias("a"), peaks.alias("b")
    far = distance([F.col(f"a.c{i}") for i in range(grid.ndim)], [F.col(f"b.c{i}") for i in range(grid.ndim)], p, grid.mapping.scale)
    met = alone.join(others, (F.col("a.grid_id") == F.col("b.grid_id")) & (F.col("a.peak_id") != F.col("b.peak_id")))
    top = met.groupBy(F.col("a.grid_id").alias("grid_id"), F.col("a.peak_id").alias("peak_id")).agg(F.max(far).alias("_far"))
    rows = rows.join(top, ["grid_id", "peak_id"], "left")
    return rows.select("grid_id", "peak_id", F.coalesce("_near", F.lit(0.0)).alias("isolation"), F.coalesce("_near", "_far").alias("topographic_isolation"))
