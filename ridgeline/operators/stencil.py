"""Neighbourhoods of cells: offsets, shifted columns and what is built on them.

Stencils run on tiled cells (``Grid.tiled``): cells are dealt once by (grid_id, tile) with a halo, and every window
below is partitioned by those two and the other axes, so that all axes share that one shuffle.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.grid import Grid, densify
from ridgeline.shared import lookup

Offset = tuple[int, ...]


def offsets(ndim: int, k: int = 1) -> list[Offset]:
    """Neighbours of k-connectivity: steps of -1, 0, 1 an axis with 1 to k axes moved, in row-major order."""
    if not 1 <= k <= ndim:
        raise ValueError(f"connectivity must be between 1 and {ndim}")
    return [o for o in itertools.product((-1, 0, 1), repeat=ndim) if 1 <= sum(map(abs, o)) <= k]


def _window(grid: Grid, axis: int):
    others = [a for d, a in enumerate(grid.axes) if d != axis]
    return Window.partitionBy("grid_id", "tile", *others).orderBy(grid.axes[axis])


def shift(grid: Grid, column: str, axis: int, step: int) -> Column:
    """The column's value ``step`` cells on along an axis of tiled cells; null outside the grid."""
    w = _window(grid, axis)
    there = F.lead(column, step).over(w) if step > 0 else F.lag(column, -step).over(w)
    where = F.lead(grid.axes[axis], step).over(w) if step > 0 else F.lag(grid.axes[axis], -step).over(w)
    return F.when(where == F.col(grid.axes[axis]) + step, there)


def name_of(offset: Offset) -> str:
    return "n_" + "_".join({-1: "m", 0: "z", 1: "p"}.get(o, str(o)) for o in offset)


def with_neighbours(grid: Grid, wanted: Sequence[Offset], column: str = "value", halo: int = 1) -> DataFrame:
    """Core cells with a column of each wanted neighbour's value (null outside the grid).

    Shifts are chained axis by axis, so that diagonal neighbours need no join.
    """
    cells = grid.tiled(halo)
    made = {(): column}
    for axis in range(grid.ndim):
        nxt, new = {}, {}
        for head, col in made.items():
            for step in sorted({o[axis] for o in wanted if o[:axis] == head}):
                key = (*head, step)
                name = name_of(key) if axis + 1 == grid.ndim else f"_s{axis}_{len(nxt)}"
                nxt[key] = col if step == 0 and axis + 1 < grid.ndim else name
                if nxt[key] == name:
                    new[name] = F.col(col) if step == 0 else shift(grid, col, axis, step)
        cells = cells.withColumns(new)
        made = nxt
    keep = ["grid_id", *grid.axes, "cell_id", "value", *(name_of(o) for o in wanted)]
    return cells.where("core").select(*keep)


def neighbour_pairs(grid: Grid, k: int = 1, steps: Sequence[Offset] | None = None) -> DataFrame:
    """``(grid_id, cell_id, value, other_id, other)``: each cell with each neighbour inside the grid."""
    wanted = list(steps or offsets(grid.ndim, k))
    weights = [math.prod(grid.shape[d + 1 :]) for d in range(grid.ndim)]
    near = with_neighbours(grid, wanted, halo=max(abs(x) for o in wanted for x in o))
    entries = [F.struct((F.col("cell_id") + sum(a * b for a, b in zip(o, weights, strict=True))).alias("other_id"), F.col(name_of(o)).alias("other")) for o in wanted]
    pairs = near.select("grid_id", "cell_id", "value", F.explode(F.array(*entries)).alias("n"))
    return pairs.select("grid_id", "cell_id", "value", "n.other_id", "n.other").where("other is not null")


def neighbour_counts(grid: Grid, k: int = 1) -> DataFrame:
    """``(grid_id, cell_id, n)``: how many neighbours each cell has."""
    n = sum((F.when(grid.valid([i + s for i, s in zip(grid.index(), o, strict=True)]), 1).otherwise(0) for o in offsets(grid.ndim, k)), F.lit(0))
    return grid.cells.select("grid_id", "cell_id", n.cast("long").alias("n"))


def local_max_mask(grid: Grid, k: int = 1) -> DataFrame:
    """Core cells with ``is_max``: no neighbour is higher."""
    if k == grid.ndim and k > 1:  # separable: a window maximum axis by axis
        cells = grid.tiled(1).withColumn("_m", F.col("value"))
        for axis in range(grid.ndim):
            cells = cells.withColumn("_m", F.max("_m").over(_window(grid, axis).rowsBetween(-1, 1)))
        return cells.where("core").select("grid_id", *grid.axes, "cell_id", "value", (F.col("value") >= F.col("_m")).alias("is_max"))
    wanted = offsets(grid.ndim, k)
    near = with_neighbours(grid, wanted)
    top = F.greatest(F.col("value"), *(F.col(name_of(o)) for o in wanted))
    return near.select("grid_id", *grid.axes, "cell_id", "value", (F.col("value") >= top).alias("is_max"))


def strict_maxima(
    grid: Grid,
    min_distance: int | Sequence[int] = 1,
    threshold_abs: float | None = None,
    threshold_rel: float | None = None,
    num_peaks: int | None = None,
) -> DataFrame:
    """Cells above all their face neighbours, thinned so that kept ones lie ``min_distance`` apart on some axis.

    Thinning takes the highest first (ties: lowest cell_id).  Cells far apart do not compete, so it runs on the
    candidates of one grid at a time, which are ordered by a shuffle on the grid.
    """
    wanted = offsets(grid.ndim, 1)
    near = with_neighbours(grid, wanted)
    test = F.lit(True)
    for o in wanted:
        test = test & (F.col(name_of(o)).isNull() | (F.col("value") > F.col(name_of(o))))
    found = near.where(test)
    if threshold_abs is not None:
        found = found.where(F.col("value") >= threshold_abs)
    if threshold_rel is not None:
        top = grid.cells.groupBy("grid_id").agg((F.max("value") * threshold_rel).alias("_floor"))
        found = lookup(found, top, ["grid_id"]).where(F.col("value") >= F.col("_floor"))
    out = ["grid_id", *grid.axes, "cell_id", "value"]
    found = found.select(*out)
    apart = (min_distance,) * grid.ndim if isinstance(min_distance, int) else tuple(min_distance)
    if any(x > 1 for x in apart):
        axes = grid.axes

        def thin(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["value", "cell_id"], ascending=[False, True])
            at = pdf[axes].to_numpy()
            buckets: dict[tuple, list] = {}
            keep = []
            for row in at:
                home = tuple(int(x // a) for x, a in zip(row, apart, strict=True))
                near = itertools.product(*((h - 1, h, h + 1) for h in home))
                clash = any(all(abs(int(x) - int(y)) < a for x, y, a in zip(row, other, apart, strict=True)) for b in near for other in buckets.get(b, ()))
                keep.append(not clash)
                if not clash:
                    buckets.setdefault(home, []).append(row)
            return pdf[keep]

        found = found.groupBy("grid_id").applyInPandas(thin, found.schema)
    if num_peaks is not None:
        rank = F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("value"), "cell_id"))
        found = found.withColumn("_r", rank).where(F.col("_r") <= num_peaks).drop("_r")
    return found


def peak_density(grid: Grid) -> DataFrame:
    """``(grid_id, density)``: share of the inner cells that equal the maximum of their 3^n box."""
    cells = grid.tiled(1).withColumn("_m", F.col("value"))
    for axis in range(grid.ndim):
        cells = cells.withColumn("_m", F.max("_m").over(_window(grid, axis).rowsBetween(-1, 1)))
    inner = F.lit(True)
    for a, n in zip(grid.axes, grid.shape, strict=True):
        inner = inner & (F.col(a) > 0) & (F.col(a) < n - 1)
    return cells.where("core").where(inner).groupBy("grid_id").agg(F.avg((F.col("value") == F.col("_m")).cast("double")).alias("density"))


def plateau_ratio(grid: Grid) -> DataFrame:
    """``(grid_id, ratio)``: share of cells with an equal face neighbour."""
    wanted = offsets(grid.ndim, 1)
    near = with_neighbours(grid, wanted)
    equal = F.lit(False)
    for o in wanted:
        equal = equal | F.coalesce(F.col("value") == F.col(name_of(o)), F.lit(False))
    return near.groupBy("grid_id").agg(F.avg(equal.cast("double")).alias("ratio"))


def gradient(grid: Grid) -> DataFrame:
    """Core cells with ``g0 ..``: central differences inside, one-sided ones at faces, 0 on an axis of one cell."""
    wanted = [o for o in offsets(grid.ndim, 1)]
    near = with_neighbours(grid, wanted)
    out = []
    for d in range(grid.ndim):
        unit = tuple(int(e == d) for e in range(grid.ndim))
        ahead, back = F.col(name_of(unit)).cast("double"), F.col(name_of(tuple(-x for x in unit))).cast("double")
        value = F.col("value").cast("double")
        g = F.when(ahead.isNotNull() & back.isNotNull(), (ahead - back) / 2).when(ahead.isNotNull(), ahead - value).when(back.isNotNull(), value - back).otherwise(0.0)
        out.append(g.alias(f"g{d}"))
    return near.select("grid_id", *grid.axes, "cell_id", "value", *out)


def noise_level(grid: Grid) -> DataFrame:
    """``(grid_id, noise)``: population standard deviation of the gradient's length."""
    length = F.sqrt(sum((F.col(f"g{d}") * F.col(f"g{d}") for d in range(1, grid.ndim)), F.col("g0") * F.col("g0")))
    return gradient(grid).groupBy("grid_id").agg(F.stddev_pop(length).alias("noise"))


def gaussian(grid: Grid, sigma: float = 0.5, truncate: float = 4.0) -> Grid:
    """Separable Gaussian filter; indices are reflected at the faces (the face cell is repeated)."""
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (x / sigma) ** 2) for x in range(radius + 1)]
    total = weights[0] + 2 * sum(weights[1:])
    cells = grid.tiled(radius).withColumn("_v", F.col("value").cast("double"))
    for axis, n in enumerate(grid.shape):
        w, a = _window(grid, axis), F.col(grid.axes[axis])
        value = F.col("_v") * (weights[0] / total)
        for step in range(1, radius + 1):
            for sign in (-1, 1):
                value = value + _reflected(w, a, n, sign * step) * (weights[step] / total)
        cells = cells.withColumn("_v", value)
    return grid.with_cells(cells.where("core").select("grid_id", *grid.axes, "cell_id", F.col("_v").alias("value")))


def _reflected(w, a: Column, n: int, step: int) -> Column:
    """Value at ``a + step`` with indices mirrored at -1/2 and n - 1/2 as often as needed."""
    cases = None
    for at in range(n) if n <= 2 * abs(step) else [*range(abs(step)), *range(n - abs(step), n)]:
        there = (at + step) % (2 * n)
        there = 2 * n - 1 - there if there >= n else there
        if there == at + step:
            continue
        move = there - at
        col = F.col("_v") if move == 0 else F.lead("_v", move).over(w) if move > 0 else F.lag("_v", -move).over(w)
        cases = F.when(a == at, col) if cases is None else cases.when(a == at, col)
    plain = F.lead("_v", step).over(w) if step > 0 else F.lag("_v", -step).over(w)
    return plain if cases is None else cases.otherwise(plain)


def rolling_windows(grid: Grid, window: Sequence[int], step: Sequence[int] | int = 1) -> DataFrame:
    """``(grid_id, w0 .., i0 .., value)``: cells of each window; windows start at every step-th index and fit inside."""
    steps = (step,) * grid.ndim if isinstance(step, int) else tuple(step)
    if any(not 1 <= w <= n for w, n in zip(window, grid.shape, strict=True)) or any(s < 1 for s in steps):
        raise ValueError("windows must fit and steps be positive")
    out = grid.cells
    for d, (a, n, w, s) in enumerate(zip(grid.axes, grid.shape, window, steps, strict=True)):
        count = (n - w) // s + 1
        first = F.greatest(F.lit(0), F.ceil((F.col(a) - (w - 1)) / s)).cast("long")
        last = F.least(F.lit(count - 1), F.floor(F.col(a) / s)).cast("long")
        out = out.where(first <= last).withColumn(f"w{d}", F.explode(F.sequence(first, last)))
    return out.select("grid_id", *(f"w{d}" for d in range(grid.ndim)), *grid.axes, "value")


def downsample(grid: Grid, factors: Sequence[int] | int, method: str = "mean") -> Grid:
    """Blocks reduced axis by axis in order (so a median is one of medians); a remainder at the end is cut off."""
    rules = {"mean": F.avg, "max": F.max, "min": F.min, "median": F.median}
    if method not in rules:
        raise ValueError(f"method must be one of {sorted(rules)}")
    f = (factors,) * grid.ndim if isinstance(factors, int) else tuple(factors)
    if any(x < 1 for x in f):
        raise ValueError("factors must be positive")
    shape = tuple(n // x for n, x in zip(grid.shape, f, strict=True))
    cells = grid.cells
    for a, n, x in zip(grid.axes, shape, f, strict=True):
        cells = cells.where(F.col(a) < n * x)
    for d, x in enumerate(f):
        keys = [(F.floor(F.col(a) / x).cast("long") if e == d else F.col(a)).alias(a) for e, a in enumerate(grid.axes)]
        cells = cells.select("grid_id", *keys, "value").groupBy("grid_id", *grid.axes).agg(rules[method]("value").alias("value"))
    from ridgeline.grid import cell_id

    cells = cells.select("grid_id", *grid.axes, cell_id(grid.index(), shape).alias("cell_id"), "value")
    return Grid(cells, shape, grid.mapping.with_scale([s * x for s, x in zip(grid.mapping.scale, f, strict=True)]))


def interpolate_missing(grid: Grid, method: str = "linear", missing: float | None = None) -> Grid:
    """Fills null, NaN (or ``missing``) cells along axis 0, then 1, and so on, each pass using the one before.

    ``linear`` weighs the known cells on both sides by distance and repeats the nearest known one at an end;
    ``nearest`` takes the closer one, the earlier on a tie.  A line without known cells is left to the next axis.
    ``cubic`` is for grids of one axis: a spline through the known cells of a grid, in one task a grid; beyond them
    the nearest known cell is repeated, and fewer than four known cells are joined linearly.
    """
    if method not in ("linear", "nearest", "cubic"):
        raise ValueError("method is 'linear', 'nearest' or 'cubic'")
    if method == "cubic":
        return _interpolate_cubic(grid, missing)
    value = F.col("value").cast("double")
    bad = value.isNull() | F.isnan(value) | ((value == missing) if missing is not None else F.lit(False))
    cells = grid.cells.withColumn("value", F.when(~bad, value))
    for axis, a in enumerate(grid.axes):
        cells = _known_on_both_sides(cells, a, ["grid_id", *(b for b in grid.axes if b != a)], grid.shape[axis])
        if method == "linear":
            between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(a) - F.col("_p0")) / (F.col("_p1") - F.col("_p0"))
        else:
            between = F.when(F.col(a) - F.col("_p0") <= F.col("_p1") - F.col(a), F.col("_v0")).otherwise(F.col("_v1"))
        filled = F.when(F.col("value").isNotNull(), F.col("value")).when(F.col("_v0").isNull(), F.col("_v1")).when(F.col("_v1").isNull(), F.col("_v0")).otherwise(between)
        cells = cells.withColumn("value", filled).drop("_v0", "_p0", "_v1", "_p1")
    return grid.with_cells(cells.select("grid_id", *grid.axes, "cell_id", "value"))


#: Cells of a line that one task orders.
LINE_CELLS = 1 << 16


def _known_on_both_sides(cells: DataFrame, a: str, keys: list[str], n: int) -> DataFrame:
    """Adds value and position of the nearest known cell up to (``_v0, _p0``) and from (``_v1, _p1``) each cell.

    A long line is cut into parts; what a part has to know of the others is its nearest known cells outside, which
    come from a table of one row a part.
    """
    here = F.when(F.col("value").isNotNull(), F.struct(F.col(a).alias("p"), F.col("value").alias("v")))
    parts = [*keys, "_part"]
    cells = cells.withColumn("_part", F.floor(F.col(a) / LINE_CELLS)).withColumn("_k", here)
    order = Window.partitionBy(*parts).orderBy(a)
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    near, far = F.last("_k", True).over(back), F.first("_k", True).over(ahead)
    if n > LINE_CELLS:
        ends = cells.groupBy(*parts).agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
        line = Window.partitionBy(*keys).orderBy("_part")
        before = F.last("_hi", True).over(line.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("_lo", True).over(line.rowsBetween(1, Window.unboundedFollowing))
        cells = cells.join(ends.select(*parts, before.alias("_before"), after.alias("_after")), parts)
        near, far = F.coalesce(near, "_before"), F.coalesce(far, "_after")
    cells = cells.withColumns({"_l": near, "_r": far})
    return cells.withColumns({"_v0": F.col("_l.v"), "_p0": F.col("_l.p"), "_v1": F.col("_r.v"), "_p1": F.col("_r.p")}).drop("_part", "_k", "_l", "_r", "_before", "_after")


def _interpolate_cubic(grid: Grid, missing: float | None) -> Grid:
    if grid.ndim != 1:
        raise ValueError("cubic interpolation needs one axis")
    from ridgeline.functions.helpers import cubic_spline

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i0", ignore_index=True)
        x, y = pdf["i0"].to_numpy(), pdf["value"].to_numpy(float)
        known = ~np.isnan(y) & ((y != missing) if missing is not None else True)
        if known.any():
            inner = (x > x[known][0]) & (x < x[known][-1])
            new = np.interp(x, x[known], y[known])
            if known.sum() > 3:
                new[inner] = cubic_spline(x[known], y[known], x[inner])
            pdf["value"] = np.where(known, y, new)
        return pdf

    cells = grid.cells.select("grid_id", "i0", "cell_id", F.col("value").cast("double").alias("value"))
    return grid.with_cells(cells.groupBy("grid_id").applyInPandas(fill, cells.schema))


def pad(grid: Grid, width: int | Sequence[int], mode: str = "constant", fill: float = 0.0) -> Grid:
    """A frame of ``width`` cells: ``constant``, ``edge`` or ``reflect`` (the face cell is not repeated)."""
    w = (width,) * grid.ndim if isinstance(width, int) else tuple(width)
    shape = tuple(n + 2 * x for n, x in zip(grid.shape, w, strict=True))
    if mode == "constant":
        points = grid.cells.select("grid_id", *((F.col(a) + x).alias(a) for a, x in zip(grid.axes, w, strict=True)), "value")
        return densify(points, shape, grid.mapping.with_origin([o - x * s for o, x, s in zip(grid.mapping.origin, w, grid.mapping.scale, strict=True)]), fill)
    if mode not in ("edge", "reflect"):
        raise ValueError("mode is 'constant', 'edge' or 'reflect'")
    points = grid.cells.select("grid_id", *grid.axes, "value")
    for a, n, x in zip(grid.axes, grid.shape, w, strict=True):
        # Each cell is repeated at every padded index that takes its value.
        to: dict[int, list[int]] = {}
        for i in [*range(-x, 0), *range(n, n + x)]:
            j = min(max(i, 0), n - 1) if mode == "edge" or n == 1 else (lambda r: r if r < n else 2 * (n - 1) - r)(i % (2 * (n - 1)))
            to.setdefault(j, []).append(i + x)
        own = F.array((F.col(a) + x).cast("long"))
        for j, places in to.items():
            own = F.when(F.col(a) == j, F.array((F.col(a) + x).cast("long"), *(F.lit(p).cast("long") for p in places))).otherwise(own)
        points = points.withColumn(a, F.explode(own))
    from ridgeline.grid import cell_id

    cells = points.select("grid_id", *grid.axes, cell_id(grid.index(), shape).alias("cell_id"), "value")
    return Grid(cells, shape, grid.mapping.with_origin([o - x * s for o, x, s in zip(grid.mapping.origin, w, grid.mapping.scale, strict=True)]))
