"""Range, radius and nearest-neighbour queries over points and grid cells, many query points at a time."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.mapping import distance


def _cells(coords: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long") for c in coords]


def hash_cells(points: DataFrame, coords: Sequence[str], size: float) -> DataFrame:
    """Points with the bucket ``b0 ..`` of a spatial hash."""
    if not size > 0:
        raise ValueError("the cell size must be positive")
    return points.withColumns({f"b{d}": c for d, c in enumerate(_cells(coords, size))})


def radius_join(points: DataFrame, centres: DataFrame, coords: Sequence[str], r: float, pid: str = "id", qid: str = "query_id") -> DataFrame:
    """``(qid, pid, d)``: points within Euclid distance ``r`` of each centre.

    Both sides are hashed to buckets of side r; a centre is repeated in the 3^n buckets around it, which makes an
    equi-join on buckets, then the exact distance is tested.
    """
    if r < 0:
        raise ValueError("the radius must not be negative")
    size = r if r > 0 else 1.0
    n = len(coords)
    buckets = [f"b{d}" for d in range(n)]
    q = centres.select(qid, *(F.col(c).alias(f"q{d}") for d, c in enumerate(coords)))
    for d in range(n):
        q = q.withColumn(f"b{d}", F.explode(F.array(*(F.floor(F.col(f"q{d}") / size).cast("long") + s for s in (-1, 0, 1)))))
    met = hash_cells(points.select(pid, *coords), coords, size).join(q, buckets)
    d = distance([F.col(c) for c in coords], [F.col(f"q{i}") for i in range(n)])
    return met.withColumn("d", d).where(F.col("d") <= r).select(qid, pid, "d")


#: Query points that one block of a nearest-neighbour query sends to the executors.
KNN_BLOCK = 10_000


def knn_join(points: DataFrame, centres: DataFrame, coords: Sequence[str], k: int, pid: str = "id", qid: str = "query_id") -> DataFrame:
    """``(qid, pid, d, rank)``: the k nearest points of each centre, ties by id.

    The centres are a query set: it goes to the executors in blocks of ``KNN_BLOCK`` and every point is read against
    each block.  Per task only the k best of a centre are kept (a rank limit that Spark applies before the shuffle),
    so what moves is k rows a centre and task.
    """
    if k < 1:
        raise ValueError("k must be positive")
    q = centres.select(qid, *(F.col(c).alias(f"q{i}") for i, c in enumerate(coords)))
    blocks = q.count() // KNN_BLOCK + 1
    out = None
    for i in range(blocks):
        block = q if blocks == 1 else q.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == i)
        met = points.select(pid, *coords).join(F.broadcast(block), F.lit(True))
        d = distance([F.col(c) for c in coords], [F.col(f"q{j}") for j in range(len(coords))])
        w = Window.partitionBy(qid).orderBy("d", pid)
        best = met.select(qid, pid, d.alias("d")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out


def range_query(points: DataFrame, coords: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Points in an inclusive box; the bounds reach the scan as filters."""
    for c, a, b in zip(coords, low, high, strict=True):
        points = points.where(F.col(c).between(a, b))
    return points


def choose_index(points: int, ndim: int) -> str:
    """Which kind of query suits a number of points: ``scan``, ``tree`` or ``hash`` (Spark plans the join itself)."""
    if points < 1_000:
        return "scan"
    return "tree" if ndim <= 3 and points < 100_000 else "hash"


def grid_radius(grid: Grid, centre: Sequence[float], r: float, p: float = 2.0) -> DataFrame:
    """Cells within Minkowski index distance ``r`` (Euclid by default) of a point in index space."""
    rows = grid.cells
    for a, c in zip(grid.axes, centre, strict=True):
        rows = rows.where(F.col(a).between(math.ceil(c - r), math.floor(c + r)))
    d = distance([F.col(a).cast("double") for a in grid.axes], [F.lit(float(c)) for c in centre], p)
    return rows.withColumn("d", d).where(F.col("d") <= r)


def grid_radius_coordinates(grid: Grid, centre: Sequence[float], r: float) -> DataFrame:
    """Cells within Euclid coordinate distance ``r`` of a point in coordinate space."""
    rows = grid.cells
    for a, c, s, o in zip(grid.axes, centre, grid.mapping.scale, grid.mapping.origin, strict=True):
        rows = rows.where(F.col(a).between(math.floor((c - r - o) / s), math.ceil((c + r - o) / s)))
    d = distance(grid.mapping.coordinates(grid.index()), [F.lit(float(c)) for c in centre])
    return rows.withColumn("d", d).where(F.col("d") <= r)


def grid_range(grid: Grid, low: Sequence[float], high: Sequence[float], outward: bool = False) -> DataFrame:
    """Cells whose coordinates lie in a box; ``outward`` rounds the box to whole cells and clips it to the grid."""
    if outward:
        lo, hi = grid.mapping.index_bounds(tuple(low), tuple(high))
        rows = grid.cells
        for a, x, y, n in zip(grid.axes, lo, hi, grid.shape, strict=True):
            rows = rows.where(F.col(a).between(min(max(x, 0), n - 1), min(max(y, 0), n - 1)))
        return rows
    rows = grid.cells
    for c, x, y in zip(grid.mapping.coordinates(grid.index()), low, high, strict=True):
        rows = rows.where(c.between(x, y))
    return rows


def sample(grid: Grid, points: DataFrame, coords: Sequence[str], method: str = "nearest", fill: float | None = None, pid: str = "id") -> DataFrame:
    """``(pid, sample)``: the grid's value at points in coordinate space; ``fill`` outside.

    ``linear`` weighs the 2^n cells around a point, all of which must lie in the grid.
    """
    spots = points.select(pid, *coords)
    if method == "nearest" or (method == "linear" and grid.ndim > 3):
        index = grid.mapping.indices([F.col(c) for c in coords])
        at = spots.select(pid, *(i.alias(a) for i, a in zip(index, grid.axes, strict=True)))
        met = at.join(grid.cells.select(*grid.axes, F.col("value").cast("double").alias("value")), grid.axes, "left")
        return met.select(pid, F.coalesce("value", F.lit(fill).cast("double")).alias("sample"))
    if method != "linear":
        raise ValueError("method is 'nearest' or 'linear'")
    exact = [(F.col(c) - o) / s for c, o, s in zip(coords, grid.mapping.origin, grid.mapping.scale, strict=True)]
    at = spots.select(pid, *(F.floor(x).cast("long").alias(f"f{d}") for d, x in enumerate(exact)), *((x - F.floor(x)).alias(f"t{d}") for d, x in enumerate(exact)))
    inside = grid.valid([F.col(f"f{d}") for d in range(grid.ndim)]) & grid.valid([F.col(f"f{d}") + 1 for d in range(grid.ndim)])
    corners = at.where(inside).withColumn("w", F.lit(1.0))
    for d, a in enumerate(grid.axes):
        ends = F.array(F.struct(F.col(f"f{d}").alias("i"), (1 - F.col(f"t{d}")).alias("w")), F.struct((F.col(f"f{d}") + 1).alias("i"), F.col(f"t{d}").alias("w")))
        corners = corners.withColumn("_e", F.explode(ends)).withColumn(a, F.col("_e.i")).withColumn("w", F.col("w") * F.col("_e.w")).drop("_e")
    met = corners.join(grid.cells.select(*grid.axes, "value"), grid.axes).groupBy(pid).agg(F.sum(F.col("w") * F.col("value")).alias("_s"))
    return spots.select(pid).join(met, pid, "left").select(pid, F.coalesce("_s", F.lit(fill).cast("double")).alias("sample"))
