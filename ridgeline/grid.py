"""Dense grids as DataFrames: ``grid_id, i0 .. i{n-1}, cell_id (row-major), value``."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.mapping import AxisMapping, axis_columns, isotropic

#: Cells of a tile: what one task of a tile kernel holds.
TILE_CELLS = 1 << 18


def strides(shape: Sequence[int]) -> list[int]:
    return [math.prod(shape[d + 1 :]) for d in range(len(shape))]


def cell_id(index: Sequence[Column], shape: Sequence[int]) -> Column:
    terms = [i.cast("long") * s for i, s in zip(index, strides(shape), strict=True)]
    return sum(terms[1:], terms[0])


def index_of(cell: Column, shape: Sequence[int]) -> list[Column]:
    return [F.floor(cell / F.lit(s)).cast("long") % n if s > 1 else cell % n for s, n in zip(strides(shape), shape, strict=True)]


@dataclass(frozen=True)
class Grid:
    """A handle: lazy cells, the shape all grids of the frame share, and the mapping to coordinates."""

    cells: DataFrame
    shape: tuple[int, ...]
    mapping: AxisMapping

    def __post_init__(self) -> None:
        if len(self.shape) != self.mapping.ndim:
            raise ValueError("shape and mapping differ in their number of axes")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return axis_columns(self.ndim)

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    def index(self, alias: str | None = None) -> list[Column]:
        return [F.col(f"{alias}.{a}" if alias else a) for a in self.axes]

    def with_cells(self, cells: DataFrame) -> Grid:
        return replace(self, cells=cells)

    # Bounds.
    def valid(self, index: Sequence[Column]) -> Column:
        tests = [(i >= 0) & (i < n) for i, n in zip(index, self.shape, strict=True)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def valid_coordinate(self, coordinate: Sequence[Column]) -> Column:
        return self.valid(self.mapping.indices(coordinate))

    def clip(self, index: Sequence[Column]) -> list[Column]:
        return [F.greatest(F.lit(0), F.least(i, F.lit(n - 1))) for i, n in zip(index, self.shape, strict=True)]

    def clip_coordinates(self, coordinate: Sequence[Column]) -> list[Column]:
        low, high = self.mapping.coordinate_bounds(self.shape)
        return [F.greatest(F.lit(a), F.least(c, F.lit(b))) for c, a, b in zip(coordinate, low, high, strict=True)]

    def boundary_distance(self, index: Sequence[Column]) -> Column:
        parts = [x for i, n in zip(index, self.shape, strict=True) for x in (i, F.lit(n - 1) - i)]
        return F.least(*parts)

    # Meshes and views.
    def index_mesh(self) -> DataFrame:
        """Every index once, whether or not a cell is stored for it."""
        cell = F.col("id")
        index = index_of(cell, self.shape)
        return self.spark.range(self.size).select(cell.alias("cell_id"), *(i.cast("long").alias(a) for i, a in zip(index, self.axes, strict=True)))

    def coordinate_mesh(self) -> DataFrame:
        mesh = self.index_mesh()
        return mesh.select("*", *(c.alias(f"c{d}") for d, c in enumerate(self.mapping.coordinates(self.index()))))

    def enumerate(self, order: str = "C") -> DataFrame:
        """Cells in C (row-major) or F (column-major) order."""
        if order not in ("C", "F"):
            raise ValueError("order is 'C' or 'F'")
        return self.cells.orderBy("grid_id", *(self.axes if order == "C" else self.axes[::-1]))

    def subgrid(self, slices: Sequence[slice], update_origin: bool = True) -> Grid:
        """Cells of a box, re-indexed from 0; a step keeps every step-th index and is not folded into the scale."""
        where, starts, shape = F.lit(True), [], []
        for a, s, n in zip(self.axes, slices, self.shape, strict=True):
            lo, hi, step = s.indices(n)
            if step < 1:
                raise ValueError("a slice's step must be positive")
            where = where & (F.col(a) >= lo) & (F.col(a) < hi) & ((F.col(a) - lo) % step == 0)
            starts.append((lo, step))
            shape.append(len(range(lo, hi, step)))
        index = [((F.col(a) - lo) / step).cast("long") for a, (lo, step) in zip(self.axes, starts, strict=True)]
        cells = self.cells.where(where).select("grid_id", *(i.alias(a) for i, a in zip(index, self.axes, strict=True)), "value")
        cells = cells.select("grid_id", *self.axes, cell_id([F.col(a) for a in self.axes], shape).alias("cell_id"), "value")
        mapping = self.mapping.with_origin(self.mapping.index_to_coordinate(tuple(lo for lo, _ in starts))) if update_origin else self.mapping
        return Grid(cells, tuple(shape), mapping)

    def scaled(self, factor: float) -> Grid:
        return replace(self, mapping=self.mapping.with_scale([s * factor for s in self.mapping.scale]))

    def info(self) -> dict:
        low, high = self.mapping.coordinate_bounds(self.shape)
        return {
            "shape": self.shape,
            "ndim": self.ndim,
            "size": self.size,
            "low": low,
            "high": high,
            "voxel_volume": self.mapping.voxel_volume,
            "total_volume": self.mapping.voxel_volume * self.size,
            **self.mapping.to_dict(),
        }

    # Tiles.
    @property
    def tile_side(self) -> int:
        return max(2, int(round(TILE_CELLS ** (1 / self.ndim))))

    @property
    def n_tiles(self) -> int:
        return math.prod(-(-n // self.tile_side) for n in self.shape)

    def tiled(self, halo: int = 1) -> DataFrame:
        """Cells with ``tile`` (its number) and ``core``; cells within ``halo`` of another tile are repeated there.

        One shuffle by (grid_id, tile) then serves any number of stencils along any axis.
        """
        side = self.tile_side
        counts = [-(-n // side) for n in self.shape]
        out = self.cells.withColumn("tile", F.lit(0).cast("long"))
        own = F.lit(0).cast("long")
        for a, k in zip(self.axes, counts, strict=True):
            here = F.floor(F.col(a) / side).cast("long")
            own = own * k + here
            if k > 1:
                near = [F.floor((F.col(a) + o) / side).cast("long") for o in (-halo, 0, halo)]
                near = F.array_distinct(F.array(*(F.greatest(F.lit(0).cast("long"), F.least(x, F.lit(k - 1).cast("long"))) for x in near)))
                out = out.withColumn("_t", F.explode(near)).withColumn("tile", F.col("tile") * k + F.col("_t")).drop("_t")
        return out.withColumn("core", F.col("tile") == own)


def densify(points: DataFrame, shape: Sequence[int], mapping: AxisMapping | None = None, fill: float | int = 0) -> Grid:
    """A dense grid from sparse ``(grid_id, i0 .., value)`` rows; absent cells get ``fill``, indices outside are left out.

    Cells come from a sequence per grid, so that the dense side is generated in parallel and never shuffled by itself.
    """
    axes = axis_columns(len(shape))
    kind = dict(points.dtypes)["value"]
    grid = Grid(points, tuple(shape), mapping or isotropic(1.0, len(shape)))
    inside = points.where(grid.valid([F.col(a) for a in axes])).select("grid_id", cell_id([F.col(a) for a in axes], shape).alias("cell_id"), "value")
    every = points.select("grid_id").distinct()
    rest = math.prod(shape[1:])
    every = every.select("grid_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shape[0] - 1).cast("long"))).alias("_r"))
    every = every.select("grid_id", F.explode(F.sequence(F.col("_r") * rest, F.col("_r") * rest + (rest - 1))).alias("cell_id"))
    cells = every.join(inside, ["grid_id", "cell_id"], "left").select(
        "grid_id", *(i.cast("long").alias(a) for i, a in zip(index_of(F.col("cell_id"), shape), axes, strict=True)), "cell_id", F.coalesce("value", F.lit(fill).cast(kind)).alias("value")
    )
    return grid.with_cells(cells)


def from_numpy(spark: SparkSession, array: np.ndarray, grid_id: str = "g", mapping: AxisMapping | None = None) -> Grid:
    array = np.asarray(array)
    if array.size == 0 or not np.issubdtype(array.dtype, np.number):
        raise ValueError("a grid needs numbers")
    import pandas as pd

    index = np.indices(array.shape).reshape(array.ndim, -1)
    frame = pd.DataFrame({"grid_id": grid_id, **{f"i{d}": index[d].astype(np.int64) for d in range(array.ndim)}, "cell_id": np.arange(array.size), "value": array.ravel()})
    if not np.issubdtype(array.dtype, np.floating):
        frame["value"] = frame["value"].astype(np.int64)
    return Grid(spark.createDataFrame(frame), array.shape, mapping or isotropic(1.0, array.ndim))
