"""Grids rolled up from tables: axes are expressions over rows, the measure is an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.grid import Grid, densify
from ridgeline.mapping import AxisMapping


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rollup(
    rows: DataFrame,
    axes: Sequence[Column],
    shape: Sequence[int],
    measure: Column | None = None,
    grid_id: Column | str = "g",
    mapping: AxisMapping | None = None,
) -> Grid:
    """One cell for each combination of axis values; rows with a null axis or an axis outside the shape are left out.

    The aggregate is combined before its shuffle, so that a hot cell costs no more than others.
    """
    gid = F.lit(grid_id) if isinstance(grid_id, str) else grid_id
    keyed = rows.select("*", gid.alias("grid_id"), *(a.cast("long").alias(f"i{d}") for d, a in enumerate(axes)))
    names = [f"i{d}" for d in range(len(axes))]
    points = keyed.dropna(subset=["grid_id", *names]).groupBy("grid_id", *names).agg((F.count("*") if measure is None else measure).alias("value"))
    return densify(points, shape, mapping)


def write_cells(grid: Grid, path: str, mode: str = "errorifexists") -> None:
    """Cells as Parquet, a folder for each grid, so that readers of one grid skip the others."""
    grid.cells.write.mode(mode).partitionBy("grid_id").parquet(path)


def read_cells(spark: SparkSession, path: str, shape: Sequence[int], mapping: AxisMapping) -> Grid:
    names = [f"i{d}" for d in range(len(shape))]
    return Grid(spark.read.parquet(path).select("grid_id", *names, "cell_id", "value"), tuple(shape), mapping)
