"""The grids that queries and tests run on, rolled up from the driver's tables or made from formulas."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ridgeline.grid import Grid, from_numpy, index_of, strides
from ridgeline.mapping import isotropic
from ridgeline.sources.tables import read_table, rollup

QD, QDT, DAY, EV = (50, 11), (50, 11, 9), (2405,), (30, 24)


def g_qd(spark: SparkSession, folder: str) -> Grid:
    """Line items by quantity and discount."""
    rows = read_table(spark, folder, "lineitem").select("l_quantity", "l_discount")
    return rollup(rows, [F.col("l_quantity") - 1, F.rint(F.col("l_discount") * 100)], QD)


def g_qdt(spark: SparkSession, folder: str) -> Grid:
    """Line items by quantity, discount and tax."""
    rows = read_table(spark, folder, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return rollup(rows, [F.col("l_quantity") - 1, F.rint(F.col("l_discount") * 100), F.rint(F.col("l_tax") * 100)], QDT)


def _day(ts: str) -> Column:
    return F.datediff(F.to_date(F.col(ts)), F.lit("1995-01-01").cast("date"))


def g_day(spark: SparkSession, folder: str) -> Grid:
    """Orders by day."""
    return rollup(read_table(spark, folder, "orders").select("o_orderdate"), [_day("o_orderdate")], DAY)


def g_rev(spark: SparkSession, folder: str) -> Grid:
    """Cents ordered by day."""
    rows = read_table(spark, folder, "orders").select("o_orderdate", "o_totalprice")
    return rollup(rows, [_day("o_orderdate")], DAY, F.sum(F.rint(F.col("o_totalprice") * 100).cast("long")))


def _event_axes(folder: str, spark: SparkSession):
    rows = read_table(spark, folder, "events").select("ts", "event_type")
    first = F.lit("2024-01-01").cast("date")
    return rows, [F.datediff(F.to_date("ts"), first), F.hour("ts")]


def g_ev(spark: SparkSession, folder: str) -> Grid:
    """Events by day and hour."""
    rows, axes = _event_axes(folder, spark)
    return rollup(rows, axes, EV)


def g_ev_type(spark: SparkSession, folder: str) -> Grid:
    """A grid of events by day and hour for each event type."""
    rows, axes = _event_axes(folder, spark)
    return rollup(rows, axes, EV, grid_id=F.col("event_type"))


def test_pattern(spark: SparkSession, shape: Sequence[int], pattern: str = "peaks", noise: float = 0.0, seed: int = 42) -> Grid:
    """Synthetic cells, computed where they lie: ``peaks``, ``sinusoid``, ``gaussian`` or ``random``, with normal noise."""
    cell = F.col("cell_id")
    index = index_of(cell, shape)
    if pattern == "random":
        value = F.rand(seed)
    elif pattern == "sinusoid":
        waves = [F.sin(F.lit((1 + 0.5 * d) * 4 * math.pi / max(1, n - 1)) * i) for d, (i, n) in enumerate(zip(index, shape, strict=True))]
        value = sum(waves[1:], waves[0]) / len(waves)
    elif pattern == "gaussian":
        value = _bump(index, [n // 2 for n in shape], [0.3 * n for n in shape], 1.0)
    elif pattern == "peaks":
        import random

        draw = random.Random(seed)
        value = F.lit(0.0)
        for _ in range(min(5, math.prod(shape) // 100 + 1)):
            centre = [draw.uniform(0, n - 1) for n in shape]
            value = value + _bump(index, centre, [draw.uniform(0.05, 0.2) * n for n in shape], draw.uniform(0.5, 1))
    else:
        raise ValueError(f"no pattern {pattern!r}")
    if noise > 0:
        value = value + F.randn(seed + 1) * noise
    cells = spark.range(math.prod(shape)).select(F.lit("g").alias("grid_id"), F.col("id").alias("cell_id"))
    cells = cells.select("grid_id", *(i.cast("long").alias(f"i{d}") for d, i in enumerate(index)), "cell_id", value.alias("value"))
    return Grid(cells, tuple(shape), isotropic(1.0, len(shape)))


def _bump(index: Sequence[Column], centre: Sequence[float], width: Sequence[float], height: float) -> Column:
    parts = [F.pow((i - F.lit(float(c))) / F.lit(float(w)), F.lit(2.0)) for i, c, w in zip(index, centre, width, strict=True)]
    return F.lit(height) * F.exp(-sum(parts[1:], parts[0]) / 2)


#: A flat top, a terrace beside a higher flat, a ring with a hole, two equal summits, a single-cell
#: peak and a plateau on the border.
PLATEAUS = (
    "777000000000",
    "770000099000",
    "000000099000",
    "000444000000",
    "000455500050",
    "000455500000",
    "000000000000",
    "066600030300",
    "060600022200",
    "066600000000",
    "000000000000",
    "000000000000",
)


def g_plateau(spark: SparkSession) -> Grid:
    import numpy as np

    return from_numpy(spark, np.array([list(map(int, row)) for row in PLATEAUS]))


__all__ = ["DAY", "EV", "PLATEAUS", "QD", "QDT", "g_day", "g_ev", "g_ev_type", "g_plateau", "g_qd", "g_qdt", "g_rev", "strides", "test_pattern"]
