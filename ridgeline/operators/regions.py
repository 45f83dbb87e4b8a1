"""Regions of equal height: plateaus, regional maxima, components of masks.

Cells are labelled tile by tile with an array kernel; labels that meet in the halo are then joined by connected
components over tile borders alone.  A task never holds more than a tile, and a grid of one tile needs no rounds.
A plateau's id is its smallest cell_id.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.operators.components import connected_components
from ridgeline.operators.kernels import Box, label_equal
from ridgeline.operators.stencil import Offset, neighbour_pairs, offsets


def _steps(grid: Grid, k: int, structure: Sequence[Offset] | None) -> list[Offset]:
    return [tuple(o) for o in structure] if structure is not None else offsets(grid.ndim, k)


def plateau_cells(grid: Grid, k: int = 1, structure: Sequence[Offset] | None = None) -> DataFrame:
    """``(grid_id, i0 .., cell_id, value, plateau_id, top)``: top is the highest neighbour's value (null if none)."""
    steps = _steps(grid, k, structure)
    axes = grid.axes

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id", ignore_index=True)
        at, value, cells = pdf[axes].to_numpy(), pdf["value"].to_numpy(), pdf["cell_id"].to_numpy()
        root = label_equal(at, value, steps)
        box = Box(at)
        has = np.zeros(len(pdf), bool)
        top = value.copy()
        for s in steps:
            u, v = box.pairs(s)
            top[u] = np.where(has[u], np.maximum(top[u], value[v]), value[v])
            has[u] = True
        pdf["plateau_id"] = cells[root]
        pdf["top"] = pd.Series(top).where(has)
        return pdf[["grid_id", *axes, "cell_id", "value", "core", "plateau_id", "top"]]

    kind = dict(grid.cells.dtypes)["value"]
    names = ", ".join(["grid_id string", *(f"{a} long" for a in axes), f"cell_id long, value {kind}, core boolean, plateau_id long, top {kind}"])
    halo = max(abs(x) for o in steps for x in o) if steps else 1
    cells = grid.tiled(halo).select("grid_id", "tile", *axes, "cell_id", "value", "core")
    local = cells.groupBy("grid_id", "tile").applyInPandas(label, names)
    if grid.n_tiles > 1:
        local = _join_tiles(local)
    return local.where("core").drop("core")


def _join_tiles(local: DataFrame) -> DataFrame:
    """Labels of one cell in several tiles name one plateau."""
    met = local.groupBy("grid_id", "cell_id").agg(F.collect_set("plateau_id").alias("labels")).where("size(labels) > 1")
    met = met.select("grid_id", F.array_min("labels").alias("low"), F.explode("labels").alias("label")).where("low <> label")
    node = lambda c: F.struct("grid_id", F.col(c).alias("id"))
    roots = connected_components(met.select(node("low").alias("a"), node("label").alias("b")))
    roots = roots.select(F.col("node.grid_id").alias("grid_id"), F.col("node.id").alias("plateau_id"), F.col("component.id").alias("_root"))
    out = local.join(roots, ["grid_id", "plateau_id"], "left").withColumn("plateau_id", F.coalesce("_root", "plateau_id")).drop("_root")
    return out.select(*local.columns)


def plateaus(grid: Grid, cells: DataFrame | None = None, k: int = 1) -> DataFrame:
    """One row a plateau: height, area, centre (mean index), whether it is a regional maximum, whether it meets a face."""
    cells = plateau_cells(grid, k) if cells is None else cells
    face = F.lit(False)
    for a, n in zip(grid.axes, grid.shape, strict=True):
        face = face | (F.col(a) == 0) | (F.col(a) == n - 1)
    return cells.groupBy("grid_id", "plateau_id").agg(
        F.first("value").alias("height"),
        F.count("*").alias("area"),
        *(F.avg(a).alias(f"c{d}") for d, a in enumerate(grid.axes)),
        (~F.bool_or(F.coalesce(F.col("top") > F.col("value"), F.lit(False)))).alias("is_peak"),
        F.bool_or(face).alias("on_face"),
    )


def regional_maxima(grid: Grid, k: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """Plateaus without a higher neighbour."""
    return plateaus(grid, cells, k).where("is_peak").drop("is_peak")


def boundary_lower_share(grid: Grid, k: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """``(grid_id, plateau_id, boundary, lower)``: distinct cells around each plateau, and how many of them are lower."""
    cells = plateau_cells(grid, k) if cells is None else cells
    own = cells.select("grid_id", "cell_id", "plateau_id")
    pairs = neighbour_pairs(grid, k).join(own, ["grid_id", "cell_id"])
    around = pairs.where("other <> value").select("grid_id", "plateau_id", "value", "other_id", "other").distinct()
    return around.groupBy("grid_id", "plateau_id").agg(F.count("*").alias("boundary"), F.count_if(F.col("other") < F.col("value")).alias("lower"))


def valid_plateaus(grid: Grid, k: int = 1, strict: bool = True, share: float = 0.5, cells: DataFrame | None = None) -> DataFrame:
    """``(grid_id, plateau_id)`` of plateaus all of whose boundary is lower, or (relaxed) more than ``share`` of it."""
    found = boundary_lower_share(grid, k, cells)
    return found.where("lower = boundary" if strict else F.col("lower") > F.col("boundary") * share).select("grid_id", "plateau_id")


def mask_components(members: DataFrame, ndim: int, k: int, key: str = "peak_id") -> DataFrame:
    """Components of masks: ``members`` are ``(grid_id, key, i0 .., cell_id)``; adds ``component`` (its smallest cell_id).

    One task labels one mask at a time.
    """
    steps, axes = offsets(ndim, k), [f"i{d}" for d in range(ndim)]

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id", ignore_index=True)
        root = label_equal(pdf[axes].to_numpy(), np.zeros(len(pdf)), steps)
        pdf["component"] = pdf["cell_id"].to_numpy()[root]
        return pdf

    rows = members.select("grid_id", key, *axes, "cell_id")
    kinds = dict(rows.dtypes)
    names = ", ".join([*(f"{c} {kinds[c]}" for c in rows.columns), "component long"])
    return rows.groupBy("grid_id", key).applyInPandas(label, names)


def grid_components(grid: Grid, condition: Callable[[Column, Column], Column] | None = None, k: int = 1) -> DataFrame:
    """``(grid_id, cell_id, component)``: components of neighbouring cells for which ``condition(value, other)`` holds.

    The default condition is equality.  Cells without such a neighbour are their own component.
    """
    test = condition or (lambda value, other: value == other)
    pairs = neighbour_pairs(grid, k).where(test(F.col("value"), F.col("other"))).where("cell_id <> other_id")
    node = lambda c: F.struct("grid_id", F.col(c).alias("id"))
    roots = connected_components(pairs.select(node("cell_id").alias("a"), node("other_id").alias("b")))
    roots = roots.select(F.col("node.grid_id").alias("grid_id"), F.col("node.id").alias("cell_id"), F.col("component.id").alias("_root"))
    return grid.cells.select("grid_id", "cell_id").join(roots, ["grid_id", "cell_id"], "left").select("grid_id", "cell_id", F.coalesce("_root", "cell_id").alias("component"))


class Components:
    """Union-find questions answered on an edge table: one labelling, then look-ups by filter and count.

    Objects don't change: ``union``, ``merge`` and ``add`` give new ones.  The labelling runs when first asked for.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame | None = None) -> None:
        self.edges = edges.select(F.col(edges.columns[0]).alias("a"), F.col(edges.columns[1]).alias("b"))
        self.nodes = None if nodes is None else nodes.select(F.col(nodes.columns[0]).alias("node"))
        self._labels: DataFrame | None = None

    @property
    def labels(self) -> DataFrame:
        """``(node, component)``; a node without edges is its own component."""
        if self._labels is None:
            labels = connected_components(self.edges)
            ends = self.edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null")
            every = ends if self.nodes is None else ends.unionByName(self.nodes)
            alone = every.distinct().join(labels, "node", "left_anti")
            self._labels = labels.unionByName(alone.select("node", F.col("node").alias("component")))
        return self._labels

    def sizes(self) -> DataFrame:
        return self.labels.groupBy("component").agg(F.count("*").alias("size"))

    def count(self) -> int:
        return self.labels.select("component").distinct().count()

    def find(self, node) -> int | None:
        row = self.labels.where(F.col("node") == F.lit(node)).first()
        return None if row is None else row["component"]

    def connected(self, a, b) -> bool:
        one = self.find(a)
        return one is not None and one == self.find(b)

    def containing(self, node) -> DataFrame:
        return self.labels.where(F.col("component") == F.lit(self.find(node))).select("node")

    def union(self, a, b) -> Components:
        more = self.edges.sparkSession.createDataFrame([(a, b)], self.edges.schema)
        return Components(self.edges.unionByName(more), self.nodes)

    def merge(self, other: Components) -> Components:
        nodes = [n for n in (self.nodes, other.nodes) if n is not None]
        return Components(self.edges.unionByName(other.edges), nodes[0].unionByName(nodes[-1]).distinct() if nodes else None)

    def add(self, nodes: DataFrame) -> Components:
        new = nodes.select(F.col(nodes.columns[0]).alias("node"))
        return Components(self.edges, new if self.nodes is None else self.nodes.unionByName(new).distinct())


def merge_plateaus(cells: DataFrame, grid: Grid, k: int = 1, valid: str = "valid") -> DataFrame:
    """Plateaus of equal height that touch become one, valid if any part is; ``(grid_id, plateau_id, merged_id, valid)``."""
    own = cells.select("grid_id", "cell_id", "plateau_id", valid)
    other = own.select("grid_id", F.col("cell_id").alias("other_id"), F.col("plateau_id").alias("other_plateau"))
    met = neighbour_pairs(grid, k).where("value = other").join(own, ["grid_id", "cell_id"]).join(other, ["grid_id", "other_id"]).where("plateau_id < other_plateau")
    node = lambda c: F.struct("grid_id", F.col(c).alias("id"))
    roots = connected_components(met.select(node("plateau_id").alias("a"), node("other_plateau").alias("b")))
    roots = roots.select(F.col("node.grid_id").alias("grid_id"), F.col("node.id").alias("plateau_id"), F.col("component.id").alias("_root"))
    each = own.groupBy("grid_id", "plateau_id").agg(F.bool_or(valid).alias(valid)).join(roots, ["grid_id", "plateau_id"], "left")
    each = each.withColumn("merged_id", F.coalesce("_root", "plateau_id")).drop("_root")
    any_valid = each.groupBy("grid_id", "merged_id").agg(F.bool_or(valid).alias(valid))
    return each.drop(valid).join(any_valid, ["grid_id", "merged_id"]).select("grid_id", "plateau_id", "merged_id", valid)
