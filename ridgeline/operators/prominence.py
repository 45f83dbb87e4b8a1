"""Prominence, saddles, descent paths and groups of equal summits.

One merge tree over the basins of all peaks of a grid replaces a flood per peak: cells are contracted to plateaus,
each plateau climbs to the peak of its steepest ascent, the highest saddle between two basins is an edge, and edges
are taken from the highest down.  Contraction runs on DataFrames (labels by tile, saddles by a combined aggregate), and
a large basin graph is contracted further by rounds, until what is left of it fits one task a grid.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.operators import kernels
from ridgeline.operators.regions import plateau_cells, plateaus
from ridgeline.operators.stencil import neighbour_pairs, offsets
from ridgeline.shared import drop_table, stage_table

#: Saddles of all grids that go to the tree as they are; more are contracted first.
MOST_SADDLES = 2_000_000
#: Cells of a grid whose ascent pointers are followed in one task.
CLIMB_CELLS = 1 << 24

BOUNDARIES = ("infinite_height", "infinite_depth")


def find_peaks(grid: Grid, k: int = 1, boundary: str = "infinite_height", min_boundary_distance: int = 0, min_area: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """``(grid_id, peak_id, height, area, c0 .., on_face)``: regional maxima.

    With ``infinite_height`` a plateau that meets a face of the grid is no peak; with ``infinite_depth`` it may be.
    A peak whose centre lies less than ``min_boundary_distance`` cells from a face is left out.
    """
    if boundary not in BOUNDARIES:
        raise ValueError(f"boundary must be one of {BOUNDARIES}")
    found = plateaus(grid, cells, k).where("is_peak").drop("is_peak").withColumnRenamed("plateau_id", "peak_id")
    if boundary == "infinite_height":
        found = found.where("not on_face")
    if min_area > 1:
        found = found.where(F.col("area") >= min_area)
    if min_boundary_distance > 0:
        found = remove_boundary_artifacts(found, grid, min_boundary_distance)
    return found


def remove_boundary_artifacts(peaks: DataFrame, grid: Grid, distance: int) -> DataFrame:
    for d, n in enumerate(grid.shape):
        peaks = peaks.where((F.col(f"c{d}") >= distance) & (F.col(f"c{d}") < n - distance))
    return peaks


def basin_cells(grid: Grid, k: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """``(grid_id, cell_id, value, plateau_id, basin)``: the peak that steepest ascent from each cell's plateau reaches.

    A plateau climbs to its highest neighbour (ties: smallest plateau id).  Pointers of a grid of up to
    ``CLIMB_CELLS`` cells are followed in one task, those of larger ones by doubling: each round is a join that
    replaces a pointer by its target's pointer, so that a path of n plateaus takes log n rounds.
    """
    cells = plateau_cells(grid, k) if cells is None else cells
    own = cells.select("grid_id", "cell_id", "plateau_id")
    other = cells.select("grid_id", F.col("cell_id").alias("other_id"), F.col("plateau_id").alias("other_plateau"))
    climbs = neighbour_pairs(grid, k).where("other > value").join(own, ["grid_id", "cell_id"]).join(other, ["grid_id", "other_id"])
    to = climbs.groupBy("grid_id", "plateau_id").agg(F.max(F.struct("other", (-F.col("other_plateau")).alias("o"))).alias("u")).select("grid_id", "plateau_id", (-F.col("u.o")).alias("up"))

    if grid.size > CLIMB_CELLS:
        top = _follow(to)
        return cells.join(top, ["grid_id", "plateau_id"], "left").select("grid_id", "cell_id", "value", "plateau_id", F.coalesce("basin", "plateau_id").alias("basin"))

    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, where = np.unique(np.r_[pdf["plateau_id"], pdf["up"]], return_inverse=True)
        up = np.arange(len(ids))
        up[where[: len(pdf)]] = where[len(pdf) :]
        while (up[up] != up).any():
            up = up[up]
        return pd.DataFrame({"grid_id": pdf["grid_id"].iloc[0], "plateau_id": ids, "basin": ids[up]})

    top = to.groupBy("grid_id").applyInPandas(climb, "grid_id string, plateau_id long, basin long")
    return cells.join(top, ["grid_id", "plateau_id"], "left").select("grid_id", "cell_id", "value", "plateau_id", F.coalesce("basin", "plateau_id").alias("basin"))


def _follow(pointers: DataFrame) -> DataFrame:
    """``(grid_id, plateau_id, basin)``: where the pointers ``(grid_id, plateau_id, up)`` lead in the end."""
    now = stage_table(pointers, "ascent")
    while True:
        ahead = now.select("grid_id", F.col("plateau_id").alias("up"), F.col("up").alias("far"))
        new = stage_table(now.join(ahead, ["grid_id", "up"], "left").select("grid_id", "plateau_id", F.coalesce("far", "up").alias("up"), F.col("far").isNotNull().alias("moved")), "ascent")
        drop_table(now)
        if not new.where("moved").take(1):
            return new.select("grid_id", "plateau_id", F.col("up").alias("basin"))
        now = new.drop("moved")


def basin_saddles(grid: Grid, k: int = 1, basins: DataFrame | None = None) -> DataFrame:
    """``(grid_id, peak_a, peak_b, saddle_height, saddle_cell)``: the highest pass between neighbouring basins."""
    basins = basin_cells(grid, k) if basins is None else basins
    a = basins.select("grid_id", "cell_id", F.col("basin").alias("x"))
    b = basins.select("grid_id", F.col("cell_id").alias("other_id"), F.col("basin").alias("y"))
    met = neighbour_pairs(grid, k).join(a, ["grid_id", "cell_id"]).join(b, ["grid_id", "other_id"]).where("x < y")
    low = F.when(F.col("value") <= F.col("other"), F.col("cell_id")).otherwise(F.col("other_id"))
    met = met.select("grid_id", F.col("x").alias("peak_a"), F.col("y").alias("peak_b"), F.least("value", "other").alias("w"), (-low).alias("c"))
    return met.groupBy("grid_id", "peak_a", "peak_b").agg(F.max(F.struct("w", "c")).alias("s")).select("grid_id", "peak_a", "peak_b", F.col("s.w").alias("saddle_height"), (-F.col("s.c")).alias("saddle_cell"))


def _graph(grid: Grid, k: int, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Peaks with heights, and saddles between their basins.

    On a grid of one tile a kernel contracts the tile; on larger ones DataFrames do.
    """
    if grid.n_tiles > 1:
        basins = basin_cells(grid, k, cells)
        tops = basins.where("plateau_id = basin").groupBy("grid_id", F.col("basin").alias("peak_a")).agg(F.first("value").alias("saddle_height"))
        return tops, basin_saddles(grid, k, basins)
    steps, axes = offsets(grid.ndim, k), grid.axes

    def contract(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell_id", ignore_index=True)
        cell, value = pdf["cell_id"].to_numpy(), pdf["value"].to_numpy()
        root = np.searchsorted(cell, pdf["plateau_id"].to_numpy())
        u, v = kernels.neighbour_edges(pdf[axes].to_numpy(), steps)
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
        top = kernels.basins(len(pdf), value, root[u], root[v])[root]
        a, b = top[u], top[v]
        cross = a != b
        a, b, u, v = a[cross], b[cross], u[cross], v[cross]
        w = np.minimum(value[u], value[v])
        at = np.where(value[u] <= value[v], cell[u], cell[v])
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((at, -w, b, a))
        a, b, w, at = a[order], b[order], w[order], at[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        peaks = np.unique(top)
        n, m = len(peaks), int(first.sum())
        return pd.DataFrame(
            {
                "grid_id": pdf["grid_id"].iloc[0],
                "peak_a": np.r_[cell[peaks], cell[a[first]]],
                "peak_b": pd.array([None] * n + cell[b[first]].tolist(), "Int64"),
                "saddle_height": np.r_[value[peaks], w[first]],
                "saddle_cell": pd.array([None] * n + at[first].tolist(), "Int64"),
            }
        )[["grid_id", "peak_a", "peak_b", "saddle_height", "saddle_cell"]] if n or m else pd.DataFrame()

    kind = dict(cells.dtypes)["value"]
    both = cells.groupBy("grid_id").applyInPandas(contract, f"grid_id string, peak_a long, peak_b long, saddle_height {kind}, saddle_cell long")
    return both.where("peak_b is null").select("grid_id", "peak_a", "saddle_height"), both.where("peak_b is not null")


def merge_tree(grid: Grid, k: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """For every regional maximum: the saddle towards strictly higher terrain and what lies beyond.

    ``(grid_id, peak_id, height, saddle_height, saddle_cell, parent, join_height, join_cell, group_id)``: parent is the
    highest peak beyond the saddle (smallest id on a tie), null for the highest peaks; join is the higher saddle that
    links the peak to an equal one first, if any, and group_id the smallest peak of the group that such links make.
    """
    cells = plateau_cells(grid, k) if cells is None else cells
    tops, edges = _graph(grid, k, cells)
    if grid.n_tiles == 1:
        return _tree(tops, edges, dict(cells.dtypes)["value"]).drop("lead", "lead_height")
    tops, edges, settled = _contract(stage_table(tops, "tops"), stage_table(edges, "saddles"))
    rest = _tree(tops, edges, dict(cells.dtypes)["value"])
    if settled is None:
        return rest.drop("lead", "lead_height")
    return _with_parents(settled, stage_table(rest, "tree"))


def _tree(tops: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Kruskal's algorithm, one grid a task."""
    nodes = tops.select("grid_id", F.col("peak_a").alias("a"), F.lit(None).cast("long").alias("b"), F.col("saddle_height").alias("h"), F.lit(None).cast("long").alias("cell"))
    links = edges.select("grid_id", F.col("peak_a").alias("a"), F.col("peak_b").alias("b"), F.col("saddle_height").alias("h"), F.col("saddle_cell").alias("cell"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        node = pdf[pdf["b"].isna()].sort_values("a", ignore_index=True)
        edge = pdf[pdf["b"].notna()]
        ids, height = node["a"].to_numpy(), node["h"].to_numpy()
        a, b = np.searchsorted(ids, edge["a"].to_numpy(np.int64)), np.searchsorted(ids, edge["b"].to_numpy(np.int64))
        rows = kernels.merge_tree(ids, height, a, b, edge["h"].to_numpy(), edge["cell"].to_numpy(np.int64))
        out = pd.DataFrame(rows, columns=["saddle_height", "saddle_cell", "parent", "join_height", "join_cell", "group_id", "lead", "lead_height"], dtype=object)
        out.insert(0, "height", height)
        out.insert(0, "peak_id", ids)
        out.insert(0, "grid_id", pdf["grid_id"].iloc[0])
        return out

    names = f"grid_id string, peak_id long, height {kind}, saddle_height {kind}, saddle_cell long, parent long, join_height {kind}, join_cell long, group_id long, lead long, lead_height {kind}"
    return nodes.unionByName(links).groupBy("grid_id").applyInPandas(join, names)


def _contract(tops: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Shrinks a basin graph of more than ``MOST_SADDLES`` saddles, and says which peaks that has settled.

    In each round every component looks at its highest pass.  If that leads to a component with a higher top, its own
    top is settled there and the component joins the other one: all other ways out are no higher, so nothing is lost.
    Of several passes of one height, the cell of any may be named.
    Tops ``(grid_id, peak_a, saddle_height)`` and saddles keep their form; settled peaks are
    ``(grid_id, peak_id, height, saddle_height, saddle_cell, next)``.
    """
    settled = None
    while edges.count() > MOST_SADDLES:
        tall = tops.select("grid_id", F.col("peak_a").alias("y"), F.col("saddle_height").alias("hy"))
        both = edges.select("grid_id", F.col("peak_a").alias("x"), F.col("peak_b").alias("y"), "saddle_height", "saddle_cell")
        both = both.unionByName(both.select("grid_id", F.col("y").alias("x"), F.col("x").alias("y"), "saddle_height", "saddle_cell"))
        best = both.join(tall, ["grid_id", "y"]).groupBy("grid_id", "x").agg(
            F.max(F.struct("saddle_height", "hy", (-F.col("y")).alias("y"))).alias("m"),
            F.max(F.struct("saddle_height", (-F.col("saddle_cell")).alias("c"))).alias("s"),
        )
        own = tall.select("grid_id", F.col("y").alias("x"), F.col("hy").alias("hx"))
        done = best.join(own, ["grid_id", "x"]).where("m.hy > hx")
        done = stage_table(done.select("grid_id", F.col("x").alias("peak_id"), F.col("hx").alias("height"), F.col("m.saddle_height").alias("saddle_height"), (-F.col("s.c")).alias("saddle_cell"), (-F.col("m.y")).alias("next")), "settled")
        if done.isEmpty():
            break
        settled = done if settled is None else settled.unionByName(done)
        into = _follow(done.select("grid_id", F.col("peak_id").alias("plateau_id"), F.col("next").alias("up")))
        for end in ("peak_a", "peak_b"):
            edges = edges.join(into.select("grid_id", F.col("plateau_id").alias(end), "basin"), ["grid_id", end], "left").withColumn(end, F.coalesce("basin", end)).drop("basin")
        low, high, cell = F.least("peak_a", "peak_b"), F.greatest("peak_a", "peak_b"), (-F.col("saddle_cell")).alias("c")
        pairs = edges.where("peak_a <> peak_b").select("grid_id", low.alias("peak_a"), high.alias("peak_b"), F.struct("saddle_height", cell).alias("s"))
        pairs = pairs.groupBy("grid_id", "peak_a", "peak_b").agg(F.max("s").alias("s"))
        edges = stage_table(pairs.select("grid_id", "peak_a", "peak_b", F.col("s.saddle_height").alias("saddle_height"), (-F.col("s.c")).alias("saddle_cell")), "saddles")
        tops = stage_table(tops.join(done.select("grid_id", F.col("peak_id").alias("peak_a")), ["grid_id", "peak_a"], "left_anti"), "tops")
    return tops, edges, settled


def _with_parents(settled: DataFrame, rest: DataFrame) -> DataFrame:
    """Settled peaks and the rest of the tree as one.

    A settled peak's parent is the highest peak that can be reached without going below its saddle: from the peak next
    to it on to that peak's parent, as long as the way there is no lower; of equal peaks on that height, the leading one.
    """
    steps = settled.select("grid_id", F.col("peak_id").alias("at"), F.col("saddle_height").alias("w"), F.col("next").alias("to"))
    steps = steps.unionByName(rest.where("parent is not null").select("grid_id", F.col("peak_id").alias("at"), F.col("saddle_height").alias("w"), F.col("parent").alias("to")))
    leads = rest.where("lead is not null").select("grid_id", F.col("peak_id").alias("at"), F.col("lead_height").alias("w"), F.col("lead").alias("to"))
    now = settled
    for table in (steps, leads):
        table = stage_table(table, "steps")
        while True:
            ahead = table.select("grid_id", F.col("at").alias("next"), "w", "to")
            new = now.join(ahead, ["grid_id", "next"], "left").withColumn("moved", F.coalesce(F.col("w") >= F.col("saddle_height"), F.lit(False)))
            new = new.withColumn("next", F.when(F.col("moved"), F.col("to")).otherwise(F.col("next"))).drop("w", "to")
            new = stage_table(new.select(*settled.columns, "moved"), "parents")
            now = new.drop("moved")
            if not new.where("moved").take(1):
                break
    none = F.lit(None)
    kind = dict(rest.dtypes)["height"]
    out = now.select("grid_id", "peak_id", "height", "saddle_height", "saddle_cell", F.col("next").alias("parent"), none.cast(kind).alias("join_height"), none.cast("long").alias("join_cell"), F.col("peak_id").alias("group_id"))
    return rest.drop("lead", "lead_height").unionByName(out)


def boundary_minimum(grid: Grid) -> DataFrame:
    """``(grid_id, face_min, face_min_cell, min_all)``: lowest value on the grid's faces (smallest cell), and of all cells."""
    face = F.lit(False)
    for a, n in zip(grid.axes, grid.shape, strict=True):
        face = face | (F.col(a) == 0) | (F.col(a) == n - 1)
    low = F.min(F.when(face, F.struct("value", "cell_id")))
    return grid.cells.groupBy("grid_id").agg(low.alias("f"), F.min("value").alias("min_all")).select("grid_id", F.col("f.value").alias("face_min"), F.col("f.cell_id").alias("face_min_cell"), "min_all")


def prominence(grid: Grid, k: int = 1, boundary: str = "infinite_height", cells: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """``merge_tree`` with ``base`` and ``prominence``.

    The highest peaks fall to the lowest face value (``infinite_height``) or the lowest value of all
    (``infinite_depth``).
    """
    return _above_floor(merge_tree(grid, k, cells) if tree is None else tree, grid, boundary)


def _above_floor(rows: DataFrame, grid: Grid, boundary: str) -> DataFrame:
    if boundary not in BOUNDARIES:
        raise ValueError(f"boundary must be one of {BOUNDARIES}")
    # One row a grid, so a grid that holds all rows is not dealt to one task.
    floor = boundary_minimum(grid).select("grid_id", F.col("face_min" if boundary == "infinite_height" else "min_all").alias("_floor"))
    out = rows.join(floor, "grid_id").withColumn("base", F.coalesce("saddle_height", "_floor")).drop("_floor")
    return out.withColumn("prominence", F.col("height") - F.col("base"))


def prominence_within(grid: Grid, peaks: DataFrame, wlen: float, k: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """``(grid_id, peak_id, base, prominence)`` where only cells within ``wlen`` of the peak's centre count.

    The base is the best pass to strictly higher terrain inside the ball; without any, the lowest cell that can be
    reached.  Each peak meets the cells of its own box (a join on box rows), and is flooded by itself.
    """
    if not wlen > 0:
        raise ValueError("wlen must be positive")
    cells = plateau_cells(grid, k) if cells is None else cells
    steps, axes, r = offsets(grid.ndim, k), grid.axes, int(math.ceil(wlen))
    centre = [F.rint(f"c{d}").cast("long") for d in range(grid.ndim)]
    box = peaks.select("grid_id", "peak_id", "height", *(f"c{d}" for d in range(grid.ndim)), *(c.alias(f"m{d}") for d, c in enumerate(centre)))
    box = box.withColumn("i0", F.explode(F.sequence(F.greatest(F.lit(0), F.col("m0") - r - 1), F.least(F.lit(grid.shape[0] - 1), F.col("m0") + r + 1))))
    near = box.join(cells.select("grid_id", *axes, "cell_id", "value", "plateau_id"), ["grid_id", "i0"])
    for d in range(1, grid.ndim):
        near = near.where(F.abs(F.col(f"i{d}") - F.col(f"c{d}")) <= wlen)
    far = sum(((F.col(f"i{d}") - F.col(f"c{d}")) ** 2 for d in range(1, grid.ndim)), (F.col("i0") - F.col("c0")) ** 2)
    near = near.where((far <= wlen * wlen) | (F.col("plateau_id") == F.col("peak_id")))
    kind = dict(cells.dtypes)["value"]

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        pdf = pdf.sort_values("cell_id", ignore_index=True)
        value, height = pdf["value"].tolist(), pdf["height"].iloc[0]
        box = kernels.Box(pdf[axes].to_numpy())
        near: dict[int, list[int]] = {}
        for s in steps:
            for u, v in zip(*(x.tolist() for x in box.pairs(s)), strict=True):
                near.setdefault(u, []).append(v)
        start = np.flatnonzero(pdf["plateau_id"].to_numpy() == pdf["peak_id"].iloc[0]).tolist()
        heap = [(-value[i], i) for i in start]
        heapq.heapify(heap)
        seen, low = set(start), height
        while heap:
            v, i = heapq.heappop(heap)
            if -v > height:
                break
            low = min(low, -v)
            for j in near.get(i, ()):
                if j not in seen:
                    seen.add(j)
                    heapq.heappush(heap, (-value[j], j))
        return pd.DataFrame({"grid_id": [pdf["grid_id"].iloc[0]], "peak_id": [pdf["peak_id"].iloc[0]], "base": [low], "prominence": [height - low]})

    return near.groupBy("grid_id", "peak_id").applyInPandas(flood, f"grid_id string, peak_id long, base {kind}, prominence {kind}")


def steepest_descent(grid: Grid) -> DataFrame:
    """``(grid_id, cell_id, value, down, down_value)``: the lowest face neighbour below each cell.

    Of equally low ones the first counts, axis by axis, backward before forward; null where none is lower.
    """
    pairs = neighbour_pairs(grid, 1, [tuple(s * int(e == d) for e in range(grid.ndim)) for d in range(grid.ndim) for s in (-1, 1)])
    weights = [math.prod(grid.shape[d + 1 :]) for d in range(grid.ndim)]
    rank = F.lit(0)
    for j, (w, s) in enumerate((w, s) for w in weights for s in (-1, 1)):
        rank = F.when(F.col("other_id") - F.col("cell_id") == s * w, j).otherwise(rank)
    best = pairs.where("other < value").groupBy("grid_id", "cell_id").agg(F.min(F.struct("other", rank.alias("r"), "other_id")).alias("d"))
    return grid.cells.select("grid_id", "cell_id", "value").join(best, ["grid_id", "cell_id"], "left").select("grid_id", "cell_id", "value", F.col("d.other_id").alias("down"), F.col("d.other").alias("down_value"))


def descent_paths(grid: Grid, starts: DataFrame) -> DataFrame:
    """``(grid_id, start, step, cell_id, value)``: steepest descent from each start cell to where nothing is lower.

    Pointers are followed step by step as joins with the pointer table; values fall strictly, so paths end.
    """
    down = stage_table(steepest_descent(grid), "descent")
    here = starts.select("grid_id", F.col("cell_id").alias("start")).distinct()
    here = here.join(down.withColumnRenamed("cell_id", "start"), ["grid_id", "start"]).select("grid_id", "start", F.lit(0).alias("step"), F.col("start").alias("cell_id"), "value", "down")
    here = stage_table(here, "paths")
    out = [here]
    while True:
        nxt = here.where("down is not null").select("grid_id", "start", (F.col("step") + 1).alias("step"), F.col("down").alias("cell_id"))
        here = stage_table(nxt.join(down, ["grid_id", "cell_id"]).select("grid_id", "start", "step", "cell_id", "value", "down"), "paths")
        if here.isEmpty():
            break
        out.append(here)
    all_steps = out[0]
    for o in out[1:]:
        all_steps = all_steps.unionByName(o)
    return all_steps.drop("down")


def path_summary(paths: DataFrame, grid: Grid) -> DataFrame:
    """``(grid_id, start, cells, length, low, high)``: Euclidean length in coordinates, lowest and highest value."""
    from ridgeline.grid import index_of
    from ridgeline.mapping import distance

    at = paths.select("*", *(i.alias(f"p{d}") for d, i in enumerate(index_of(F.col("cell_id"), grid.shape))))
    w = Window.partitionBy("grid_id", "start").orderBy("step")
    here = [F.col(f"p{d}") for d in range(grid.ndim)]
    leg = distance(here, [F.lag(f"p{d}").over(w) for d in range(grid.ndim)], scale=grid.mapping.scale)
    return at.withColumn("_leg", leg).groupBy("grid_id", "start").agg(F.count("*").alias("cells"), F.coalesce(F.sum("_leg"), F.lit(0.0)).alias("length"), F.min("value").alias("low"), F.max("value").alias("high"))


def virtual_peaks(tree: DataFrame, peaks: DataFrame, ndim: int, max_link_distance: float | None = None) -> DataFrame:
    """Groups of equal summits that join above the saddle to higher terrain, as one peak each.

    ``(grid_id, group_id, height, members, area, c0 .., saddle_height)``: centre weighted by area; the group's base is
    the saddle towards strictly higher terrain.  ``max_link_distance`` keeps groups whose summits all lie within that
    distance of the group's centre.
    """
    area = peaks.select("grid_id", "peak_id", "area", *(f"c{d}" for d in range(ndim)))
    rows = tree.join(area, ["grid_id", "peak_id"])
    w = Window.partitionBy("grid_id", "group_id")
    rows = rows.withColumn("_n", F.count("*").over(w)).where("_n > 1")
    out = rows.groupBy("grid_id", "group_id").agg(
        F.first("height").alias("height"),
        F.sort_array(F.collect_list("peak_id")).alias("constituents"),
        F.count("*").alias("members"),
        F.sum("area").alias("area"),
        *((F.sum(F.col(f"c{d}") * F.col("area")) / F.sum("area")).alias(f"c{d}") for d in range(ndim)),
        F.max("saddle_height").alias("saddle_height"),
        *(F.collect_list(f"c{d}").alias(f"_l{d}") for d in range(ndim)),
    )
    if max_link_distance is not None:
        spread = [F.array_max(F.transform(f"_l{d}", lambda x, d=d: F.abs(x - F.col(f"c{d}")))) for d in range(ndim)]
        out = out.where(sum((s * s for s in spread[1:]), spread[0] * spread[0]) <= max_link_distance**2)
    return out.drop(*(f"_l{d}" for d in range(ndim)))


def virtual_prominence(groups: DataFrame, grid: Grid, boundary: str = "infinite_height") -> DataFrame:
    """``virtual_peaks`` with ``base`` and ``prominence``; the highest groups fall to the grid's floor, as in ``prominence``."""
    return _above_floor(groups, grid, boundary)


def peak_saddles(grid: Grid, k: int = 1, cells: DataFrame | None = None) -> DataFrame:
    """The highest pass between each two neighbouring basins; see ``basin_saddles``."""
    cells = plateau_cells(grid, k) if cells is None else cells
    return _graph(grid, k, cells)[1].select("grid_id", "peak_a", "peak_b", "saddle_height", "saddle_cell")


def area_at_level(grid: Grid, peaks: DataFrame, rel_height: float = 0.5, k: int = 1) -> DataFrame:
    """``(grid_id, peak_id, level, cells)``: size of the region around a peak at ``height - rel_height * prominence``.

    ``peaks`` needs peak_id, height and prominence.  Each level is a flood of its own over the grid of the peak,
    carried out peak by peak in the group of the grid.
    """
    if not 0 <= rel_height <= 1:
        raise ValueError("rel_height must be in 0 to 1")
    steps, axes = offsets(grid.ndim, k), grid.axes
    rows = peaks.select("grid_id", "peak_id", (F.col("height") - F.col("prominence") * rel_height).cast("double").alias("level"))
    levels = rows.groupBy("grid_id").agg(F.collect_list(F.struct("peak_id", "level")).alias("levels"))
    cells = grid.cells.select("grid_id", *axes, "cell_id", F.col("value").cast("double").alias("value"))

    def flood(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"grid_id": [], "peak_id": [], "level": [], "cells": []})
        left = left.sort_values("cell_id", ignore_index=True)
        value, cell = left["value"].to_numpy(), left["cell_id"].to_numpy()
        u, v = kernels.neighbour_edges(left[axes].to_numpy(), steps)
        w = np.minimum(value[u], value[v])
        out = []
        for p in sorted(right["levels"].iloc[0], key=lambda p: p["level"]):
            on = w >= p["level"]
            root = kernels.settle(len(left), u[on], v[on])
            home = root[np.searchsorted(cell, p["peak_id"])]
            out.append((key[0], p["peak_id"], p["level"], int((root == home).sum())))
        return pd.DataFrame(out, columns=["grid_id", "peak_id", "level", "cells"])

    return cells.groupBy("grid_id").cogroup(levels.groupBy("grid_id")).applyInPandas(flood, "grid_id string, peak_id long, level double, cells long")
