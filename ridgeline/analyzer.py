"""The facade: detect peaks of a grid, ask for features, summarise."""

from __future__ import annotations

import time
import warnings
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.features.geometric import peak_cells
from ridgeline.features.registry import Context, features
from ridgeline.functions.helpers import ensure_list
from ridgeline.grid import Grid
from ridgeline.operators import prominence as prom
from ridgeline.operators.regions import plateau_cells
from ridgeline.operators.statistics import ValidationResult, statistics, validate
from ridgeline.operators.stencil import gaussian, neighbour_pairs
from ridgeline.plans.frame import PeakFrame
from ridgeline.plans.strategy import STRATEGIES, characteristics, decide
from ridgeline.shared import stage_table


def check_parameters(**given: Any) -> None:
    """Raises ValueError or TypeError for arguments outside their domain."""
    tests = {
        "connectivity": (int, lambda v: v >= 1),
        "minkowski_p": ((int, float), lambda v: v > 0),
        "wlen": ((int, float), lambda v: v > 0),
        "min_area": ((int, float), lambda v: v >= 0),
        "rel_height": ((int, float), lambda v: 0 <= v <= 1),
        "radius": ((int, float), lambda v: v > 0),
        "boundary": (str, lambda v: v in prom.BOUNDARIES),
        "features": ((list, tuple), lambda v: all(isinstance(x, str) for x in v)),
        "scale": ((int, float, list, tuple), lambda v: all(x > 0 for x in ensure_list(v))),
        "strategy": (str, lambda v: v == "auto" or bool(STRATEGIES.get(v))),
    }
    for name, value in given.items():
        if value is None or name not in tests:
            continue
        kind, ok = tests[name]
        if not isinstance(value, kind) or isinstance(value, bool):
            raise TypeError(f"{name} must be of type {kind}")
        if not ok(value):
            raise ValueError(f"{name}={value!r} is out of range")


class TerrainAnalyzer:
    def __init__(self, strategy: str = "auto", connectivity: int = 1, boundary: str = "infinite_height", minkowski_p: float = 2.0, min_boundary_distance: int = 1, noise_threshold: float = 0.0) -> None:
        check_parameters(connectivity=connectivity, boundary=boundary, minkowski_p=minkowski_p)
        if strategy != "auto":
            STRATEGIES.get(strategy)
        self.strategy, self.connectivity, self.boundary, self.p = strategy, connectivity, boundary, minkowski_p
        self.min_boundary_distance, self.noise_threshold = min_boundary_distance, noise_threshold

    def validate(self, grid: Grid, **options: Any) -> ValidationResult:
        return validate(grid, **options)

    def find_peaks(self, grid: Grid, min_area: int = 1, **filters: Any) -> PeakFrame:
        """Peaks of every grid of the frame, by regions of equal height; filters as in ``PeakFrame.filter``.

        Plateaus are labelled once and written to the shared folder; all features start from there.
        """
        if self.connectivity > grid.ndim:
            raise ValueError(f"connectivity must be at most {grid.ndim}")
        name = self.strategy
        if name == "auto":
            name = decide(characteristics(grid).first().asDict())
        work = gaussian(grid) if self.noise_threshold > 0 else grid
        cells = stage_table(plateau_cells(work, self.connectivity), "plateau-cells")
        work = work.with_cells(cells.select("grid_id", *work.axes, "cell_id", "value"))
        peaks = prom.find_peaks(work, self.connectivity, self.boundary, self.min_boundary_distance, min_area, cells)
        tree = prom.merge_tree(work, self.connectivity, cells)
        context = Context(work, peaks, peak_cells(cells, peaks), tree, self.boundary, self.p)
        return PeakFrame(context, strategy=STRATEGIES.get(name).name).filter(**filters)

    def analyze_prominence(self, peaks: PeakFrame, wlen: float | None = None) -> DataFrame:
        check_parameters(wlen=wlen)
        c = peaks.context
        if wlen is not None and wlen > max(c.grid.shape):
            warnings.warn("wlen is larger than the grid", stacklevel=2)
        if wlen is None:
            return features(c, ["prominence"])
        return prom.prominence_within(c.grid, peaks.df, wlen, self.connectivity)

    def calculate_features(self, peaks: PeakFrame, names: list[str]) -> DataFrame:
        check_parameters(features=names)
        return peaks.df.select("grid_id", "peak_id").join(features(peaks.context, names), ["grid_id", "peak_id"])

    def filter_peaks(self, peaks: PeakFrame, **criteria: Any) -> PeakFrame:
        return peaks.filter(**criteria)

    def get_virtual_peaks(self, peaks: PeakFrame, max_link_distance: float | None = None) -> DataFrame:
        c = peaks.context
        return prom.virtual_prominence(prom.virtual_peaks(c.tree, peaks.df, c.grid.ndim, max_link_distance), c.grid, self.boundary)


def benchmark_strategies(grid: Grid, names: list[str] | None = None) -> list[dict[str, Any]]:
    """Time, peaks, peaks per million cells and mean height of each strategy."""
    out = []
    for name in names or STRATEGIES.names():
        began = time.perf_counter()
        row = TerrainAnalyzer(strategy=name, min_boundary_distance=0).find_peaks(grid).df.agg(F.count("*").alias("n"), F.avg("height").alias("h")).first()
        out.append({"name": name, "seconds": time.perf_counter() - began, "peaks": row.n, "peaks_per_million": row.n / grid.size * 1e6, "mean_height": row.h})
    return out


def analyze(grid: Grid, **options: Any) -> dict[str, Any]:
    """Validation, peaks, geometry, topography, neighbour lists of plateau cells, and statistics."""
    analyzer = TerrainAnalyzer(**options)
    peaks = analyzer.find_peaks(grid)
    c = peaks.context
    near = neighbour_pairs(c.grid, c.grid.ndim).join(c.members.select("grid_id", "peak_id", "cell_id"), ["grid_id", "cell_id"])
    return {
        "validation": validate(grid),
        "peaks": peaks,
        "geometric": features(c, ["geometry", "perimeter"]),
        "topographic": features(c, ["prominence", "box_prominence", "slopes", "roughness", "tpi", "tri", "isolation"]),
        "connectivity": near.select("grid_id", "peak_id", "cell_id", "other_id", "other"),
        "stats": statistics(grid.cells),
    }
