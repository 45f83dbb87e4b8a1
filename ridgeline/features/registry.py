"""Feature families by name: what columns each gives, and how to build it.

A family is a function of a context (grid, peaks, plateau cells of the peaks) that returns a lazy DataFrame; asking
for a column joins its family alone, so that nothing else is computed.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ridgeline.features import geometric, morphological, spread, topographic
from ridgeline.grid import Grid
from ridgeline.shared import drop_table, stage_table


@dataclass(frozen=True)
class Context:
    grid: Grid
    peaks: DataFrame
    members: DataFrame
    tree: DataFrame
    boundary: str = "infinite_height"
    p: float = 2.0


Builder = Callable[[Context], DataFrame]


def _prominence(c: Context) -> DataFrame:
    from ridgeline.operators.prominence import prominence

    return prominence(c.grid, boundary=c.boundary, tree=c.tree).select("grid_id", "peak_id", "prominence", "base", "saddle_cell", "parent", "group_id")


FAMILIES: dict[str, tuple[Builder, tuple[str, ...]]] = {
    "prominence": (_prominence, ("prominence", "base", "saddle_cell", "parent", "group_id")),
    "geometry": (
        lambda c: geometric.geometry(c.members, c.grid).drop("height", "area"),
        ("volume", "relief_volume", "aspect_ratio", "extent", "elongation", "box_volume", "centroid_0", "centroid_1", "centroid_2", "cells"),
    ),
    "perimeter": (lambda c: geometric.perimeter(c.members, c.grid), ("boundary", "perimeter", "compactness")),
    "box_prominence": (lambda c: topographic.box_prominence(c.peaks, c.grid), ("box_prominence",)),
    "relative_height": (lambda c: topographic.relative_height(c.peaks, c.grid), ("rel_height_10", "rel_height_25", "rel_height_50", "rel_height_100", "local_rel_height")),
    "slopes": (lambda c: topographic.slopes(c.members, c.grid), ("gradient_mean", "gradient_max", "gradient_min", "gradient_std", "slope_angle", "drainage_density", "flow_consistency")),
    "aspect": (lambda c: topographic.aspect(c.peaks, c.grid), ("aspect_angle",)),
    "curvature": (lambda c: topographic.curvature(c.peaks, c.grid), ("mean_curvature", "sharpness", "gaussian_curvature", "principal_1", "principal_2")),
    "directional": (lambda c: topographic.directional_slopes(c.peaks, c.grid), ("slope_0", "slope_1", "slope_2", "laplacian", "slope_variability")),
    "roughness": (lambda c: topographic.roughness(c.members), ("roughness",)),
    "tpi": (lambda c: topographic.topographic_position(c.peaks, c.grid), ("tpi",)),
    "tri": (lambda c: topographic.ruggedness(c.members, c.grid), ("tri",)),
    "isolation": (lambda c: topographic.isolation(c.peaks, c.grid, c.p), ("isolation", "topographic_isolation")),
    "responses": (lambda c: morphological.responses(c.members, c.grid), ("erosion_ratio", "dilation_ratio", "dilation_gain", "opening_ratio", "opening_loss", "closing_ratio", "closing_gain")),
    "erosion": (lambda c: morphological.erosion_depth(c.members, c.grid), ("erosion_iterations",)),
    "solidity": (lambda c: morphological.solidity(c.members, c.grid), ("solidity",)),
    "concavity": (lambda c: morphological.concavity(c.members, c.grid), ("concavity",)),
    "pattern": (lambda c: morphological.connectivity_pattern(c.members, c.grid), ("components", "largest_share", "size_variance", "component_sizes")),
    "euler": (lambda c: morphological.euler_number(c.members, c.grid), ("euler_number",)),
    "boundary_complexity": (lambda c: morphological.boundary_complexity(c.members, c.grid), ("boundary_length", "boundary_complexity", "fractal_dimension")),
    "skeleton": (lambda c: morphological.skeleton(c.members, c.grid), ("skeleton_length", "skeleton_ratio", "branch_points", "end_points")),
    "watershed": (lambda c: morphological.watershed(c.peaks, c.grid), ("watershed_regions", "drainage_area", "watershed_complexity")),
    "nearest": (lambda c: spread.nearest_neighbours(c.peaks, c.grid, p=c.p), ("nearest", "mean_knn", "std_knn", "max_knn", "knn", "k_used")),
    "density": (lambda c: spread.local_density(c.peaks, c.grid, c.p), ("density_r5", "density_r10", "density_r20", "density_r50", "density_adaptive")),
    "clustering": (lambda c: spread.clustering(c.peaks, c.grid, p=c.p), ("cluster_id", "cluster_size", "intra_mean", "intra_max", "inter_mean", "inter_min")),
    "distribution": (lambda c: spread.distribution(c.peaks, c.grid), ("center_distance", "center_distance_norm")),
    "isolation_measures": (lambda c: spread.isolation_measures(c.peaks, c.grid, c.p), ("topographic", "general", "prominence_isolation")),
    "boundary_distance": (lambda c: spread.boundary_distances(c.peaks, c.grid), ("min_boundary", "max_boundary", "mean_boundary", "norm_boundary")),
    "nearest_peaks": (lambda c: spread.nearest_peaks(c.peaks, c.grid, p=c.p), ("higher_id", "higher_distance", "similar_id", "similar_distance")),
}


def register_family(name: str, builder: Builder, columns: tuple[str, ...]) -> None:
    """A feature family of one's own."""
    taken = {c for n, (_, cols) in FAMILIES.items() if n != name for c in cols}
    if clash := taken & set(columns):
        raise ValueError(f"columns already given by another family: {sorted(clash)}")
    FAMILIES[name] = (builder, tuple(columns))


def family_of(column: str) -> str | None:
    return next((n for n, (_, cols) in FAMILIES.items() if column in cols), None)


def features(context: Context, names: list[str]) -> DataFrame:
    """``grid_id, peak_id`` and the named columns (or all columns of a named family)."""
    out = context.peaks.select("grid_id", "peak_id")
    by_family: dict[str, list[str]] = {}
    for n in names:
        if n in FAMILIES:
            by_family[n] = list(FAMILIES[n][1])
        elif (f := family_of(n)) is not None:
            by_family.setdefault(f, []).append(n)
        else:
            raise ValueError(f"no feature {n!r}")
    for f, cols in by_family.items():
        made = FAMILIES[f][0](context)
        out = out.join(made.select("grid_id", "peak_id", *(c for c in cols if c in made.columns)), ["grid_id", "peak_id"], "left")
    return out


class FeatureStore:
    """Feature families computed once and kept as tables, oldest first out.

    ``PeakFrame`` plans features anew for each question; a store is for asking the same ones often.
    """

    def __init__(self, context: Context, most: int = 50) -> None:
        self.context, self.most = context, most
        self._kept: dict[str, DataFrame] = {}
        self.hits = self.misses = 0

    def family(self, name: str) -> DataFrame:
        if name in self._kept:
            self.hits += 1
        else:
            self.misses += 1
            self._kept[name] = stage_table(FAMILIES[name][0](self.context), f"features-{name}")
            while len(self._kept) > self.most:
                drop_table(self._kept.pop(next(iter(self._kept))))
        return self._kept[name]

    def get(self, column: str) -> DataFrame:
        name = family_of(column)
        if name is None:
            raise ValueError(f"no feature {column!r}")
        return self.family(name).select("grid_id", "peak_id", column)

    def precompute(self, names: list[str], progress: Callable[[int, int], None] | None = None, threads: int = 4) -> None:
        """Computes families side by side; ``progress(done, all)`` is called after each."""
        wanted = [n for n in dict.fromkeys(n if n in FAMILIES else family_of(n) for n in names) if n]
        with ThreadPoolExecutor(threads) as pool:
            for done, _ in enumerate(pool.map(self.family, wanted), 1):
                if progress:
                    progress(done, len(wanted))

    def submit(self, name: str) -> Future:
        """Computes a family in the background."""
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(self.family, name)
        finally:
            pool.shutdown(wait=False)

    def statistics(self) -> dict[str, int]:
        return {"families": len(self._kept), "hits": self.hits, "misses": self.misses}

    def clear(self) -> None:
        for table in self._kept.values():
            drop_table(table)
        self._kept.clear()
