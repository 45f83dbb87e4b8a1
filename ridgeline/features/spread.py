"""How peaks lie to one another: distances, neighbours, density, clusters, isolation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.mapping import distance
from ridgeline.shared import stage_table

RADII = (5.0, 10.0, 20.0, 50.0)


#: Peaks up to which all pairs of a grid are looked at to find the nearest.
FEW_PEAKS = 2_000


def nearest_pairs(peaks: DataFrame, grid: Grid, k: int, p: float = 2.0, test: Column | None = None) -> DataFrame:
    """``pair_distances`` of each peak's k nearest others that pass ``test`` (on the columns of that table), ties by id.

    Many peaks are not paired with all others: rounds look within a radius, peaks that have found k there are done,
    and the rest looks four times as far.  A round joins buckets of the radius' side with the 3^n buckets around a
    peak; no Minkowski distance is less than the difference along an axis, so nothing nearer is missed.
    """
    test = F.lit(True) if test is None else test
    w = Window.partitionBy("grid_id", "peak_id").orderBy("d", "other_id")
    best = lambda pairs: pairs.where(test).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    n = grid.ndim
    at = [f"_x{d}" for d in range(n)]
    peaks = stage_table(peaks.select("grid_id", "peak_id", "height", *(f"c{d}" for d in range(n)), *((F.col(f"c{d}") * s).alias(a) for d, (a, s) in enumerate(zip(at, grid.mapping.scale, strict=True)))), "peaks")
    count, *ends = peaks.agg(F.count("*"), *(F.max(a) - F.min(a) for a in at)).first()
    if count <= FEW_PEAKS:
        return best(pair_distances(peaks, grid, p))
    widest = max([*ends, 1e-9])
    far = widest * (n if p < 1 or math.isinf(1 / p) else n ** (1 / min(p, 2.0))) * 2 if not math.isinf(p) else widest * 2
    r = widest * (4 * k / count) ** (1 / n)
    buckets = [f"_b{d}" for d in range(n)]
    todo, out = peaks, None
    while True:
        here = peaks.select("grid_id", F.col("peak_id").alias("other_id"), F.col("height").alias("other_height"), *(F.col(a).alias(f"{a}o") for a in at), *(F.floor(F.col(a) / r).alias(b) for a, b in zip(at, buckets, strict=True)))
        near = todo
        for a, b in zip(at, buckets, strict=True):
            near = near.withColumn(b, F.explode(F.array(*(F.floor(F.col(a) / r) + o for o in (-1, 0, 1)))))
        met = near.join(here, ["grid_id", *buckets]).where("peak_id <> other_id")
        d = distance([F.col(a) for a in at], [F.col(f"{a}o") for a in at], p)
        pairs = met.select("grid_id", "peak_id", "other_id", d.alias("d"), "height", "other_height")
        last = r >= far
        found = stage_table(best(pairs if last else pairs.where(F.col("d") <= r)), "nearest")
        done = found.groupBy("grid_id", "peak_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= k).select("grid_id", "peak_id")
        keep = found if last else found.join(done, ["grid_id", "peak_id"], "left_semi")
        out = keep if out is None else out.unionByName(keep)
        if last:
            return out
        todo = stage_table(todo.join(done, ["grid_id", "peak_id"], "left_anti"), "peaks")
        if todo.isEmpty():
            return out
        r *= 4


def pair_distances(peaks: DataFrame, grid: Grid, p: float = 2.0) -> DataFrame:
    """``(grid_id, peak_id, other_id, d, height, other_height)`` for each two different peaks of a grid.

    A feature that is defined over all pairs; Spark deals the pairs of one grid by both sides of the join.
    """
    n = grid.ndim
    cols = ["grid_id", "peak_id", "height", *(f"c{d}" for d in range(n))]
    a, b = peaks.select(*cols).alias("a"), peaks.select(*cols).alias("b")
    d = distance([F.col(f"a.c{i}") for i in range(n)], [F.col(f"b.c{i}") for i in range(n)], p, grid.mapping.scale)
    met = a.join(b, (F.col("a.grid_id") == F.col("b.grid_id")) & (F.col("a.peak_id") != F.col("b.peak_id")))
    return met.select("a.grid_id", "a.peak_id", F.col("b.peak_id").alias("other_id"), d.alias("d"), "a.height", F.col("b.height").alias("other_height"))


def nearest_neighbours(peaks: DataFrame, grid: Grid, k: int = 5, p: float = 2.0) -> DataFrame:
    """Nearest distance, and mean, std, max and list of the k nearest positive ones."""
    near = nearest_pairs(peaks, grid, k, p, F.col("d") > 0)
    return near.groupBy("grid_id", "peak_id").agg(
        F.min("d").alias("nearest"),
        F.avg("d").alias("mean_knn"),
        F.stddev_pop("d").alias("std_knn"),
        F.max("d").alias("max_knn"),
        F.sort_array(F.collect_list("d")).alias("knn"),
        F.count("*").alias("k_used"),
    )


def _measure(r: Column, n: int) -> Column:
    if n == 2:
        return F.lit(math.pi) * r * r
    if n == 3:
        return F.lit(4 / 3 * math.pi) * r * r * r
    return F.pow(r, F.lit(float(n)))


def local_density(peaks: DataFrame, grid: Grid, p: float = 2.0) -> DataFrame:
    """Other peaks within fixed radii, and within the mean distance, by the size of the ball."""
    pairs = pair_distances(peaks, grid, p)
    w = Window.partitionBy("grid_id", "peak_id")
    pairs = pairs.withColumn("_m", F.avg(F.when(F.col("d") > 0, F.col("d"))).over(w))
    n = grid.ndim
    cols = [(F.count_if(F.col("d") <= r) / _measure(F.lit(r), n)).alias(f"density_r{r:g}") for r in RADII]
    return pairs.groupBy("grid_id", "peak_id").agg(*cols, (F.count_if(F.col("d") <= F.col("_m")) / F.first(_measure(F.col("_m"), n))).alias("density_adaptive"))


def clusters(peaks: DataFrame, grid: Grid, cut: float = 10.0, p: float = 2.0) -> DataFrame:
    """Ward clusters of a grid's peaks, cut at a distance; a cluster's id is its smallest peak.

    Agglomeration needs all peaks of a grid; one task handles one grid.
    """
    n, scale = grid.ndim, grid.mapping.scale
    cols = [f"c{d}" for d in range(n)]

    def ward(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("peak_id", ignore_index=True)
        at = pdf[cols].to_numpy() * np.asarray(scale)
        gap = np.abs(at[:, None] - at[None])
        d = gap.max(axis=2) if math.isinf(p) else (gap**p).sum(axis=2) ** (1 / p)
        np.fill_diagonal(d, np.inf)
        size, label = np.ones(len(at)), np.arange(len(at))
        while True:
            i, j = divmod(int(np.argmin(d)), len(at))
            if not d[i, j] <= cut:
                break
            i, j = min(i, j), max(i, j)
            a, b = size[i], size[j]
            with np.errstate(invalid="ignore"):
                new = np.sqrt(((a + size) * d[i] ** 2 + (b + size) * d[j] ** 2 - size * d[i, j] ** 2) / (a + b + size))
            new[np.isinf(d[i]) | np.isinf(d[j])] = np.inf
            d[i], d[:, i] = new, new
            d[j], d[:, j] = np.inf, np.inf
            d[i, i] = np.inf
            size[i] += b
            label[label == j] = i
        ids = pdf["peak_id"].to_numpy()
        return pd.DataFrame({"grid_id": pdf["grid_id"], "peak_id": ids, "cluster_id": ids[label]})

    return peaks.select("grid_id", "peak_id", *cols).groupBy("grid_id").applyInPandas(ward, "grid_id string, peak_id long, cluster_id long")


def clustering(peaks: DataFrame, grid: Grid, cut: float = 10.0, p: float = 2.0) -> DataFrame:
    """Cluster, its size, mean and largest distance within it, mean and smallest distance to other clusters."""
    own = clusters(peaks, grid, cut, p)
    other = own.select("grid_id", F.col("peak_id").alias("other_id"), F.col("cluster_id").alias("_oc"))
    pairs = pair_distances(peaks, grid, p).join(own, ["grid_id", "peak_id"]).join(other, ["grid_id", "other_id"])
    same = F.col("cluster_id") == F.col("_oc")
    agg = pairs.groupBy("grid_id", "peak_id").agg(
        F.avg(F.when(same, F.col("d"))).alias("intra_mean"),
        F.max(F.when(same, F.col("d"))).alias("intra_max"),
        F.avg(F.when(~same, F.col("d"))).alias("inter_mean"),
        F.min(F.when(~same, F.col("d"))).alias("inter_min"),
    )
    size = own.groupBy("grid_id", "cluster_id").agg(F.count("*").alias("cluster_size"))
    return own.join(size, ["grid_id", "cluster_id"]).join(agg, ["grid_id", "peak_id"], "left")


def distribution(peaks: DataFrame, grid: Grid) -> DataFrame:
    """Distance from the middle of the grid (also by the largest), position by shape, deviation from the middle."""
    n = grid.ndim
    centre = distance([F.col(f"c{d}") for d in range(n)], [F.lit(s / 2) for s in grid.shape])
    rows = peaks.select("grid_id", "peak_id", *(f"c{d}" for d in range(n)), centre.alias("center_distance"))
    top = F.max("center_distance").over(Window.partitionBy("grid_id"))
    out = {"center_distance_norm": F.when(top > 0, F.col("center_distance") / top).otherwise(0.0)}
    out |= {f"relative_{d}": F.col(f"c{d}") / s for d, s in enumerate(grid.shape)}
    out |= {f"deviation_{d}": F.abs(F.col(f"c{d}") / s - 0.5) for d, s in enumerate(grid.shape)}
    return rows.withColumns(out).drop(*(f"c{d}" for d in range(n)))


def isolation_measures(peaks: DataFrame, grid: Grid, p: float = 2.0) -> DataFrame:
    """Distance to the nearest peak of at least the height (else the farthest), to the nearest, and weighed by height."""
    pairs = pair_distances(peaks, grid, p).join(peaks.groupBy("grid_id").agg(F.max("height").alias("_t")), "grid_id")
    weighed = F.col("d") / (F.col("other_height") / F.col("_t") + 0.1)
    general = F.min(F.when(F.col("d") > 0, F.col("d")))
    return pairs.groupBy("grid_id", "peak_id").agg(
        F.coalesce(F.min(F.when(F.col("other_height") >= F.col("height"), F.col("d"))), F.max("d")).alias("topographic"),
        general.alias("general"),
        F.when(F.first("_t") > 0, F.min(weighed)).otherwise(general).alias("prominence_isolation"),
    )


def boundary_distances(peaks: DataFrame, grid: Grid) -> DataFrame:
    """Smallest, largest and mean distance to the faces, and the smallest by the size of its axis."""
    each = [x for d, s in enumerate(grid.shape) for x in (F.col(f"c{d}"), F.lit(s - 1) - F.col(f"c{d}"))]
    by_size = [x / grid.shape[i // 2] for i, x in enumerate(each)]
    return peaks.select(
        "grid_id", "peak_id",
        F.least(*each).alias("min_boundary"),
        F.greatest(*each).alias("max_boundary"),
        (sum(each[1:], each[0]) / len(each)).alias("mean_boundary"),
        F.least(*by_size).alias("norm_boundary"),
    )


def nearest_peaks(peaks: DataFrame, grid: Grid, tolerance: float = 0.1, p: float = 2.0) -> DataFrame:
    """Nearest strictly higher peak, and nearest of similar height (within a share of the peak's own)."""
    higher = nearest_pairs(peaks, grid, 1, p, F.col("other_height") > F.col("height"))
    similar = nearest_pairs(peaks, grid, 1, p, F.abs(F.col("other_height") - F.col("height")) <= F.abs(F.col("height")) * tolerance)
    named = lambda pairs, x: pairs.select("grid_id", "peak_id", F.col("other_id").alias(f"{x}_id"), F.col("d").alias(f"{x}_distance"))
    rows = peaks.select("grid_id", "peak_id").join(named(higher, "higher"), ["grid_id", "peak_id"], "left")
    return rows.join(named(similar, "similar"), ["grid_id", "peak_id"], "left")
