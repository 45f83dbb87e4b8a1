"""What kind of data a grid holds, and which detection strategy suits it.

Both strategies have one physical plan here; the choice is validated, recorded, and carried in the result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.operators.stencil import noise_level, peak_density, plateau_ratio

#: Cells beyond which work by tiles is advised, and the least side of a tile.
CHUNK_CELLS, CHUNK_SIDE = 1_000_000, 64


@dataclass(frozen=True)
class StrategyConfig:
    connectivity: int = 1
    min_plateau_size: int = 1
    noise_threshold: float = 0.0
    parallel: bool = False
    chunk: int | None = None


@dataclass(frozen=True)
class Strategy:
    name: str
    config: StrategyConfig = StrategyConfig()
    #: Estimated seconds and bytes a cell, and scores for accuracy and scaling (fixed values).
    seconds: float = 1e-6
    bytes: int = 16
    accuracy: float = 0.9
    scalability: float = 0.8

    def estimate(self, cells: int) -> dict[str, float]:
        return {"seconds": self.seconds * cells, "megabytes": (self.bytes + 12) * cells / 1e6, "accuracy": self.accuracy, "scalability": self.scalability}


class Registry:
    """Strategies by name and alias."""

    def __init__(self) -> None:
        self._made: dict[str, Strategy] = {}
        self._alias: dict[str, str] = {}

    def register(self, strategy: Strategy, *aliases: str) -> None:
        self._made[strategy.name] = strategy
        for a in aliases:
            self.alias(a, strategy.name)

    def alias(self, alias: str, name: str) -> None:
        if name not in self._made:
            raise ValueError(f"no strategy {name!r}")
        self._alias[alias] = name

    def get(self, name: str, config: StrategyConfig | None = None) -> Strategy:
        name = self._alias.get(name.lower(), name.lower())
        if name not in self._made:
            raise ValueError(f"no strategy {name!r}; there are {self.names()}")
        made = self._made[name]
        return replace(made, config=config) if config else made

    def names(self) -> list[str]:
        return sorted(self._made)

    def info(self) -> list[dict[str, Any]]:
        return [{"name": s.name, "aliases": sorted(a for a, n in self._alias.items() if n == s.name), **s.estimate(1_000_000)} for s in self._made.values()]


STRATEGIES = Registry()
STRATEGIES.register(Strategy("union_find"), "uf", "unionfind")
STRATEGIES.register(Strategy("plateau_first", seconds=2e-6, bytes=12, accuracy=0.85, scalability=0.9), "plateau", "morphological")


def characteristics(grid: Grid) -> DataFrame:
    """One row a grid: size, value range, plateau ratio, noise level, peak density."""
    base = grid.cells.groupBy("grid_id").agg(F.count("*").alias("size"), F.min("value").alias("low"), F.max("value").alias("high"))
    out = base.join(plateau_ratio(grid).withColumnRenamed("ratio", "plateau_ratio"), "grid_id").join(noise_level(grid), "grid_id")
    return out.join(peak_density(grid).withColumnRenamed("density", "peak_density"), "grid_id", "left")


def decide(row: dict[str, Any], override: str | None = None, min_accuracy: float | None = None, max_time: float | None = None) -> str:
    """The strategy for a row of ``characteristics``."""
    if override and override != "auto":
        return STRATEGIES.get(override).name
    n, plateau, noise, density = row["size"], row["plateau_ratio"], row["noise"], row["peak_density"] or 0.0
    if min_accuracy is not None and min_accuracy > 0.9:
        return "union_find"
    if max_time is not None and max_time < 10 and n < 100_000 and plateau > 0.1:
        return "plateau_first"
    if n < 10_000 or plateau > 0.4:
        return "plateau_first"
    if n > 100_000 and plateau < 0.1:
        return "union_find"
    if plateau > 0.2:
        return "plateau_first"
    if noise > 0.1 * abs(row["high"]) or density > 0.01:
        return "union_find"
    return "union_find" if n > 50_000 else "plateau_first"


def decide_column(high: str = "high") -> Column:
    """The same rule as a column over ``characteristics``, for many grids at a time."""
    n, plateau = F.col("size"), F.col("plateau_ratio")
    first, second = F.lit("plateau_first"), F.lit("union_find")
    return (
        F.when((n < 10_000) | (plateau > 0.4), first)
        .when((n > 100_000) & (plateau < 0.1), second)
        .when(plateau > 0.2, first)
        .when((F.col("noise") > 0.1 * F.abs(high)) | (F.coalesce("peak_density", F.lit(0.0)) > 0.01), second)
        .when(n > 50_000, second)
        .otherwise(first)
    )


def auto_configure(row: dict[str, Any], connectivity: int = 1, max_memory_mb: float | None = None) -> StrategyConfig:
    config = StrategyConfig(connectivity=connectivity)
    if row["noise"] > 0.1:
        config = replace(config, noise_threshold=0.5 * row["noise"])
    if max_memory_mb is not None and max_memory_mb < 1000:
        config = replace(config, chunk=50_000)
    return config


def chunk_side(shape: tuple[int, ...]) -> int | None:
    """Side of a tile for a large grid, None for one that needs none."""
    cells = 1
    for n in shape:
        cells *= n
    return None if cells <= CHUNK_CELLS else max(CHUNK_SIDE, int(CHUNK_CELLS ** (1 / len(shape))))
