"""Summary statistics, normalisation and validation of grid values, each in one aggregation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.grid import Grid
from ridgeline.shared import lookup, stage_table

PERCENTILES = (5, 25, 50, 75, 95)
LEVELS = ("minimal", "standard", "strict", "custom")


def _finite(c: Column) -> Column:
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _percentiles(x: Column, shares: list[float], accuracy: int | None) -> Column:
    return F.percentile(x, shares) if accuracy is None else F.percentile_approx(x, shares, accuracy)


def statistics(cells: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row a grid, over finite values: moments, extremes, linear percentiles, coefficient of variation, gaps.

    Exact percentiles keep a count for each different value of a grid in one task.  For grids with very many of them,
    ``accuracy`` gives percentiles whose rank is off by no more than a share of ``1 / accuracy``, in bounded memory.
    """
    ok = _finite(F.col("value"))
    x = F.when(ok, F.col("value").cast("double"))
    agg = cells.groupBy("grid_id").agg(
        F.count(x).alias("count"),
        F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
        F.var_pop(x).alias("var"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        _percentiles(x, [p / 100 for p in PERCENTILES], accuracy).alias("_p"),
        F.when(F.var_pop(x) > 0, F.skewness(x)).alias("skewness"),
        F.when(F.var_pop(x) > 0, F.kurtosis(x)).alias("kurtosis"),
        F.count_if(~ok).alias("missing"),
        F.count("*").alias("_all"),
    )
    p = {q: F.col("_p")[i] for i, q in enumerate(PERCENTILES)}
    agg = agg.withColumns({f"p{q}": c for q, c in p.items()}).withColumns(
        {"median": p[50], "range": F.col("max") - F.col("min"), "iqr": p[75] - p[25], "cv": F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")), "missing_share": F.col("missing") / F.col("_all")}
    )
    return agg.drop("_p", "_all")


def normalise(cells: DataFrame, method: str = "minmax", axes: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Values scaled over each grid, or over each combination of the other ``axes`` given; spreads of 0 count as 1.

    ``accuracy`` is that of ``statistics``, for the robust method.
    """
    keys = ["grid_id", *axes]
    x = F.col("value").cast("double")
    q = _percentiles(x, [0.25, 0.5, 0.75], accuracy)
    aggs = {
        "minmax": [F.min(x).alias("_a"), (F.max(x) - F.min(x)).alias("_b")],
        "zscore": [F.avg(x).alias("_a"), F.stddev_pop(x).alias("_b")],
        "robust": [q[1].alias("_a"), (q[2] - q[0]).alias("_b")],
        "unit": [F.lit(0.0).alias("_a"), F.sqrt(F.sum(x * x)).alias("_b")],
    }
    if method not in aggs:
        raise ValueError(f"method must be one of {sorted(aggs)}")
    by = cells.groupBy(*keys).agg(*aggs[method])
    return lookup(cells, by, keys).withColumn("normalised", (x - F.col("_a")) / F.when(F.col("_b") == 0, 1.0).otherwise(F.col("_b"))).drop("_a", "_b")


@dataclass
class ValidationResult:
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def is_valid(self) -> bool:
        return not self.errors

    def merge(self, other: ValidationResult) -> ValidationResult:
        return ValidationResult(self.warnings + other.warnings, self.errors + other.errors, self.metadata | other.metadata)


def quality_score(strict: bool = False) -> Column:
    """Score of the columns of ``value_profile``: finite share, in strict mode by relative variance, with a bonus."""
    score = F.col("finite") / F.col("cells")
    if strict:
        spread = F.col("max") - F.col("min")
        score = score * F.when(spread == 0, 0.1).otherwise(F.least(F.lit(1.0), F.col("var") / (spread * spread) * 100))
    cv = F.when(F.col("mean") != 0, F.sqrt("var") / F.abs("mean"))
    return F.least(F.lit(1.0), score * F.when((cv > 0.01) & (cv < 10), 1.1).otherwise(1.0))


def value_profile(cells: DataFrame, low: float | None = None, high: float | None = None, inclusive: bool = True) -> DataFrame:
    """Everything the validators ask, one row a grid: counts, moments, extremes, range violations, outliers."""
    x = F.col("value").cast("double")
    ok = _finite(x)
    v = F.when(ok, x)
    below = F.lit(False) if low is None else (v < low if inclusive else v <= low)
    above = F.lit(False) if high is None else (v > high if inclusive else v >= high)
    first = cells.groupBy("grid_id").agg(
        F.count("*").alias("cells"), F.count_if(ok).alias("finite"), F.avg(v).alias("mean"), F.var_pop(v).alias("var"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, 0.5).alias("median"),
        F.count_if(below).alias("below"), F.count_if(above).alias("above"),
    )
    outside = F.abs(F.col("value").cast("double") - F.col("mean")) > 3 * F.sqrt("var")
    first = stage_table(first, "profile")
    out = lookup(cells, first.select("grid_id", "mean", "var"), ["grid_id"]).groupBy("grid_id").agg(F.count_if(outside).alias("outliers"))
    return first.join(out, "grid_id")


def validate(
    grid: Grid,
    level: str = "standard",
    low: float | None = None,
    high: float | None = None,
    inclusive: bool = True,
    expected_shape: Sequence[int] | None = None,
    expected_mean: float | None = None,
    tolerance: float = 0.1,
    completeness: float = 0.95,
    extra: Sequence[Any] = (),
) -> ValidationResult:
    """Checks one grid handle from a single profile; ``extra`` are callables ``(grid, profile row) -> ValidationResult``."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    kind = dict(grid.cells.dtypes)["value"]
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kind.startswith("decimal"):
        return ValidationResult(errors=[f"values must be numbers, not {kind}"])
    out = ValidationResult()
    rows = value_profile(grid.cells, low, high, inclusive).withColumn("quality", quality_score(level == "strict")).collect()
    if not rows:
        return ValidationResult(errors=["the grid has no cells"])
    for r in rows:
        out.metadata[r.grid_id] = r.asDict()
        share = r.finite / r.cells
        if r.finite < r.cells:
            out.errors.append(f"{r.grid_id}: {r.cells - r.finite} values are not finite")
        if r.cells != grid.size:
            out.errors.append(f"{r.grid_id}: {r.cells} cells for the shape {grid.shape}")
        if level == "minimal":
            continue
        if share < completeness:
            (out.errors if share < 0.8 else out.warnings).append(f"{r.grid_id}: {share:.1%} of the values are finite")
        if r.below or r.above:
            out.errors.append(f"{r.grid_id}: {r.below} values below and {r.above} above the range")
        if r.var is not None and r.var < 1e-12:
            out.warnings.append(f"{r.grid_id}: hardly any variance")
        if r.outliers:
            out.warnings.append(f"{r.grid_id}: {r.outliers} values beyond three standard deviations")
        if expected_mean is not None and abs(r.mean - expected_mean) > tolerance:
            out.warnings.append(f"{r.grid_id}: mean {r.mean} instead of {expected_mean}")
        if r.quality < 0.5:
            out.warnings.append(f"{r.grid_id}: quality {r.quality:.2f}")
        for check in extra:
            out = out.merge(check(grid, r))
    if expected_shape is not None and tuple(expected_shape) != grid.shape:
        out.errors.append(f"shape {grid.shape} instead of {tuple(expected_shape)}")
    if any(s < 1e-10 for s in grid.mapping.scale):
        out.warnings.append("a scale is close to 0")
    return out


def completeness(cells: DataFrame) -> DataFrame:
    """``(grid_id, coverage)``: share of finite values."""
    return cells.groupBy("grid_id").agg(F.avg(_finite(F.col("value")).cast("double")).alias("coverage"))
