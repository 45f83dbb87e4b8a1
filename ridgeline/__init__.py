"""ridgeline: peak and terrain analytics over gridded tables, on PySpark."""

from ridgeline.analyzer import TerrainAnalyzer, analyze
from ridgeline.features import FeatureStore, features, register_family
from ridgeline.grid import Grid, densify, from_numpy
from ridgeline.mapping import AxisMapping
from ridgeline.operators.statistics import normalise, statistics, validate
from ridgeline.operators.stencil import offsets, strict_maxima
from ridgeline.plans.frame import PeakFrame
from ridgeline.sources.fixtures import test_pattern

__all__ = ["AxisMapping", "FeatureStore", "Grid", "TerrainAnalyzer", "PeakFrame", "analyze", "densify", "features", "from_numpy", "normalise", "offsets", "register_family", "statistics", "strict_maxima", "test_pattern", "validate"]
