"""Per-peak features, each family a lazy DataFrame keyed by ``grid_id, peak_id``."""

from ridgeline.features.registry import FAMILIES, FeatureStore, features, register_family

__all__ = ["FAMILIES", "FeatureStore", "features", "register_family"]
