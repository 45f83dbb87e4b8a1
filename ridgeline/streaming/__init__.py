"""Grids that grow by micro-batches."""

from ridgeline.streaming.grids import GridStream

__all__ = ["GridStream"]
