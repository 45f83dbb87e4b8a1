"""Small driver-side helpers: argument shapes, array checks, timing, memory."""

from __future__ import annotations

import functools
import logging
import resource
import time
from collections.abc import Callable
from typing import Any

import numpy as np

log = logging.getLogger("ridgeline")


def ensure_list(value: Any) -> list:
    """None is empty; sequences become lists; anything else is the only entry."""
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple, set, np.ndarray)) else [value]


def ensure_tuple(value: Any, length: int | None = None) -> tuple:
    """Like ``ensure_list``; a single value is repeated to ``length``."""
    out = tuple(ensure_list(value))
    if length is not None:
        if len(out) == 1:
            out *= length
        if len(out) != length:
            raise ValueError(f"expected {length} entries, got {len(out)}")
    return out


def validate_array(array: Any, min_dims: int = 1, max_dims: int | None = None, dtype: type | None = None, allow_empty: bool = False, finite: bool = False) -> np.ndarray:
    """The value as an array, or a ValueError or TypeError that says what is wrong with it."""
    out = np.asarray(array)
    if not np.issubdtype(out.dtype, np.number) and out.dtype != bool:
        raise TypeError(f"an array of numbers is needed, not {out.dtype}")
    if dtype is not None:
        out = out.astype(dtype)
    if out.ndim < min_dims or (max_dims is not None and out.ndim > max_dims):
        raise ValueError(f"{out.ndim} dimensions are outside {min_dims} to {max_dims or 'any'}")
    if not allow_empty and out.size == 0:
        raise ValueError("the array is empty")
    if finite and not np.isfinite(out).all():
        raise ValueError("the array holds values that are not finite")
    return out


def timer(fn: Callable) -> Callable:
    """Logs how long each call takes; the last time is kept as ``fn.seconds``."""

    @functools.wraps(fn)
    def run(*args: Any, **kwargs: Any) -> Any:
        began = time.perf_counter()
        try:
            return fn(*args, **kwargs)
        finally:
            run.seconds = time.perf_counter() - began
            log.info("%s took %.3f s", fn.__name__, run.seconds)

    run.seconds = None
    return run


def profile_memory(fn: Callable) -> Callable:
    """Logs by how much a call raises the driver's peak memory; kept as ``fn.megabytes``."""

    @functools.wraps(fn)
    def run(*args: Any, **kwargs: Any) -> Any:
        peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
        before = peak()
        try:
            return fn(*args, **kwargs)
        finally:
            run.megabytes = peak() - before
            log.info("%s raised the peak by %.1f MB", fn.__name__, run.megabytes)

    run.megabytes = None
    return run


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through four or more points whose third derivative is continuous next to both ends."""
    n = len(x)
    if n < 4:
        raise ValueError("a cubic spline needs four points")
    h = np.diff(x).astype(float)
    slope = np.diff(y) / h
    a, b = np.zeros((n, n)), np.zeros(n)  # second derivatives at the points
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * (slope[i] - slope[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    left, right = x[i + 1] - at, at - x[i]
    return (m[i] * left**3 + m[i + 1] * right**3) / (6 * h[i]) + (y[i] / h[i] - m[i] * h[i] / 6) * left + (y[i + 1] / h[i] - m[i + 1] * h[i] / 6) * right
