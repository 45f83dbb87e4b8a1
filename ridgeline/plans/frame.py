"""PeakFrame: peaks with features that are joined only when a filter, an order or a selection names them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ridgeline.features.registry import Context, family_of, features

_TESTS: dict[str, Callable[[Column, Any], Column]] = {
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(list(v)),
    "nin": lambda c, v: ~c.isin(list(v)),
}
#: Shorthands of criteria.
_SHORT = {"prominence_threshold": "prominence__gte", "min_area": "area__gte", "min_height": "height__gte", "max_height": "height__lte"}


def parse_criterion(name: str) -> tuple[str, str]:
    """``feature__op`` (no suffix: eq)."""
    name = _SHORT.get(name, name)
    feature, sep, op = name.rpartition("__")
    if not sep:
        return name, "eq"
    if op not in _TESTS:
        raise ValueError(f"no operator {op!r}; there are {sorted(_TESTS)}")
    return feature, op


class PeakFrame:
    """A lazy collection of peaks."""

    def __init__(self, context: Context, df: DataFrame | None = None, strategy: str = "plateau_first") -> None:
        self.context = context
        self.df = context.peaks if df is None else df
        self.strategy = strategy

    def _with(self, df: DataFrame) -> PeakFrame:
        return PeakFrame(self.context, df, self.strategy)

    def _needing(self, *columns: str) -> DataFrame:
        missing = [c for c in columns if c not in self.df.columns]
        if not missing:
            return self.df
        for c in missing:
            if family_of(c) is None:
                raise ValueError(f"no feature {c!r}")
        # The peaks that are left so far decide for which peaks features are joined.
        return self.df.join(features(self.context, missing), ["grid_id", "peak_id"], "left")

    def filter(self, *tests: Callable[[Column], Column] | Column, **criteria: Any) -> PeakFrame:
        """Keep peaks that meet all criteria; ``feature__op=value``, ``feature=callable(Column)``, or columns.

        Criteria on columns at hand come first, so that features are joined for the rest alone.
        """
        parsed = [(*parse_criterion(k), v) for k, v in criteria.items()]
        out = self
        for feature, op, value in sorted(parsed, key=lambda t: t[0] not in self.df.columns):
            df = out._needing(feature)
            out = out._with(df.where(value(F.col(feature)) if callable(value) else _TESTS[op](F.col(feature), value)))
        for t in tests:
            out = out._with(out.df.where(t))
        return out

    def filter_by_coordinates(self, **ranges: tuple[float, float]) -> PeakFrame:
        """``x_range=(low, high)`` and so on, by axis label, inclusive."""
        mapping, df = self.context.grid.mapping, self.df
        for name, (low, high) in ranges.items():
            d = mapping.axis_info(name.removesuffix("_range"))["index"]
            df = df.where((F.lit(mapping.origin[d]) + F.col(f"c{d}") * mapping.scale[d]).between(low, high))
        return self._with(df)

    def sort_by(self, feature: str, ascending: bool = True) -> PeakFrame:
        df = self._needing(feature)
        return self._with(df.orderBy(F.col(feature).asc() if ascending else F.col(feature).desc(), "grid_id", "peak_id"))

    def top(self, n: int, feature: str = "height") -> PeakFrame:
        df = self._needing(feature)
        return self._with(df.orderBy(F.desc(feature), "grid_id", "peak_id").limit(n))

    def get_features(self, names: list[str]) -> DataFrame:
        """Peaks with the named features."""
        return self._needing(*names).select("grid_id", "peak_id", "height", *names)

    def __getitem__(self, key: str | int | slice) -> Any:
        if isinstance(key, str):
            return self._needing(key).select("grid_id", "peak_id", key)
        rows = self.df.orderBy("grid_id", "peak_id").limit(key.stop if isinstance(key, slice) else key + 1).collect()
        return rows[key]

    def __len__(self) -> int:
        return self.df.count()

    def __iter__(self) -> Iterator[Row]:
        return self.df.toLocalIterator()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def cache(self) -> PeakFrame:
        self.df.persist()
        return self

    def clear_cache(self) -> PeakFrame:
        self.df.unpersist()
        return self

    def to_df(self) -> DataFrame:
        """Peaks with centre coordinates."""
        mapping = self.context.grid.mapping
        index = [F.col(f"c{d}") for d in range(mapping.ndim)]
        return self.df.withColumns({f"coord_{d}": c for d, c in enumerate(mapping.coordinates(index))})

    def to_pandas(self):
        return self.to_df().toPandas()

    def write(self, path: str, mode: str = "errorifexists") -> None:
        self.to_df().write.mode(mode).parquet(path)


def all_of(tests: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, tests, F.lit(True))
