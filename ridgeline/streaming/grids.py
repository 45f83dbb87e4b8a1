"""Rolls a stream of rows up into grid cells and analyses the grids again after each micro-batch.

A batch is reduced to one row a cell before it meets the cells so far, which are kept as one Parquet version a batch
in the shared folder.  A version is named after its batch, and a batch starts from the version before it: repeating
a batch after a failure writes the same version again, so that each row counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridgeline.grid import Grid, densify
from ridgeline.mapping import AxisMapping
from ridgeline.shared import scratch_path

Listener = Callable[[Grid, int], None]


class GridStream:
    """Counts (or sums of ``measure``) by cell over everything that came so far."""

    def __init__(self, spark: SparkSession, axes: Sequence[Column], shape: Sequence[int], measure: Column | None = None, grid_id: Column | str = "g", mapping: AxisMapping | None = None, folder: str | None = None) -> None:
        self.spark, self.axes, self.shape, self.mapping = spark, list(axes), tuple(shape), mapping
        self.measure = F.lit(1).cast("long") if measure is None else measure
        self.grid_id = F.lit(grid_id) if isinstance(grid_id, str) else grid_id
        self.folder = folder or scratch_path(spark, "grid-stream")
        self.names = [f"i{d}" for d in range(len(self.shape))]

    def _version(self, batch: int) -> str:
        return f"{self.folder}/cells-{batch}"

    def _cells(self, rows: DataFrame) -> DataFrame:
        keyed = rows.select(self.grid_id.alias("grid_id"), *(a.cast("long").alias(n) for n, a in zip(self.names, self.axes, strict=True)), self.measure.alias("value"))
        return keyed.dropna(subset=["grid_id", *self.names]).groupBy("grid_id", *self.names).agg(F.sum("value").alias("value"))

    def update(self, rows: DataFrame, batch: int) -> Grid:
        """Adds a batch and gives the grids after it."""
        new = self._cells(rows)
        if batch > 0:
            old = self.spark.read.schema(new.schema).parquet(self._version(batch - 1))
            new = old.unionByName(new).groupBy("grid_id", *self.names).agg(F.sum("value").alias("value"))
        new.write.mode("overwrite").parquet(self._version(batch))
        return self.grid(batch)

    def grid(self, batch: int) -> Grid:
        return densify(self.spark.read.parquet(self._version(batch)), self.shape, self.mapping)

    def start(self, stream: DataFrame, on_update: Listener, checkpoint: str | None = None, **trigger) -> StreamingQuery:
        """Starts a query that calls ``on_update(grid, batch)`` after each micro-batch."""
        writer = stream.writeStream.foreachBatch(lambda rows, batch: on_update(self.update(rows, batch), batch))
        return writer.option("checkpointLocation", checkpoint or f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
