from pyspark.sql import functions as F

from ridgeline.operators.regions import regional_maxima
from ridgeline.sources import fixtures as fx
from ridgeline.sources.tables import read_table
from ridgeline.streaming import GridStream

from conftest import DATA


def test_stream_ends_like_the_batch(spark, tmp_path):
    events = read_table(spark, f"{DATA}/sf0.001", "events")
    source = str(tmp_path / "events")
    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(source)
    axes = [F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")), F.hour("ts")]
    grids = GridStream(spark, axes, fx.EV)
    seen = {}
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = grids.start(stream, lambda grid, batch: seen.update({batch: (grid.cells.agg(F.sum("value")).first()[0], regional_maxima(grid).count())}))
    query.awaitTermination()
    batch = fx.g_ev(spark, f"{DATA}/sf0.001")
    assert len(seen) == 3 and seen[2] == (1000, regional_maxima(batch).count()) and seen[0][0] < seen[1][0] < 1000
    # A repeated batch counts once.
    last = events.where(F.pmod("event_id", F.lit(3)) == 2)
    again = grids.update(last.limit(0), 3)
    assert grids.update(last.limit(0), 3).cells.exceptAll(again.cells).count() == 0
