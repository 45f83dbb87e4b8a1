import os

from ridgeline.shared import clear_scratch, drop_table, scratch_root, stage_table


def test_staged_tables(spark):
    keep, drop = stage_table(spark.range(5), "keep"), stage_table(spark.range(7), "drop")
    root = scratch_root(spark).removeprefix("file://")
    assert keep.count() == 5 and drop.count() == 7
    before = len(os.listdir(root))
    drop_table(drop)
    drop_table(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
    assert len(os.listdir(root)) == before - 1 and keep.count() == 5
    assert spark.read.parquet("/root/testdata/sf0.001/region.parquet").count() == 5
    clear_scratch(spark)
    assert not os.path.exists(root)
