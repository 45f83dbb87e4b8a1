"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a fresh local one.

    On a cluster an unset folder is an error: executors would not see one of the driver's machine.
    """
    root = spark.conf.get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_KEY} to a folder that driver and executors share")
        root = getattr(spark, "_ridgeline_root", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="ridgeline-")
            spark._ridgeline_root = root
    # In full, as readers other than Spark know no default file system.
    path = spark._jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", full)


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_root(spark)}/ridgeline/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application has staged, once its results have been written elsewhere.

    Results are lazy and read staged tables when they run, so nothing is deleted before.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result survives the loss of any executor and carries no lineage of the plan that made it.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    plain = lambda uri: re.sub("^file:/+", "file:///", uri)
    for folder in {plain(f).rpartition("/")[0] for f in df.inputFiles()}:
        if folder.startswith(scratch_root(spark) + "/"):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of plans that have been run.

    Spark removes a plan's shuffle files from the executors' disks, and its generated classes, when the driver finds it
    unreachable; that may be long after the table it made has been staged.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Rows up to which a staged table is sent to all tasks.
SMALL_ROWS = 200_000


def lookup(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Inner join of ``big`` with the rows of ``small``, one for each combination of keys.

    A key may hold all of ``big`` (one grid), so the join must not deal ``big`` by key.  ``small`` is staged and
    counted: up to ``SMALL_ROWS`` rows it is broadcast, beyond that its rows are repeated over salts.
    """
    staged = stage_table(small, "lookup")
    if staged.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return big.join(F.broadcast(staged), keys)
    salt = F.pmod(F.xxhash64(*(c for c in big.columns if c not in keys)), F.lit(salts)).cast("int")
    spread = staged.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(spread, [*keys, "_salt"]).drop("_salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
