"""Connected components of an undirected edge table.

Large-star / small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond"): each round
hangs every node under a smaller neighbour, and the number of rounds grows with the logarithm of the longest
path.  Every round is written to the shared folder, so the plan stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.shared import drop_table, stage_table

#: Least number of neighbours from which a node's rows are not shuffled to one place.
HOT = 1_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every node that has an edge to another node; component is its smallest node.

    Null ends, self loops and repeated edges are ignored.  An empty edge table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, mark = _round(pairs, None)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        was, old = mark, pairs
        pairs, mark = _round(_small_star(_large_star(pairs, max(HOT, mark[0] // 1000))), old)
        if mark == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # Every node now hangs directly under the smallest node of its component.
    tops = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def _round(pairs: DataFrame, old: DataFrame | None) -> tuple[DataFrame, tuple]:
    staged = stage_table(pairs, "components")
    mark = staged.agg(
        F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")
    ).first()
    if old is not None:
        drop_table(old)
    return staged, tuple(mark)


def _large_star(pairs: DataFrame, hot: int) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    # Nodes with very many neighbours are few (at most 2000, as `hot` is a thousandth of the edges), and their rows
    # stay where they are; only the others meet in a shuffle.
    centres = low.where(F.col("n") >= hot).select("u", F.col("m").alias("h"))
    tagged = both.join(F.broadcast(centres), "u", "left")
    spread = tagged.where("h is not null").select("u", "v", F.col("h").alias("m"))
    joined = tagged.where("h is null").select("u", "v").join(low.where(F.col("n") < hot).select("u", "m"), "u").unionByName(spread)
    return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
