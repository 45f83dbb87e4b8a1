"""Best-fit packing of token sequences by exact-complement hashing.

Pieces differ in nothing but their length, of which there are at most ``LENGTH``: the packing is found on the driver
from the histogram of lengths, whatever the number of pieces.  The longest length left opens a sequence; single
lengths, pairs and triples that sum to its gap are looked up in indexes of their sums, and the combination is used
as often as the counts allow.  Without one, the longest length that fits narrows the gap (best fit) and the search
goes on from there.  Each step uses up a length, so there are some thousand patterns at most, each with the number
of its sequences.

Pieces get a rank among those of their length: within hash buckets, after the counts of the buckets before.  Rank and
pattern give sequence and offset by arithmetic, without a join or a shuffle beyond that ranking.

Nulls and ties: a null text is empty, one piece with the closing id alone.  Repeated rows are packed as often as they
come, null ids stay null, extra columns are ignored.  An empty table gives no rows.  Texts of any length are cut
into full pieces, only the first of which may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import id_and_text, small
from ridgeline.llm.tokens import encoder, vocabulary
from ridgeline.shared import stage_table

LENGTH = 1024
CLOSING_ID = 2
#: Hash buckets among which the pieces of one length are ranked.
BUCKETS = 64

_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces: all full but the first."""
    n = len(ids)
    first = n % most or most if n else 0
    return [(0, first)] + [(s, most) for s in range(first, n, most)] if n else []


def pieces(docs: DataFrame, most: int = LENGTH, path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document."""
    path = path or vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in small(it):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.r_[encode(text), CLOSING_ID].astype("<u4")
                rows += [(doc_id, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cut(ids, most))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Complements:
    """Available lengths and the sums of one, two and three of them."""

    def __init__(self, counts: dict[int, int], most: int) -> None:
        self.left = np.zeros(most + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.most = most
        self._index()

    def _index(self) -> None:
        self.one = self.left > 0
        self.two = np.convolve(self.one, self.one)[: self.most + 1] > 0

    def times(self, pattern: list[int]) -> int:
        """How often the counts allow a pattern."""
        lengths, need = np.unique(pattern, return_counts=True)
        return int((self.left[lengths] // need).min())

    def use(self, pattern: list[int], times: int) -> None:
        for length in pattern:
            self.left[length] -= times
        if not self.left[pattern].all():
            self._index()

    def _pair(self, held: list[int], gap: int, top: int) -> list[int] | None:
        if gap >= 2 and self.two[gap]:
            a = np.arange(min(top, gap - 1), (gap - 1) // 2, -1)
            for x in a[self.one[a] & self.one[gap - a]]:
                if self.times([*held, x, gap - x]):
                    return [int(x), int(gap - x)]
        return None

    def exact(self, held: list[int], gap: int) -> list[int] | None:
        """One, two or three available lengths that fill the gap, the longest first."""
        if self.one[gap] and self.times([*held, gap]):
            return [gap]
        if found := self._pair(held, gap, gap):
            return found
        a = np.arange(gap - 2, 0, -1)
        for x in a[self.one[a] & self.two[gap - a]]:
            if 3 * x < gap:
                break
            if found := self._pair([*held, int(x)], gap - int(x), int(x)):
                return [int(x), *found]
        return None

    def fitting(self, held: list[int], gap: int) -> int | None:
        """The longest available length up to the gap."""
        for x in np.flatnonzero(self.one[: gap + 1])[::-1]:
            if self.times([*held, int(x)]):
                return int(x)
        return None


def pack_lengths(counts: dict[int, int], most: int = LENGTH) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each with the number of sequences that follow it; every length is used up."""
    index = Complements(counts, most)
    out = []
    while len(rest := np.flatnonzero(index.one)):
        pattern = [int(rest[-1])]
        while gap := most - sum(pattern):
            if found := index.exact(pattern, gap):
                pattern += found
                break
            longest = index.fitting(pattern, gap)
            if longest is None:
                break
            pattern.append(longest)
        times = index.times(pattern)
        index.use(pattern, times)
        out.append((pattern, times))
    return out


def _segments(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern: first rank, first sequence, pieces in a sequence, offset of the first."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            k = pattern.count(length)
            rank = used.get(length, 0)
            rows.append((length << 48 | rank, rank, base, k, offset))
            used[length] = rank + k * times
            offset += k * length
        base += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("key", "rank", "base", "each", "offset"), cols.T, strict=True))


def pack(docs: DataFrame, most: int = LENGTH, path: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of ``docs``."""
    spark = docs.sparkSession
    cut_up = stage_table(pieces(docs, most, path), "pieces")
    full = cut_up.where(F.col("length") == most).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = cut_up.where(F.col("length") < most).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)).cast("int"))
    # At most `most` * BUCKETS rows, whatever the input.
    counts = short.groupBy("length", "bucket").count().orderBy("length", "bucket").toPandas()
    before = counts["count"].groupby(counts["length"]).cumsum() - counts["count"]
    start = np.zeros((most + 1, BUCKETS), np.int64)
    start[counts["length"], counts["bucket"]] = before
    plan = spark.sparkContext.broadcast({"start": start, **_segments(pack_lengths(counts.groupby("length")["count"].sum().to_dict(), most))})

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in it:
            length, bucket, nth = (batch.column(i).to_numpy() for i in (3, 5, 6))
            rank = p["start"][length, bucket] + nth - 1
            at = np.searchsorted(p["key"], length << 48 | rank, side="right") - 1
            k = rank - p["rank"][at]
            sequence, offset = p["base"][at] + k // p["each"][at], p["offset"][at] + k % p["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*_PIECES.names, "sequence_id", "offset"])

    ranked = short.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")).cast("long"))
    names = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, names).unionByName(full)
