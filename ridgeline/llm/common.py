"""What the text operators share: input columns, word hashes, fold rules."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.shared import scratch_path, shuffle_partitions

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.  bytes.split() uses the same set.
#: bytes.lower() changes A-Z alone, so that both rules act on UTF-8 bytes without decoding.
MASK = (1 << 64) - 1


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_and_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone: further columns, whatever their names, are left behind; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bucketed_table(df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a table of the shared folder, bucketed by ``key``: joins on it shuffle the other side alone."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), key).option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


#: Bits of the filter that keeps rows without a key from being shuffled or read further.
FILTER_BITS = 26


def maybe_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key``, a 64-bit hash, is none of ``keys``.

    The keys set bits in a filter of fixed size, whose words (at most ``2 ** (FILTER_BITS - 6)`` rows) are sent to all
    tasks.  It loses no row with a key; where the keys outgrow it, it passes more and more others, so it is for uses
    where these cost time alone.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    bit = keys.select(place(key).alias("_h")).selectExpr("cast(_h div 64 as int) as _word", "shiftleft(1L, cast(_h % 64 as int)) as _bit")
    words = bit.groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    at = rows.withColumn("_h", place(key)).withColumn("_word", F.expr("cast(_h div 64 as int)"))
    met = at.join(F.broadcast(words), "_word").where(F.expr("shiftrightunsigned(_bits, cast(_h % 64 as int)) & 1 = 1"))
    return met.select(*rows.columns)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


class WordHash(dict):
    """64-bit hash of a word, remembered.  ``trim`` keeps the memory bounded."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self, most: int = 200_000) -> None:
        if len(self) > most:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` word hashes, in order."""
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        out = mix(out + h[j : j + n])
    return out


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct ``k``-word shingles; fewer words make one shingle; no words, none."""
    if not len(words):
        return words
    return np.unique(windows(words, min(k, len(words))))


def small(it: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that few texts are Python objects at a time."""
    for batch in it:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batches(fn: Callable[[list, list], list | None], names: list[str], schema: pa.Schema):
    """A mapInArrow function: ``fn`` takes the named columns as Python lists and gives the output columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            if batch.num_rows:
                out = fn(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema, strict=True)], schema=schema)

    return run


def salted_lookup(big: DataFrame, small: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join of ``big`` with the rows of ``small`` (one for each key), where one key may hold a large share of ``big``.

    A key's rows in ``big`` are dealt over ``salts`` join keys and the row of ``small`` is repeated for each of
    them, so no task gets more than a ``salts``-th of a hot key.
    """
    spread = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in big.columns if c != key]), F.lit(salts)).cast("int"))
    return left.join(small.select("*", spread), [key, "_salt"], "left").drop("_salt")
