"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

A text becomes a sparse vector: hashed words weighted by their share of the text, and one indicator for the bin of
each structure statistic.  The machine adds a linear part and low-rank pairwise interactions,

    sum over pairs of <v_i, v_j> x_i x_j  =  1/2 sum over f of ((sum v_if x_i)^2 - sum v_if^2 x_i^2),

so that a text is scored in time linear in its words.  It is trained on the driver from at most ``TRAINING_ROWS``
labelled rows, whose vectors the executors make, and sent to them as two arrays of fixed size.

Nulls and ties: a null or empty text has the indicators of an empty text and is scored.  Null labels, and labels of
unknown documents, teach nothing; several labels of a document are several rows.  Without labels of both classes
every score is 1 (or 0 if all known labels are 0).  Repeated rows and null ids are scored like others (a null id is
never held out).  Extra columns are ignored, among them lang and source; long texts are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import WordHash, fold, id_and_text, small

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Bound on the labelled rows that the machine is trained on.
TRAINING_ROWS = 6_000
WORD_BITS = 16
RANK = 4
BINS = 16

_UPPER, _DIGIT, _SPACE, _STOP = re.compile(rb"[A-Z]"), re.compile(rb"[0-9]"), re.compile(rb"[\x20\x09-\x0d]"), re.compile(rb"[.,;:!?'\"()\-]")
_MARK = re.compile(rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e]")
STATS = 16


def _bin(value: float) -> int:
    return min(BINS - 1, max(0, int(value * BINS)))


def structure(raw: bytes, words: list[bytes], distinct: int) -> list[int]:
    """The bin of each statistic; ``raw`` is the text's UTF-8 and ``words`` its lower-case words."""
    n, chars = len(words), len(raw)
    one, some = max(1, chars), max(1, n)
    marks = len(_MARK.findall(raw))
    upper = len(_UPPER.findall(raw))
    lines = raw.split(b"\n")
    ends = sum(1 for w in words if w[-1:] in b"!%&*#$|~^=+<>")
    bare = sum(1 for w in words if not w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
    return [
        _bin(np.log2(1 + n) / 16),
        _bin(np.log2(1 + chars) / 20),
        _bin(chars / some / 24),
        _bin(4 * marks / one),
        _bin(upper / one),
        _bin(8 * upper / one),
        _bin(8 * len(_DIGIT.findall(raw)) / one),
        _bin(4 * len(_SPACE.findall(raw)) / one / 2),
        _bin(8 * (marks - len(_STOP.findall(raw))) / one),
        _bin(distinct / some),
        _bin(len(set(lines)) / len(lines)),
        _bin(np.log2(1 + n / len(lines)) / 12),
        _bin(ends / some),
        _bin(4 * bare / some),
        _bin(2 * sum(map(eq, words, words[1:])) / some),
        _bin(sum(map(eq, words, words[1:])) / some),
    ]


class Vectors:
    """Turns texts into sparse vectors; remembers word hashes."""

    def __init__(self) -> None:
        self.words = WordHash()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        self.words.trim()
        raw = text.encode()
        words = raw.lower().split()
        ids = (self.words.of(words) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
        ids, counts = np.unique(ids, return_counts=True)
        stats = np.asarray(structure(raw, words, len(ids)), np.int32) + BINS * np.arange(STATS, dtype=np.int32) + (1 << WORD_BITS)
        x = np.r_[2 * counts / max(1, len(words)), np.full(STATS, 0.5)].astype(np.float32)
        return np.r_[ids, stats].astype(np.int32), x


WIDTH = (1 << WORD_BITS) + BINS * STATS


def train(ids: list[np.ndarray], xs: list[np.ndarray], y: np.ndarray, rounds: int = 150, rate: float = 0.05, l2: float = 2e-5) -> dict:
    """Adam on the logistic loss over all rows at once."""
    row = np.repeat(np.arange(len(ids)), [len(i) for i in ids])
    col, x = np.concatenate(ids), np.concatenate(xs)
    used, col = np.unique(col, return_inverse=True)
    rng = np.random.default_rng(7)
    theta = np.zeros((len(used), RANK + 1), np.float32)
    theta[:, 1:] = rng.normal(0, 0.05, (len(used), RANK))
    bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    starts = np.searchsorted(row, np.arange(len(ids)))
    for t in range(1, rounds + 1):
        tx = theta[col] * x[:, None]
        s = np.add.reduceat(tx, starts, axis=0)
        q = np.add.reduceat(tx[:, 1:] ** 2, starts, axis=0).sum(axis=1)
        z = bias + s[:, 0] + 0.5 * ((s[:, 1:] ** 2).sum(axis=1) - q)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32) / len(y)
        e = err[row] * x
        grad = np.empty_like(theta)
        grad[:, 0] = np.bincount(col, e, len(used))
        for f in range(1, RANK + 1):
            grad[:, f] = np.bincount(col, e * (s[row, f] - tx[:, f]), len(used))
        grad += l2 * theta
        bias -= rate * float(err.sum())
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    full = np.zeros((WIDTH, RANK + 1), np.float32)
    full[used] = theta
    return {"bias": bias, "theta": full}


def score(model: dict, ids: np.ndarray, x: np.ndarray) -> float:
    tx = model["theta"][ids] * x[:, None]
    s = tx.sum(axis=0)
    z = model["bias"] + s[0] + 0.5 * float((s[1:] ** 2).sum() - (tx[:, 1:] ** 2).sum())
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def quality_model(docs: DataFrame, labels: DataFrame) -> dict:
    known = labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(TRAINING_ROWS)

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Vectors()
        for batch in small(it):
            made = [make(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([b.tobytes() for _, b in made], pa.binary()), batch.column(1)], names=["ids", "x", "quality"])

    rows = id_and_text(docs).join(F.broadcast(known), "doc_id").select("text", "quality").mapInArrow(vectors, "ids binary, x binary, quality int").toPandas()
    y = rows["quality"].to_numpy().astype(np.float32)
    if not len(y) or y.min() == y.max():
        always = 30.0 if not len(y) or y[0] == 1 else -30.0
        return {"bias": always, "theta": np.zeros((WIDTH, RANK + 1), np.float32)}
    order = np.lexsort((rows["x"], rows["ids"]))  # the same model whatever the order in which rows arrive
    return train([np.frombuffer(rows["ids"][i], np.int32) for i in order], [np.frombuffer(rows["x"][i], np.float32) for i in order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(quality_model(docs, labels))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, model = Vectors(), held.value
        for batch in small(it):
            scores = [score(model, *make(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
