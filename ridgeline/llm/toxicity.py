"""Toxicity: class-conditional Kneser-Ney models of words, symbol by symbol.

Two models, one of toxic and one of ordinary labelled texts, predict every symbol of every word, and its end, from the
``ORDER`` symbols before it in the word.  Each class has its own counts of these grams, from which an absolute
discount is taken; what it takes goes to one backoff that both share, interpolated Kneser-Ney over the last three
symbols: its counts are not occurrences but how many different grams end so.  So a rare expression that neither class
knows well weighs next to nothing, while a rare inflection keeps the weight of its stem.  A word counts once for each
text that has it, and grams counted once are wholly left to the backoff.

A text's figures are differences of its log-likelihoods under the two models: that of the whole text, a symbol, and
those of its ``STRONGEST`` words that speak most for toxicity, by the root of their length.  A logistic function of
them, fitted on at most ``CALIBRATION_ROWS`` labelled texts that the counts behind it have not seen, gives the score.

Texts are read once, into staged blocks: the distinct words of about ``BLOCK_CHARS`` characters of text, and which of
them each text has how often.  Counts cover every labelled training row; they are summed by Spark under 64-bit
digests of contexts, and model tables are DataFrames that grow with the input.  A block asks for the contexts it has,
each once, in a join, and gets their differences back.  Nothing but the calibration rows' figures reaches the driver.

Nulls and ties: a null or empty text has the figures 0 and is scored as such.  Labels that are null or of an unknown
document teach nothing; a document with several labels counts once for each.  Without labels of both classes every
score is 0.  Repeated rows and null ids are scored like others (a null id is never held out).  Extra columns are
ignored.  Texts and words are read whole; a text longer than a block is a block of its own.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import bucketed_table, fold, id_and_text, small, windows
from ridgeline.shared import drop_table, release, shuffle_partitions, stage_table

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Bound on the labelled rows that the logistic function is fitted on.
CALIBRATION_ROWS = 4_000
#: Symbols before a predicted one that the class models know.
ORDER = 5
#: Absolute discounts of class counts of one, two, and three or more.
DISCOUNTS = (1.0, 1.5, 1.8)
#: Absolute discount of the shared continuation counts.
SHARED_DISCOUNT = 0.75
#: Words of a text whose differences are figures of their own.
STRONGEST = 3
#: A block of texts closes at this many characters.
BLOCK_CHARS = 16 << 20

_WORD = re.compile(r"[^\W_]+")
_PAD, _END = "\0", "\1"
_SYMBOL_BITS = 21


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return _WORD.findall(text.lower())


class WordIds(dict):
    """Numbers of words, in the order in which they come."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol of the words, and of their ends: context, last three symbols, number of the word.

    A context is a digest of the ``ORDER`` symbols before; what precedes a word is padding.  With the symbol, the
    lowest bits of the last three, it is a gram.
    """
    line = "".join([f"{_PAD * ORDER}{w}{_END}" for w in words])
    codes = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    if not len(codes):
        none = np.zeros(0, np.int64)
        return none, none, none
    at = np.flatnonzero(codes[ORDER:])
    context = windows(codes, ORDER)[at]
    symbol = codes[at + ORDER]
    last = codes[at + ORDER - 2] << np.uint64(2 * _SYMBOL_BITS) | codes[at + ORDER - 1] << np.uint64(_SYMBOL_BITS) | symbol
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1)
    return context.astype(np.int64), last.astype(np.int64), owner


_BLOCK = pa.schema(
    [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("versions", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("words", pa.binary()), ("bag", pa.binary()), ("times", pa.binary())]
)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def text_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts: ids, versions (hashes of the texts), distinct words, and each text's words with their times.

    ``bag`` has word numbers, in each text rising and kept as steps, and ``times`` how often each occurs, text after
    text; ``ends`` is where each text's end.
    """

    def close(ids: list, versions: list, ends: list, known: WordIds, bags: list, times: list) -> pa.RecordBatch:
        # All lowest bytes of the numbers first, and so on: most of the others are 0.
        one = lambda parts: _pack(np.concatenate(parts).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
        cells = (uuid.uuid4().int >> 65, ids, versions, ends, _pack(" ".join(known).encode()), one(bags), one(times))
        return pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(cells, _BLOCK, strict=True)], schema=_BLOCK)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, versions, ends, known, bags, times, size, total = [], [], [], WordIds(), [], [], 0, 0
        for batch in small(it):
            for doc_id, text, version in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size + len(text) > BLOCK_CHARS and ids:
                    yield close(ids, versions, ends, known, bags, times)
                    ids, versions, ends, known, bags, times, size, total = [], [], [], WordIds(), [], [], 0, 0
                found = Counter(words_of(text))
                bag, often = (np.fromiter(v, np.int64, len(found)) for v in (map(known.__getitem__, found), found.values()))
                order = np.argsort(bag)
                bags.append(np.diff(bag[order], prepend=0))
                times.append(often[order])
                size, total = size + len(text), total + len(found)
                ids.append(doc_id)
                versions.append(version)
                ends.append(total)
        if ids:
            yield close(ids, versions, ends, known, bags, times)

    rows = id_and_text(docs).withColumn("version", F.xxhash64("text"))
    return rows.mapInArrow(run, "block long, ids array<long>, versions array<long>, ends array<int>, words binary, bag binary, times binary")


def _words(cell: bytes) -> list[str]:
    line = _unpack(cell).decode()
    return line.split(" ") if line else []


def _numbers(cell: bytes) -> np.ndarray:
    return np.frombuffer(_unpack(cell), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _bag(steps: bytes, ends: np.ndarray) -> np.ndarray:
    """Word numbers of all texts of a block."""
    total = np.cumsum(_numbers(steps))
    length = np.diff(ends, prepend=0)
    before = np.r_[0, total][ends - length]
    return total - np.repeat(before, length)


def _block_rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one at a time, as a batch may hold many large ones."""
    for batch in small(it, 1):
        yield from batch.to_pylist()


def _discounted(n: str) -> str:
    """What the absolute discount takes from a count."""
    return f"least({n}, if({n} >= 3, {DISCOUNTS[2]}D, if({n} >= 2, {DISCOUNTS[1]}D, {DISCOUNTS[0]}D)))"


#: Class counts of the two models: of all training rows, and of one part, which judges the other.
_CLASSES = {"o": "c0 + c2", "t": "c1 + c3", "ho": "c0", "ht": "c1"}


def class_counts(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """``(context, last, o, t, ho, ht, n.., s..)``: counts of each gram by model, with those of its context.

    n is the sum of a context's counts, and s what the discount takes from them.  ``known`` has one row ``(doc_id, part, ordinary, toxic)`` for each labelled document, with its numbers of labels.
    """

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _block_rows(it):
            words, ends = _words(b["words"]), np.array(b["ends"], np.int64)
            bag = _bag(b["bag"], ends)
            row, part, labels = (np.array([m[k] for m in b["marks"]], np.int64) for k in ("row", "part", "labels"))
            labels = labels.reshape(-1, 2)
            weight = np.zeros((4, len(ends)))
            for j in range(4):
                np.add.at(weight[j], row[part == j // 2], labels[part == j // 2, j % 2])
            text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            per_word = [np.bincount(bag, w[text], len(words)) for w in weight]
            met = np.flatnonzero(sum(per_word))
            context, last, owner = word_grams([words[i] for i in met])
            order = np.lexsort((last, context))
            context, last, owner = context[order], last[order], owner[order]
            first = np.flatnonzero(np.r_[True, (context[1:] != context[:-1]) | (last[1:] != last[:-1])][: len(context)])
            if not len(first):
                continue
            cells = [context[first], last[first]] + [np.add.reduceat(w[met][owner], first).astype(np.int64) for w in per_word]
            for i in range(0, len(first), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in cells], names=["context", "last", "c0", "c1", "c2", "c3"])

    texts = blocks.select("block", F.posexplode("ids").alias("row", "doc_id")).join(known, "doc_id")
    marks = texts.groupBy("block").agg(F.collect_list(F.struct("row", "part", F.array("ordinary", "toxic").alias("labels"))).alias("marks"))
    rows = blocks.select("block", "ends", "words", "bag").join(marks, "block").drop("block")
    partial = rows.mapInArrow(count, "context long, last long, c0 long, c1 long, c2 long, c3 long")
    # Blocks have summed their own; dealt by context, no sum over the grams of a context needs another shuffle.
    counts = partial.repartition(shuffle_partitions(blocks.sparkSession), "context").groupBy("context", "last").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(4)))
    counts = counts.selectExpr("context", "last", *(f"{e} as {c}" for c, e in _CLASSES.items()))
    context = Window.partitionBy("context")
    totals = [F.sum(c).over(context).alias(f"n{c}") for c in _CLASSES] + [F.sum(F.expr(_discounted(c))).over(context).alias(f"s{c}") for c in _CLASSES]
    return counts.select("*", *totals)


def shared_backoff(counts: DataFrame) -> DataFrame:
    """``(last, low)``: p(symbol | the two before it), from how many different grams end so.

    Interpolated over three, two and one symbols, and below these the same share for each symbol met and one unmet.
    """
    bits, d = _SYMBOL_BITS, f"{SHARED_DISCOUNT}D"
    three = stage_table(counts.groupBy("last").agg(F.count("*").alias("n")).selectExpr("last", f"last & ((1L << {2 * bits}) - 1) as two", "n"), "endings")
    two = three.groupBy("two").agg(F.count("*").alias("n")).selectExpr("two", f"two & ((1L << {bits}) - 1) as one", f"two >> {bits} as before", "n")
    one = two.groupBy("one").agg(F.count("*").alias("n"))
    # Symbols are code points, so the totals below are few rows.
    total = one.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    one = one.crossJoin(F.broadcast(total)).selectExpr("one", f"(greatest(n - {d}, 0) + {d} * kinds / (kinds + 1)) / total as p1")
    by_two = two.groupBy("before").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    two = two.join(by_two, "before").join(one, "one").selectExpr("two", f"(greatest(n - {d}, 0) + {d} * kinds * p1) / total as p2")
    three = three.withColumn("before", F.expr(f"last >> {bits}"))
    by_three = three.groupBy("before").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return three.join(by_three, "before").join(two, "two").selectExpr("last", f"(greatest(n - {d}, 0) + {d} * kinds * p2) / total as low")


def probabilities(counts: DataFrame, shared: DataFrame) -> DataFrame:
    """``(context, last, p.., w..)`` for o, t, ho, ht: p(symbol | context) of each class and its weight of the backoff."""
    rows = counts.select("*", *(F.expr(f"if(n{c} > 0, s{c} / n{c}, 1d)").alias(f"w{c}") for c in _CLASSES))
    own = (f"if(n{c} > 0, ({c} - {_discounted(c)}) / n{c}, 0d) + w{c} * low as p{c}" for c in _CLASSES)
    return rows.join(shared, "last").selectExpr("context", "last", *own, *(f"w{c}" for c in _CLASSES))


def differences(p: DataFrame) -> DataFrame:
    """``(context, gaps)``: log p(toxic) - log p(ordinary) of the symbols after a context, under both pairs of models.

    The first of ``gaps`` is that of symbols no class has met there: the shared backoff cancels, and its weights remain.
    It holds for symbols met once, too; the others follow.  Each is a number of 64 bits: the symbol, and two fixed-point
    numbers of 20 bits in steps of ``2 ** -14``.  Contexts without any difference are left out.
    """
    fixed = lambda x, y: f"cast(rint((ln({x}) - ln({y})) * {_STEPS}) as bigint) & {_LOW}"
    pair = lambda x: f"shiftleft({fixed(f'{x}t', f'{x}o')}, {_GAP_BITS}) | ({fixed(f'{x}ht', f'{x}ho')})"
    symbol = f"shiftleft(last & {(1 << _SYMBOL_BITS) - 1}, {2 * _GAP_BITS})"
    rows = p.selectExpr("context", f"{pair('w')} as unmet", f"{pair('p')} as own", f"{symbol} as symbol").where("unmet <> 0 or own <> unmet")
    met = F.when(F.expr("own <> unmet"), F.expr("symbol | own"))
    rows = rows.groupBy("context").agg(F.min("unmet").alias("unmet"), F.collect_list(met).alias("met"))
    return rows.select("context", F.expr("concat(array(unmet), met)").alias("gaps"))


#: Bits of a difference, and its steps.
_GAP_BITS, _STEPS = 20, 1 << 14
_LOW = (1 << _GAP_BITS) - 1


def _gap(packed: np.ndarray, which: int) -> np.ndarray:
    """The first or second difference of packed numbers."""
    x = (packed >> (_GAP_BITS * (1 - which))) & _LOW
    return (x - ((x >> (_GAP_BITS - 1)) << _GAP_BITS)) / _STEPS


def _block_keys(words: list[str]) -> tuple[np.ndarray, ...]:
    """Distinct contexts; each symbol's context among them, symbol, and word."""
    context, last, owner = word_grams(words)
    contexts, at = np.unique(context, return_inverse=True)
    return contexts, at, last & ((1 << _SYMBOL_BITS) - 1), owner


def _asked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, at, context)``: the distinct contexts of each block, in sorted order."""
    for b in _block_rows(it):
        contexts = np.unique(word_grams(_words(b["words"]))[0])
        for i in range(0, len(contexts), 50_000):
            part = contexts[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b["block"])), pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part)], names=["block", "at", "context"])


def word_gains(words: list[str], found: pa.StructArray) -> tuple[list[np.ndarray], np.ndarray]:
    """Differences of the log-likelihoods of each word, under both pairs of models, and the words' lengths.

    ``found`` has the rows of ``differences`` for the words' contexts, with ``at``, their places in sorted order.
    """
    contexts, at, symbol, owner = _block_keys(words)
    length = np.bincount(owner, minlength=len(words))
    place = found.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = found.field("gaps")
    gaps, begin = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    begin = begin - begin[0] if len(begin) else begin
    unmet = np.zeros(len(contexts), np.int64)
    unmet[place] = gaps[begin[:-1]]
    own = np.ones(len(gaps), bool)
    own[begin[:-1]] = False
    key = np.repeat(place, np.diff(begin))[own] << _SYMBOL_BITS | gaps[own] >> (2 * _GAP_BITS)
    order = np.argsort(key)
    key, own = key[order], gaps[own][order]
    mine = at << _SYMBOL_BITS | symbol
    gap = unmet[at]
    if len(key):
        hit = np.minimum(np.searchsorted(key, mine), len(key) - 1)
        gap = np.where(key[hit] == mine, own[hit], gap)
    return [np.bincount(owner, _gap(gap, i), len(words)) for i in (0, 1)], length


def figures(gain: np.ndarray, length: np.ndarray, bag: np.ndarray, times: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per text: difference of the log-likelihoods a symbol, and of the strongest words by the root of their length."""
    n = len(ends)
    out = np.zeros((n, 1 + STRONGEST))
    text = np.repeat(np.arange(n), np.diff(ends, prepend=0))
    out[:, 0] = np.bincount(text, gain[bag] * times, n) / np.maximum(np.bincount(text, length[bag] * times, n), 1)
    word = (gain / np.sqrt(np.maximum(length, 1)))[bag]
    order = np.lexsort((-word, text))
    rank = np.arange(len(order)) - np.r_[0, ends[:-1]][text[order]]
    for i in range(STRONGEST):
        pick = order[rank == i]
        out[text[pick], 1 + i] = np.maximum(word[pick], 0)
    return out


_FIGURES = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("full", pa.list_(pa.float64())), ("half", pa.list_(pa.float64()))])


def _judged(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, version, full, half)``: each text's figures under the two pairs of models."""
    for batch in small(it, 1):
        found = batch.column(batch.schema.get_field_index("found")).flatten()
        b = batch.drop_columns(["found"]).to_pylist()[0]
        (full, half), length = word_gains(_words(b["words"]), found)
        times, ends = _numbers(b["times"]), np.array(b["ends"], np.int64)
        bag = _bag(b["bag"], ends)
        for i in range(0, len(ends), 10_000):
            lo, hi = ends[i - 1] if i else 0, ends[min(i + 10_000, len(ends)) - 1]
            f = [pa.array(list(figures(g, length, bag[lo:hi], times[lo:hi], ends[i : i + 10_000] - lo)), pa.list_(pa.float64())) for g in (full, half)]
            yield pa.RecordBatch.from_arrays([pa.array(b["ids"][i : i + 10_000], pa.int64()), pa.array(b["versions"][i : i + 10_000], pa.int64()), *f], schema=_FIGURES)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Slopes and shift, by Newton's method on scaled figures."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = z.T @ (z * (p * (1 - p))[:, None]) + (l2 * len(x) + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - l2 * len(x) * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    slope = w[:-1] / scale
    return slope, float(w[-1] - slope @ mean)


def labelled(labels: DataFrame) -> DataFrame:
    """``(doc_id, part, ordinary, toxic)``: the training labels of each document, and its part of two."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.sum(1 - F.col("toxic")).alias("ordinary"), F.sum("toxic").alias("toxic"))
    return known.withColumn("part", (fold(F.col("doc_id"), FOLDS) / 2).cast("int"))


def text_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, version, score)`` for every row of ``docs``; version is a hash of the text."""
    blocks = bucketed_table(text_blocks(docs), "text_blocks", "block")
    known = labelled(labels)
    counts = stage_table(class_counts(blocks, known), "gram-counts")
    most = counts.agg(*(F.max(c).alias(c) for c in _CLASSES)).first().asDict()
    flat = blocks.select(F.explode(F.arrays_zip("ids", "versions")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.versions").alias("version"), F.lit(0.0).alias("score"))
    if not (most["o"] and most["t"]):
        return flat
    gains = stage_table(differences(probabilities(counts, shared_backoff(counts))), "gram-differences")
    drop_table(counts)
    release(docs.sparkSession)
    found = blocks.select("block", "words").mapInArrow(_asked, "block long, at int, context long").join(gains, "context")
    found = found.groupBy("block").agg(F.collect_list(F.struct("at", "gaps")).alias("found"))
    empty = F.expr("cast(array() as array<struct<at: int, gaps: array<bigint>>>)")
    rows = blocks.join(found, "block", "left").select("ids", "versions", "ends", "words", "bag", "times", F.coalesce("found", empty).alias("found"))
    judged = stage_table(rows.mapInArrow(_judged, "doc_id long, version long, full array<double>, half array<double>"), "figures")
    # The logistic function is fitted where the counts of the other part judge.
    halves = bool(most["ho"] and most["ht"])
    sample = judged.join(known.where("part = 1") if halves else known, "doc_id").select("doc_id", "version", "half" if halves else "full", "ordinary", "toxic")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "version").limit(CALIBRATION_ROWS).collect()
    y = np.array([float(r.toxic > r.ordinary) for r in sample])
    drop_table(blocks)
    release(docs.sparkSession)
    if len(set(y)) < 2:
        return judged.select("doc_id", "version", F.lit(0.0).alias("score"))
    slope, shift = fit_logistic(np.array([r[2] for r in sample]), y)
    line = F.lit(shift)
    for i, s in enumerate(slope):
        line = line + F.col("full")[i] * float(s)
    return judged.select("doc_id", "version", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    return text_scores(docs, labels).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is not predicted toxic."""
    toxic = text_scores(docs, labels).where(F.col("score") >= THRESHOLD).select(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).distinct()
    toxic = stage_table(toxic, "toxic")
    same = docs["doc_id"].cast("long").eqNullSafe(toxic["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == toxic["_version"])
    return docs.join(toxic, same, "left_anti")
