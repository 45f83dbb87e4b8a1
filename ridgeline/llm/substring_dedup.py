"""Substring dedup: units of text are hashed, the earliest occurrence of each stays, later ones are cut out.

A unit is a line, or a part of one: a line is cut after the words whose hash is the least among the ``MIN_WORDS - 1``
words on both sides, where the last words of sentences come before all others, and never within ``MIN_WORDS`` words of
the line's ends.  So whether a line is cut after a word depends on a few words around it alone, and a passage that
stands inside different lines is met unit by unit.  Its first and last words, up to the first cut inside it and from
the last one on, belong to units with other words and stay.  Units are normalised (case, white space, punctuation at
the ends of words) and digested to 128 bits; per digest the lowest (doc_id, unit) is the one that stays.  What is cut is
described by character offsets into the original text.

Digests are pre-aggregated before they are shuffled, and units meet the digests that occur again in a join of two
staged tables, whose hot keys adaptive execution splits.  No group of units is gathered in one place.

Nulls and ties: a null or empty text has no units; rows without a doc_id are left as they are and keep nothing from
others.  Rows of one doc_id are one document: repeated rows do not cut each other, and of rows with
other texts under one id each is cut by its own offsets.  Units under ``MIN_WORDS`` words
are never compared; they go only where the units on both sides of them go to neighbouring units of one document.
Extra columns pass through; an empty table gives no spans.  Texts of any length are treated whole, in linear time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import free_name, id_and_text, small
from ridgeline.shared import release, stage_table

MIN_WORDS = 5

_WORD = re.compile(r"\S+")
_LINE = re.compile(r"\n\s*")
_ENDS = re.compile(r"[.!?][^\w\s]*\Z")
_MARKS = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”„‘’…–—"
_UNITS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("unit", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])


class Words(dict):
    """A word in lower case without punctuation at its ends, and its weight in the choice of cuts; remembered."""

    def __missing__(self, word: str) -> tuple[str, int]:
        bare = word.lower().strip(_MARKS)
        found = self[word] = bare, zlib.crc32(bare.encode("utf-8", "replace")) + (0 if _ENDS.search(word) else 1 << 32)
        return found

    def trim(self, most: int = 150_000) -> None:
        if len(self) > most:
            self.clear()


def text_units(text: str, min_words: int = MIN_WORDS, known: Words | None = None) -> list[tuple[int, int, str]]:
    """``(start, stop, normalised)`` of the units of at least ``min_words`` words; stop is where the next one begins."""
    out: list[tuple[int, int, str]] = []
    known = Words() if known is None else known
    at = 0
    for m in _LINE.finditer(text):
        _cut_line(text, at, m.end(), min_words, known, out)
        at = m.end()
    if at < len(text):
        _cut_line(text, at, len(text), min_words, known, out)
    return out


def _cut_line(text: str, start: int, stop: int, min_words: int, known: Words, out: list) -> None:
    at, words, weights = [], [], []
    for m in _WORD.finditer(text, start, stop):
        bare, weight = known[m[0]]
        if bare:
            at.append(m.start())
            words.append(bare)
            weights.append(weight)
    n = len(words)
    if n < min_words:
        return
    first, begin = 0, start
    if n >= 2 * min_words:
        for i in _cuts(np.array(weights, np.int64), min_words).tolist():
            out.append((begin, at[i + 1], " ".join(words[first : i + 1])))
            first, begin = i + 1, at[i + 1]
    out.append((begin, stop, " ".join(words[first:])))


def _cuts(weight: np.ndarray, min_words: int) -> np.ndarray:
    """The words after which a line is cut: less than the ``min_words - 1`` before, not more than as many after."""
    n, reach = len(weight), min_words - 1
    least = np.ones(n, bool)
    for d in range(1, reach + 1):
        least[d:] &= weight[d:] < weight[:-d]
        least[:-d] &= weight[:-d] <= weight[d:]
    least[:reach] = least[n - min_words :] = False
    return np.flatnonzero(least)


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, version, unit, start, stop, h1, h2)``: the units and their digests; version is a hash of the text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(5)]
        digests, known = bytearray(), Words()
        for batch in small(it):
            known.trim()
            for doc_id, text, version in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, (start, stop, piece) in enumerate(text_units(text, min_words, known)):
                    for col, cell in zip(cols, (doc_id, version, i, start, stop), strict=True):
                        col.append(cell)
                    digests += xxhash.xxh3_128_digest(piece)
                if len(cols[0]) >= 50_000:
                    yield flush(cols, digests)
                    cols, digests = [[] for _ in range(5)], bytearray()
        if cols[0]:
            yield flush(cols, digests)

    def flush(cols: list[list], digests: bytearray) -> pa.RecordBatch:
        h = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([*(pa.array(c, t.type) for c, t in zip(cols, _UNITS, strict=False)), pa.array(h[:, 0]), pa.array(h[:, 1])], schema=_UNITS)

    rows = id_and_text(docs).where("doc_id is not null").withColumn("version", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, version long, unit int, start long, stop long, h1 long, h2 long")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, version, unit, start, stop, kept_doc_id, kept_unit)``: every unit of an earlier unit's text, by offset."""
    found = stage_table(units(docs, min_words), "units")
    again = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "unit")).alias("kept"), F.max(F.struct("doc_id", "unit")).alias("last"))
    again = stage_table(again.where("kept <> last").select("h1", "h2", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.unit").alias("kept_unit")), "repeats")
    release(docs.sparkSession)
    met = found.join(again, ["h1", "h2"]).where("doc_id <> kept_doc_id or unit <> kept_unit")
    return met.select("doc_id", "version", "unit", "start", "stop", "kept_doc_id", "kept_unit").distinct()


def cut_spans(text: str, spans: list[dict]) -> str:
    """``text`` without the spans; what lies between neighbours that go to neighbours goes with them."""
    spans = sorted(spans, key=lambda s: s["unit"])
    out, at, before = [], 0, None
    for s in spans:
        joined = before is not None and (s["unit"], s["kept_doc_id"], s["kept_unit"]) == (before["unit"] + 1, before["kept_doc_id"], before["kept_unit"] + 1)
        if not joined:
            out.append(text[at : s["start"]])
        at, before = s["stop"], s
    return "".join(out) + text[at:]


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with later occurrences of repeated units cut out of ``text``; every row stays."""
    spans = repeated_spans(docs, min_words)
    key, version, cuts = (free_name(docs, n) for n in ("_id", "_version", "_spans"))
    lists = spans.groupBy(F.col("doc_id").alias(key), F.col("version").alias(version)).agg(F.collect_list(F.struct("unit", "start", "stop", "kept_doc_id", "kept_unit")).alias(cuts))
    columns, at = docs.columns, docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            cut = [t if not s else cut_spans(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
            cells = batch.columns[:-1]
            cells[at] = pa.array(cut, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cells, names=columns)

    same = (docs["doc_id"].cast("long") == lists[key]) & (F.xxhash64(docs["text"]) == lists[version])
    return docs.join(lists, same, "left").select(*(docs[c] for c in columns), lists[cuts]).mapInArrow(run, docs.schema)
