"""Benchmark decontamination by template canonicalisation.

Words become literals (lower case, without punctuation at their ends) or typed placeholders: numbers, units after
numbers, and names (capitalised words inside a sentence).  Windows of ``WINDOW`` template words of the documents meet
those of the benchmark by hash.  A document holds an item if, within a stretch not much longer than the item, at
least ``PERCENT`` of the item's windows are met and the values in the placeholders are consistent: one value of the
item always stands for the same value of the document and conversely.  So a question with other numbers and names is
caught, and text that merely has its form with mixed-up values is not.  A word after a line feed or a colon, or behind
a quotation mark, may begin a sentence or not; it is read both ways.

Besides, a document holds an item of which it has, within such a stretch, ``PERCENT`` of all windows word for word
(case and punctuation aside), whatever the windows hold: so copies of items that are short, or nothing but numbers and
names, are found too.

The benchmark is the query set: it is read in blocks of bounded size, each sent to the executors, and every document
is read against each block; documents are not shuffled.

Nulls and ties: null and empty texts hold nothing, and null or empty items are held by nothing.  An item shorter than
a window is one window.  Items with equal text are all reported; a repeated document row is reported as often as it
comes; rows without an id are searched too (null doc_id).  Extra columns are ignored, an empty benchmark or table
gives no rows.  Long texts are searched whole, in linear time.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import id_and_text, small, windows

WINDOW = 5
PERCENT = 75
#: Characters of benchmark text in a block.
BLOCK_CHARS = 16 << 20
#: A window needs this many literal words to count.
LITERALS = 3

#: Words taken as units after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons cup cups s sec secs second seconds min mins minute minutes "
    "h hr hrs hour hours day days week weeks month months year years cent cents dollar dollars euro euros "
    "percent degrees celsius fahrenheit mph kmh volt volts watt watts joule joules newton newtons".split()
)

_MARKS = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»“”„‘’…–—€£$"
_QUOTES = "\"'`([«“„‘"
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?\Z")
_MEASURE = re.compile(r"([+-]?\d[\d.,]*)([a-zA-Zµ°%]+)\Z")
_LITERAL, _NUM, _NAME, _UNIT = range(4)


_SLOTS = [xxhash.xxh3_64_intdigest(b"\0slot%d" % kind) for kind in range(4)]


class Words(dict):
    """Row of a word in tables of: literal hash, hash inside a sentence, flags; remembered word by word."""

    def __init__(self) -> None:
        self.literal: list[int] = []
        self.inside: list[int] = []
        self.exact: list[int] = []
        # 1 empty, 2 ends a sentence, 4 number, 8 may be a unit, 16 name inside a sentence, 32 colon, 64 behind a quotation mark
        self.flags: list[int] = []

    def __missing__(self, word: str) -> int:
        flags = 0
        if word.isalpha():  # most words
            bare, tail = word, ""
        elif word[:-1].isalpha() and word[-1] in _MARKS:
            bare, tail = word[:-1], word[-1]
        else:
            bare, tail = word.strip(_MARKS), word[len(word.rstrip(_MARKS)) :]
        if tail and ("." in tail or "!" in tail or "?" in tail):
            flags = 2
        low = bare.lower()
        if ":" in tail:
            flags |= 32
        if word[0] in _QUOTES:
            flags |= 64
        exact = literal = inside = xxhash.xxh3_64_intdigest(low)
        if not bare:
            flags |= 1
        elif not bare.isalpha() and (_NUMBER.match(bare) or _MEASURE.match(bare)):
            flags |= 4
            literal = inside = _SLOTS[_NUM]
        elif low in UNITS:
            flags |= 8
        elif bare[0].isupper() and not bare.isupper():
            flags |= 16
            inside = _SLOTS[_NAME]
        self.literal.append(literal)
        self.inside.append(inside)
        self.exact.append(exact)
        self.flags.append(flags)
        row = self[word] = len(self.literal) - 1
        return row


class Template:
    """Template words of a text: hashes, kinds and the words themselves.

    ``other`` has the hashes where all words that may begin a sentence do, and ``exact`` those of the words as they are.
    """

    def __init__(self, raw: list[str], rows: np.ndarray, lines: list[int], literal: np.ndarray, inside: np.ndarray, exact: np.ndarray, flags: np.ndarray) -> None:
        f = flags[rows]
        real = np.flatnonzero(f & 1 == 0)
        first = np.zeros(len(f) + 1, bool)
        first[lines] = True  # of a line; a mark that stands alone hands it on
        first = np.diff(np.cumsum(first[:-1])[real], prepend=0) > 0
        opens = np.r_[0, f & 96]  # a mark that stands alone opens what follows, too
        f, rows = f[real], rows[real]
        alone = opens[real] * (np.diff(real, prepend=-1) > 1) != 0
        begins = np.r_[True, f[:-1] & 2 != 0][: len(f)]
        unit = (f & 8 != 0) & np.r_[False, f[:-1] & 4 != 0][: len(f)]
        name = (f & 16 != 0) & ~begins
        self.hashes = np.where(unit, np.uint64(_SLOTS[_UNIT]), np.where(begins, literal[rows], inside[rows]))
        self.kinds = np.where(f & 4 != 0, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, _LITERAL)))
        maybe = begins | first | alone | (f & 64 != 0) | np.r_[False, f[:-1] & 32 != 0][: len(f)]
        self.other = np.where(unit, np.uint64(_SLOTS[_UNIT]), np.where(maybe, literal[rows], inside[rows]))
        self.exact = exact[rows]
        self.raw, self.at = raw, real

    def word(self, i: int) -> str:
        return self.raw[self.at[i]].strip(_MARKS).lower()

    def windows(self, k: int) -> np.ndarray:
        return windows(self.hashes, min(k, len(self.hashes))) if len(self.hashes) else self.hashes


class Tables:
    """Word tables kept as arrays with room to grow, and started anew beyond ``most`` words."""

    def __init__(self, most: int = 150_000) -> None:
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.words, self.known = Words(), 0
        self.room = tuple(np.zeros(1 << 16, k) for k in (np.uint64, np.uint64, np.uint64, np.uint8))

    def template(self, text: str) -> Template:
        if len(self.words) > self.most:
            self._clear()
        raw, lines, w = [], [], self.words
        for line in text.split("\n"):
            lines.append(len(raw))
            raw += line.split()
        rows = np.fromiter(map(w.__getitem__, raw), np.int64, len(raw))
        n = len(w.literal)
        if n > self.known:
            if n > len(self.room[0]):
                self.room = tuple(np.r_[a, np.zeros(n, a.dtype)] for a in self.room)
            for a, values in zip(self.room, (w.literal, w.inside, w.exact, w.flags), strict=True):
                a[self.known : n] = values[self.known :]
            self.known = n
        return Template(raw, rows, lines, *self.room)


def benchmark_index(items: list[tuple[int, str]], k: int = WINDOW) -> dict:
    """Windows of a block of items, as templates and word for word: sorted hashes with item and position, a bit table for a first look."""
    tables, parts, exact, held = Tables(), [], [], {}
    for item, text in items:
        t = tables.template(text or "")
        if not len(t.hashes):
            continue
        h, e = t.windows(k), windows(t.exact, min(k, len(t.exact)))
        literal = np.convolve(t.kinds == _LITERAL, np.ones(min(k, len(t.kinds)), int), "valid")
        keep = np.flatnonzero(literal >= min(LITERALS, len(t.kinds)))
        number = len(held)
        held[number] = (item, len(t.hashes), len(keep), t.kinds.tolist(), [t.word(i) for i in range(len(t.hashes))])
        parts.append((h[keep], np.full(len(keep), number), keep))
        exact.append((e, np.full(len(e), number), np.arange(len(e))))
    if not held:
        return {}
    sizes = sorted({min(k, n) for _, n, *_ in held.values()})
    return {"template": _sorted(parts), "exact": _sorted(exact), "items": held, "sizes": sizes}


def _sorted(parts: list[tuple]) -> dict:
    h, number, at = (np.concatenate(p) for p in zip(*parts, strict=True))
    order = np.argsort(h, kind="stable")
    bits = np.zeros(1 << 20, bool)
    bits[h & np.uint64((1 << 20) - 1)] = True
    return {"hash": h[order], "item": number[order], "at": at[order], "bits": bits}


def consistent(kinds: list[int], words: list[str], doc: Template, met: dict[int, int], k: int) -> bool:
    """Whether values in the placeholders of the met windows (item position to document position) agree one to one."""
    forth: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    for p, d in met.items():
        for j in range(min(k, len(words))):
            kind = kinds[p + j]
            if kind in (_NUM, _NAME):
                mine, theirs = words[p + j], doc.word(d + j)
                if forth.setdefault((kind, mine), theirs) != theirs or back.setdefault((kind, theirs), mine) != mine:
                    return False
    return True


def search(text: str, index: dict, tables: Tables, k: int = WINDOW, percent: int = PERCENT) -> list[tuple[int, int, int, int, int]]:
    """``(item, windows met, windows of the item, first word, last word)`` for each item that the text holds."""
    doc = tables.template(text)
    hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
    _meet(doc.hashes, index["template"], index["sizes"], hits)
    if not np.array_equal(doc.hashes, doc.other):
        _meet(doc.other, index["template"], index["sizes"], hits)
    out, found = [], set()
    for number, places in hits.items():
        item, length, n, kinds, words = index["items"][number]
        for met in _stretches(places, length, n, k, percent):
            if consistent(kinds, words, doc, met, k):
                out.append((item, len(met), n, min(met.values()), max(met.values()) + min(k, length) - 1))
                found.add(number)
                break
    hits = defaultdict(set)
    _meet(doc.exact, index["exact"], index["sizes"], hits)
    for number, places in hits.items():
        item, length, *_ = index["items"][number]
        n = length - min(k, length) + 1
        if number not in found and (met := next(_stretches(places, length, n, k, percent), None)):
            out.append((item, len(met), n, min(met.values()), max(met.values()) + min(k, length) - 1))
    return out


def _meet(hashes: np.ndarray, table: dict, sizes: list[int], hits: dict[int, set[tuple[int, int]]]) -> None:
    """Adds ``(document position, item position)`` of each window that an item of the table has."""
    for size in sizes:
        if len(hashes) < size:
            continue
        h = windows(hashes, size)
        maybe = np.flatnonzero(table["bits"][h & np.uint64((1 << 20) - 1)])
        lo = np.searchsorted(table["hash"], h[maybe], side="left")
        hi = np.searchsorted(table["hash"], h[maybe], side="right")
        for d, a, b in zip(maybe[lo < hi], lo[lo < hi], hi[lo < hi], strict=True):
            for i in range(a, b):
                hits[int(table["item"][i])].add((int(d), int(table["at"][i])))


def _stretches(places: set[tuple[int, int]], length: int, n: int, k: int, percent: int) -> Iterator[dict[int, int]]:
    """Item position to document position, for each stretch that has enough of an item's windows."""
    if 100 * len({p for _, p in places}) < percent * n:
        return
    places = sorted(places)
    reach, lo, seen = length + length // 2 + k, 0, defaultdict(int)
    for hi, (d, p) in enumerate(places):
        seen[p] += 1
        while places[lo][0] < d - reach:
            q = places[lo][1]
            seen[q] -= 1
            if not seen[q]:
                del seen[q]
            lo += 1
        if 100 * len(seen) >= percent * n:
            yield dict((p, d) for d, p in places[lo : hi + 1])


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("windows_met", pa.int32()), ("item_windows", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])


def _blocks(benchmark: DataFrame) -> Iterator[dict]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = total // BLOCK_CHARS + 1
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        if index := benchmark_index(sorted((r.item_id if r.item_id is not None else -1, r.text) for r in part.collect())):
            yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, item_id, windows_met, item_windows, first_word, last_word)`` for every document and item it holds."""
    names = "doc_id long, item_id long, windows_met int, item_windows int, first_word long, last_word long"
    out = None
    for index in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tables = Tables()
            for batch in small(it):
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in search(t, held.value, tables, k, percent)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _HITS, strict=True)], schema=_HITS)

        met = id_and_text(docs).mapInArrow(run, names)
        out = met if out is None else out.unionByName(met)
    return out if out is not None else docs.sparkSession.createDataFrame([], names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, each judged where it lies (no join on ids)."""
    at = docs.columns.index("text")
    for index in _blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            tables = Tables()
            for batch in small(it):
                yield batch.filter(pa.array([not search(t or "", held.value, tables, k, percent) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
