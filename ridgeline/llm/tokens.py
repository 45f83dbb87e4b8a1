"""Token ids of whole texts, and token counts by section with offset-mapped attribution.

A document is encoded once.  A byte-level token stands for a run of the text's UTF-8 bytes, so the ids alone give
the token spans, which are joined with the spans of the sections (lines with their line feed, which cover the text).
A token that crosses a boundary goes whole to the section that holds most of its characters, to the earlier one on
a tie; so the counts of the sections add up to the document's count.

Nulls and ties: a null or empty text is one empty section without tokens.  Repeated rows are counted as often as
they come, null ids stay null, extra columns are ignored, an empty table gives no rows.  A long text is encoded
whole, in one task.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.common import id_and_text, small


def vocabulary() -> str:
    """Place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of the byte-level tokenizer in ``path``, without added special tokens.

    Beside a tokenizer file lies the same vocabulary as a table of ranks, which a faster library reads.  Texts that
    hold a special token's string, or characters on whose class the two libraries might differ, go through the
    tokenizer file itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, "rb") as f:
            added = json.load(f)["added_tokens"]
        self.special = [t["content"] for t in added]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max([len(ranks), *(t["id"] + 1 for t in added)]), np.int64)  # bytes of a token
        for token, rank in ranks.items():
            self.width[rank] = len(token)
        for t in added:
            self.width[t["id"]] = len(t["content"].encode())

    @cached_property
    def full(self):
        """The tokenizer file itself, loaded when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if text.isascii() or max(text) < "ɐ":  # the Latin blocks, whose classes have long been fixed
            if not any(s in text for s in self.special):
                return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def section_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the sections in characters and in bytes."""
    lines = text.split("\n")
    chars = np.cumsum([len(x) + 1 for x in lines])
    chars[-1] -= 1
    if text.isascii():
        return chars, chars
    octets = np.cumsum([len(x.encode()) + 1 for x in lines])
    octets[-1] -= 1
    return chars, octets


def attribute(text: str, ids: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character ends of the sections, their tokens, and how many of these cross a boundary."""
    chars, octets = section_spans(text)
    if not len(ids):
        none = np.zeros(len(chars), np.int64)
        return chars, none, none
    end = np.cumsum(width[ids])
    begin = end - width[ids]
    first = np.minimum(np.searchsorted(octets, begin, side="right"), len(octets) - 1)
    last = np.searchsorted(octets, end - 1, side="right")
    owner, across = first.copy(), np.flatnonzero(first < last)
    if len(across):
        raw = text.encode()
        begins = np.r_[0, octets[:-1]]
        for t in across:
            best = -1
            for s in range(first[t], last[t] + 1):
                part = raw[max(begin[t], begins[s]) : min(end[t], octets[s])]
                held = sum(1 for b in part if b & 0xC0 != 0x80)
                if held > best:
                    best, owner[t] = held, s
    counts = np.bincount(owner, minlength=len(chars))
    return chars, counts, np.bincount(owner[across], minlength=len(chars))


_SECTIONS = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int64()), ("n_crossing", pa.int64()), ("doc_tokens", pa.int64())])


def section_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, section, char_start, char_end, n_tokens, n_crossing, doc_tokens)``, one row for each section."""
    path = path or vocabulary()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in small(it):
            parts: list[list] = [[] for _ in _SECTIONS]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text)
                ends, counts, crossing = attribute(text, ids, encode.width)
                n = len(ends)
                cells = ([doc_id] * n, np.arange(n), np.r_[0, ends[:-1]], ends, counts, crossing, np.full(n, len(ids)))
                for part, cell in zip(parts, cells, strict=True):
                    part.extend(cell)
                held += n
                if held > 50_000:
                    yield _batch(parts)
                    parts, held = [[] for _ in _SECTIONS], 0
            yield _batch(parts)

    def _batch(parts: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(p, t.type) for p, t in zip(parts, _SECTIONS, strict=True)], schema=_SECTIONS)

    names = "doc_id long, section int, char_start long, char_end long, n_tokens long, n_crossing long, doc_tokens long"
    return id_and_text(docs).mapInArrow(run, names)
