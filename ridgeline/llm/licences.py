"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags; expressions are parsed.

Notice phrases are found over the words of a text, an identifier tag's expression (and/or/with, brackets) goes
through a shunting-yard parser.  It contributes the licences that it names, and is evaluated: an "or" leaves the
choice, an "and" and a "with" bind to both sides, so a text is permissive if each of its expressions can be met by
permissive licences alone.  Names that are no known identifier give no label and are not permissive.

Nulls and ties: a null or empty text has no words and no place.  Overlapping places all count.  Repeated rows are
returned as often as they come, null ids stay null, extra columns are ignored.  Long texts are scanned whole, in
time linear in their length.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.common import batches, id_and_text

#: The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Further notice phrases and their labels.
MORE = {
    "all rights reserved": "proprietary",
    "gnu affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by sa": "cc-by-sa",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
#: Identifiers of permissive licences, in lower case.
PERMISSIVE = frozenset(
    "0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause "
    "bsd-3-clause-clear bsd-4-clause bsl-1.0 cc-by-3.0 cc-by-4.0 cc0-1.0 ecl-2.0 fsfap ftl isc libpng mit mit-0 ms-pl ncsa "
    "ofl-1.1 openssl php-3.01 postgresql psf-2.0 python-2.0 unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()
)
#: Identifiers of other licences, in lower case; the versions of the GNU ones also end in -only and -or-later.
BOUND = frozenset(
    "agpl-3.0 busl-1.1 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cddl-1.0 "
    "cddl-1.1 cecill-2.1 cpl-1.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 "
    "lppl-1.3c mpl-1.1 mpl-2.0 ms-rl odbl-1.0 osl-3.0 sspl-1.0".split()
)

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.\-+:]*")
#: Binding strength of the operators.
_BINDS = {"or": 1, "and": 2, "with": 3}


def words_of(text: str) -> list[bytes]:
    """Words of ASCII letters and digits and of non-ASCII characters, A-Z lowered."""
    return text.encode().translate(_KEEP).split()


def parse_expression(text: str) -> list | str | None:
    """An expression as nested lists ``[operator, left, right]`` of lower-case identifiers; None if it is malformed.

    Words after a complete expression end it, so that a tag may stand in running text.
    """
    out: list = []
    ops: list[str] = []

    def reduce() -> bool:
        if len(out) < 2:
            return False
        right, left = out.pop(), out.pop()
        out.append([ops.pop(), left, right])
        return True

    operand = False
    for token in _TOKEN.findall(text):
        low = token.lower().rstrip(".:")
        if low in _BINDS:
            if not operand:
                return None
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[low]:
                if not reduce():
                    return None
            ops.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            ops.append(token)
        elif token == ")":
            if not operand or "(" not in ops:
                return None
            while ops[-1] != "(":
                if not reduce():
                    return None
            ops.pop()
        elif operand:
            break
        else:
            out.append(low)
            operand = True
    if not operand:
        return None
    while ops:
        if ops[-1] == "(" or not reduce():
            return None
    return out[0] if len(out) == 1 else None


def _bottom_up(tree: list | str, leaf: Callable, join: Callable):
    """The value of a tree from those of its leaves, without recursion: lines of many thousand names are deep trees."""
    todo: list = [tree]
    order = []
    while todo:
        node = todo.pop()
        order.append(node)
        if not isinstance(node, str):
            todo += node[1:]
    values: list = []
    for node in reversed(order):
        if isinstance(node, str):
            values.append(leaf(node))
        else:
            right, left = values.pop(), values.pop()
            values.append(join(node[0], left, right))
    return values[0]


def identifiers(tree: list | str | None) -> set[str]:
    """The licences of an expression; an exception after ``with`` belongs to its licence."""

    def join(op: str, left: set, right: set) -> set:
        if op == "with":
            return {f"{x} with {y}" for x in left for y in right}
        big, little = (left, right) if len(left) >= len(right) else (right, left)
        big |= little
        return big

    return set() if tree is None else _bottom_up(tree, lambda name: {name}, join)


def _licence(name: str) -> str:
    """The identifier without what says "or later": a plus sign, ``-only`` or ``-or-later``; an exception leaves its licence."""
    return name.split(" ", 1)[0].removesuffix("+").removesuffix("-only").removesuffix("-or-later")


def known(name: str) -> bool:
    """Whether a name, with its exception if it has one, is an identifier; references to licences of one's own are."""
    return name.startswith(("licenseref-", "documentref-")) or _licence(name) in PERMISSIVE or _licence(name) in BOUND


def permissive(tree: list | str | None) -> bool:
    """Whether an expression can be met by permissive licences alone; a malformed one can't."""
    if tree is None:
        return False
    join = lambda op, left, right: left or right if op == "or" else left if op == "with" else left and right
    return _bottom_up(tree, lambda name: _licence(name) in PERMISSIVE, join)


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    phrases = [(p, label, True) for p, label in BASE.items()] + [(p, label, False) for p, label in MORE.items()] + [(TAG, None, False)]
    for phrase, label, base in phrases:
        found.add_word(f" {phrase} ", (phrase, label, base))
    found.make_automaton()
    return found


def scan(text: str) -> tuple:
    """``(n_words, n_base, first_word, last_word, base_labels, labels, score, permissive)`` of one text."""
    words = words_of(text)
    line = f" {b' '.join(words).decode()} " if words else ""
    hits = [(end, *value) for end, value in _automaton().iter(line)]
    starts, base, every = [], set(), set()
    at, words_before = 0, -1
    for end, phrase, label, is_base in hits:  # in the order of their ends
        if is_base:
            words_before += line.count(" ", at, end + 1)
            at = end + 1
            starts.append(words_before - phrase.count(" ") - 1)
            base.add(label)
        if label:
            every.add(label)
    free = None
    if any(phrase == TAG for _, phrase, _, _ in hits):
        for m in _TAG_LINE.finditer(text):
            tree = parse_expression(m[1])
            every |= set(filter(known, identifiers(tree)))
            free = permissive(tree) and free is not False
    covered = sum(phrase.count(" ") + 1 for _, phrase, _, _ in hits)
    score = min(1.0, 0.5 * bool(hits) + 0.5 * covered / max(1, len(words))) if hits else 0.0
    join = lambda labels: ",".join(sorted(labels))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), join(base), join(every), score, free


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("permissive", pa.bool_())])


def licence_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: places and labels of the base phrases, all labels, and a score in 0 to 1.

    The score is 0 without any hit, otherwise 0.5 and half the share of words that hits cover.  ``permissive`` says
    whether each expression of a text can be met by permissive licences alone; null without an expression.
    """

    def run(ids: list, texts: list) -> list:
        return [ids, *map(list, zip(*map(scan, texts), strict=True))]

    names = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"
    return id_and_text(docs).mapInArrow(batches(run, ["doc_id", "text"], _SCHEMA), names)
