"""HTML extraction by equivalence-class template deduction.

Pages of one host are made from templates.  A whole page, articles included, is read as tokens: starts and ends of its
elements by path, text nodes by path and content.  Tokens that occur equally often in every page of their host have
one occurrence vector and form an equivalence class; a class that is large (two tokens or more) and frequent (half of
the host's pages, two at least) is a candidate.  A page follows a class if its tokens stand there in the class's
order, once each in turn, and if the class nests: it lies in one slot of each class met before, and they in slots of
it.  A slot is what stands between two neighbouring tokens of a class.  Tokens then take different roles in different
slots: vectors are counted again for tokens by slot (``ROUNDS``), and the classes of the last round are the template.

On every page, text that is a token of a class it follows is fixed, and the rest is the content of slots.  The main
text is the content of the slots in articles, else in the main element where there is one, otherwise of all slots; element
names and hints check it afterwards and take out menus, headers, footers, sidebars, notices, adverts, forms and reader
comments.  Inside an article or main element a fixed text goes (a notice, a line to share) only if it is of the very
class of that element, seen in three different articles, and if such texts are less than half of what the host's
articles hold on average: else it is a copied passage.  Fixed headings and labels there are the article's own and stay.

Pages of a host that have equal text without a template are one page for the vectors, so that copies, under other
menus too, don't make their own text look fixed.
An occurrence vector has an entry for each page; it is kept as the exclusive-or of one hash per page and count, so
that classes come from aggregates that Spark combines before the shuffle, however many pages a host has.  A host's
template is small and is repeated over salts to meet the pages of a host with a large share of all pages.

Nulls and ties: a null page has the text ''.  A null or odd url belongs to the host ''.  Repeated rows, and pages that
are copies under other ids, have one text and are returned as often as they come.  Null ids stay null, extra columns are ignored, an empty table
gives no rows.  Unclosed and wrongly nested elements are closed as browsers do; long pages are read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import MASK, salted_lookup, small
from ridgeline.shared import drop_table, release, stage_table

#: Share of a host's pages that a class must occur in.
SUPPORT = 0.5
#: Times that classes are deduced; each time but the first, tokens are told apart by the slots found before.
ROUNDS = 2
#: Different pages that a text inside articles must stand in, and its largest share of their text on average, to be fixed.
ARTICLES, SHARE = 3, 0.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

#: Elements whose content is never text of a page.
_RAW = frozenset("script style noscript template iframe object svg canvas math audio video textarea select".split())
#: Elements that are not main text wherever they stand.
_ASIDE = frozenset("nav footer aside form menu dialog button head title option datalist fieldset".split())
#: Words in a class, id or role that mark something other than main text.
_HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "nav navbar navigation navigationbar menu menubar breadcrumb breadcrumbs pagination pager toolbar skip "
    "footer foot copyright masthead sidebar side aside complementary contentinfo related recommended recommendations "
    "share sharing social comment comments commentlist disqus respond reply replies widget search".split()
)
#: How a name starts that tells of something elsewhere on the page ("has-sidebar").
_TELLS = ("has-", "has_", "with-", "with_", "no-", "no_", "without-", "without_", "is-", "is_")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
#: Elements that label what an article says; their text stays where every article has it.
_LABELS = frozenset("h1 h2 h3 h4 h5 h6 hgroup caption figcaption dt td th summary".split())
#: What the start of an element closes, up to the elements that stop the search.
_CLOSES = {
    "li": (frozenset(["li", "p"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "p"]), frozenset(["table"])),
    "td": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "p"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


class _Open:
    __slots__ = ("tag", "path", "aside", "main", "holder", "label")

    def __init__(self, tag: str, path: int, aside: bool, main: int, holder: int, label: bool) -> None:
        self.tag, self.path, self.aside, self.main, self.holder, self.label = tag, path, aside, main, holder, label


class Block:
    """A run of text: hash of its element's path, whether it is set aside, and 2 in an article, 1 in a main element, else 0.

    ``at`` is its place among the page's marks, ``holder`` that of the article or main element around it (-1: none), and
    ``label`` tells whether a heading or label holds it.
    """

    __slots__ = ("path", "aside", "main", "text", "at", "holder", "label")

    def __init__(self, above: _Open, text: str, at: int) -> None:
        self.path, self.aside, self.main, self.holder, self.label = above.path, above.aside, above.main, above.holder, above.label
        self.text, self.at = text, at


def read_page(page: str) -> tuple[list[Block], list[int]]:
    """The blocks of a page, and its marks, both in page order.

    A mark is the hash of the path of an element that starts, its complement where the element ends, or 0 where a block stands.
    """
    stack = [_Open("", 0, False, 0, -1, False)]
    blocks: list[Block] = []
    marks: list[int] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            if text := " ".join(entities.unescape("".join(parts)).split()):
                blocks.append(Block(stack[-1], text, len(marks)))
                marks.append(0)
            parts.clear()

    def close(depth: int) -> None:
        while len(stack) > depth:
            marks.append(~stack.pop().path)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in _BLOCK and tag not in _RAW and tag not in _ASIDE and tag not in ("td", "th"):
            if tag == "br" or tag in _VOID:
                parts.append(" ")
            continue  # an inline element changes nothing
        if m[1]:
            if tag in ("td", "th"):
                parts.append(" ")
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                flush()
                close(depth)
            elif tag in _BLOCK:
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in ("td", "th"):
            parts.append(" ")
        else:
            flush()
        if tag == "hr":
            continue
        if tag in _CLOSES:
            closed, stop = _CLOSES[tag]
            while len(stack) > 1 and stack[-1].tag in closed and stack[-1].tag not in stop:
                close(len(stack) - 1)
        elif tag in _BLOCK:
            while stack[-1].tag == "p":
                close(len(stack) - 1)
        if m[3].rstrip().endswith("/") and tag not in ("td", "th"):
            continue
        above = stack[-1]
        names = " ".join(a or b or c for _, a, b, c in _NAMES.findall(m[3])).lower()
        main = above.main
        if not above.aside:
            if tag == "article" or "articlebody" in names.replace("-", ""):
                main = 2
            elif tag == "main" or "main" in names.split():
                main = max(main, 1)
        hints = {t for n in names.split() if not n.startswith(_TELLS) for t in _SPLIT.split(n)}
        aside = above.aside or tag in _ASIDE or (tag == "header" and not above.main) or (bool(hints) and not _HINTS.isdisjoint(hints) and tag not in ("body", "html", "article", "main"))
        path = _token(above.path, f"{tag}.{names}")
        holder = above.holder if main == above.main else len(marks)
        label = tag in _LABELS or (above.label and main == above.main)
        stack.append(_Open(tag, path, aside, main, holder, label))
        marks.append(path)
    flush()
    close(1)
    return blocks, marks


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _token(path: int, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}") >> 1


def page_tokens(blocks: list[Block], marks: list[int]) -> list[int]:
    """The tokens of a page, one for each mark: starts and ends of elements, and the text nodes."""
    texts = iter(blocks)
    return [m if m > 0 else _token(~m, "\0end") if m else _token((b := next(texts)).path, b.text) for m in marks]


def follow(classes: list[list[int]], tokens: list[int]) -> tuple[list[int], list[int]]:
    """The class that each token of a page is of (-1: none), and the token that its innermost slot follows (-1: none).

    A page follows a class if it has its tokens equally often, in their order, and if the class nests with those before.
    """
    place: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        place.setdefault(t, []).append(i)
    owner, slot = [-1] * len(tokens), [-1] * len(tokens)
    for c, (_, *group) in enumerate(classes):
        where = [place.get(t, ()) for t in group]
        if not where[0] or any(len(w) != len(where[0]) for w in where):
            continue
        turns = list(zip(*where, strict=True))
        row = [i for turn in turns for i in turn]
        if any(i >= j for i, j in zip(row, row[1:])):
            continue  # not ordered
        if any(slot[i] != slot[turn[0]] for turn in turns for i in turn):
            continue  # not nested
        for turn in turns:
            around = slot[turn[0]]
            for i, j in zip(turn, turn[1:]):
                slot[i + 1 : j] = [i if k == around else k for k in slot[i + 1 : j]]
        for i in row:
            owner[i] = c
    return owner, slot


def by_slot(tokens: list[int], owner: list[int], slot: list[int]) -> list[int]:
    """The tokens told apart by their slots; those of the classes stay as they are."""
    return [t if c >= 0 or s < 0 else ((t ^ tokens[s] * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & MASK) >> 1 for t, c, s in zip(tokens, owner, slot, strict=True)]


def main_text(blocks: list[Block], template: list[list[list[int]]], tokens: list[int]) -> str:
    """The main text of a page: the content of its main slots, given the classes of its host by round.

    A class is the number of characters inside articles that it may fix, and its tokens in template order.
    """
    owner = [-1] * len(tokens)
    for n, classes in enumerate(template):
        owner, slot = follow(classes, tokens)
        if n + 1 < len(template):
            tokens = by_slot(tokens, owner, slot)
    best = max((b.main for b in blocks if not b.aside), default=0)
    kept = [b for b in blocks if b.main == best and not b.aside]
    if best:
        fixed = [b for b in kept if not b.label and 0 <= owner[b.at] == owner[b.holder]]
        size: Counter[int] = Counter()
        for b in fixed:
            size[owner[b.at]] += len(b.text)
        gone = {b.at for b in fixed if size[owner[b.at]] <= template[-1][owner[b.at]][0]}
    else:
        gone = {b.at for b in kept if owner[b.at] >= 0}
    return "\n\n".join(b.text for b in kept if b.at not in gone)


_STATS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("vector", pa.int64()), ("pos", pa.int64())])


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each token of each page its entry in the occurrence vector and its first place; token -1 has the length of the text."""
    for batch in small(it):
        rows = []
        for url, page, template in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            host = host_of(url)
            blocks, marks = read_page(page)
            tokens = page_tokens(blocks, marks)
            text = main_text(blocks, [], tokens)
            mark = xxhash.xxh3_128_hexdigest(text)
            for classes in template or []:
                tokens = by_slot(tokens, *follow(classes, tokens))
            place = {t: i for i, t in reversed(list(enumerate(tokens)))}
            rows.append((host, -1, xxhash.xxh3_64_intdigest(mark) >> 1, len(text)))
            rows += [(host, t, xxhash.xxh3_64_intdigest(f"{mark}\0{n}") >> 1, place[t]) for t, n in Counter(tokens).items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _STATS, strict=True)], schema=_STATS)


def _host_classes(pages: DataFrame) -> DataFrame:
    """``(host, classes)`` from ``(url, html, template)``: frequent first, tokens in page order after what the class may fix."""
    found = pages.mapInArrow(_counted, "host string, token long, vector long, pos long")
    # Copies of a page have one entry; the least of their places keeps the order that all of them have.
    found = found.groupBy("host", "token", "vector").agg(F.min("pos").alias("pos"))
    stats = stage_table(
        found.groupBy("host", "token").agg(F.count("*").alias("pages"), F.expr("bit_xor(vector)").alias("vector"), F.sum("pos").alias("pos")).where("pages > 1"),
        "page-tokens",
    )
    most = F.when(F.col("pages") >= ARTICLES, F.floor(F.col("pos") / F.col("pages") * SHARE)).otherwise(0).cast("long")
    hosts = stats.where("token = -1").select("host", F.col("pages").alias("all_pages"), most.alias("most"))
    frequent = salted_lookup(stats.where("token >= 0"), hosts, "host").where(f"pages >= greatest(2, {SUPPORT} * all_pages)")
    most = F.when(F.max("pages") >= ARTICLES, F.max("most")).otherwise(0).cast("long").alias("most")
    classes = frequent.groupBy("host", "vector").agg(F.max("pages").alias("pages"), most, F.array_sort(F.collect_list(F.struct((F.col("pos") / F.col("pages")).alias("at"), "token"))).alias("t"))
    classes = classes.where("size(t) > 1").select("host", F.struct(-F.col("pages"), -F.size("t"), F.concat(F.array("most"), F.col("t.token")).alias("tokens")).alias("c"))
    classes = stage_table(classes.groupBy("host").agg(F.array_sort(F.collect_list("c")).getField("tokens").alias("classes")), "classes")
    drop_table(stats)
    release(pages.sparkSession)
    return classes


_ROUNDS = "array<array<array<bigint>>>"


def host_templates(pages: DataFrame) -> DataFrame:
    """``(host, template)``: by round, the classes of each host's pages as ``main_text`` takes them."""
    rows = _columns(pages).select("url", "html", F.lit(None).cast(_ROUNDS).alias("template"))
    template = _host_classes(rows).select("host", F.array("classes").alias("template"))
    for _ in range(1, ROUNDS):
        # Pages of hosts without classes have no slots.
        rows = _with_template(pages, template).where("template is not null").select("url", "html", "template")
        template = stage_table(_host_classes(rows).join(template, "host").select("host", F.concat("template", F.array("classes")).alias("template")), "templates")
    return template


def _columns(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))


def _with_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return salted_lookup(_columns(pages).withColumn("host", host), templates, "host").select("page_id", "url", "html", "template")


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page."""
    rows = _with_template(pages, host_templates(pages))

    def extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(it):
            texts = []
            for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                blocks, marks = read_page(page)
                texts.append(main_text(blocks, template or [], page_tokens(blocks, marks)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXTS)

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
