"""The text operators against brute force, round trips and held-out labels."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import decontaminate, licences, media, ngram_join, packing, pages, quality, substring_dedup, tokens, toxicity
from ridgeline.shared import scratch_path, stage_table

DATA = "/root/testdata"
ODD = "doc_id long, text string, lang string, sid long, _id string, _spans string, _stay int, grams string"


def odd_docs(spark, texts):
    """Documents with further columns whose names the operators use themselves."""
    rows = [(i, t, None, 1, "a", None, 3, "b") for i, t in texts]
    return spark.createDataFrame(rows, ODD)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


EDGE = [(0, None), (1, ""), (2, "  \n "), (3, "one"), (3, "one"), (None, "one two three four five six"), (5, "one two three four five six"), (6, "x " * 30_000)]


# --- 1. media columns

def test_media_round_trip(spark):
    docs = odd_docs(spark, [*EDGE, (9, "é" * 500), (10, "a" * 192), (11, "a" * 193)])
    got = media.media_table(docs).collect()
    assert len(got) == 11
    texts = defaultdict(list)
    for i, t in [*EDGE, (9, "é" * 500), (10, "a" * 192), (11, "a" * 193)]:
        texts[i].append(t or "")
    for r in got:
        raw = texts[r.doc_id][0].encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert r.n_bytes == len(raw) and r.payload_bytes == len(padded) and len(padded) % 192 == 0
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() == r.digest and r.tail_crc32 == zlib.crc32(padded[-16:])
        assert (r.width, r.height, r.bits) == (192, len(padded) // 192, 8)
        assert r.media_bytes == r.length and re.fullmatch("[0-9a-f]{32}", r.feature)
    same = {r.feature for r in got if texts[r.doc_id][0] == ""}
    assert len(same) == 1
    assert media.media_table(docs.limit(0)).count() == 0


def test_media_shards(spark):
    import io
    import tarfile

    from pyarrow.fs import FileSystem

    docs = spark.createDataFrame([(i, words(random.Random(i % 20), 60)) for i in range(60)], "doc_id long, text string").coalesce(1)
    root = scratch_path(spark, "shards")
    rows = media.write_shards(docs, root, shard_bytes=4000).collect()
    fs, base = FileSystem.from_uri(root)
    names = {r.shard for r in rows}
    assert len(names) > 1
    for name in names:
        with fs.open_input_file(f"{base}/{name}") as f:
            blob = f.read()
        with tarfile.open(fileobj=io.BytesIO(blob)) as t:
            members = {m.name: t.extractfile(m).read() for m in t.getmembers()}
        for r in (r for r in rows if r.shard == name):
            image = blob[r.offset : r.offset + r.length]
            assert members[f"{r.digest}.png"] == image
            assert hashlib.sha256(media.decode_png(image).tobytes()).hexdigest() == r.digest
    bad = bytearray(image)
    bad[-6] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(bad))


# --- 2 and 8. classifiers

def measured(rows, labels, column):
    held = [(r.score, r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good = [s for s, _, y in held if y]
    poor = [s for s, _, y in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(good, poor)])
    return auc, np.mean([p == y for _, p, y in held])


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/sf0.01/{t}.parquet")
    return {t: read(t) for t in ("documents", "labels", "pages", "benchmark")}


def test_quality(spark, tables):
    rows = quality.quality_scores(tables["documents"], tables["labels"]).collect()
    labels = {r.doc_id: r.quality for r in tables["labels"].collect()}
    auc, accuracy = measured(rows, labels, "quality")
    assert len(rows) == 1000 and auc > 0.97 and accuracy > 0.93
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_training_bound_is_the_documented_one():
    with (Path(__file__).parents[2] / "README.md").open() as f:
        bound = re.search(r"trained on at most ([\d,]+) labelled rows \(`TRAINING_ROWS`\)", f.read())[1]
    assert quality.TRAINING_ROWS == int(bound.replace(",", ""))


def test_factorisation_machine_identity():
    rng = np.random.default_rng(0)
    theta = rng.normal(size=(quality.WIDTH, quality.RANK + 1)).astype(np.float32) * 0.3
    ids, x = np.sort(rng.choice(quality.WIDTH, 12, replace=False)), rng.random(12).astype(np.float32)
    z = 0.4 + sum(theta[i, 0] * v for i, v in zip(ids, x)) + sum(theta[i, 1:] @ theta[j, 1:] * a * b for (i, a), (j, b) in itertools.combinations(zip(ids, x), 2))
    assert quality.score({"bias": 0.4, "theta": theta}, ids, x) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)


def test_toxicity(spark, tables):
    rows = toxicity.toxicity_scores(tables["documents"], tables["labels"]).collect()
    labels = {r.doc_id: r.toxic for r in tables["labels"].collect()}
    auc, accuracy = measured(rows, labels, "toxic")
    assert len(rows) == 1000 and auc > 0.8 and accuracy > 0.9
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_toxicity_separates_planted_stems(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        text = [f"{rng.choice(['ba', 'ko', 'ri', 'mu'])}{rng.choice(['lan', 'tes', 'vor'])}{rng.choice('aeiou')}" for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(60)] = "zwek" + "".join(rng.choice("aeioulmn") for _ in range(3))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, known).collect()}
    held = [(got[i].predicted, bad) for i, _, bad in labels if got[i].held_out]
    assert sum(p == b for p, b in held) >= 0.98 * len(held)
    left = {r.doc_id for r in toxicity.drop_toxic(docs, known).collect()}
    assert left == {i for i, r in got.items() if not r.predicted}


def test_toxicity_reads_long_words_to_their_end(spark):
    # Toxic and ordinary words share eleven letters, and letters beyond the basic plane tell two others apart.
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice("lamp table green river stone window entertainment \U0001d4d0\U0001d4d1".split()) for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(40)] = rng.choice(["entertainmvile", "\U0001d4d0\U0001d4d2"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    got = {r.doc_id: r for r in toxicity.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(got[i].predicted, bad) for i, _, bad in labels if got[i].held_out]
    assert len(held) > 100 and all(p == b for p, b in held)


def brute_kneser_ney(rows, order):
    """Counts and probabilities of ``(text, class)`` rows by dictionaries; classes 0 and 1."""
    seen = [Counter(), Counter()]
    for text, c in rows:
        for w in set(re.findall(r"[^\W_]+", text.lower())):
            line = "\0" * order + w + "\1"
            for i in range(order, len(line)):
                seen[c][line[i - order : i], line[i]] += 1
    grams = set(seen[0]) | set(seen[1])
    three = Counter((context[-2:], s) for context, s in grams)
    two = Counter((context[-1:], s) for context, s in three)
    one = Counter(s for _, s in two)

    def low(counts, context, s, below):
        own = {x: n for (c, x), n in counts.items() if c == context}
        if not own:
            return below
        return (max(own.get(s, 0) - 0.75, 0) + 0.75 * len(own) * below) / sum(own.values())

    def shared(context, s):
        p = low({("", x): n for x, n in one.items()}, "", s, 1 / (len(one) + 1))
        return low(three, context[-2:], s, low(two, context[-1:], s, p))

    def p(c, context, s):
        own = {x: n for (k, x), n in seen[c].items() if k == context}
        if not own:
            return shared(context, s)
        cut = {x: min(n, 1.8 if n >= 3 else 1.5 if n == 2 else 1.0) for x, n in own.items()}
        return (own.get(s, 0) - cut.get(s, 0) + sum(cut.values()) * shared(context, s)) / sum(own.values())

    return grams, [*one, "unmet"], p


def test_toxicity_equals_brute_force_kneser_ney(spark):
    rng = random.Random(12)
    syllables = ["ka", "ri", "ko", "é", "mu", "\U0001d4d0"]
    rows = [(i, " ".join("".join(rng.choice(syllables[: 3 + i % 4]) for _ in range(rng.randint(1, 5))) for _ in range(6)), i % 2) for i in range(24)]
    train = [(t, c) for i, t, c in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    grams, symbols, p = brute_kneser_ney(train, toxicity.ORDER)
    for context in sorted({c for c, _ in grams})[::7]:
        for c in (0, 1):
            assert sum(p(c, context, s) for s in symbols) == pytest.approx(1)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, c) for i, _, c in rows], "doc_id long, toxic int")
    counts = toxicity.class_counts(stage_table(toxicity.text_blocks(docs), "blocks"), toxicity.labelled(labels))
    got = toxicity.probabilities(counts, toxicity.shared_backoff(counts)).collect()
    want = sorted((p(0, *g), p(1, *g)) for g in grams)
    assert np.allclose(sorted((r.po, r.pt) for r in got), want)
    # Words, met and unmet, by their log-likelihoods.
    table = {r.context: r for r in toxicity.differences(toxicity.probabilities(counts, toxicity.shared_backoff(counts))).collect()}
    kind = pa.struct([("at", pa.int32()), ("gaps", pa.list_(pa.int64()))])
    for w in ["kariko", "kakakakakakaka", "zzz", "é\U0001d4d0é", "rikariko", "mu"]:
        line = "\0" * toxicity.ORDER + w + "\1"
        want = sum(np.log(p(1, line[i - toxicity.ORDER : i], line[i]) / p(0, line[i - toxicity.ORDER : i], line[i])) for i in range(toxicity.ORDER, len(line)))
        rows = [{"at": i, **table[c].asDict(True)} for i, c in enumerate(toxicity._block_keys([w])[0].tolist()) if c in table]
        gains, length = toxicity.word_gains([w], pa.array(rows, kind))
        assert gains[0][0] == pytest.approx(want, abs=1e-3) and length[0] == len(w) + 1


def test_toxicity_does_not_depend_on_blocks(spark, tables, monkeypatch):
    docs = tables["documents"].where("doc_id < 300")
    once = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, tables["labels"]).collect()}
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 20_000)
    assert once == pytest.approx({r.doc_id: r.score for r in toxicity.toxicity_scores(docs, tables["labels"]).collect()}, abs=1e-6)


@pytest.mark.parametrize("scores,column", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_classifier_edges(spark, scores, column):
    docs = odd_docs(spark, EDGE)
    names = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], names)
    one = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (None, 0, 1), (99, 0, 1), (5, None, None)], names)
    for labels in (none, one):
        got = scores(docs, labels).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
        assert [r.held_out for r in got if r.doc_id is None] == [False]
    mixed = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)], names)
    assert scores(docs, mixed).count() == len(EDGE) and scores(docs.limit(0), mixed).count() == 0


# --- 3. decontamination

ITEM = "A train leaves Boston at 40 miles per hour while Alice walks 3 km toward the old harbour bridge"


def test_decontamination_templates(spark):
    item = ITEM
    other = ITEM.replace("Boston", "Denver").replace("40", "75").replace("Alice", "Robert").replace("3 km", "9 miles")
    mixed = "The price in Paris is 5 dollars and in Paris it is 5 dollars and later Paris asks 5 dollars again for bread"
    wrong = "The price in Rome is 7 dollars and in Oslo it is 9 dollars and later Bern asks 4 dollars again for bread"
    filler = words(random.Random(1), 200)
    docs = [(20, item), (21, f"{filler} {other}. {filler}"), (22, filler), (23, f"{filler} {wrong} {filler}"), (24, f"{filler} {mixed} {filler}"), (26, " ".join(item.split()[:6])), *EDGE]
    bench = spark.createDataFrame([(7, item), (8, mixed), (9, None), (10, ""), (11, "tiny question here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd_docs(spark, docs), bench).collect()}
    assert got == {(20, 7), (21, 7), (24, 8)}
    left = decontaminate.drop_contaminated(odd_docs(spark, docs), bench)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in docs if d not in {x for x, _ in got}), key=str)
    assert decontaminate.contaminated(odd_docs(spark, docs), bench.limit(0)).count() == 0


@pytest.mark.parametrize(
    "item,text",
    [
        ("What is 48 * 3?", "so we ask what is 48 * 3? and go on"),
        ("Who wrote Pride and Prejudice?", "some words Question: Who wrote Pride and Prejudice? Answer"),
        ("When did the king of Norway leave London?", "a list\nWhen did the king of Sweden leave Paris? and more"),
        ("Why does Alice meet Bob in Paris at noon?", "they say WHY DOES ALICE MEET BOB IN PARIS AT NOON? again"),
        ("7 12 19", "count 7 12 19 now"),
    ],
)
def test_decontamination_of_short_items(item, text):
    index = decontaminate.benchmark_index([(1, item), (2, "none of these words stand there")])
    assert [hit[0] for hit in decontaminate.search(text, index, decontaminate.Tables())] == [1]
    assert decontaminate.search(words(random.Random(1), 50), index, decontaminate.Tables()) == []


def test_decontamination_blocks_and_brute_force(spark, tables, monkeypatch):
    once = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(tables["documents"], tables["benchmark"]).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 2000)
    assert once == {(r.doc_id, r.item_id) for r in decontaminate.contaminated(tables["documents"], tables["benchmark"]).collect()}
    plain = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    items = {r.item_id: " ".join(plain(r.text)) for r in tables["benchmark"].collect()}
    for r in tables["documents"].collect():
        line = " ".join(plain(r.text or ""))
        want |= {(r.doc_id, i) for i, t in items.items() if t in line}
    assert want <= once and len(once - want) <= 0.02 * len(once) + 1


# --- 4 and 10. tokens and packing

def test_encoder_equals_the_tokenizer_file():
    e = tokens.encoder(tokens.vocabulary())
    rng = random.Random(0)
    texts = ["", "a <|endoftext|> b", "naïve  café\n\n\tx", "日本語 text", "a͸b  x", *("".join(chr(rng.choice([32, 10, 65, 97, 233, 0x300, 0x1F600, 0x2028, 0x660])) for _ in range(50)) for _ in range(50))]
    for t in texts:
        ids = e(t)
        assert ids.tolist() == e.full.encode(t, add_special_tokens=False).ids
        assert int(e.width[ids].sum()) == len(t.encode())


def test_section_tokens(spark):
    e = tokens.encoder(tokens.vocabulary())
    texts = [*EDGE[:6], (8, "first line\n\n\n  second é line\nthird"), (9, "a\n" * 50)]
    got = defaultdict(list)
    for r in tokens.section_tokens(odd_docs(spark, texts)).collect():
        got[r.doc_id].append(r)
    for i, t in texts:
        if i == 3:
            continue
        t = t or ""
        rows = sorted(got[i], key=lambda r: r.section)
        assert [t[r.char_start : r.char_end].rstrip("\n") for r in rows] == t.split("\n")
        assert sum(r.n_tokens for r in rows) == len(e(t)) == rows[0].doc_tokens
        assert "".join(t[r.char_start : r.char_end] for r in rows) == t
        # Brute force: each token goes to the section with most of its characters.
        want, at = Counter(), 0
        for token in e(t):
            span = range(at, at + int(e.width[token]))
            at = span.stop
            raw = t.encode()
            owner = Counter()
            for b in span:
                if raw[b] & 0xC0 != 0x80 or len(span) == 1:
                    owner[t.encode()[:b].decode(errors="ignore").count("\n")] += 1
            if owner:
                want[min(owner, key=lambda s: (-owner[s], s))] += 1
        if t.isascii():
            assert {r.section: r.n_tokens for r in rows if r.n_tokens} == dict(want)


def packed(rows, most):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for group in by.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    return len(by)


def test_packing(spark, tables):
    e = tokens.encoder(tokens.vocabulary())
    docs = tables["documents"]
    rows = packing.pack(docs).collect()
    total = 0
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for r in docs.collect():
        ids = [*e(r.text or "").tolist(), 2]
        total += len(ids)
        parts = sorted(by[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 1024 for p in parts[1:])
        for p in parts:
            cut = np.array(ids[p.start : p.start + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(cut.tobytes())
    n = packed(rows, 1024)
    assert n <= 1.01 * total / 1024 + 1
    edge = packing.pack(odd_docs(spark, EDGE)).collect()
    packed(edge, 1024)
    assert Counter(r.doc_id for r in edge if r.length == 1) == {0: 1, 1: 1} and packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_lengths_is_near_the_best(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([1, 2, 3, 5, 8, 9, 10, 13]) if seed % 2 else rng.randrange(1, 21) for _ in range(200))
    plan = packing.pack_lengths(dict(counts), 20)
    used = Counter()
    for pattern, times in plan:
        assert sum(pattern) <= 20 and times > 0
        for x in pattern:
            used[x] += times
    assert used == counts
    low = max(-(-sum(k * n for k, n in counts.items()) // 20), sum(n for k, n in counts.items() if k > 10))
    assert sum(t for _, t in plan) <= 1.04 * low + 1


# --- 5. pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a < b) x("</p>")</script></head><body><nav><ul><li><a>Home</a><li>News</ul></nav>
<header>Site</header><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>
 text.<p>Second&nbsp;one <!-- note --><div class="ad">Buy</div><aside>Side</aside><ul><li>a<li>b</ul><form><p>Name</p></form></article>
<section id="comments"><p>Nice!</p></section><footer>&copy; 2020</footer></body></html>"""


def test_page_article():
    blocks, paths = pages.read_page(PAGE)
    assert pages.main_text(blocks, [], pages.page_tokens(blocks, paths)) == "Title & more\n\nFirst bold text.\n\nSecond one\n\na\n\nb"
    assert pages.host_of("https://User@WWW.Example.org:80/a") == "www.example.org" and pages.host_of(None) == "" and pages.host_of("//x.y/z") == "x.y"


def test_page_containers():
    def text(page):
        blocks, paths = pages.read_page(page)
        return pages.main_text(blocks, [], pages.page_tokens(blocks, paths))

    assert text('<body class="has-sidebar"><div class="with-sidebar wide"><main><h2>Lead</h2><article><p>Body</article><p>More</main></div>') == "Body"
    assert text('<div id="main"><p>One<br>two</div><div class="menu">x</div>') == "One two"
    assert text('<section id="comments"><article><p>Reply</article></section><article><header><h1>T</h1></header><p>B &lt; C</p></article>') == "T\n\nB < C"
    assert text("<p>a<table><tr><td>1<td>2<tr><td>3</table><p>b") == "a\n\n1 2\n\n3\n\nb"
    assert text("") == "" and text("plain text") == "plain text" and text("<p>cut off <b") == "cut off <b"


def test_templates_drop_what_all_pages_of_a_host_share(spark):
    page = "<html><body><div><div>Welcome to the site</div><div>Latest offers</div><div><p>{}</p><p>{}</p></div><div>Contact us today</div></div></body></html>"
    rng = random.Random(2)
    body = [(words(rng, 12), words(rng, 9)) for _ in range(8)]
    rows = [(i, f"http://h.example/{i}", page.format(*b)) for i, b in enumerate(body)]
    rows += [(100, None, None), (101, "nonsense", ""), (102, "http://solo.example/", "<p>alone &lt;here&gt;"), (None, "http://h.example/x", page.format("p q", "r s")), (7, "http://h.example/7", page.format(*body[7]))]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, host string, template int")
    got = pages.extract_main_text(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 8:
            assert r.text == "\n\n".join(body[r.page_id]) and r.n_chars == len(r.text)
    texts = {r.page_id: r.text for r in got}
    assert texts[100] == texts[101] == "" and texts[102] == "alone <here>" and texts[None] == "p q\n\nr s"
    assert pages.extract_main_text(df.limit(0)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    page = "<html><body><div>Welcome to the site</div><div>Latest offers</div><div><p>{}</p><p>{}</p></div></body></html>"
    rng = random.Random(5)
    body = {c: (words(rng, 12), words(rng, 9)) for c in "abc"}
    rows = [(i, f"http://h.example/{i}", page.format(*body[c])) for i, c in enumerate("aaaabc")] + [(0, "http://h.example/0", page.format(*body["a"]))]
    got = pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == sorted((i, "\n\n".join(body["aaaabc"[i]])) for i, *_ in rows)


def extracted(spark, rows):
    got = pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_templates_decide_inside_articles(spark):
    rng = random.Random(11)
    page = "<html><body><nav>{}</nav><article><h2>Story</h2><p>{}</p><p>Share this story</p>{}</article></body></html>"
    rows, want = [], {}
    for i in range(6):
        body, more = words(rng, 30), [words(rng, 20) for _ in range(i % 3)]
        rows.append((i, f"http://a.example/{i}", page.format(i, body, "".join(f"<p>{m}</p>" for m in more))))
        want[i] = "\n\n".join(["Story", body, *more])
    # Two articles don't tell a template, near copies of one article keep what they share, and so does one article under many menus.
    shared = [words(rng, 30) for _ in range(4)]
    for i in range(10, 12):
        body = words(rng, 30)
        rows.append((i, f"http://b.example/{i}", page.format(i, body, "")))
        want[i] = f"Story\n\n{body}\n\nShare this story"
    for i in range(20, 25):
        body = [words(rng, 30), *shared]
        rows.append((i, f"http://c.example/{i}", "<html><body><article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"))
        want[i] = "\n\n".join(body)
    for i in range(30, 35):
        rows.append((i, f"http://d.example/{i}", page.format(i, shared[0], "")))
        want[i] = f"Story\n\n{shared[0]}\n\nShare this story"
    assert extracted(spark, rows) == want


def test_tokens_have_roles_by_slot(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(6):
        body = [words(rng, 8) for _ in range(2 + i % 3)] + ["More"] * (i % 3)
        rows.append((i, f"http://a.example/{i}", "<html><body>" + "".join(f"<div>{t}</div>" for t in ["Head", "More", "Start", *body, "End"]) + "</body></html>"))
        want[i] = "\n\n".join(body)
    assert extracted(spark, rows) == want


def test_classes_are_ordered_and_nested():
    root = [0, 1, 2, 3]
    owner, slot = pages.follow([root, [0, 7, 8]], [1, 7, 9, 8, 7, 8, 2, 5, 3])
    assert owner == [0, 1, -1, 1, 1, 1, 0, -1, 0] and slot == [-1, 0, 1, 0, 0, 0, -1, 6, -1]
    assert pages.follow([root, [0, 7, 8]], [1, 7, 2, 8, 3])[0] == [0, -1, 0, -1, 0]  # cut by a token of the class around it
    assert pages.follow([root, [0, 7, 8]], [7, 1, 2, 8, 3])[0] == [-1, 0, 0, -1, 0]
    assert pages.follow([[0, 7, 8], root], [7, 1, 2, 3, 8])[0] == [0, 1, 1, 1, 0]
    assert pages.follow([root], [1, 3, 2])[0] == [-1] * 3 and pages.follow([root], [1, 2])[0] == [-1] * 2
    assert pages.follow([[0, 7, 8]], [7, 7, 8, 8])[0] == [-1] * 4


def test_classes_of_the_first_round_against_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(pages, "ROUNDS", 1)
    rng = random.Random(13)
    made = []
    for i in range(40):
        parts = ["<p>fixed</p>"] * (i % 4 != 0) + [f"<div class=x{i % 3}><p>{rng.choice('abcd')}</p></div>" for _ in range(rng.randrange(4))] + [f"<ul>{'<li>go</li>' * rng.randrange(1, 4)}</ul>", f"<p>{i // 2}</p>"]
        made.append((f"http://h{i % 5}.example/", f"<html><body>{''.join(parts)}</body></html>"))
    got = {r.host: r.template[0] for r in pages.host_templates(spark.createDataFrame([(i, *p) for i, p in enumerate(made)], "page_id long, url string, html string")).collect()}
    for host in {pages.host_of(u) for u, _ in made}:
        seen = {}
        for url, page in made:
            if pages.host_of(url) == host:
                blocks, marks = pages.read_page(page)
                tokens = pages.page_tokens(blocks, marks)
                seen[pages.main_text(blocks, [], tokens)] = tokens
        vectors = {}
        for t in set().union(*seen.values()):
            vector = tuple(s.count(t) for s in seen.values())
            if sum(map(bool, vector)) >= max(2, len(seen) / 2):
                vectors.setdefault(vector, set()).add(t)
        assert sorted(sorted(c[1:]) for c in got[host]) == sorted(sorted(v) for v in vectors.values() if len(v) > 1)


def test_pages_table(spark, tables):
    got = {r.page_id: r.text for r in pages.extract_main_text(tables["pages"]).collect()}
    for r in tables["pages"].collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]*>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n\n".join(w for w in want if w)


# --- 6. n-gram Jaccard join

def sets_of(rows, k=5):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def brute_classes(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    passage = words(rng, 40)
    bases = [words(rng, rng.randint(20, 120)) for _ in range(5)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            w = rng.choice(bases).split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
            rows.append((i, " ".join(w).upper() if rng.random() < 0.2 else "\t".join(w)))
        elif kind < 0.8:
            rows.append((i, f"{words(rng, rng.randint(1, 15))} {passage}"))
        else:
            rows.append((i, words(rng, rng.randint(0, 8), 6)))
    return rows


@pytest.mark.parametrize("leaf,seed", [(1_000_000, 0), (0, 0), (0, 1), (40, 2)])
def test_jaccard_classes(spark, monkeypatch, leaf, seed):
    monkeypatch.setattr(ngram_join, "LEAF_PAIRS", leaf)
    monkeypatch.setattr(ngram_join, "PIVOTS", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 500)
    rows = near_copies(seed)
    sets = sets_of(rows)
    got = ngram_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_classes(sets)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}


def test_first_looks_of_sets_within_the_radius_meet():
    rng = random.Random(8)
    for _ in range(3000):
        a = set(rng.sample(range(10_000), rng.choice([1, 2, 3, 5, 8, 40, 130])))
        b = set(a)
        for _ in range(rng.randint(0, len(a) // 3)):
            if rng.random() < 0.6 and len(b) > 1:
                b.remove(rng.choice(sorted(b)))
            else:
                b.add(rng.randrange(10_000))
        if 100 * len(a & b) >= 75 * len(a | b):
            (qa, la), (qb, lb) = (ngram_join.first_look(len(x), 75) for x in (a, b))
            assert len(set(sorted(a)[:qa]) & set(sorted(b)[:qb])) >= max(la, lb)


def test_buckets_as_streams():
    rng = np.random.default_rng(4)
    grams, sids = rng.integers(0, 60, 900).astype(np.uint64), rng.integers(0, 25, 900)
    bucket, met = ngram_join._Bucket(), Counter()
    for i in range(0, 900, 70):
        for sid, n in zip(*bucket.add(grams[i : i + 70], sids[i : i + 70]), strict=True):
            met[int(sid)] += int(n)
    by = defaultdict(set)
    for g, s in zip(grams.tolist(), sids.tolist()):
        by[g].add(s)
    want = Counter(s for held in by.values() if len(held) > 1 for s in held)
    assert bucket.grams.tolist() == sorted(by) and {s for s in met if met[s]} == set(want) and all(met[s] >= n for s, n in want.items())
    assert all((d > 1) == (len(by[g]) > 1) and d >= len(by[g]) for g, d in zip(bucket.grams.tolist(), bucket.df.tolist()))


def test_points_measured_against_different_pivots_stay_open(spark):
    # Pivots 1 (80 shingles) and 2; 3 (100) holds 1 and lies in 4 (125); 4 and 1 fail the bound by size.  5 is as far from
    # 2 as 4 is, and 6 lies near 2, which rules the pairs of 6 with 4 and 5 out.
    stars = spark.createDataFrame([(9, 3, 1, 0), (9, 4, 2, 1), (9, 5, 2, 1), (9, 6, 2, 1)], "rid long, sid long, pivot long, turn int")
    measured = spark.createDataFrame([(1, 3, 80, 100, 80), (2, 4, 125, 125, 23), (2, 5, 125, 125, 23), (2, 6, 125, 120, 100)], "a long, b long, na long, nb long, common long")
    members = spark.createDataFrame([(9, i, n, n, i) for i, n in ((3, 100), (4, 125), (5, 125), (6, 120))], "rid long, sid long, n long, rest long, component long")
    placed = members.join(ngram_join._near(stars, measured, 2), ["rid", "sid"], "left")
    got = {(r.a, r.b) for r in ngram_join._open_pairs(placed, 75).collect()}
    assert got == {(3, 4), (3, 5), (3, 6), (4, 5)}


def test_jaccard_edges(spark):
    docs = odd_docs(spark, EDGE)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (3, 1, 3), (None, 2, 5), (5, 2, 5), (6, 1, 6)], key=str)
    assert ngram_join.jaccard_classes(docs.limit(0)).count() == 0
    kept = ngram_join.keep_one_of_each_class(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == {0: 1, 1: 1, 2: 1, 3: 2, None: 1, 5: 1, 6: 1}


# --- 7. license scans

def brute_scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in licences.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licence_scan():
    rng = random.Random(5)
    vocabulary = "under the MIT license apache version 2 cc by nc é foo 4.0 cc-by-nc under".split()
    for _ in range(3000):
        text = rng.choice([" ", "-", "\n", ", "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))
        got = licences.scan(text)
        assert got[:5] == brute_scan(text) and 0 <= got[6] <= 1
        assert set(filter(None, got[4].split(","))) <= set(filter(None, got[5].split(",")))


@pytest.mark.parametrize(
    "text,want",
    [
        ("MIT", {"mit"}),
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", {"mit", "apache-2.0", "bsd-3-clause"}),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", {"gpl-2.0-only with classpath-exception-2.0", "mit"}),
        ("MIT see the file", {"mit"}),
        ("(MIT OR", set()),
        ("AND MIT", set()),
        ("", set()),
    ],
)
def test_licence_expressions(text, want):
    assert licences.identifiers(licences.parse_expression(text)) == want


def test_licence_precedence_and_tags(spark):
    assert licences.parse_expression("a OR b AND c WITH d") == ["or", "a", ["and", "b", ["with", "c", "d"]]]
    docs = odd_docs(spark, [*EDGE, (9, "# SPDX-License-Identifier: MIT OR Apache-2.0\nReleased under the MIT License.")])
    got = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    assert got[9].labels == "apache-2.0,mit" and got[9].base_labels == "mit" and got[9].n_base == 1 and got[9].score > 0.5
    assert got[0].n_words == 0 and got[0].first_word is None and got[6].n_words == 30_000
    assert licences.licence_scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("MIT", True),
        ("GPL-3.0-only OR MIT", True),
        ("GPL-3.0-only AND MIT", False),
        ("(GPL-3.0-or-later OR MIT) AND (Apache-2.0 OR MPL-2.0)", True),
        ("GPL-2.0+ OR MIT AND EPL-2.0", False),
        ("Apache-2.0 WITH LLVM-exception", True),
        ("GPL-2.0-only WITH Classpath-exception-2.0", False),
        ("Nonesuch", False),
        ("(MIT OR", False),
    ],
)
def test_licence_evaluation(text, want):
    assert licences.permissive(licences.parse_expression(text)) is want


def test_licence_evaluation_against_all_choices():
    rng = random.Random(9)
    names = ["mit", "isc", "gpl-3.0", "mpl-2.0"]

    def build(depth):
        """An expression as text, and the sets of licences that it lets one choose from."""
        if depth == 0 or rng.random() < 0.2:
            name = rng.choice(names)
            return name, [{name}]
        (a, left), (b, right) = build(depth - 1), build(depth - 1)
        if rng.random() < 0.5:
            return f"({a} OR {b})", left + right
        return f"({a} AND {b})", [x | y for x in left for y in right]

    for _ in range(300):
        text, choices = build(3)
        tree = licences.parse_expression(text)
        assert licences.permissive(tree) == any(c <= licences.PERMISSIVE for c in choices)
        assert licences.identifiers(tree) == set().union(*choices)


def test_licence_scan_of_deep_and_unknown_expressions():
    tag = "SPDX-License-Identifier: "
    assert licences.scan(tag + " OR ".join(["GPL-3.0-only"] * 20_000 + ["MIT"]))[5::2] == ("gpl-3.0-only,mit", True)
    assert licences.scan(tag + "(" * 5_000 + "MIT" + ")" * 5_000)[5::2] == ("mit", True)
    assert licences.scan(tag + "whatever\n" + tag + "LicenseRef-Own AND MIT")[5::2] == ("licenseref-own,mit", False)
    assert licences.scan("no tag here")[7] is None and licences.scan(tag)[7] is False


# --- 9. substring dedup

def brute_repeats(rows):
    first, out = {}, set()
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for u, (start, stop, piece) in enumerate(substring_dedup.text_units(t or "")):
            if first.setdefault(piece, (i, u)) != (i, u):
                out.add((i, u, start, stop, *first[piece]))
    return out


@pytest.mark.parametrize("space", ["\t", "\u00a0", "\u3000", " \t"])
def test_units_of_lines_with_other_spaces(space):
    row = space.join("alpha beta gamma delta epsilon zeta".split())
    got = substring_dedup.text_units(f"{row}\n{row}\none{space}two\n{row}")
    assert [(stop - start, piece) for start, stop, piece in got] == [(len(row) + 1, "alpha beta gamma delta epsilon zeta")] * 2 + [(len(row), "alpha beta gamma delta epsilon zeta")]


@pytest.mark.parametrize("n,mean,least", [(55, 0.75, 0.4), (80, 0.83, 0.6)])
def test_units_of_a_passage_are_met_wherever_it_stands(n, mean, least):
    rng = random.Random(4)

    def prose(k):
        return " ".join(w + rng.choice(["", "", "", "", "", ".", ","]) for w in words(rng, k).split())

    shares = []
    for _ in range(300):
        passage = prose(n)
        found = []
        for _ in range(2):
            text = f"{prose(rng.randint(0, 60))} {passage} {prose(rng.randint(0, 60))}".strip()
            at = text.index(passage)
            found.append({(max(a, at) - at, min(b, at + len(passage)) - at, p) for a, b, p in substring_dedup.text_units(text) if a >= at and b <= at + len(passage) + 1})
        shares.append(sum(b - a for a, b, _ in found[0] & found[1]) / len(passage))
    assert np.mean(shares) > mean and min(shares) > least


def test_substring_dedup(spark):
    rng = random.Random(9)
    passage = ". ".join(words(rng, 15).capitalize() for _ in range(4)) + "."
    line = "this line stands in many documents of the table"
    rows = []
    for i in range(60):
        text = f"{words(rng, 20).capitalize()}. {words(rng, 9)}"
        if i % 3 == 0:
            text += f" {passage} {words(rng, 7)}."
        if i % 2 == 0:
            text += f"\n{line}\nOk.\n{words(rng, 30)}"
        rows.append((i, text))
    rows += [r for r in EDGE if r[0] not in (0, 1, 2, 3, 5, 6)] + [(100, rows[0][1]), (0, rows[0][1]), (101, line.upper() + "!"), (102, None)]
    docs = odd_docs(spark, rows)
    spans = substring_dedup.repeated_spans(docs)
    got = {(r.doc_id, r.unit, r.start, r.stop, r.kept_doc_id, r.kept_unit) for r in spans.collect()}
    assert got == brute_repeats(rows)
    out = substring_dedup.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = defaultdict(list)
    for r in out.collect():
        texts[r.doc_id].append(r.text)
    middle = passage.split(". ")[1]
    assert [i for i in range(60) if middle in texts[i][0]] == [0] and [i for i in range(60) if line in texts[i][0]] == [0]
    assert len(texts[0]) == 2 and texts[0][0] == texts[0][1] == rows[0][1] and texts[100][0].strip() == "Ok." or texts[100][0] == ""
    clean = [i for i in range(60) if i % 2 and i % 3]
    assert all(texts[i][0] == dict(rows[:60])[i] for i in clean) and texts[102] == [None]
    assert substring_dedup.drop_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_with_other_texts(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six seven"
    docs = spark.createDataFrame([(1, f"{a}\n{b}"), (2, f"{b}\nfresh words that nobody else has here\n{a}"), (2, f"{a}\nall of these words are new to the table")], "doc_id long, text string")
    out = sorted(r.text for r in substring_dedup.drop_repeats(docs).where("doc_id = 2").collect())
    assert out == ["all of these words are new to the table", "fresh words that nobody else has here\n"]
