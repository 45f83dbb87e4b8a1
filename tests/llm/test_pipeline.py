"""The pipeline's stages against what they must do to planted cases."""

import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline as p
from ridgeline.llm import tokens


def words(rng, n):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    top = str(tmp_path_factory.mktemp("tables"))
    leak = words(rng, 30)
    passage = ". ".join(words(rng, 14).capitalize() for _ in range(5)) + "."
    copy = words(rng, 90)
    rows, labels = [], []
    for i in range(240):
        text = words(rng, 60)
        if i % 6 == 0:
            w = text.split()
            for _ in range(4):
                w[rng.randrange(60)] = "grob" + "".join(rng.choice("aeiou") for _ in range(3))
            text = " ".join(w)
        elif i in (13, 31, 61):
            text = f"{text} {leak} {words(rng, 20)}"
        elif i in (25, 43, 73):
            text = f"{text}. {passage} {words(rng, 20)}"
        elif i in (37, 55, 67):
            w = copy.split()
            w[i % 80] = "changed"
            text = " ".join(w)
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, rows, passage, leak


def test_stages(spark, folder):
    top, rows, passage, leak = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, top)
        assert out.columns == columns
        kept[name] = {r.doc_id: r.text for r in out.collect()}
        docs = spark.createDataFrame(out.collect(), out.schema)
    tox, join, cut, clean = (kept[n] for n, _ in p.STAGES[:-1])
    assert set(tox) == {i for i in range(240) if i % 6}
    assert set(tox) - set(join) == {55, 67}
    # The leak is a repeated passage too: what is cut of it in later documents is no longer there to be found.
    assert set(cut) == set(join) and {i for i in cut if cut[i] != join[i]} - {31, 61} == {43, 73}
    middle = passage.split(". ")[2]
    assert [i for i in cut if middle in cut[i]] == [25]
    assert 13 in set(cut) - set(clean) <= {13, 31, 61} and not any(leak in t for t in clean.values())
    e = tokens.encoder(tokens.vocabulary())
    pieces = defaultdict(int)
    for r in p.run(spark, top).collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(e(t)) + 1 for i, t in clean.items()}


def test_stage_names():
    assert 4 <= len(p.STAGES) <= 5 and all(re.fullmatch(r"[a-z_]+", n) for n, _ in p.STAGES) and p.ORACLE_SQL is None
