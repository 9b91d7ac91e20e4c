import hashlib
import re

import pytest

from cellsieve.llm import decontaminate as D

from .conftest import SF, plain, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SMALL = str.maketrans(D.CAPITALS, D.SMALL)
COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[k:k + 10]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [
    (1, "same TEXT here"), (2, "One two three four five six seven eight nine ten eleven twelve"), (3, "of two"), (4, ""), (5, None),
    (None, "big id"), (7, "... !!"), (8, "wörd wort wörd wort wörd wort wörd wort wörd wort"), (9, "of two"), (9, "end"),
]
MORE = [(50, "x One-two three,four five six seven\neight nine ten eleven twelve one two three", "s"), (51, "éa0 İx one two", "s")]


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_edges(spark, build, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    from .conftest import EDGES

    docs = build(EDGES + MORE)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert plain(D.contamination(docs, items), *COLUMNS) == expected(texts_of(docs), ITEMS)


def test_documents(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    want = expected(texts_of(documents), rows)
    assert plain(D.contamination(documents, items), *COLUMNS) == want
    clean = D.clean_documents(documents, items)
    assert clean.columns == documents.columns
    assert plain(clean, "doc_id") == sorted(((r[0],) for r in want if not r[5]), key=repr)


def test_empty_tables(spark, build):
    nothing = spark.createDataFrame([], "item_id long, text string")
    rows = D.contamination(build(), nothing).collect()
    assert len(rows) == build().count() and not any(r["contaminated"] for r in rows)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert D.contamination(build([]), items).count() == 0
    assert D.clean_documents(build([]), items).count() == 0
    clean = D.clean_documents(build(), items)
    want = [r[0] for r in expected(texts_of(build()), ITEMS) if not r[5]]
    assert clean.columns == build().columns and sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted(want, key=repr)


def test_words(spark, build):
    from pyspark.sql import functions as F

    for text, got in build(MORE).select("text", D.words_of(F.col("text"))).collect():
        assert got == words(text)


def test_no_python(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    plan = D.contamination(documents, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
