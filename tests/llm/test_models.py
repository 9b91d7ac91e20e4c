"""Factorisation machine and quality trees."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellsieve.llm import base, factor_machine as M, quality_trees as T

from .conftest import plain, texts_of

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def counted(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 3000 else None
    lines, dup, seen = (text or "").encode().split(b"\n"), 0, set()
    for line in lines:
        dup += bool(line.split()) and line in seen
        seen.add(line)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), dup,
            len(words) if hit is None else len(hit))


def test_statistics(build, documents):
    docs = [t for _, t in texts_of(build())] + [t for _, t in texts_of(documents.limit(60))]
    docs += ["a b c a b c", "a a a a", "a\n\na\n b\na\x0c\n \n", "x#*$%&|<> y", "1 2 3 4 5 1 2 3"]
    for text in docs:
        assert tuple(base.text_statistics((text or "").encode())[0][:5]) == counted(text)


def test_many_distinct_words():
    ids = np.concatenate([np.arange(2_000_001), [7, 8, 9]])
    assert base.repeated_words(ids) == 6


def test_report(tables, build):
    docs, labels = tables
    trees = T.train(docs, labels)
    report = T.quality_report(docs, trees).join(labels, "doc_id").where("not base_failed")
    held = report.where(base.held_out(F.col("doc_id")))
    assert held.where("kept = (quality = 1)").count() >= 0.97 * held.count()
    edges = T.quality_report(build(), trees)
    want = sorted(((i, *counted(t)) for i, t in texts_of(build())), key=repr)
    assert plain(edges, "doc_id", *base.STATISTICS[:5]) == want
    for r in edges.collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    kept = T.keep_good(docs, trees)
    assert kept.columns == docs.columns
    assert plain(kept, "doc_id") == plain(T.quality_report(docs, trees).where("kept"), "doc_id")
    assert T.keep_good(build(), trees).columns == build().columns
    assert T.quality_report(build([]), trees).count() == 0


def test_without_labels(spark, build):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert T.train(build(), labels) is None
        scores = M.score_documents(build(), M.train(build(), labels)).select("score").distinct().collect()
        assert len(scores) == 1 and 0 <= scores[0][0] <= 1
    assert T.quality_report(build(), None).where("kept = base_failed").count() == 0


def test_trees_are_monotonic():
    rng = np.random.default_rng(1)
    x = rng.random((800, len(T.FEATURES)))
    y = ((x[:, 0] + 0.3 * rng.random(800) < 0.6) | (x[:, 4] > 0.9)).astype(float)
    y[(x[:, 1] > 0.4) & (x[:, 1] < 0.6)] = 1  # a bump that a monotonic score must not follow
    trees = T.fit_trees(x, y, T.SIGNS)
    for f, sign in enumerate(T.SIGNS):
        if not sign:
            continue
        probe = np.repeat(x[:50], 40, axis=0)
        probe[:, f] = np.tile(np.linspace(0, 1, 40), 50)
        steps = np.diff(trees.raw_score(probe).reshape(50, 40), axis=1)
        assert (steps * sign >= -1e-9).all()
    assert trees.score(x)[y == 1].mean() > trees.score(x)[y == 0].mean() + 0.3


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.random((300, 3))
    trees = T.fit_trees(x, (x[:, 0] > 0.5).astype(float), np.zeros(3), trees=7)
    for row, score in zip(x, trees.raw_score(x)):
        total = trees.start
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert abs(total - score) < 1e-9


def test_machine_held_out(tables):
    docs, labels = tables
    machine = M.train(docs, labels)
    scored = M.score_documents(docs, machine).join(labels, "doc_id").collect()
    assert {r["doc_id"] for r in scored if r["held_out"]} == {
        r["doc_id"] for r in scored if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    held = [r for r in scored if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in scored)
    # what is held out teaches nothing
    flipped = labels.withColumn("quality", F.when(base.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = M.train(docs, flipped)
    assert np.array_equal(machine.weight, other.weight) and np.array_equal(machine.factor, other.factor)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    width = M.BUCKETS + len(base.STATISTICS)
    machine = M.Machine(0.1, rng.normal(0, 0.3, width), rng.normal(0, 0.3, (width, M.FACTORS)),
                        np.zeros(len(base.STATISTICS)), np.ones(len(base.STATISTICS)))
    rows = [M.Features()(t) for t in (b"a b c a", b"", "ä ö # x\nx".encode())]
    for row, score in zip(rows, machine.score(rows)):
        index, values, _ = M.stacked([(row[0], row[1], machine.numbers(row[2]))])
        raw = machine.bias + machine.weight[index] @ values + sum(
            machine.factor[index[i]] @ machine.factor[index[j]] * values[i] * values[j]
            for i in range(len(index)) for j in range(i))
        assert abs(1 / (1 + np.exp(-raw)) - score) < 1e-9


def test_machine_edges(build, tables):
    machine = M.train(*tables)
    rows = M.score_documents(build(), machine).collect()
    assert len(rows) == build().count() and all(0 <= r["score"] <= 1 for r in rows)
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert M.score_documents(build([]), machine).count() == 0


def test_sample_is_bounded(build, spark):
    docs = build([(1, f"text number {i}", "s") for i in range(200)])  # one id on all rows
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    sample = base.labelled_sample(docs, labels, "quality", 10)
    assert len(base.bounded_collect(sample, 10)) == 10
