import zlib

import pytest
from pyspark.sql import functions as F

from cellsieve.llm import hash_tree as H

from .conftest import texts_of

TREE = H.ShardTree.regular(4, 2, 2)


def shards(spark, tree, n=6000):
    rows = spark.range(n).select("id", H.shard_of(F.col("id"), tree).alias("s")).collect()
    return {r["id"]: r["s"] for r in rows}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before, after = shards(spark, TREE), shards(spark, TREE.with_shard(16))
    moved = [i for i in before if before[i] != after[i]]
    assert all(after[i] == 16 for i in moved)
    assert 0.7 * 6000 / 17 < len(moved) < 1.3 * 6000 / 17
    counts = [list(before.values()).count(s) for s in range(16)]
    assert min(counts) > 0.75 * 6000 / 16 and max(counts) < 1.25 * 6000 / 16
    twice = shards(spark, TREE.with_shard(16).with_shard(17))
    assert all(twice[i] == 17 for i in after if after[i] != twice[i])


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    before = H.ShardTree({"a": {"r": {0: 1.0, 1: 1.0}, "q": {2: 2.0}}, "b": {"r": {3: 1.0, 4: 3.0}}})
    heavier = H.ShardTree({"a": {"r": {0: 1.0, 1: 1.0}, "q": {2: 2.0}}, "b": {"r": {3: 1.0, 4: 5.0}}})
    x, y = shards(spark, before), shards(spark, heavier)
    moved = [(x[i], y[i]) for i in x if x[i] != y[i]]
    # region b gained weight: rows move into it, or inside it towards shard 4, never between the others
    assert moved and all(to in (3, 4) for _, to in moved)
    assert all(to == 4 for of, to in moved if of == 3)
    share = list(x.values()).count(4) / len(x)
    assert abs(share - 3 / 8) < 0.03


def test_trees_need_shards_and_weights(spark):
    for tree in (H.ShardTree({}), H.ShardTree({"a": {}}), H.ShardTree({"a": {"r": {0: 0.0}}})):
        with pytest.raises(ValueError):
            H.shard_of(F.col("id"), tree)
    with pytest.raises(ValueError):
        TREE.with_shard(3)


def test_edges(build, documents):
    for docs in (build(), documents):
        rows = H.with_slots(H.place(docs, TREE)).collect()
        want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts_of(docs)), key=repr)
        assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
        for s in {r["shard"] for r in rows}:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
        of = {}
        assert all(of.setdefault(r["doc_id"], r["shard"]) == r["shard"] for r in rows)
    assert H.with_slots(H.place(build([]), TREE)).count() == 0


def test_many_equal_rows(spark):
    """Equal rows reach the numbering as one row per partition."""
    rows = spark.range(0, 100_000, 1, 6).selectExpr("cast(null as bigint) doc_id", "'x' text").unionByName(
        spark.range(500).selectExpr("id doc_id", "'y' text"))
    slotted = H.with_slots(H.place(rows, TREE))
    got = slotted.groupBy("shard").agg(
        F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi")).collect()
    assert sum(r["n"] for r in got) == 100_500
    assert all((r["n"], r["lo"], r["hi"]) == (r["d"], 0, r["n"] - 1) for r in got)
    plan = slotted._jdf.queryExecution().optimizedPlan().toString()
    window, generate = plan.index("Window [sum(_n"), plan.index("Generate explode(sequence")
    assert generate < window < plan.index("count(1) AS _n")  # printed from the last step to the first


def test_placement_needs_no_shuffle(documents):
    plan = documents.select(H.shard_of(F.col("doc_id"), TREE))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan
