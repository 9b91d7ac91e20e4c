import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cellsieve.llm import merkle as M

from .conftest import EDGES, plain

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
LOWERED = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, pos):
    """Per level the place in the run and the run."""
    out = []
    for level in levels[:-1]:
        run = level[pos // 8 * 8:pos // 8 * 8 + 8]
        out.append((pos % 8, run))
        pos //= 8
    return out


def expected(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row[2], []).append(row)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append(tree([leaf(r) for r in by_lang[lang]]))
    top = tree([t[-1][0] for t in trees]) if trees else []
    out = []
    for nth, (lang, levels) in enumerate(zip(langs, trees)):
        for pos, row in enumerate(by_lang[lang]):
            path = siblings(levels, pos) + siblings(top, nth)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None
            folded = leaf((*row[:4], row[4].translate(LOWERED))) if hit else leaf(row)
            for at, run in path:
                folded = h(*run[:at], folded, *run[at + 1:])
            proof = h(*[x for at, run in path for k, x in enumerate(run) if k != at])
            out.append((row[0], leaf(row), levels[-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def given(df):
    return [tuple(r) for r in df.select(*M.FIELDS).collect()]


def test_documents(documents):
    got = plain(M.verified(documents), *COLUMNS)
    assert got == expected(given(documents))
    # tampering shows exactly where it changes a letter
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("limit", [M.BROADCAST_BYTES, 0])
def test_edges(build, monkeypatch, limit):
    monkeypatch.setattr(M, "BROADCAST_BYTES", limit)
    docs = build([*EDGES, (12, "ABC", "s")]).withColumn(
        "lang", F.when(F.col("doc_id") == 1, None).when(F.col("doc_id") == 9, "").otherwise(F.col("source")))
    assert plain(M.verified(docs), *COLUMNS) == expected(given(docs))
    assert plain(M.verified(docs.where("doc_id = 12")), *COLUMNS) == expected([(12, "s", "s", 3, "ABC")])
    nothing = M.verified(build([]))
    assert nothing.columns == list(COLUMNS) and nothing.count() == 0


@pytest.mark.parametrize("rows,langs", [(9, 1), (64, 1), (65, 2), (700, 70), (20, 20)])
def test_shapes(spark, rows, langs):
    docs = spark.range(rows).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % langs).cast("string").alias("lang"),
        F.lit(1).alias("n_chars"), F.concat(F.lit("Text "), "id").alias("text")).repartition(5)
    assert plain(M.verified(docs), *COLUMNS) == expected(given(docs))


def test_many_equal_rows(spark, monkeypatch):
    docs = spark.range(3000).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"),
        F.lit(1).alias("n_chars"), F.lit("T").alias("text"))
    manifest = M.build(docs)
    # equal leaves are dealt to all ranges: none has more than twice its share
    placed = M.numbered(M.leaves_of(docs, F.col("text")), [F.asc("leaf"), F.asc("row")], "places")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = [r["count"] for r in placed.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2 * 3000 / parts
    assert manifest.root == expected(given(docs))[0][3]


def test_limit_is_restored(spark, documents):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    M.climb(M.build(documents))
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
