import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellsieve.llm import decontaminate, queries

from . import test_decontaminate, test_minhash, test_mixing
from .conftest import SF, texts_of

NAMES = ("op1_pii_bootstrap op2_factor_machine op3_token_codes op4_hash_tree op5_decontaminate op6_suffix_dedup "
         "op7_minhash_dedup op8_quality_trees op9_chat_format op10_mix_sources op11_merkle_manifest "
         "op12_byte_bpe op13_periodic_runs pipeline").split()


def test_registered():
    assert set(queries.QUERIES) == set(NAMES) and set(NAMES) <= set(entry.queries())
    assert set(queries.SQL) <= set(NAMES) and set(queries.SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    result = con.execute(queries.SQL[name])
    columns = [c[0] for c in result.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(found.columns)
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in found.select(*columns).collect()) == want


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage got and gave."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns(stages):
    assert all(df.schema.simpleString() == stages[0].schema.simpleString() for df in stages[:5])
    assert stages[5].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_quality(stages, spark):
    kept = {r["doc_id"] for r in stages[1].collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    from .test_models import counted

    for i, text in texts_of(stages[0]):
        n, _, _, _, repeats = counted(text)
        if n < 50 or 100 * repeats > 50 * n:
            assert i not in kept
        elif i in labels:
            assert (i in kept) == bool(labels[i])


def test_dedup(stages):
    want = {r[0] for r in test_minhash.expected(texts_of(stages[1]), 5) if r[3]}
    assert sorted(i for i, _ in texts_of(stages[2])) == sorted(want)


def test_decontamination(stages, spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = [r[0] for r in test_decontaminate.expected(texts_of(stages[2]), items) if not r[5]]
    assert sorted(i for i, _ in texts_of(stages[3])) == sorted(want)
    left = decontaminate.contamination(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert left.where("contaminated").count() == 0


def test_mix(stages):
    report = {r["doc_id"]: r["taken"] for r in test_mixing.check(stages[3])}
    taken = {}
    for i, text in texts_of(stages[4]):
        taken[i] = taken.get(i, 0) + test_mixing.word_count(text)
    assert taken == {i: n for i, n in report.items() if n}


def test_tokens(stages, spark):
    rows = stages[5].orderBy("start").collect()
    assert len(rows) == stages[4].count()
    assert [r["start"] for r in rows] == [sum(r["n_tokens"] for r in rows[:k]) for k in range(len(rows))]
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)
    run = corpus_pipeline.run(spark, SF)
    both = run.exceptAll(stages[5].select(run.columns)).union(stages[5].select(run.columns).exceptAll(run))
    assert both.agg(F.count("*")).first()[0] == 0
