"""Physical plans: what is scanned, exchanged and compiled."""

import re

import pytest
from pyspark.sql import functions as F

from cellsieve import ColumnSpec, DatasetSpec, cell_issues
from cellsieve.operators import summary
from cellsieve.plans import keys
from cellsieve.plans.keys import key_issues
from cellsieve.scratch import write_table

C = ColumnSpec
SPEC = DatasetSpec.of(
    C("i", "integer", True, rules={"min": 0, "max": 9}), C("n", "number", rules={"min": 0.5}), C("b", "boolean"),
    C("d", "date", rules={"formats": ["%Y-%m-%d", "%d.%m.%Y"], "min_date": "2020-01-01"}),
    C("e", "enum", rules={"allowed": ["a"]}), C("s", rules={"regex": "[a-z]+", "min_len": 1, "max_len": 5, "not_in": ["x"]}),
)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "t")
    names = [c.name for c in SPEC.columns] + ["unused"]
    spark.range(100).select(F.col("id").alias("row"), *[F.col("id").cast("string").alias(c) for c in names]).write.parquet(path)
    return spark.read.parquet(path)


def explain(spark, df, mode="formatted"):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def test_cell_pass_is_one_scan_without_exchange(spark, stored):
    plan = explain(spark, cell_issues(stored, SPEC))
    assert "Exchange" not in plan and "EvalPython" not in plan and plan.count("Scan parquet") == 2  # tree and details
    assert "_common_expr" not in plan  # would be evaluated for cells that do not need it
    assert "size(array" not in plan  # cells would be put together twice
    assert "unused" not in plan.split("ReadSchema")[1]


def test_generated_methods_stay_compilable(spark, stored):
    """The JIT skips methods of more than 8000 bytes."""
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", explain(spark, cell_issues(stored, SPEC), "codegen"))
    assert sizes and max(map(int, sizes)) < 8000


def test_named_dates_and_offsets_stay_in_the_jvm(spark, stored):
    spec = DatasetSpec.of(
        C("i", "integer"), C("d", "date", rules={"formats": ["%d %b %Y", "%A, %d. %B %y"], "min_date": "01 Jan 2020"}),
        C("n", "datetime", rules={"formats": ["%Y-%m-%dT%H:%M:%S%z", "%I:%M %p"]}))
    issues = cell_issues(stored, spec)
    assert "EvalPython" not in explain(spark, issues)
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", explain(spark, issues, "codegen"))
    assert all(int(size) < 8000 for size in sizes)


def test_method_size_does_not_grow_with_columns(spark):
    def size(n):
        df = spark.range(1).select(F.col("id").alias("row"), *[F.lit(str(i)).alias(f"c{i}") for i in range(n)])
        spec = DatasetSpec.of(*[C(f"c{i}", "integer" if i % 2 else "number", rules={"min": i, "max": i + 2}) for i in range(n)])
        return max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", explain(spark, cell_issues(df, spec), "codegen"))))
    assert size(60) < size(4) + 2000 < 8000


def test_wide_table(spark):
    n = 300
    df = spark.range(50).select(F.col("id").alias("row"), *[(F.col("id") + i).cast("string").alias(f"c{i}") for i in range(n)])
    spec = DatasetSpec.of(*[C(f"c{i}", "integer", rules={"max": 300}) for i in range(n)])
    assert cell_issues(df, spec).count() == sum(1 for r in range(50) for i in range(n) if r + i > 300)


def test_one_pass_summary_exchanges_only_partial_aggregates(spark, stored):
    plan = explain(spark, summary.one_pass_summary(stored, SPEC))
    assert plan.count("partial_") >= 2 and "Sort" not in plan


def test_key_columns_only(spark, stored):
    spec = DatasetSpec.of(C("s", rules={"unique": True}), unique_together=[("e", "b")])
    plan = explain(spark, key_issues(stored, spec))
    schemas = re.findall(r"ReadSchema: (.*)", plan)
    assert schemas and all("i:string" not in s and "n:string" not in s for s in schemas)
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan  # few repeated keys: broadcast


@pytest.mark.parametrize("repeats", [2, 3000])
def test_identity_of_rows_is_moved_once(spark, monkeypatch, repeats):
    """Rows known by several columns: keys are counted by their hashes, and only then rows are moved, none of frequent keys."""
    written = []
    monkeypatch.setattr(keys, "write_table", lambda df, name: written.append(explain(spark, df)) or write_table(df, name))
    rows = spark.range(6000).select(
        F.col("id").alias("x"), F.col("id").cast("string").alias("y"), (F.col("id") / repeats).cast("long").cast("string").alias("k"))
    spec = DatasetSpec.of(C("k", rules={"unique": True}))
    for options in ({}, {"broadcast_keys": 0}, {"broadcast_keys": 0, "hot_rows": 1000}):
        written.clear()
        found = key_issues(rows, spec, ["x", "y"], **options)
        plan = explain(spark, found, "simple")
        counted = re.findall(r"Functions \[\d+\]: \[(.*)\]", written[0])
        assert counted and all("min" not in f and "first" not in f for f in counted) and "SortMergeJoin" not in plan
        if repeats == 2:
            assert len(written) == 1 and plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
        got = {(r["row"]["x"], r["row"]["y"]) for r in found.collect()}
        assert got == {(i, str(i)) for i in range(6000) if i % repeats}
