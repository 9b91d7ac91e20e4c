"""Whole runs: order, uniqueness, skew, summaries and views against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cellsieve import ColumnSpec, DatasetSpec, validate
from cellsieve.operators import summary, views
from cellsieve.plans.keys import key_issues
from cellsieve.plans.validate import all_issues, dataset_issues, issue_order
from tests import brute

C = ColumnSpec
SPEC = DatasetSpec.of(
    C("id", "integer", True, False, {"unique": True, "max": 900}),
    C("name", "string", rules={"unique": True, "min_len": 2, "regex": r"[a-z -]+", "max_len": 3}),
    C("price", "number", rules={"min": -5, "max": 5.5}),
    C("day", "date", rules={"formats": ["%Y-%m-%d", "%d.%m.%Y"], "min_date": "2020-01-05"}),
    C("kind", "enum", rules={"allowed": ["A", "B"], "not_in": ["b"]}),
    C("free", "integer", unvalidated=True),
    null_values=["none"],
    unique_together=[("kind", "day"), ("free", "nope"), ("free", "kind", "price"), ("day", "free")],
)


def dirty(n, seed=0):
    rng = random.Random(seed)
    pick = lambda *xs: [rng.choice(xs) for _ in range(n)]
    return {
        "id": [rng.choice([str(rng.randint(0, 1000)), " 7 ", "007", "x", "NA", ""]) for _ in range(n)],
        "name": pick("ab", "AB ", "zz", "abcd", "a", "--", "none", "x-y", "Q!"),
        "price": pick("1", "1.0", "1e1", "-6", "abc", "nan", "", "2.5"),
        "day": pick("2020-01-01", "06.01.2020", "2020-01-06", "2020-13-01", None, "-"),
        "kind": pick("A", "a", "B", "C", ""),
        "free": pick("1", " 1", "zzz", "", None),
    }


@pytest.fixture(scope="module")
def columns():
    return dirty(600)


def triples(issues):
    return [(r["row"], r["column"], r["code"]) for r in issue_order(issues).collect()]


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_issues_in_emission_order(make, columns, partitions):
    issues = all_issues(make(columns, partitions), SPEC)
    assert triples(issues) == brute.run(columns, SPEC)


@pytest.mark.parametrize("broadcast_keys,hot_rows", [(10**6, 10**6), (0, 10**6), (0, 10), (0, 1), (3, 50)])
def test_every_way_of_joining_keys(make, columns, broadcast_keys, hot_rows):
    found = key_issues(make(columns, 5), SPEC, broadcast_keys=broadcast_keys, hot_rows=hot_rows)
    want = [t for t in brute.run(columns, SPEC) if t[2].startswith("UNIQUE")]
    assert triples(found) == want


def test_third_of_rows_share_a_key(spark):
    n = 30000
    df = spark.range(n, numPartitions=8).select(
        F.col("id").alias("row"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") / F.lit(2))).alias("k"),
        F.lit("same").alias("l"),
    )
    spec = DatasetSpec.of(C("k", rules={"unique": True}), unique_together=[("k", "l")])
    for options in ({}, {"broadcast_keys": 0, "hot_rows": 100}):
        found = key_issues(df, spec, **options).groupBy("code").agg(F.count("*").alias("n"), F.min("row").alias("m"))
        got = {r["code"]: (r["n"], r["m"]) for r in found.collect()}
        assert got == {"UNIQUE_VIOLATED": (9999, 3), "UNIQUE_TOGETHER_VIOLATED": (2 * 9999, 3)}


def test_messages_name_the_first_row(make):
    df = make({"A": ["x", "x", " X", "y"], "B": ["1", "1", "2", "1"]})
    spec = DatasetSpec.of(C("A", rules={"unique": True}), unique_together=[("A", "B")])
    got = [(r["row"], r["column"], r["message"]) for r in issue_order(key_issues(df, spec)).collect()]
    assert got == [
        (1, "A", "Duplicate value 'x'"), (2, "A", "Duplicate value ' X'"),
        (1, "A", "Composite key (A, B) duplicates row 0"), (1, "B", "Composite key (A, B) duplicates row 0"),
    ]


@pytest.mark.parametrize("values,rows", [
    (["fir", "yew", " FIR", "Yew ", "oak"], [2, 3]), (["n/a", "", "--"], []), (["9"], []), (["7", "07", "7 "], [2]),
    (["ü", "Ü", "u"], [1]), (["y" * 90, "y" * 91, "y" * 90], [2]),
])
def test_unique(make, values, rows):
    spec = DatasetSpec.of(C("V", rules={"unique": True}))
    assert [r["row"] for r in key_issues(make({"V": values}), spec).orderBy("row").collect()] == rows


@pytest.mark.parametrize("keys", [(10**6, 10**6), (0, 10**6), (0, 1)])
def test_repeated_and_missing_row_keys(spark, keys):
    rows = [(1, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, "c"), (None, "c"), (3, "c"), (4, "d"), (None, "e")]
    df = spark.createDataFrame(rows, "row long, V string")
    found = key_issues(df, DatasetSpec.of(C("V", rules={"unique": True})), "row", *keys)
    assert sorted(((r["row"], r["message"][-3:]) for r in found.collect()), key=repr) == sorted(
        [(1, "'a'"), (1, "'a'"), (None, "'b'"), (None, "'c'"), (3, "'c'")], key=repr)
    struct = df.select(F.struct(F.col("row").alias("x"), F.lit(0).alias("y")).alias("row"), "V")
    assert key_issues(struct, DatasetSpec.of(C("V", rules={"unique": True})), "row", *keys).count() == 5


def test_composite_keys_by_struct_row(spark):
    df = spark.createDataFrame([("b", "1", "k"), ("a", "2", "k"), ("a", "1", "K ")], "x string, y string, z string")
    spec = DatasetSpec.of(C("z", rules={"unique": True}))
    got = key_issues(df, spec, ["x", "y"]).select("row.x", "row.y").orderBy("x", "y").collect()
    assert [tuple(r) for r in got] == [("a", "2"), ("b", "1")]


def test_counters(make):
    df = make({
        "Tree": ["oak", "elm", "--", "", "fir"], "Rings": ["12", "x", "900", "7", "-1"], "Share": ["0.25", "2", "0.5", "0", "1"]})
    spec = DatasetSpec.of(
        C("Tree", required=True), C("Rings", "integer", rules={"min": 0, "max": 500}), C("Share", "number", rules={"max": 1}))
    done = validate(df, spec).store()
    stats = done.stats.first()
    assert (stats["rows"], stats["columns"], stats["total_cells"]) == (5, 3, 15)
    assert (stats["invalid_cells"], stats["invalid_rows"], stats["invalid_columns"], stats["worst_column"]) == (6, 4, 3, "Rings")
    assert {tuple(c) for c in stats["top_issue_codes"]} == {
        ("REQUIRED_EMPTY", 2), ("MAX_VIOLATED", 2), ("TYPE_MISMATCH", 1), ("MIN_VIOLATED", 1)}
    got = {r["column"]: (r["invalid_count"], r["total"]) for r in done.column_summary.collect()}
    assert got == {"Tree": (2, 5), "Rings": (3, 5), "Share": (1, 5)}
    assert summary.invalid_cell_pct(done.stats).first()[0] == 40.0


def test_summaries_match_brute_force(make, columns):
    df = make(columns, 4)
    issues = all_issues(df, SPEC)
    want = brute.run(columns, SPEC)
    by_col = {c: len({r for r, col, _ in want if col == c}) for c in columns}
    got = {r["column"]: r["invalid_count"] for r in summary.column_invalid_counts(df, issues).collect()}
    assert got == by_col
    stats = summary.dataset_stats(df, issues).first()
    assert stats["invalid_rows"] == len({r for r, _, _ in want})
    assert stats["invalid_cells"] == len({(r, c) for r, c, _ in want})
    assert stats["worst_column"] == max(by_col, key=by_col.get)
    codes = {}
    for _, _, code in want:
        codes[code] = codes.get(code, 0) + 1
    top = sorted(codes.items(), key=lambda kv: -kv[1])[:5]
    assert [tuple(c) for c in stats["top_issue_codes"]] == top
    assert [tuple(r) for r in summary.top_issue_codes(issues).collect()] == top


def test_numeric_stats(make, columns):
    df = make(columns, 3)
    want = brute.run(columns, SPEC)
    bad = {(r, c) for r, c, code in want if code != "UNIQUE_TOGETHER_VIOLATED"}
    got = {r["column"]: r for r in summary.numeric_stats(df, SPEC).collect()}
    for name, read in (("id", int), ("price", float)):
        nums = [float(read(v)) for i, v in enumerate(columns[name])
                if (i, name) not in bad and v.strip().lower() not in brute.NULLS]
        mean = sum(nums) / len(nums)
        std = (sum((x - mean) ** 2 for x in nums) / (len(nums) - 1)) ** 0.5
        r = got[name]
        assert (r["count"], r["min"], r["max"]) == (len(nums), min(nums), max(nums))
        assert r["mean"] == pytest.approx(mean, abs=1e-5) and r["std"] == pytest.approx(std, abs=1e-5)


def test_numeric_stats_of_few_values(make):
    df = make({"a": ["5", "x"], "b": ["", "NA"], "c": ["9" * 400, "2"]})
    spec = DatasetSpec.of(C("a", "integer"), C("b", "number"), C("c", "integer"))
    got = {r["column"]: (r["count"], r["mean"], r["std"]) for r in summary.numeric_stats(df, spec).collect()}
    assert got == {"a": (1, 5.0, None), "c": (1, 2.0, None)}


def test_one_pass_summary_equals_the_general_one(make, columns):
    df = make(columns, 4)
    spec = DatasetSpec.of(C("id", "integer", True), *SPEC.columns[2:], null_values=["none"])
    issues = all_issues(df, spec)
    key = lambda rows: sorted(map(repr, rows))
    one = summary.one_pass_summary(df, spec).select("column", "pos", "invalid_count", "total", "numeric_stats")
    assert key(one.collect()) == key(summary.column_summary(df, issues, spec).collect())


def test_empty_table(make, spark):
    df = spark.createDataFrame([], "row bigint, A string")
    spec = DatasetSpec.of(C("A", "integer", rules={"unique": True}))
    stats = validate(df, spec).stats.first()
    assert (stats["rows"], stats["invalid_cells"], stats["invalid_rows"], stats["worst_column"]) == (0, 0, 0, None)
    assert stats["top_issue_codes"] == []
    assert summary.invalid_cell_pct(validate(df, spec).stats).first()[0] is None
    plain = validate(df, DatasetSpec.of(C("A", "integer")))
    assert [tuple(r)[:4] for r in plain.column_summary.collect()] == [("A", 0, 0, 0)]


def test_worst_column_ties_and_none(make):
    spec = DatasetSpec.of(C("A", "integer"), C("B", "integer"))
    df = make({"A": ["4", "x", "5", "y"], "B": ["p", "6", "q", "7"]})
    counts = summary.column_invalid_counts(df, all_issues(df, spec))
    assert summary.worst_column(counts).first()[0] == "A"  # the first of equally bad ones
    fine = make({"A": ["8"], "B": ["9"]})
    counts = summary.column_invalid_counts(fine, all_issues(fine, spec))
    assert summary.worst_column(counts).first()[0] is None


def test_dataset_issues(make):
    df = make({"Y": ["1"], "Z": ["2"]})
    spec = DatasetSpec.of(C("X", required=True), C("Y"), C("Q"), strict=True)
    got = [tuple(r) for r in dataset_issues(df, spec).collect()]
    assert got == [
        ("MISSING_COLUMN", "X", "Required column 'X' is missing from the file"),
        ("EXTRA_COLUMN", "Z", "Unexpected column 'Z' (strict mode)"),
    ]


def test_views(make, columns):
    df = make(columns, 4)
    issues = all_issues(df, SPEC)
    want = brute.run(columns, SPEC)
    wrong = {r for r, _, _ in want}
    rows = lambda d: sorted(r["row"] for r in d.collect())
    assert rows(views.filter_rows(df, issues, "wrong_rows")) == sorted(wrong)
    assert rows(views.filter_rows(df, issues, "correct_rows")) == sorted(set(range(600)) - wrong)
    assert rows(views.filter_rows(df, issues)) == list(range(600))
    mins = {r for r, _, c in want if c == "MIN_VIOLATED"}
    assert rows(views.filter_rows(df, issues, "all", "MIN_VIOLATED")) == sorted(mins)
    assert rows(views.filter_rows(df, issues, "correct_rows", "MIN_VIOLATED")) == []
    first = {}
    for r, c, code in want:
        first.setdefault((r, c), code)
    got = {(r["row"], r["column"]): r["code"] for r in views.first_issue_per_cell(issues).collect()}
    assert got == first
    shown = {(r["row"], r["column"]): (r["v"], r["i"], r["c"]) for r in views.cells_with_errors(df, issues).collect()}
    assert shown == {
        (i, c): (vals[i] or "", (i, c) in first, first.get((i, c))) for c, vals in columns.items() for i in range(600)
    }
    notes = {r["row"]: r["notes"] for r in views.annotate_rows(df, issues).collect()}
    assert {(r, c): n.split(":")[0] for r, m in notes.items() for c, n in (m or {}).items()} == first
    as_map = {r["row"]: r["errors"] for r in views.issues_map(issues).collect()}
    assert {(r, c): e["code"] for r, m in as_map.items() for c, e in m.items()} == first


def test_pages(make, columns):
    df = make(columns, 4)
    rows = lambda d: [r["row"] for r in d.collect()]
    assert rows(views.page(df, -5, 0)) == [0]
    assert rows(views.page(df, 10, 1000)) == list(range(10, 210))
    assert rows(views.page(df, 590)) == list(range(590, 600))
    assert rows(views.page(df.where("row % 2 = 0"), limit=3, after=500)) == [502, 504, 506]
    got = [(r["row"], r["idx"]) for r in views.display_index(df.where("row % 2 = 1"), 3, 2).collect()]
    assert got == [(7, 4), (9, 5)]
    assert rows(views.preview(df)) == list(range(10))


def test_select_invalid_columns(make):
    df = make({"A": ["1", "2"], "B": ["x", "y"]})
    spec = DatasetSpec.of(C("A", "integer"), C("B", "integer"))
    assert views.select_invalid_columns(df, all_issues(df, spec)).columns == ["row", "B"]
    fine = DatasetSpec.of(C("A", "integer"))
    assert views.select_invalid_columns(df, all_issues(df, fine)).columns == ["row", "A", "B"]


def test_streams_are_refused_where_order_matters(spark, tmp_path):
    from cellsieve.operators.infer import inference_sample
    from cellsieve.plans.rowid import row_index

    spark.range(1).selectExpr("id AS row", "'x' AS a").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row bigint, a string").parquet(str(tmp_path / "in"))
    unique = DatasetSpec.of(C("a", rules={"unique": True}))
    for call in (lambda: key_issues(stream, unique), lambda: all_issues(stream, unique),
                 lambda: inference_sample(stream), lambda: row_index(stream)):
        with pytest.raises(ValueError):
            call()
