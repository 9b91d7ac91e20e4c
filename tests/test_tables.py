"""Specifications, matching, inference, files, stored tables and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cellsieve import ColumnSpec, DatasetSpec, Template, cell_issues, validate
from cellsieve.operators import infer, match, tables, views
from cellsieve.plans.rowid import row_index
from cellsieve.plans.validate import all_issues, issue_order
from cellsieve.sinks import exports
from cellsieve.sinks.stored import save_issues, save_raw
from cellsieve.sources import csv_files, json_files, stored, xml_files
from cellsieve.spec import SpecError, bind_spec, manual_spec, match_columns
from cellsieve.streaming.checks import stream_issues, write_issues
from suite import table_queries
from tests.test_runs import SPEC as RUN_SPEC
from tests.test_runs import dirty

C = ColumnSpec

STATIONS = {
    "id": "stations-3", "name": "Stations", "version": "3.1", "strict": True,
    "null_values": ["", "unknown"], "xml_record_path": "root.records.record",
    "dataset_rules": [{"type": "unique_together", "columns": ["Station", "Since"]}],
    "columns": [
        {"name": "Station", "aliases": ["station_no", "STATION NR"], "type": "string", "required": True, "nullable": False,
         "rules": {"regex": "[A-Z]{2}[0-9]+", "max_len": 9}},
        {"name": "Height", "aliases": ["height_m"], "type": "number", "required": True, "nullable": False, "rules": {"max": 9000}},
        {"name": "Since", "type": "date", "required": False, "nullable": True, "rules": {"formats": ["%d.%m.%Y"]}},
    ],
}


def test_template_round_trip():
    template = Template.from_json(json.dumps(STATIONS))
    assert template.to_dict() == STATIONS


@pytest.mark.parametrize("change", [
    {"type": "nope"}, {"rules": {"nope": 1}}, {"rules": {"min_len": "3"}}, {"rules": {"max": "x"}}])
def test_templates_check_themselves(change):
    with pytest.raises(SpecError):
        Template.from_dict({"id": "t", "name": "t", "columns": [{"name": "a", "type": "string", **change}]})


@pytest.mark.parametrize("header,matched,missing,extra", [
    (["STATION_NO ", "height_m", "Extra"], {"Station": "STATION_NO ", "Height": "height_m"}, (), ("Extra",)),
    (["depth", "width"], {}, ("Station", "Height"), ("depth", "width")),
    ([], {}, ("Station", "Height"), ()),
    (["station", "STATION", "Since"], {"Station": "STATION", "Since": "Since"}, ("Height",), ("station",)),
])
def test_match_one_header(header, matched, missing, extra):
    got = match_columns(Template.from_dict(STATIONS), header)
    assert (got.matched, got.missing, got.extra) == (matched, missing, extra)


def test_bind_spec():
    template = Template.from_dict(STATIONS)
    spec = bind_spec(template, ["station_no", "height_m", "since", "x"])
    assert [(c.name, c.unvalidated) for c in spec.columns] == [
        ("station_no", False), ("height_m", False), ("since", False), ("x", True)]
    assert spec.unique_together[0].columns == ("station_no", "since") and spec.strict
    with pytest.raises(SpecError):
        bind_spec(template, ["station_no"])
    forced = bind_spec(template, ["station_no"], force=True)
    assert [c.name for c in forced.columns] == ["station_no", "Height"]
    mapped = bind_spec(template, ["station_no", "metres"], overrides={"Height": "metres", "Since": "__skip__"})
    assert mapped.by_name()["metres"].type == "number"
    with pytest.raises(SpecError):
        bind_spec(template, ["station_no", "height_m"], overrides={"Since": "height_m"})


def test_manual_spec():
    spec = manual_spec(["a", "b", "c", "d"], {"a": "integer", "b": "enum", "c": "date"}, {"a": "error"},
                       {"a": {"min": "1", "max": "x"}, "b": {"allowed": " x, ,y "}, "c": {"formats": "%Y, %d"}, "d": {"regex": " a+ "}})
    by = spec.by_name()
    assert by["a"].rules == {"min": 1.0} and by["a"].must_be_filled and not by["b"].must_be_filled
    assert by["b"].rules == {"allowed": ["x", "y"]} and by["c"].rules == {"formats": ["%Y", "%d"]}
    assert by["d"].rules == {"regex": "a+"}


def test_catalog_equals_single_matches(spark):
    template = Template.from_dict(STATIONS)
    headers = {"one": ["STATION_NO ", "height_m", "Extra"], "two": ["station", "STATION", "Since"], "three": ["foo"]}
    rows = [(d, i, n) for d, names in headers.items() for i, n in enumerate(names)]
    got = match.match_schema_catalog(
        spark.createDataFrame(rows, "dataset_id string, pos int, name string"),
        match.template_candidates(spark, [template, Template("other", "o", (C("foo"),))]),
        spark.createDataFrame([(d, template.id) for d in headers], "dataset_id string, template_id string"),
    ).collect()
    for d, names in headers.items():
        want = match_columns(template, names)
        mine = [r for r in got if r["dataset_id"] == d]
        pick = lambda s, c: sorted(r[c] for r in mine if r["status"] == s)
        assert {r["column"]: r["name"] for r in mine if r["status"] == "matched"} == want.matched
        assert pick("missing", "column") == sorted(want.missing)
        assert pick("unresolved", "column") == sorted(want.unresolved)
        assert pick("extra", "name") == sorted(want.extra)


# --- inference ---------------------------------------------------------------

LADDER = {
    "int": ["0", "1", "-5", "+7"], "int95": ["1"] * 19 + ["x"], "num": ["1", "2.5", "1e3", "3"],
    "datetime": ["2024-01-15 10:30:00"] * 3, "t": ["2024-01-15T10:30:00"] * 2, "minute": ["15/01/2024 10:30"] * 2,
    "date": ["2024-01-15", "2024-1-5"], "european": ["15/01/2024", "01/02/2024"], "ambiguous": ["01/02/2024", "03/04/2024"],
    "bool": ["Yes", "no", "TRUE", "false"], "enum": ["a", "b", "a"], "blank": ["", "NA", " - "],
    "enum20": [f"v{i}" for i in range(20)], "string21": [f"v{i}" for i in range(21)],
    "enum100": [f"v{i % 11}" for i in range(100)], "string101": [f"v{i % 11}" for i in range(101)],
    "enum110": [f"v{i % 11}" for i in range(110)], "late": ["1"] * 500 + ["x"] * 400,
}
EXPECTED = {
    "int": "integer", "int95": "integer", "num": "number", "datetime": "datetime", "t": "datetime", "minute": "datetime",
    "date": "date", "european": "date", "ambiguous": "date", "bool": "boolean", "enum": "enum", "blank": "string",
    "enum20": "enum", "string21": "string", "enum100": "enum", "string101": "string", "enum110": "enum", "late": "integer",
}


def padded(columns):
    longest = max(map(len, columns.values()))
    return {k: v + [""] * (longest - len(v)) for k, v in columns.items()}


def test_inference_ladder(make):
    found = {r["column"]: r for r in infer.infer_column_types(make(padded(LADDER), 5)).collect()}
    assert {c: r["type"] for c, r in found.items()} == EXPECTED
    assert found["minute"]["formats"] == ["%d/%m/%Y %H:%M"] and found["ambiguous"]["formats"] == ["%d/%m/%Y"]
    assert found["enum"]["allowed"] == ["a", "b"] and found["int"]["formats"] is None


def test_sample_takes_the_first_values(spark):
    n = 20000
    df = spark.range(n).select(
        (F.col("id") * 3 - 50).alias("row"),
        F.when(F.col("id") % 100 == 0, F.col("id").cast("string")).alias("rare"),
        F.when(F.col("id") > 15000, F.lit("z")).otherwise(F.lit("NA")).alias("late"),
        F.col("id").cast("string").alias("dense"),
        F.lit("").alias("none"),
    ).repartition(6)
    got = infer.inference_sample(df, n=50).groupBy("column").agg(F.count("*").alias("n"), F.max("row").alias("m"))
    assert {r["column"]: (r["n"], r["m"]) for r in got.collect()} == {
        "rare": (50, 4900 * 3 - 50), "late": (50, 15050 * 3 - 50), "dense": (50, 49 * 3 - 50)}
    infer.HEAD_ROWS = 64
    again = infer.inference_sample(df, n=50).groupBy("column").agg(F.count("*").alias("n"), F.max("row").alias("m"))
    infer.HEAD_ROWS = 1 << 16
    assert sorted(again.collect()) == sorted(got.collect())
    keyed = infer.inference_sample(df.withColumn("k", F.format_string("%08d", "row")).drop("row"), "k", 50)
    assert keyed.groupBy("column").count().count() == 3


# --- positions ---------------------------------------------------------------

@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_row_index_follows_file_order(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr("cellsieve.plans.rowid.BROADCAST_FILES", broadcast)
    for i in range(4):
        part = spark.range(i * 100, i * 100 + 100, numPartitions=1).selectExpr("id", "cast(id as string) AS s")
        part.write.parquet(str(tmp_path / f"p/f{i}"))
        part.coalesce(1).write.option("header", True).csv(str(tmp_path / f"c/f{i}"))
    got = row_index(spark.read.parquet(*[str(tmp_path / f"p/f{i}") for i in (2, 0, 1, 3)]))
    assert got.where("row <> id").count() == 0 and got.count() == 400
    csv = spark.read.schema("id bigint, s string").option("header", True).csv(
        *[[str(tmp_path / f"c/f{i}") for i in (3, 0, 1, 2)]])
    got = row_index(csv)
    assert got.where("row <> id").count() == 0 and got.count() == 400
    with pytest.raises(ValueError):
        row_index(spark.range(3))
    with pytest.raises(ValueError):
        row_index(spark.range(3).withColumnRenamed("id", "Row"))
    plan = row_index(spark.read.parquet(str(tmp_path / "p/f0")))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
    assert not moved


# --- files -------------------------------------------------------------------

def write(path, content, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content.encode(encoding))
    return str(path)


def records(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_detection_and_cells(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Plant;Rows;Remark\nfern;12;wet\nmoss;NA;\"p;\"\"q\"\"\"\n")
    df = csv_files.scan_csv(spark, path)
    assert df.columns == ["Plant", "Rows", "Remark"]
    assert records(df) == [("fern", "12", "wet"), ("moss", "NA", 'p;"q"')]
    assert [tuple(r)[1:] for r in csv_files.detect_csv_dialect(spark, path).collect()] == [("utf-8", ";")]


def test_csv_names_short_rows_and_sentinels(spark, tmp_path):
    path = write(tmp_path / "a.csv", "﻿a,a, ,b \n1,2,3,nan\n4,5\n None,,None,<NA>\n")
    df = csv_files.scan_csv(spark, path, delimiter=",")
    assert df.columns == ["a", "a.1", "Unnamed: 2", "b"]
    assert records(df) == [(" None", "", "", ""), ("1", "2", "3", ""), ("4", "5", "", "")]


def test_csv_long_rows_are_errors(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more fields"):
        csv_files.scan_csv(spark, path, ",", "utf-8").collect()


def test_csv_latin1_and_mixed_sets(spark, tmp_path):
    write(tmp_path / "d/a.csv", "name,n\nné,1\n", "latin-1")
    write(tmp_path / "d/b.csv", "name;n\nüb;2\n")
    got = csv_files.scan_csv(spark, str(tmp_path / "d"))
    assert records(got) == [("né", "1"), ("üb", "2")]


def test_csv_files_with_different_headers(spark, tmp_path):
    write(tmp_path / "d/a.csv", "x,y\n1,2\n")
    write(tmp_path / "d/b.csv", "y,z\n3,4\n")
    got = csv_files.scan_csv(spark, str(tmp_path / "d"), ",", "utf-8")
    assert sorted(tuple(r) for r in got.select("x", "y", "z").collect()) == [("", "3", "4"), ("1", "2", "")]


@pytest.mark.parametrize("header_row,names,n", [(0, ["report", "Unnamed: 1"], 5), (2, ["id", "v"], 3)])
def test_csv_header_row(spark, tmp_path, header_row, names, n):
    for f in "ab":
        write(tmp_path / f"d/{f}.csv", "report,\n\nmade,today\nid,v\n1,x\n2,y\nid,v\n")
    got = csv_files.scan_csv(spark, str(tmp_path / "d"), ",", "utf-8", header_row)
    assert got.columns == names and got.count() == 2 * n
    if header_row:
        assert got.where("id = 'id'").count() == 2


def test_csv_larger_than_a_split(spark, tmp_path):
    lines = "".join(f"{i};{'x' * 50}\n" for i in range(20000))
    path = write(tmp_path / "big.csv", "skip me;\nid;v\n" + lines)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = csv_files.scan_csv(spark, path, header_row=1)
        assert got.columns == ["id", "v"]
        assert got.agg(F.count("*"), F.sum("id"), F.max(F.length("v"))).first()[:] == (20000, 199990000.0, 50)
        plain = csv_files.scan_csv(spark, path, ";", "utf-8")
        assert plain.count() == 20001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_peek_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n" + "1,2\n" * 30)
    got = csv_files.peek_rows(spark, path).collect()
    assert len(got) == 12 and got[0]["cells"] == ["a", "b"] and got[1]["cells"] == ["1", "2"]
    assert csv_files.peek_rows(spark, str(tmp_path / "nothing.csv")).count() == 0


@pytest.mark.parametrize("content,columns,want", [
    ('[{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]', ["id", "name"], [("1", "a"), ("2", "b")]),
    ('{"data": [{"km": "7 "}, {"km": "n"}]}', ["km"], [("7 ",), ("n",)]),
    ('{"values": [{"x": 1}], "records": [{"x": 2}]}', ["x"], [("2",)]),
    ('{"x": 1.50, "y": true, "z": null, "w": {"a": [1]}}', ["x", "y", "w"], [("1.50", "True", '{"a":["1"]}')]),
    ('[{"x": 1}, {"y": "nan"}]', ["x", "y"], [("", ""), ("1", "")]),
    ('{"data": "text", "x": 1}', ["data", "x"], [("text", "1")]),
    ('[{"data": [{"a": 1}]}]', ["data"], [('[{"a":"1"}]',)]),
])
def test_json(spark, tmp_path, content, columns, want):
    path = write(tmp_path / "a.json", content)
    assert records(json_files.scan_json(spark, path, columns=columns)) == want


def test_json_lines_and_errors(spark, tmp_path):
    path = write(tmp_path / "l.json", '{"id": 1, "items": [{"k": 1}]}\n{"id": 2, "items": []}\n')
    found = json_files.scan_json(spark, path, lines=True, columns=["id", "items"])
    assert records(found) == [("1", '[{"k":"1"}]'), ("2", "[]")]
    with pytest.raises(ValueError):
        json_files.scan_json(spark, write(tmp_path / "s.json", '"scalar"'))
    peeked = json_files.peek_json(spark, write(tmp_path / "p.json", '[{"a": 2, "b": "x"}, {"a": 1}]'), 5)
    assert [tuple(r) for r in peeked.orderBy("row").collect()] == [(0, ["2", "x"]), (1, ["1", ""])]
    assert json_files.peek_json(spark, str(tmp_path / "nothing.json")).count() == 0


@pytest.mark.parametrize("limits", [(500_000, 100_000), (0, 100_000), (0, 2)])
def test_popular_template(spark, limits):
    """One template held against many tables, by broadcast, by shuffle and in copies."""
    wanted = Template.from_dict({"id": "t", "columns": [
        {"name": "Key", "aliases": ["Id", "No"], "required": True}, {"name": "Note", "required": True}, {"name": "Left out"}]})
    tables = {f"d{i}": ["no", "ID ", f"x{i}"] if i % 2 else ["note", "NO", "Note"] for i in range(9)}
    headers = spark.createDataFrame(
        [(d, k, n) for d, names in tables.items() for k, n in enumerate(names)], "dataset_id string, pos int, name string")
    pairs = spark.createDataFrame([(d, "t") for d in tables], "dataset_id string, template_id string")
    got = match.match_schema_catalog(headers, match.template_candidates(spark, [wanted]), pairs, *limits).collect()
    want = set()
    for d, names in tables.items():
        one = match_columns(wanted, names)
        want |= {(d, "matched", c, n) for c, n in one.matched.items()}
        want |= {(d, "unresolved", c, None) for c in one.unresolved} | {(d, "missing", c, None) for c in one.missing}
        want |= {(d, "extra", None, n) for n in one.extra}
    assert {(r["dataset_id"], r["status"], r["column"], r["name"]) for r in got} == want and len(got) == len(want)
    assert match_columns(wanted, tables["d1"]).matched == {"Key": "ID "}
    assert match_columns(wanted, tables["d2"]).matched == {"Key": "NO", "Note": "Note"}


def test_stored_run(make, tmp_path):
    from cellsieve.sinks.stored import save_run

    spec = DatasetSpec.of(ColumnSpec("A", "integer"), ColumnSpec("lost", required=True))
    df = make({"A": ["1", "x", ""]})
    done = validate(df, spec)
    root = str(tmp_path / "runs")
    save_run(done, root, "a/b")
    save_run(validate(make({"A": ["1"]}), spec), root, "c")
    got = stored.load_run(df.sparkSession, root, "a/b")
    assert records(got["issues"]) == records(done.issues) and got["issues"].count() == 1
    assert [r["code"] for r in got["dataset_issues"].collect()] == ["MISSING_COLUMN"]
    assert got["stats"].first()["invalid_cells"] == 1 and got["column_summary"].count() == done.column_summary.count()
    with pytest.raises(FileNotFoundError):
        stored.load_run(df.sparkSession, root, "b")


def test_deep_pages(make):
    df = make({"V": [str(i) for i in range(50)]})
    deep = views.display_index(df, 20, 5, after=19).collect()
    assert [(r["row"], r["idx"]) for r in deep] == [(i, i + 1) for i in range(20, 25)]
    assert deep == views.display_index(df, 20, 5).collect()
    assert views.filter_rows(df, df.select("row").limit(0).withColumn("code", F.lit("X")), "correct_rows", "X").count() == 0


def test_json_layouts_of_many_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    for name, content in {
        "a": '\n [{"x": 1}, {"x": 2}]', "b": '{"data": [{"x": 3}, {"y": "q"}], "n": 1}', "c": '{"x": 4, "data": "text"}',
        "d": '{"values": [7, 8], "n": 1}', "e": '{"items": [], "x": 9}', "f": '{"rows": "[1]", "items": [{"x": 5}]}',
    }.items():
        write(tmp_path / "docs" / f"{name}.json", content)
    got = json_files.scan_json(spark, str(tmp_path / "docs"), columns=["x", "y", "data", "0"])
    assert records(got) == sorted([
        ("1", "", "", ""), ("2", "", "", ""), ("3", "", "", ""), ("", "q", "", ""), ("4", "", "text", ""),
        ("", "", "", "7"), ("", "", "", "8"), ("5", "", "", "")])


def test_csv_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    write(tmp_path / "csv" / "a.csv", 'id,"no\nte"\n1,"two\nlines, ""quoted"""\n2,plain\n')
    write(tmp_path / "csv" / "b.csv", 'id,"no\nte"\n3,x\n')
    write(tmp_path / "csv" / "c.csv", 'id;other\n4;y\n')
    got = csv_files.scan_csv(spark, str(tmp_path / "csv")).select("id", "no\nte", "other")
    assert records(got) == [("1", 'two\nlines, "quoted"', ""), ("2", "plain", ""), ("3", "x", ""), ("4", "", "y")]
    peeked = csv_files.peek_rows(spark, str(tmp_path / "csv" / "a.csv"), 2).orderBy("row").collect()
    assert [r["cells"] for r in peeked] == [["id", "no\nte"], ["1", 'two\nlines, "quoted"']]
    latin = tmp_path / "latin.csv"
    latin.write_bytes("a;b\nß;é\n".encode("latin-1"))
    assert csv_files.peek_rows(spark, str(latin)).orderBy("row").collect()[1]["cells"] == ["ß", "é"]


def test_xml_layouts_of_many_files(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    write(tmp_path / "xml" / "a.xml", "<r><o><k>1</k></o><o><k>2</k></o></r>")
    write(tmp_path / "xml" / "b.xml", "<q><p><k>3</k></p><p><k>4</k></p></q>")
    write(tmp_path / "xml" / "c.xml", "<r><items><o><k>5</k></o><o><k>6</k></o></items><tail><o><k>stray</k></o></tail></r>")
    got = xml_files.scan_xml(spark, str(tmp_path / "xml")).select("k")
    assert records(got) == [(str(i),) for i in range(1, 7)]
    assert records(xml_files.scan_xml(spark, str(tmp_path / "xml" / "c.xml"), "r.items.o").select("k")) == [("5",), ("6",)]


XML = """<?xml version="1.0"?><root xmlns="urn:x"><meta><record><id>stray</id></record></meta><records>
<record k="7"><id> 1 </id><v>a</v><v>b</v><n>own<c>deep</c></n></record>
<record><id>2</id><w/></record></records></root>"""


def test_xml(spark, tmp_path):
    path = write(tmp_path / "a.xml", XML)
    want = [("", "2", "", "", ""), ("7", "1", "own", "b", "")]
    exact = xml_files.scan_xml(spark, path, "root.records.record", exact=True)
    assert records(exact.select("@k", "id", "n", "v", "w")) == want
    loose = xml_files.scan_xml(spark, path, "root.records.record", exact=False)
    assert sorted(r["id"] for r in loose.collect()) == ["1", "2", "stray"]
    for found in (xml_files.scan_xml(spark, path), xml_files.scan_xml(spark, path, "root.records.record")):
        assert records(found.select("@k", "id", "n", "v", "w")) == want
    template = Template.from_dict(STATIONS)
    assert records(xml_files.scan_xml(spark, path, template=template, exact=True).select("@k", "id", "n", "v", "w")) == want
    with pytest.raises(ValueError):
        xml_files.scan_xml(spark, path, "root.nope.record", exact=True)


def test_xml_paths(spark):
    documents = {
        "a": "<r><x/><ys><y/><y/><y/></ys><zs><z/><z/></zs></r>", "b": "<r><x/><y/></r>", "c": "<r/>",
        "d": "<r><p><p><p><p><p><p><p><q/><q/></p></p></p></p></p></p></p></r>", "e": "<n:r xmlns:n='u'><n:i/><n:i/></n:r>",
    }
    df = spark.createDataFrame([(k, v.encode()) for k, v in documents.items()], "path string, content binary")
    got = {r["path"]: (r["record_path"], r["n_children"]) for r in xml_files.detect_xml_record_paths(df).collect()}
    assert got == {"a": ("r.ys.y", 3), "b": ("r.x", 2), "c": ("r.record", 0), "d": ("r" + ".p" * 7 + ".q", 2), "e": ("r.i", 2)}
    offered = {}
    for r in xml_files.xml_path_candidates(df).orderBy("path", "visit_order").collect():
        offered.setdefault(r["path"], []).append(r["record_path"])
    assert offered == {"a": ["r.ys.y", "r.zs.z"], "b": ["r"], "c": ["r"], "d": ["r"], "e": ["r.i"]}


# --- stored tables and exports -----------------------------------------------

def test_stored_by_data_set(spark, make, tmp_path):
    root = str(tmp_path / "raw")
    save_raw(make({"a": ["1", None]}), root, "x/1:=", keep=["row"])
    save_raw(make({"b": ["2"], "c": ["3"]}), root, "007")
    save_raw(make({"b": ["4"], "c": ["5"]}), root, "7")
    assert records(stored.scan_raw(spark, root, "x/1:=")) == [(0, "1"), (1, "")]
    assert records(stored.scan_raw(spark, root, "007").select("b", "c")) == [("2", "3")]
    with pytest.raises(FileNotFoundError):
        stored.scan_raw(spark, root, "nope")


def test_issues_of_the_last_run(spark, make, tmp_path):
    root, df = str(tmp_path / "issues"), make({"A": ["x", "1"], "B": ["y", "z"]})
    for spec in (DatasetSpec.of(C("A", "integer"), C("B", "integer")), DatasetSpec.of(C("A", "integer"))):
        save_issues(all_issues(df, spec), root, "d")
    save_issues(all_issues(df, DatasetSpec.of(C("B", "integer"))), root, "e")
    assert [(r["row"], r["column"]) for r in stored.load_issues(spark, root, "d").collect()] == [(0, "A")]
    assert stored.load_issues(spark, root, "e", ordered=True).select("run_at", "rule_pos").count() == 2


def test_exports(spark, make, tmp_path):
    df = make({"A": ["x", "1", 'q"t,', ""], "B": ["1", "2", "3", " pad "]})
    spec = DatasetSpec.of(C("A", "integer"))
    done = validate(df, spec)
    exports.export_issues_csv(done.ordered_issues, str(tmp_path / "i"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "i").glob("part-*")) if p.stat().st_size)
    assert text.splitlines()[0] == "row,column,code,message"
    assert "0,A,TYPE_MISMATCH,\"Expected integer, got 'x'\"" in text
    exports.export_wrong_rows(df, done.issues, str(tmp_path / "w"))
    read = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "w"))
    assert read.columns == ["A", "B"] and records(read) == [('q"t,', "3"), ("x", "1")]
    exports.export_valid_rows(df, done.issues, str(tmp_path / "v"))
    assert "\n".join(p.read_text() for p in (tmp_path / "v").glob("part-*")).count(" pad ") == 1
    exports.export_annotated(df, done.ordered_issues, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).where("notes IS NOT NULL").count() == 2


def test_normalisation(spark):
    df = spark.createDataFrame([("nan", None, 1.5), ("None ", "<NA>", None)], "` a` string, b string, c double")
    assert records(tables.normalize_raw(tables.to_string_table(df))) == [("", "", "1.5"), ("None ", "", "")]
    assert tables.normalize_raw(df).columns == ["a", "b", "c"]
    profile = tables.dataset_profile(df, ignore=["c"]).first()
    assert (profile["rows"], profile["cols"], profile["columns"]) == (2, 2, [" a", "b"])


def test_stream_equals_batch(spark, make, tmp_path):
    spec = DatasetSpec.of(*[c for c in RUN_SPEC.columns if not c.rules.get("unique")])
    df = make(dirty(300, 4), 6)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    write_issues(stream, spec, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    batch = cell_issues(df, spec)
    assert records(spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))) == records(batch)
    with pytest.raises(ValueError):
        stream_issues(stream, RUN_SPEC)


def test_random_runs_do_not_depend_on_partitions(make):
    for seed in range(2):
        columns = dirty(random.Random(seed).randint(1, 200), seed + 10)
        one, many = (issue_order(all_issues(make(columns, p), RUN_SPEC)).collect() for p in (1, 9))
        assert one == many


def test_dialects_of_a_table_whose_first_split_has_no_rows(spark, tmp_path):
    """A writer leaves a header for an empty first partition: it was listed as a file in UTF-8 of a Latin-1 segment."""
    rows = [(i, f"Customer#{i}", i % 7, i / 4, s) for i, s in enumerate([*table_queries.SEPARATORS] * 300)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(
        1).write.parquet(str(tmp_path / "customer.parquet"))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = [spark.conf.get(n) for n in names]
    try:
        for name, value in zip(names, ("1000", "0")):
            spark.conf.set(name, value)
        got = table_queries.dialects(spark, str(tmp_path)).collect()
    finally:
        for name, value in zip(names, kept):
            spark.conf.set(name, value)
    shown = {"\t": "tab"}
    assert sorted(map(tuple, got)) == sorted(
        (s, "latin-1" if s == "MACHINERY" else "utf-8", shown.get(sep, sep)) for s, sep in table_queries.SEPARATORS.items())


def test_exported_files_are_bounded(make, tmp_path, monkeypatch):
    """A partition was one file, which readers of cells with line breaks take in one task."""
    monkeypatch.setattr(exports, "CELLS_PER_FILE", 200, raising=False)
    issues = validate(make({"A": ["x"] * 333}), DatasetSpec.of(C("A", "integer"))).ordered_issues
    exports.export_issues_csv(issues, str(tmp_path / "i"))
    files = [p.read_text().splitlines() for p in sorted((tmp_path / "i").glob("part-*"))]
    assert max(map(len, files)) <= 51 and {f[0] for f in files} == {"row,column,code,message"}
    assert [int(line.split(",")[0]) for f in files for line in f[1:]] == list(range(333))
