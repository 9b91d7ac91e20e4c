"""Large JSON documents are cut into records by all their splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cellsieve.sources import json_files
from cellsieve.sources.json_records import json_records


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    size, cost = spark.conf.get(name), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(name, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    spark.conf.set(name, size)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


def value(rng, depth=0):
    text = "".join(rng.choice('ab"\\{}[],: é中\n') for _ in range(rng.randrange(12)))
    kinds = [text, rng.randrange(1000), None, True]
    if depth < 3:
        kinds += [{k: value(rng, depth + 1) for k in rng.sample(["data", "rows", "p", "q}"], 2)}] * 2
        kinds.append([value(rng, depth + 1) for _ in range(rng.randrange(4))])
    return rng.choice(kinds)


def objects(rng, n):
    return [{"id": i, **{k: value(rng) for k in rng.sample(["data", "x", "y{", "z]"], rng.randrange(4))}} for i in range(n)]


def cut(spark, tmp_path, document, indent=None, end=""):
    path = tmp_path / "a.json"
    path.write_text(json.dumps(document, indent=indent, ensure_ascii=False) + end, encoding="utf-8")
    told, records = json_records(spark, [str(path)], json_files.WRAPPER_KEYS)
    file = told.first()
    ordered = records.sort("path", "start", "line").collect() if file["apart"] else []
    found = [json.loads(r["record"]) for r in ordered]
    return file["layout"], file["apart"], found


@pytest.mark.parametrize("seed,indent,end", [(0, None, ""), (1, 2, "\n"), (2, None, " \n\n")])
def test_records_of_all_layouts(spark, small_splits, tmp_path, seed, indent, end):
    rng = random.Random(seed)
    held, other = objects(rng, 60), objects(rng, 8)
    assert cut(spark, tmp_path, held, indent, end) == (None, True, held)
    meta = {"data": {"rows": other}, "q}data": [1, [[2], {"k": 1}]]}
    document = {"meta": meta, "values": other, "n}": [[[1]]], "s": 'x "items": [{', "records": held, "items": [], "z": {"data": other}}
    assert cut(spark, tmp_path, document, indent, end) == ("records", True, held)


@pytest.mark.parametrize("document,layout", [
    ({"a": {"data": [{"k": 1}] * 200}, "b": 1}, None),
    ({"data": [f"}}{i}" for i in range(200)]}, "data"),
    ({"data": [{"k": 1}] * 100 + [5] + [{"k": 2}] * 50}, "data"),
    ({"data": [5] + [{"k": 1}] * 100}, "data"),
    ({"data": [{"k": 1}] * 100 + ["end"]}, "data"),
    ([[{"k": 1}]] * 100, None),
    ({"data": [], "x": [{"k": 1}] * 200}, "data"),
])
def test_documents_left_to_one_task(spark, small_splits, tmp_path, document, layout):
    assert cut(spark, tmp_path, document)[:2] == (layout, False)


def test_broken_documents_are_not_cut(spark, small_splits, tmp_path):
    whole = json.dumps([{"id": i, "v": "x" * 20} for i in range(100)])
    for text in (whole[:-1], whole[:-30], whole.replace('"v": "', '"v": ', 1)):
        path = tmp_path / "b.json"
        path.write_text(text)
        told, _ = json_records(spark, [str(path)], json_files.WRAPPER_KEYS)
        assert not told.first()["apart"]


def test_scan_cuts_large_documents(spark, small_splits, tmp_path):
    """Rows come in the order of the document, from several tasks, together with small documents of other layouts."""
    (tmp_path / "in dir").mkdir()
    rows = [{"id": i, "t": {"k": [i]}, "on": i % 2 == 0, "s": "two\nlines"} for i in range(300)]
    (tmp_path / "in dir" / "a.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "in dir" / "b.json").write_text(json.dumps({"n": 1, "rows": [{"id": 1000 + i} for i in range(300)]}))
    (tmp_path / "in dir" / "c.json").write_text('{"id": 7.50}')
    got = json_files.scan_json(spark, str(tmp_path / "in dir"), columns=["id", "on", "s", "t"]).collect()
    a = [tuple(r) for r in got if r["id"].isdigit() and int(r["id"]) < 1000]
    assert a == [(str(i), str(i % 2 == 0), "two\nlines", f'{{"k":["{i}"]}}') for i in range(300)]
    assert sorted(r["id"] for r in got if r["on"] == "") == sorted([str(1000 + i) for i in range(300)] + ["7.50"])
    parts = json_files.scan_json(spark, str(tmp_path / "in dir" / "a.json")).select(F.spark_partition_id()).distinct().count()
    assert parts > 1
    schema = spark.createDataFrame([], "n long, rows array<struct<id: long>>").schema
    assert json_files.scan_json(spark, str(tmp_path / "in dir" / "b.json"), schema=schema).count() == 300


def test_documents_of_numbers_are_read_about_once(spark, tmp_path):
    """The multi-line reader opened the file again for every number read as text."""
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"data": [{"id": i, "x": i / 8, "on": i % 2 == 0, "of": {"k": [i]}} for i in range(3000)]}))
    files = spark._jvm.org.apache.hadoop.fs.FileSystem
    read = lambda: files.getGlobalStorageStatistics().get("file").getLong("bytesRead")
    before = read()
    got = json_files.scan_json(spark, str(path), columns=["id", "x", "on", "of"]).collect()
    assert read() - before < 20 * path.stat().st_size
    assert len(got) == 3000 and tuple(got[9]) == ("9", "1.125", "False", '{"k":["9"]}')
