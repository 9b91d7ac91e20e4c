import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from cellsieve.sources import csv_files
from cellsieve.sources.csv_records import csv_records


def by_reader(text, delimiter):
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if any(c.strip() for c in r)]


@pytest.fixture
def small_splits(spark):
    """Many splits a file."""
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed,delimiter", [(1, ","), (2, ";"), (3, "|")])
def test_records_of_many_splits_equal_the_reader(spark, tmp_path, small_splits, seed, delimiter):
    rng = random.Random(seed)
    pieces = ["a", "bc", '""', "\n", "\n\n", delimiter, " ", "é"]

    def cell():
        if rng.random() < 0.5:
            return '"' + "".join(rng.choices(pieces, k=rng.randint(0, 12))) + '"'
        # quotes inside of a cell without quotes around it are text
        return "".join(rng.choices(["a", "b ", 'c"d', 'e""f'], k=rng.randint(1, 4)))

    text = "".join(delimiter.join(cell() for _ in range(4)) + "\n" * rng.randint(1, 2) for _ in range(500))
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode())
    got = csv_records(spark, [str(path)], delimiter, "UTF-8")
    assert got.select("start").distinct().count() > 20
    rows = [csv_files._cells(r["record"], delimiter) for r in got.orderBy("start", "line").collect()]
    assert [r for r in rows if any(c.strip() for c in r)] == by_reader(text, delimiter)


def test_scan_of_many_splits(spark, tmp_path, small_splits):
    rng = random.Random(4)
    for name, encoding in (("a", "utf-8"), ("b", "latin-1")):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding=encoding) as f:
            out = csv.writer(f, delimiter=";", lineterminator="\n")
            out.writerow(["id", "te\nxt", "n"])
            for i in range(300):
                out.writerow([f"{name}{i}", "".join(rng.choices("ab\n;\"é", k=rng.randint(1, 40))) + "é", i])
    df = csv_files.scan_csv(spark, str(tmp_path), delimiter=";")
    assert df.columns == ["id", "te\nxt", "n"] and df.count() == 600
    got = {tuple(r) for r in df.collect()}
    for name, encoding in (("a", "utf-8"), ("b", "latin-1")):
        with open(tmp_path / f"{name}.csv", newline="", encoding=encoding) as f:
            for row in list(csv.reader(f, delimiter=";"))[1:]:
                assert tuple(row) in got


def test_headers_of_any_length(spark, tmp_path):
    long_cell = "\n".join(f"line {i}" for i in range(90))
    (tmp_path / "a.csv").write_text(f'id,"{long_cell}"\n1,x\n2,"y\nz"\n')
    df = csv_files.scan_csv(spark, str(tmp_path / "a.csv"), ",", "utf-8")
    assert df.columns == ["id", long_cell] and {tuple(r) for r in df.collect()} == {("1", "x"), ("2", "y\nz")}
    above = "".join(f'"note {i}\nsecond\n\nlast",\n' for i in range(40))
    (tmp_path / "b.csv").write_text(above + "id,name\n1,x\n")
    deep = csv_files.scan_csv(spark, str(tmp_path / "b.csv"), ",", "utf-8", header_row=40)
    assert [r.asDict() for r in deep.collect()] == [{"id": "1", "name": "x"}]
    with pytest.raises(ValueError, match="no header"):
        csv_files.scan_csv(spark, str(tmp_path / "b.csv"), ",", "utf-8", header_row=60)
