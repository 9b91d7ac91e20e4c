"""Benchmark: validation of lineitem and orders as stored all-string tables.

Prints one JSON line. Tables are first written as text, split like a table of
many files, because that is what a validation run reads; writing them is not
timed. Every timing is the best of ``BENCH_RUNS`` runs in one warm session.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cellsieve import ColumnSpec, DatasetSpec, cell_issues, validate  # noqa: E402
from cellsieve.operators import infer, summary, views  # noqa: E402
from cellsieve.plans.keys import key_issues  # noqa: E402
from cellsieve.plans.rowid import row_index  # noqa: E402
from cellsieve.sources.csv_files import scan_csv  # noqa: E402
from suite.dirty import ORDERS_SPEC, dirty_orders  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

LINE_COLUMNS = (
    ColumnSpec("l_orderkey", "integer", True, False, {"min": 0, "max": 149000}),
    ColumnSpec("l_partkey", "integer", rules={"min": 0}),
    ColumnSpec("l_suppkey", "integer", rules={"min": 0, "max": 995}),
    ColumnSpec("l_linenumber", "integer", rules={"min": 1, "max": 7}),
    ColumnSpec("l_quantity", "number", rules={"min": 1, "max": 49}),
    ColumnSpec("l_extendedprice", "number", rules={"min": 1000}),
    ColumnSpec("l_discount", "number", rules={"min": 0, "max": 0.1}),
    ColumnSpec("l_tax", "number", rules={"max": 0.08}),
    ColumnSpec("l_returnflag", "enum", rules={"allowed": ["A", "N", "R"]}),
    ColumnSpec("l_linestatus", "string", rules={"regex": "[OF]", "max_len": 1}),
    ColumnSpec("l_shipdate", "datetime", rules={"formats": ["%Y-%m-%d %H:%M:%S"], "min_date": "1995-02-01"}),
)
LINES = DatasetSpec.of(*LINE_COLUMNS)
PATTERNED = DatasetSpec.of(
    ColumnSpec("priority", rules={"regex": r"(?i)\d-[\w ]+"}), ColumnSpec("order_date", "date", rules={"formats": ["%Y-%m-%d"]}))
KEYED = DatasetSpec.of(*LINE_COLUMNS, unique_together=[("l_orderkey", "l_linenumber")])


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def stored_text(spark: SparkSession, df, path: str):
    df.repartition(CPUS).write.parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    spark = session()
    work = tempfile.mkdtemp(prefix="bench-")
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    # The position in the file identifies a row; it is stored with the text.
    numbered = lineitem.select(
        F.monotonically_increasing_id().alias("row"),
        *[F.col(c).cast("string").alias(c) for c in lineitem.columns],
    )
    lines = stored_text(spark, numbered, f"{work}/lines")
    orders = stored_text(spark, dirty_orders(spark, SF_DIR), f"{work}/orders")
    n = lines.count()
    text = f"{work}/orders-csv"
    orders.repartition(CPUS).write.option("header", True).csv(text)

    def consume(df):
        df.write.format("noop").mode("overwrite").save()

    queries = {
        "cell_issues": lambda: consume(cell_issues(lines, LINES)),
        "one_pass_summary": lambda: summary.one_pass_summary(lines, LINES).collect(),
        "unique_together": lambda: consume(key_issues(lines, KEYED)),
        "validate_keyed": lambda: consume(validate(lines, KEYED).issues),
        "validate_and_stats": lambda: validate(lines, KEYED).store().stats.collect(),
        "infer_column_types": lambda: infer.infer_column_types(lines).collect(),
        "rows_wrong": lambda: consume(views.rows_wrong(lines, cell_issues(lines, LINES))),
        "annotate_rows": lambda: consume(views.annotate_rows(lines, cell_issues(lines, LINES))),
        "dirty_orders_validate": lambda: consume(validate(orders, ORDERS_SPEC, "row_key").issues),
        "dirty_orders_summary": lambda: summary.column_invalid_counts(
            orders, validate(orders, ORDERS_SPEC, "row_key").ordered_issues, "row_key"
        ).collect(),
        "flagged_pattern": lambda: consume(cell_issues(orders, PATTERNED, "row_key")),
        "row_index": lambda: consume(row_index(lines.drop("row"))),
        "scan_csv": lambda: consume(scan_csv(spark, text)),
    }
    seconds = {}
    for name, run in queries.items():
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            run()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "validation_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
                "rows": n,
                "cells_per_second": round(n * len(LINE_COLUMNS) / seconds["cell_issues"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
