"""Column type inference from the first values of each column.

The sample is the first non-null values in row order. Sorting the whole table
for it would be wasteful, so rows are first counted in row ranges that double
in length; only cells in the ranges that can hold the sample are then ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve.functions import dates, numbers
from cellsieve.functions.text import is_null_token, py_strip
from cellsieve.plans.cells import ROW, open_cells, table_columns

# Thresholds and sizes of the inference.
THRESHOLD = 0.95
SAMPLE = 500
ENUM_MAX_UNIQUE = 20
ENUM_MAX_RATIO = 0.10
ENUM_SMALL_SAMPLE = 100
HEAD_ROWS = 1 << 16  # rows tried before the whole table is counted
# Formats tried, in this order.
DATETIME_FORMATS = (
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M",
    "%d/%m/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M",
    "%d.%m.%Y %H:%M:%S",
    "%d.%m.%Y %H:%M",
    "%m/%d/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M",
)
DATE_FORMATS = ("%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%d-%m-%Y", "%Y/%m/%d")


def non_null_values(df: DataFrame, row_key: str | Sequence[str] = ROW) -> DataFrame:
    """``row, pos, column, value`` of every cell that is not a null token."""
    names = table_columns(df, row_key)
    cells = open_cells(df, names, row_key).select(
        ROW, "pos", py_strip(F.col("raw")).alias("value")
    )
    return cells.where(~is_null_token(F.col("value"))).select(
        ROW, "pos", F.get(F.array(*[F.lit(c) for c in names]), F.col("pos")).alias("column"), "value"
    )


def inference_sample(
    df: DataFrame, row_key: str | Sequence[str] = ROW, n: int = SAMPLE
) -> DataFrame:
    """``row, pos, column, value``: the first *n* non-null values per column."""
    if df.isStreaming:
        raise ValueError("inference needs a batch table")
    names = table_columns(df, row_key)
    cells = non_null_values(df, row_key)
    integral = isinstance(row_key, str) and isinstance(
        df.schema[row_key].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    )
    if integral:
        cells = _leading_cells(df, cells, row_key, len(names), n)
    # Tasks keep their first n cells per column before anything is exchanged.
    ranked = cells.withColumn(
        "_rank", F.row_number().over(Window.partitionBy("pos").orderBy(ROW))
    )
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def _leading_cells(
    df: DataFrame, cells: DataFrame, row_key: str, width: int, n: int
) -> DataFrame:
    """Cells up to the row range in which each column's sample is complete.

    Range k holds the rows whose distance from the first row has k bits, so a
    table of any length has at most 64 of them. The counts - one per column and
    range - decide at plan time how far each column is read. The head of the
    table is tried first; only columns that are sparse there need all counts.
    """
    key = F.col(f"`{row_key}`")
    first = df.agg(F.min(key)).first()[0]
    if first is None:
        return cells
    head = df.where(key < F.lit(first + HEAD_ROWS))
    reach = _reach(non_null_values(head, row_key), first, width, n)
    if reach is None:
        reach = _reach(cells, first, width, n, partial=True)
    limit = F.get(F.array(*[F.lit(r).cast("bigint") for r in reach]), F.col("pos"))
    # The plain bound on the key reaches the scan and skips row groups.
    leading = df.where(key <= F.lit(max(reach)))
    return non_null_values(leading, row_key).where(F.col(ROW) <= limit)


def _reach(
    cells: DataFrame, first: int, width: int, n: int, partial: bool = False
) -> list[int] | None:
    """Last row to read per column, or None when a column's sample is incomplete."""
    span = F.length(F.bin(F.col(ROW).cast("bigint") - F.lit(first))).alias("span")
    counts: dict[int, list[tuple[int, int]]] = {}
    for r in cells.groupBy("pos", span).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["pos"], []).append((r["span"], r["n"]))
    reach = []
    for pos in range(width):
        total, last = 0, 0
        for last, found in sorted(counts.get(pos, [])):
            total += found
            if total >= n:
                break
        if total < n and not partial:
            return None
        reach.append(first + (1 << last) - 1)
    return reach


def match_rate(test: Column) -> Column:
    """Share of values that pass *test*, 0.0 for no values."""
    return F.coalesce(F.avg(test.cast("double")), F.lit(0.0))


def type_rates(sample: DataFrame) -> DataFrame:
    """Per column: sample size, distinct values and one rate per type and format."""
    value = F.col("value")
    rates = [
        match_rate(numbers.is_integer(value)).alias("integer"),
        match_rate(numbers.number_value(value).isNotNull()).alias("number"),
        match_rate(numbers.looks_boolean(value)).alias("boolean"),
    ]
    for fmt in DATETIME_FORMATS + DATE_FORMATS:
        rates.append(match_rate(dates.strptime(value, fmt).isNotNull()).alias(fmt))
    return sample.groupBy("pos", "column").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("value")).alias("values"), *rates
    )


def enum_candidates(sample: DataFrame) -> DataFrame:
    """Per column: sample size, number of distinct values and the values, sorted."""
    return sample.groupBy("pos", "column").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set("value")).alias("values")
    ).select("pos", "column", "n", F.size("values").alias("n_unique"), "values")


def infer_column_types(
    df: DataFrame, row_key: str | Sequence[str] = ROW, n: int = SAMPLE
) -> DataFrame:
    """``column, pos, type, formats, allowed`` for every column of the table."""
    names = table_columns(df, row_key)
    rates = type_rates(inference_sample(df, row_key, n))
    formats = {f: F.col(f"`{f}`") >= THRESHOLD for f in DATETIME_FORMATS + DATE_FORMATS}

    def first_format(options) -> Column:
        return F.coalesce(*[F.when(formats[f], F.lit(f)) for f in options])

    unique = F.size("values")
    is_enum = (unique <= ENUM_MAX_UNIQUE) & (
        (F.col("n") <= ENUM_SMALL_SAMPLE) | (unique / F.col("n") <= ENUM_MAX_RATIO)
    )
    moment, day = first_format(DATETIME_FORMATS), first_format(DATE_FORMATS)
    kind = (
        F.when(F.col("integer") >= THRESHOLD, F.lit("integer"))
        .when(F.col("number") >= THRESHOLD, F.lit("number"))
        .when(moment.isNotNull(), F.lit("datetime"))
        .when(day.isNotNull(), F.lit("date"))
        .when(F.col("boolean") >= THRESHOLD, F.lit("boolean"))
        .when(is_enum, F.lit("enum"))
        .otherwise(F.lit("string"))
    )
    typed = rates.select("pos", "column", kind.alias("type"), moment.alias("m"), day.alias("d"), "values")
    found = typed.select(
        "column",
        "pos",
        "type",
        F.when(F.col("type") == "datetime", F.array("m"))
        .when(F.col("type") == "date", F.array("d"))
        .alias("formats"),
        F.when(F.col("type") == "enum", F.col("values")).alias("allowed"),
    )
    # Columns without any value have no sample row and are plain text.
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "pos int, column string")
    blank = listed.join(found.select("pos"), "pos", "left_anti").select(
        "column",
        "pos",
        F.lit("string").alias("type"),
        F.lit(None).cast("array<string>").alias("formats"),
        F.lit(None).cast("array<string>").alias("allowed"),
    )
    return found.unionByName(blank)
