"""Exports of issues and row sets; every writer runs distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.operators.views import annotate_rows, rows_correct, rows_wrong
from cellsieve.plans.cells import ISSUE_COLUMNS, ROW, row_column
from cellsieve.plans.validate import issue_order


# A file holds so many cells: a reader of cells with line breaks takes a file in one task.
CELLS_PER_FILE = 2_000_000


def _write_csv(df: DataFrame, path: str) -> None:
    writer = df.write.mode("error").option("header", True).option("escape", '"')
    # A partition goes on in further files, whose names follow its order.
    writer = writer.option("maxRecordsPerFile", max(1, CELLS_PER_FILE // max(1, len(df.columns))))
    # Empty texts are written as nothing; blanks around a value belong to it.
    writer = writer.option("emptyValue", "").option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)


def export_issues_csv(issues: DataFrame, path: str) -> None:
    """``row,column,code,message`` in emission order, header included."""
    _write_csv(issue_order(issues).select(F.col(ROW).cast("string"), *ISSUE_COLUMNS[1:]), path)


def export_wrong_rows(
    df: DataFrame, issues: DataFrame, path: str, row_key: str | Sequence[str] = ROW
) -> None:
    """Rows with an issue, in row order, with the table's own columns."""
    _write_csv(_data(rows_wrong(df, issues, row_key), row_key), path)


def export_valid_rows(
    df: DataFrame, issues: DataFrame, path: str, row_key: str | Sequence[str] = ROW
) -> None:
    """Rows without issues, in row order."""
    _write_csv(_data(rows_correct(df, issues, row_key), row_key), path)


def _data(rows: DataFrame, row_key: str | Sequence[str]) -> DataFrame:
    ordered = rows.orderBy(row_column(row_key))
    return ordered.drop(row_key) if isinstance(row_key, str) and row_key == ROW else ordered


def export_annotated(
    df: DataFrame, issues: DataFrame, path: str, row_key: str | Sequence[str] = ROW
) -> None:
    """Every row with the notes of its invalid cells, as Parquet."""
    annotate_rows(df, issues, row_key).write.mode("error").parquet(path)
