"""A whole validation run: cell pass, keyed rules and dataset checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve import codes
from cellsieve.plans.cells import ISSUE_COLUMNS, ORDER_COLUMNS, ROW, cell_issues, table_columns
from cellsieve.plans.keys import key_issues, key_rules
from cellsieve.scratch import write_table
from cellsieve.spec import DatasetSpec


def union_issues(*parts: DataFrame) -> DataFrame:
    """Cell, unique and composite issues as one relation."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def all_issues(df: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str] = ROW) -> DataFrame:
    """Every cell-level issue of a batch table."""
    if df.isStreaming:
        raise ValueError("a whole run needs a batch table; cell_issues also takes streams")
    singles, composites = key_rules(df, spec, row_key)
    cells = cell_issues(df, spec, row_key)
    if not singles and not composites:
        return cells
    return union_issues(cells, key_issues(df, spec, row_key))


def issue_order(issues: DataFrame) -> DataFrame:
    """Issues in emission order.

    Cell and uniqueness issues come by column, row and rule; composite rules
    follow by rule, row and column.
    """
    return issues.orderBy(
        "phase",
        "rule_id",
        F.when(F.col("phase") == 0, F.col("col_pos")).otherwise(F.lit(0)),
        ROW,
        "rule_pos",
    )


def missing_columns(columns: Sequence[str], spec: DatasetSpec) -> list[tuple[str, str, str]]:
    """Required, validated columns the table does not have."""
    return [
        (codes.MISSING_COLUMN, c.name, f"Required column '{c.name}' is missing from the file")
        for c in spec.columns
        if c.required and not c.unvalidated and c.name not in columns
    ]


def extra_columns(columns: Sequence[str], spec: DatasetSpec) -> list[tuple[str, str, str]]:
    """In strict mode, table columns the specification does not validate."""
    if not spec.strict:
        return []
    known = {c.name for c in spec.columns if not c.unvalidated}
    return [
        (codes.EXTRA_COLUMN, c, f"Unexpected column '{c}' (strict mode)")
        for c in columns
        if c not in known
    ]


def dataset_issues(
    df: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """``code, column, message`` of the checks on the header alone."""
    names = table_columns(df, row_key)
    rows = missing_columns(names, spec) + extra_columns(names, spec)
    return df.sparkSession.createDataFrame(rows, "code string, column string, message string")


@dataclass(frozen=True)
class Validation:
    """Relations of one run; all of them are lazy plans."""

    table: DataFrame
    spec: DatasetSpec
    row_key: str | tuple[str, ...]
    ordered_issues: DataFrame

    @property
    def issues(self) -> DataFrame:
        """``row, column, code, message``."""
        return self.ordered_issues.select(*ISSUE_COLUMNS)

    @property
    def dataset_issues(self) -> DataFrame:
        return dataset_issues(self.table, self.spec, self.row_key)

    @property
    def column_summary(self) -> DataFrame:
        from cellsieve.operators import summary

        singles, composites = key_rules(self.table, self.spec, self.row_key)
        if not singles and not composites:
            return summary.one_pass_summary(self.table, self.spec, self.row_key)
        return summary.column_summary(self.table, self.ordered_issues, self.spec, self.row_key)

    @property
    def stats(self) -> DataFrame:
        from cellsieve.operators import summary

        return summary.dataset_stats(self.table, self.ordered_issues, self.row_key)

    def store(self, path: str | None = None) -> "Validation":
        """Write the issues once; summaries, views and exports then read them back."""
        written = write_table(self.ordered_issues, "issues", path)
        return Validation(self.table, self.spec, self.row_key, written)


def validate(
    df: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str] = ROW
) -> Validation:
    """Validate a table whose rows are identified and ordered by *row_key*."""
    key = row_key if isinstance(row_key, str) else tuple(row_key)
    return Validation(df, spec, key, all_issues(df, spec, row_key))


__all__ = [
    "ORDER_COLUMNS",
    "Validation",
    "all_issues",
    "dataset_issues",
    "extra_columns",
    "issue_order",
    "missing_columns",
    "union_issues",
    "validate",
]
