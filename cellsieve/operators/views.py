"""Row sets, cell views and pages over a table and its issues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.functions.text import safe_str
from cellsieve.operators.summary import cell_counts
from cellsieve.plans.cells import ROW, row_column, table_columns

MODES = ("all", "wrong_rows", "correct_rows")  # Fixed values: view modes.
DEFAULT_PAGE, MAX_PAGE = 100, 200  # Fixed values: page sizes.
PREVIEW_ROWS = 10  # Fixed value: rows of a preview.

_MARK = "_row"


def _keyed(df: DataFrame, row_key: str | Sequence[str]) -> DataFrame:
    return df.withColumn(_MARK, row_column(row_key))


def _semi(df: DataFrame, rows: DataFrame, row_key, how: str) -> DataFrame:
    # A row's issues lie in one task, so most repeats go before the exchange that
    # the join needs anyway.
    found = rows.select(F.col(ROW).alias(_MARK)).distinct()
    return _keyed(df, row_key).join(found, _MARK, how).drop(_MARK)


def rows_wrong(df: DataFrame, issues: DataFrame, row_key: str | Sequence[str] = ROW) -> DataFrame:
    """Rows with at least one issue."""
    return _semi(df, issues, row_key, "left_semi")


def rows_correct(df: DataFrame, issues: DataFrame, row_key: str | Sequence[str] = ROW) -> DataFrame:
    """Rows without any issue."""
    return _semi(df, issues, row_key, "left_anti")


def rows_with_code(
    df: DataFrame, issues: DataFrame, code: str, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """Rows with an issue of the given code."""
    return _semi(df, issues.where(F.col("code") == code), row_key, "left_semi")


def filter_rows(
    df: DataFrame,
    issues: DataFrame,
    mode: str = "all",
    code: str | None = None,
    row_key: str | Sequence[str] = ROW,
) -> DataFrame:
    """View mode and code filter together; both have to hold.

    A row with an issue of the code is wrong already, so one join is enough, and no correct row has one.
    """
    if code:
        return df.where(F.lit(False)) if mode == "correct_rows" else rows_with_code(df, issues, code, row_key)
    if mode == "wrong_rows":
        return rows_wrong(df, issues, row_key)
    return rows_correct(df, issues, row_key) if mode == "correct_rows" else df


def filtered_row_count(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("total"))


def select_invalid_columns(
    df: DataFrame, issues: DataFrame, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """Key and the columns with an invalid cell; every column when there is none.

    The projection has to be known at plan time, so the positions of invalid
    columns - one number per column at most - are fetched here.
    """
    names = table_columns(df, row_key)
    hit = {r["pos"] for r in issues.select(F.col("col_pos").alias("pos")).distinct().collect()}
    shown = [c for i, c in enumerate(names) if i in hit] or names
    keys = [row_key] if isinstance(row_key, str) else [k for k in row_key if k not in shown]
    return df.select(*[f"`{c}`" for c in [*keys, *shown]])


def errors_by_row(issues: DataFrame) -> DataFrame:
    """``row, errors`` with the first issue of every invalid cell of the row.

    One exchange on the row brings a row's issues together; their number is
    bounded by the specification (columns times rules), not by the data.
    """
    listed = F.array_sort(
        F.collect_list(F.struct("col_pos", "phase", "rule_id", "rule_pos", "column", "code", "message"))
    )
    grouped = issues.groupBy(ROW).agg(listed.alias("found"))
    first = F.filter(
        "found",
        lambda x, i: (i == 0) | (F.get(F.col("found"), i - 1)["col_pos"] != x["col_pos"]),
    )
    return grouped.select(ROW, first.alias("errors"))


def first_issue_per_cell(issues: DataFrame) -> DataFrame:
    """``row, column, code, message``: the first issue of each invalid cell."""
    return errors_by_row(issues).select(ROW, F.inline("errors")).select(ROW, "column", "code", "message")


def issues_map(issues: DataFrame) -> DataFrame:
    """``row, errors`` as a map from column to code and message."""
    entries = F.transform(
        "errors",
        lambda x: F.struct(x["column"], F.struct(x["code"].alias("code"), x["message"].alias("message"))),
    )
    return errors_by_row(issues).select(ROW, F.map_from_entries(entries).alias("errors"))


def annotate_rows(
    df: DataFrame, issues: DataFrame, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """Every row with ``notes``: column -> ``code: message`` of its first issue."""
    notes = errors_by_row(issues).select(
        F.col(ROW).alias(_MARK),
        F.map_from_entries(
            F.transform(
                "errors",
                lambda x: F.struct(x["column"], F.concat(x["code"], F.lit(": "), x["message"])),
            )
        ).alias("notes"),
    )
    return _keyed(df, row_key).join(notes, _MARK, "left").drop(_MARK)


def cells_with_errors(
    df: DataFrame, issues: DataFrame, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """``row, pos, column, v, i, c, m`` for every cell.

    Rows meet their issues once and are opened into cells afterwards, so the
    join moves rows, not cells.
    """
    names = table_columns(df, row_key)
    found = errors_by_row(issues).select(F.col(ROW).alias(_MARK), "errors")
    joined = _keyed(df, row_key).join(found, _MARK, "left")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), safe_str(F.col(f"`{c}`")).alias("v")) for c in names])
    opened = joined.select(
        F.col(_MARK).alias(ROW), "errors", F.posexplode(cells).alias("pos", "cell")
    )
    hit = F.get(F.filter("errors", lambda x: x["col_pos"] == F.col("pos")), F.lit(0))
    return opened.select(ROW, "pos", "cell.column", "cell.v", hit.alias("hit")).select(
        ROW,
        "pos",
        "column",
        "v",
        F.col("hit").isNotNull().alias("i"),
        F.col("hit.code").alias("c"),
        F.col("hit.message").alias("m"),
    )


def page(
    view: DataFrame,
    offset: int = 0,
    limit: int = DEFAULT_PAGE,
    row_key: str | Sequence[str] = ROW,
    after: object = None,
) -> DataFrame:
    """One page of a view in row order; sizes outside 1..200 are clamped.

    *after*, the last row of the previous page, takes the place of an offset deep
    into a large view: skipped rows are then filtered by the scan, not sorted.
    """
    offset, limit = max(0, offset), min(MAX_PAGE, max(1, limit))
    row = row_column(row_key)
    if after is not None:
        return view.where(row > F.lit(after)).orderBy(row).limit(limit)
    return view.orderBy(row).offset(offset).limit(limit)


def display_index(
    view: DataFrame,
    offset: int = 0,
    limit: int = DEFAULT_PAGE,
    row_key: str | Sequence[str] = ROW,
    after=None,
) -> DataFrame:
    """A page with ``idx``, the 1-based position within the view.

    Deep pages take ``after=<last row>`` and the *offset* of the page, that is the ``idx`` of that row; then no rows
    before the page are sorted.
    """
    # The window only ever sees the rows of one page.
    number = F.row_number().over(Window.orderBy(row_column(row_key)))
    shown = page(view, offset, limit, row_key, after=after)
    return shown.withColumn("idx", number + max(0, offset))


def preview(df: DataFrame, row_key: str | Sequence[str] = ROW, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of a table."""
    return df.orderBy(row_column(row_key)).limit(n)
