"""Counts and statistics of a validation run.

Everything here reduces to at most one row per column or code. Partial results
are brought together by union and aggregation, never by a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsieve.plans import keys
from cellsieve.plans.cells import (
    ROW,
    plan_columns,
    spec_cells,
    statistics_value,
    table_columns,
)
from cellsieve.spec import DatasetSpec

TOP_CODES = 5  # Fixed value: length of the most-frequent-codes report.


def columns_by_row(issues: DataFrame) -> DataFrame:
    """Per invalid row, the positions of its invalid columns.

    One exchange of (row, position) pairs serves the cell, row and column
    counts; a row holds at most as many positions as the table has columns.
    """
    return issues.groupBy(ROW).agg(F.collect_set("col_pos").alias("cols"))


def cell_counts(issues: DataFrame) -> DataFrame:
    """``pos, n``: invalid rows per column; position -1 counts invalid rows."""
    return (
        columns_by_row(issues)
        .select(F.explode(F.concat(F.col("cols"), F.array(F.lit(-1)))).alias("pos"))
        .groupBy("pos")
        .agg(F.count("*").alias("n"))
    )


def column_invalid_counts(
    df: DataFrame, issues: DataFrame, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """``column, pos, invalid_count, total`` for every table column, zeros included."""
    names = table_columns(df, row_key)
    listed = F.array(
        *[F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos")) for i, c in enumerate(names)]
    )
    totals = (
        df.agg(F.count("*").alias("total"))
        .select(F.inline(listed), "total")
        .withColumn("invalid_count", F.lit(0).cast("bigint"))
    )
    found = (
        cell_counts(issues)
        .where("pos >= 0")
        .select(
            F.element_at(F.array(*[F.lit(c) for c in names]), F.col("pos") + 1).alias("column"),
            "pos",
            F.lit(0).cast("bigint").alias("total"),
            F.col("n").alias("invalid_count"),
        )
    )
    return (
        totals.unionByName(found)
        .groupBy("column", "pos")
        .agg(F.sum("invalid_count").alias("invalid_count"), F.sum("total").alias("total"))
    )


def invalid_count_by_col(counts: DataFrame) -> DataFrame:
    """Columns with at least one invalid row."""
    return counts.where("invalid_count > 0").select("column", "invalid_count")


def worst_column(counts: DataFrame) -> DataFrame:
    """Column with most invalid rows, the first in table order on ties, else null."""
    best = F.max_by("column", F.struct(F.col("invalid_count"), -F.col("pos")))
    return counts.agg(F.when(F.max("invalid_count") > 0, best).alias("worst_column"))


def code_counts(issues: DataFrame) -> DataFrame:
    """Issues per code."""
    return issues.groupBy("code").agg(F.count("*").alias("count"))


def distinct_codes(issues: DataFrame) -> DataFrame:
    return issues.select("code").distinct().orderBy("code")


def code_order(issues: DataFrame) -> DataFrame:
    """``code, count, first_seen`` where *first_seen* is the emission position.

    The first aggregation only keeps numbers, so it stays a hash aggregation
    with map-side combine; its result has one row per column and rule.
    """
    slots = issues.groupBy("code", "phase", "rule_id", "col_pos", "rule_pos").agg(
        F.count("*").alias("n"), F.min(ROW).alias("first_row")
    )
    position = F.struct("phase", "rule_id", "col_pos", "first_row", "rule_pos")
    return slots.groupBy("code").agg(
        F.sum("n").alias("count"), F.min(position).alias("first_seen")
    )


def top_issue_codes(issues: DataFrame, n: int = TOP_CODES) -> DataFrame:
    """The most frequent codes; ties keep the order of first appearance."""
    return (
        code_order(issues)
        .orderBy(F.desc("count"), F.asc("first_seen"))
        .limit(n)
        .select("code", "count")
    )


def dataset_stats(
    df: DataFrame, issues: DataFrame, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """One row: table size, invalid cells, rows and columns, worst column, top codes."""
    names = table_columns(df, row_key)
    width = len(names)
    size = df.agg(F.count("*").alias("rows"))
    counted = cell_counts(issues)
    in_column = F.col("pos") >= 0
    worst = F.max_by("pos", F.when(in_column, F.struct(F.col("n"), -F.col("pos"))))
    cells = counted.agg(
        F.coalesce(F.sum(F.when(in_column, F.col("n"))), F.lit(0)).alias("invalid_cells"),
        F.coalesce(F.sum(F.when(~in_column, F.col("n"))), F.lit(0)).alias("invalid_rows"),
        F.count_if(in_column).alias("invalid_columns"),
        F.when(
            F.count_if(in_column) > 0, F.get(F.array(*[F.lit(c) for c in names]), worst)
        ).alias("worst_column"),
    )
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.col("count")).alias("k"), "first_seen", "code", "count"))
    )
    codes = code_order(issues).agg(
        F.transform(
            F.slice(ranked, 1, TOP_CODES), lambda x: F.struct(x["code"].alias("code"), x["count"].alias("count"))
        ).alias("top_issue_codes")
    )
    parts = size.unionByName(cells, allowMissingColumns=True).unionByName(
        codes, allowMissingColumns=True
    )
    one = parts.agg(
        *[
            F.first(c, ignorenulls=True).alias(c)
            for c in ("rows", "invalid_cells", "invalid_rows", "invalid_columns", "worst_column", "top_issue_codes")
        ]
    )
    return one.select(
        "rows",
        F.lit(width).cast("bigint").alias("columns"),
        (F.col("rows") * width).alias("total_cells"),
        "invalid_cells",
        "invalid_rows",
        "invalid_columns",
        "worst_column",
        "top_issue_codes",
    )


def invalid_cell_pct(stats: DataFrame) -> DataFrame:
    """Share of invalid cells in percent, null for an empty table."""
    share = 100 * F.col("invalid_cells") / F.nullif(F.col("total_cells"), F.lit(0))
    return stats.select(F.round(share, 1).alias("invalid_cell_pct"))


def _statistics(value: Column) -> list[Column]:
    return [
        F.count(value).alias("count"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.stddev_samp(value), 6).alias("std"),
    ]


_NO_STATISTICS = "column string, pos int, count bigint, min double, max double, mean double, std double"


def numeric_stats(
    df: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """``column, pos, count, min, max, mean, std`` of valid, filled numeric cells.

    Plain columns share one aggregation of one scan. Cells of a unique column
    that repeat an earlier value do not count, so those columns aggregate one
    value per distinct key instead.
    """
    numeric = [p for p in plan_columns(df, spec, row_key) if p.numeric]
    plain = [p for p in numeric if not p.spec.rules.get("unique", False)]
    singles = [r for r in keys.key_rules(df, spec, row_key)[0] if r.plan.numeric]
    names = {p.pos: p.spec.name for p in numeric}
    parts: list[DataFrame] = []
    if plain:
        valid = F.when(F.col("mask") == 0, statistics_value(plain))
        pos = F.get(F.array(*[F.lit(p.pos) for p in plain]), F.col("cell"))
        parts.append(
            spec_cells(df, spec, plain, row_key)
            .select(pos.alias("pos"), valid.alias("num"))
            .groupBy("pos")
            .agg(*_statistics(F.col("num")))
        )
    if singles:
        folded = keys.fold_keys(keys.key_candidates(df, spec, row_key, singles, []))
        parts.append(folded.groupBy(F.col("rule").alias("pos")).agg(*_statistics(F.col("num"))))
    if not parts:
        return df.sparkSession.createDataFrame([], _NO_STATISTICS)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    labels = F.create_map(*[F.lit(x) for pos, name in names.items() for x in (pos, name)])
    return out.where("count > 0").select(
        F.element_at(labels, F.col("pos")).alias("column"), "pos", "count", "min", "max", "mean", "std"
    )


def column_summary(
    df: DataFrame, issues: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """Invalid counts and, for numeric columns with valid cells, their statistics."""
    stats = numeric_stats(df, spec, row_key).select(
        "pos", F.struct("count", "min", "max", "mean", "std").alias("numeric_stats")
    )
    # Both sides have one row per column.
    return column_invalid_counts(df, issues, row_key).join(stats, "pos", "left").select(
        "column", "pos", "invalid_count", "total", "numeric_stats"
    )


def one_pass_summary(
    df: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """Column summary of the cell pass alone, in a single aggregation of one scan.

    For specifications without uniqueness rules this equals
    :func:`column_summary` and needs neither issues nor any exchange of rows.
    """
    singles, composites = keys.key_rules(df, spec, row_key)
    if singles or composites:
        raise ValueError("uniqueness rules need the issues relation")
    names = table_columns(df, row_key)
    checked = plan_columns(df, spec, row_key)
    # Unchecked columns contribute their (always valid) cells without being read.
    totals = df.agg(F.count("*").alias("total")).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(i).alias("pos")) for i, n in enumerate(names)])),
        "total",
        F.lit(0).cast("bigint").alias("invalid_count"),
        F.lit(None).cast("struct<count:bigint,min:double,max:double,mean:double,std:double>").alias("numeric_stats"),
    )
    if not checked:
        return totals.select("column", "pos", "invalid_count", "total", "numeric_stats")
    rest = [i for i in range(len(names)) if i not in {p.pos for p in checked}]
    value = F.when(F.col("mask") == 0, statistics_value(checked))
    per_cell = (
        spec_cells(df, spec, checked, row_key)
        .select("cell", "mask", value.alias("num"))
        .groupBy("cell")
        .agg(
            F.count_if(F.col("mask") != 0).alias("invalid_count"),
            F.count("*").alias("total"),
            F.struct(*_statistics(F.col("num"))).alias("s"),
        )
        .select(
            F.get(F.array(*[F.lit(p.spec.name) for p in checked]), F.col("cell")).alias("column"),
            F.get(F.array(*[F.lit(p.pos) for p in checked]), F.col("cell")).alias("pos"),
            "invalid_count",
            "total",
            F.when(F.col("s.count") > 0, F.col("s")).alias("numeric_stats"),
        )
    )
    empty = totals.where((F.col("total") == 0) | F.col("pos").isin(*rest)) if rest else totals.where("total = 0")
    return per_cell.unionByName(empty)
