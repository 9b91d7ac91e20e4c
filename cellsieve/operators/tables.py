"""Whole-table normalisation and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.functions.text import blank_missing, safe_str


def to_string_table(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every column as text, missing as the empty string; *keep* stays as it is."""
    return df.select(
        *[F.col(f"`{c}`") if c in keep else safe_str(F.col(f"`{c}`")).alias(c) for c in df.columns]
    )


def normalize_raw(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Blank out spelled-out missing values and strip column names."""
    return df.select(
        *[
            F.col(f"`{c}`") if c in keep else blank_missing(F.col(f"`{c}`")).alias(str(c).strip())
            for c in df.columns
        ]
    )


def dataset_profile(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """One row: number of rows and columns, and the column names in order."""
    names = [c for c in df.columns if c not in ignore]
    return df.agg(F.count("*").alias("rows")).select(
        "rows",
        F.lit(len(names)).alias("cols"),
        F.array(*[F.lit(c) for c in names]).alias("columns"),
    )
