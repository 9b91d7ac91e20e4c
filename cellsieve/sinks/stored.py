"""Store tables and issues by data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.operators.tables import to_string_table
from cellsieve.plans.validate import Validation
from cellsieve.sources.stored import RUN_PARTS, _stored, partition_path


def _replace_partition(df: DataFrame, root: str, dataset_id: str) -> None:
    """Write the folder of one data set; a table without rows replaces earlier ones too."""
    df.write.mode("overwrite").parquet(partition_path(root, dataset_id))


def save_raw(df: DataFrame, root: str, dataset_id: str, keep=()) -> None:
    """Write the all-string table; other data sets under *root* are untouched."""
    _replace_partition(to_string_table(df, keep), root, dataset_id)


def save_issues(issues: DataFrame, root: str, dataset_id: str) -> None:
    """Write issues, replacing those of the last run of this data set."""
    _replace_partition(issues.withColumn("run_at", F.current_timestamp()), root, dataset_id)


def save_run(run: Validation, root: str, dataset_id: str) -> None:
    """Write all of a run: issues with their order, data set issues, column summary and statistics.

    Each part is a table under *root*; the parts of other data sets stay. Issues are written first and read
    back for the rest, so the checks run once.
    """
    save_issues(run.ordered_issues, f"{root}/issues", dataset_id)
    stored = Validation(run.table, run.spec, run.row_key, _stored(run.table.sparkSession, f"{root}/issues", dataset_id))
    for part in RUN_PARTS:
        _replace_partition(getattr(stored, part), f"{root}/{part}", dataset_id)
