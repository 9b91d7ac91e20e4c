"""Tables and issues stored by data set."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from cellsieve.plans.cells import ISSUE_COLUMNS

DATASET = "dataset_id"
#: Tables of a stored run beside its issues.
RUN_PARTS = ("dataset_issues", "column_summary", "stats")


# Characters that are percent-encoded in partition folder names.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


def partition_path(root: str, dataset_id: str) -> str:
    """Folder of one data set. Data sets differ in columns, so only it is listed."""
    name = _ESCAPED.sub(lambda m: f"%{ord(m.group()):02X}", dataset_id)
    return f"{root.rstrip('/')}/{DATASET}={name}"


def _stored(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    try:
        return spark.read.parquet(partition_path(root, dataset_id))
    except AnalysisException as error:
        raise FileNotFoundError(f"nothing stored for data set {dataset_id!r} under {root}") from error


def scan_raw(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    """The all-string table of one data set; only its partition is read."""
    return _stored(spark, root, dataset_id)


def load_issues(spark: SparkSession, root: str, dataset_id: str, ordered: bool = False) -> DataFrame:
    """Issues of the last stored run, optionally with their order columns."""
    found = _stored(spark, root, dataset_id)
    return found if ordered else found.select(*ISSUE_COLUMNS)


def load_run(spark: SparkSession, root: str, dataset_id: str) -> dict[str, DataFrame]:
    """``issues``, ``dataset_issues``, ``column_summary`` and ``stats`` of the last stored run."""
    parts = {part: _stored(spark, f"{root}/{part}", dataset_id) for part in RUN_PARTS}
    return {"issues": load_issues(spark, f"{root}/issues", dataset_id), **parts}
