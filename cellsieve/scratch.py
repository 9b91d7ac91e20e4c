"""Work tables in the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_PRIVATE: dict[str, str] = {}  # by application, for local sessions only


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a private one only where none is named."""
    context = spark.sparkContext
    named = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir", None)
        or context.getCheckpointDir()
    )
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    application = context.applicationId
    if application not in _PRIVATE:
        _PRIVATE[application] = tempfile.mkdtemp(prefix="cellsieve-")
    return _PRIVATE[application]


def new_path(spark: SparkSession, name: str) -> str:
    """A path nothing has been written to yet."""
    return f"{shared_dir(spark)}/cellsieve/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the session's driver ends; results may read it until then."""
    jvm_path, files = _file_system(spark, path)
    files.deleteOnExit(jvm_path)


def remove(spark: SparkSession, path: str) -> None:
    """The folder of a work table that nothing reads any more."""
    jvm_path, files = _file_system(spark, path)
    files.delete(jvm_path, True)


def write_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write once and read back: cuts lineage and fixes every value for re-reads.

    Files outlive lost executors, and later readers prune columns and row groups. Without a
    path of the caller's own, they are removed when the session's driver ends.
    """
    spark = df.sparkSession
    target = path or new_path(spark, name)
    df.write.mode("error").parquet(target)
    if path is None:
        remove_at_exit(spark, target)
    return spark.read.schema(df.schema).parquet(target)
