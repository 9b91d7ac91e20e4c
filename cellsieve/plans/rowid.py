"""Dense 0-based row positions in file order, without sorting the data.

Only one small table per file is ordered: its row counts, accumulated in path
order, give each file's first position. That table has one row per file, which
is what the driver already lists to plan the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.plans.cells import ROW
from cellsieve.scratch import write_table

FILE, BLOCK, SEQ = "_file", "_block", "_seq"

HASH, BASE = "_hash", "_base"

# Up to this many files or splits are broadcast as pairs of a 64-bit hash and a position: 16 bytes each, 160 MB for
# 1.3 PB in splits of 128 MB. Hashes are checked to be distinct.
BROADCAST_FILES = 10_000_000


def _attach(scan: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join ``_base`` of every file or split to its rows, without moving the rows while the hashes fit."""
    known = write_table(small.select(*keys, BASE, F.xxhash64(*keys).alias(HASH)), "bases")
    n, distinct = known.agg(F.count("*"), F.count_distinct(HASH)).first()
    if n == distinct and n <= BROADCAST_FILES:
        side = F.broadcast(known.select(HASH, BASE))
        return scan.withColumn(HASH, F.xxhash64(*keys)).join(side, HASH).drop(HASH)
    return scan.join(known.drop(HASH), keys)


def _rows_before(counts: DataFrame, *order: str) -> DataFrame:
    """``_base``: rows of all files or splits before, over one row per file or split."""
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(BASE, F.coalesce(F.sum("_n").over(before), F.lit(0)))


def index_parquet(df: DataFrame, name: str = ROW) -> DataFrame:
    """Add the position column to a Parquet scan.

    The reader numbers rows within a file whatever the split layout, so the
    result does not depend on how tasks were packed or re-run.
    """
    scan = df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.row_index").alias(SEQ),
    )
    per_file = df.groupBy(F.col("_metadata.file_path").alias(FILE)).agg(F.count("*").alias("_n"))
    return _attach(scan, _rows_before(per_file, FILE), [FILE]).select(
        (F.col(BASE) + F.col(SEQ)).alias(name), *[F.col(f"`{c}`") for c in df.columns]
    )


def tag_scan(df: DataFrame) -> DataFrame:
    """Tag a text-format scan with file, split and a running number."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(SEQ),
    )


def _splits(tagged: DataFrame) -> DataFrame:
    """Rows and first running number of every split.

    Running numbers are only comparable inside one job, so *tagged* has to be a
    stored table, not a scan that may be planned differently next time.
    """
    return tagged.groupBy(FILE, BLOCK).agg(F.count("*").alias("_n"), F.min(SEQ).alias("_first"))


def position_in_file(tagged: DataFrame) -> DataFrame:
    """Turn tags that were written down into per-file positions (``_pos``)."""
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = _splits(tagged).withColumn(BASE, F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    placed = _attach(tagged, starts, [FILE, BLOCK])
    return placed.withColumn("_pos", F.col(BASE) + F.col(SEQ)).drop(BASE)


def index_text_scan(df: DataFrame, name: str = ROW) -> DataFrame:
    """Add the position column to a CSV, JSON or XML scan.

    These readers do not number rows, so the scan is stored once, which an
    all-string ingest does anyway. Files and splits are placed by one join.
    """
    tagged = write_table(tag_scan(df), "scan")
    starts = _rows_before(_splits(tagged), FILE, BLOCK)
    starts = starts.withColumn(BASE, F.col(BASE) - F.col("_first"))
    return _attach(tagged, starts, [FILE, BLOCK]).select(
        (F.col(BASE) + F.col(SEQ)).alias(name), *[F.col(f"`{c}`") for c in df.columns]
    )


def row_index(df: DataFrame, name: str = ROW) -> DataFrame:
    """Positions for a file scan of any format; other plans are refused."""
    if df.isStreaming:
        raise ValueError("row positions need a batch table")
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {name!r} already; pass another name")
    files = df.inputFiles()
    if not files:
        raise ValueError("row positions need a file scan; pass a key column instead")
    try:
        scan = df.select("_metadata.row_index")
    except Exception:  # unresolved: not Parquet, or not directly on a file scan
        return index_text_scan(df, name)
    del scan
    return index_parquet(df, name)
