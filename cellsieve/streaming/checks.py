"""Cell checks on streaming tables.

The checks are stateless: a stream needs no watermark and no state, and every
micro-batch carries its own issues. Uniqueness, row positions and inference need
a whole table and refuse streams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cellsieve.plans.cells import ROW, cell_issues
from cellsieve.spec import DatasetSpec


def stream_issues(
    stream: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """Issues of a streaming table as another streaming table."""
    keyed = [c.name for c in spec.columns if c.rules.get("unique", False)]
    if stream.isStreaming and (keyed or spec.unique_together):
        raise ValueError(f"uniqueness rules need a batch table: {keyed or 'unique_together'}")
    return cell_issues(stream, spec, row_key)


def write_issues(
    stream: DataFrame,
    spec: DatasetSpec,
    path: str,
    checkpoint: str,
    row_key: str | Sequence[str] = ROW,
    available_now: bool = True,
) -> StreamingQuery:
    """Append a stream's issues to Parquet, exactly once."""
    writer = (
        stream_issues(stream, spec, row_key)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
