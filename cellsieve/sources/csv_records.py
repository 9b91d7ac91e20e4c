"""Records of CSV files whose cells hold line breaks, found by all splits at once.

Whether a line starts a record depends on all quotes before it in its file. A line turns the state it is entered in (outside or
inside a quoted cell) into the state it is left in, so it is one of four functions: it keeps the state, turns it, or
sets it. Functions are composed within each split, then over one row per split of a file, and every line gets its state from both.
Lines of one record go to one key; records of a single line, the most, stay where they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsieve.scratch import write_table

# States while the quotes of a line are read: after a quote that is text, inside a cell, after a quote that may
# close a cell or escape the next one, and at the start of a line.
_TEXT, _INSIDE, _CLOSED, _START = range(4)


def _left_inside(line: Column, delimiter: str, inside: bool) -> Column:
    """Whether a line that is entered outside or inside a quoted cell ends inside one.

    Only what stands before each quote matters: a quote opens a cell where one starts, that is at the start of the line or
    after a delimiter; inside a cell it closes it, but for one that follows at once.
    """
    before = F.split(line, '"')

    def step(state: Column, piece: Column) -> Column:
        opens = piece.endswith(delimiter) | ((piece == "") & state.isin(_START, _CLOSED))
        return F.when(state == _INSIDE, _CLOSED).when(opens, _INSIDE).otherwise(_TEXT)

    last = F.aggregate(F.slice(before, 1, F.size(before) - 1), F.lit(_INSIDE if inside else _START), step)
    return F.when(F.contains(line, F.lit('"')), last == _INSIDE).otherwise(F.lit(inside))


def _entered(entry: Column, order: Window, out: Column, into: Column) -> Column:
    """The state before each row of *order*, entered in *entry*: that set last, turned as often as since then.

    *out* and *into* are the states in which a row is left when entered outside and inside.
    """
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sets = out == into
    turned = F.coalesce(F.sum((out & ~into).cast("int")).over(before), F.lit(0))
    set_to = F.last(F.when(sets, out), ignorenulls=True).over(before)
    # turns up to the row that has set the state are not turned again
    base = F.coalesce(F.last(F.when(sets, F.col("_turns")), ignorenulls=True).over(before), F.lit(0))
    return (F.coalesce(set_to, entry).cast("int") + turned - base) % 2 == 1


def _with_turns(rows: DataFrame, order: Window, out: str, into: str) -> DataFrame:
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_turns", F.sum((F.col(out) & ~F.col(into)).cast("int")).over(upto))


def csv_records(spark: SparkSession, files: Sequence[str], delimiter: str, charset: str) -> DataFrame:
    """``path``, ``start``, ``line`` (in order within the file) and ``record``, the text of every record that is not blank.

    A window holds the lines of one split, or one row per split of a file; a group holds the lines of one record.
    """
    value = F.decode(F.col("value").cast("binary"), charset) if charset != "UTF-8" else F.col("value")
    lines = spark.read.text(list(files)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"), value.alias("value"))
    # stored once: numbers of lines of separate scans need not agree
    lines = write_table(lines.select(
        "*", _left_inside(F.col("value"), delimiter, False).alias("out"),
        _left_inside(F.col("value"), delimiter, True).alias("into")), "csv-lines")

    in_split = Window.partitionBy("path", "start").orderBy("line")
    both = _with_turns(lines, in_split, "out", "into").select(
        "*", *[_entered(F.lit(bool(k)), in_split, F.col("out"), F.col("into")).alias(f"from_{k}") for k in range(2)])
    # what a split does to its state, and where its last record starts
    ends = both.groupBy("path", "start").agg(
        *[F.max_by(F.when(F.col(f"from_{k}"), F.col("into")).otherwise(F.col("out")), "line").alias(f"end_{k}") for k in range(2)],
        *[F.max(F.when(~F.col(f"from_{k}"), F.col("line"))).alias(f"last_{k}") for k in range(2)])
    by_split = Window.partitionBy("path").orderBy("start")
    ends = _with_turns(ends, by_split, "end_0", "end_1").withColumn(
        "entry", _entered(F.lit(False), by_split, F.col("end_0"), F.col("end_1")))
    begun = F.when(F.col("entry"), F.col("last_1")).otherwise(F.col("last_0"))
    ends = ends.select("path", "start", "entry", F.last(begun, ignorenulls=True).over(
        by_split.rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    entries = ends.select(F.col("path").alias("_path"), F.col("start").alias("_start"), "entry", "open")

    placed = both.join(entries, (F.col("path") == F.col("_path")) & (F.col("start") == F.col("_start"))).select(
        "path", "start", "line", "value", "open",
        F.when(F.col("entry"), F.col("from_1")).otherwise(F.col("from_0")).alias("inside"),
        F.when(F.when(F.col("entry"), F.col("from_1")).otherwise(F.col("from_0")), F.col("into")).otherwise(F.col("out")).alias("goes_on"))
    alone = placed.where(~F.col("inside") & ~F.col("goes_on")).select("path", "start", "line", F.col("value").alias("record"))
    first = F.last(F.when(~F.col("inside"), F.col("line")), ignorenulls=True).over(in_split)
    several = placed.withColumn("first", F.coalesce(first, "open")).where(F.col("inside") | F.col("goes_on"))
    joined = several.groupBy("path", "first").agg(
        F.sort_array(F.collect_list(F.struct("start", "line", "value"))).alias("lines")).select(
        "path", F.col("lines")[0]["start"].alias("start"), F.col("first").alias("line"),
        F.array_join(F.col("lines.value"), "\n").alias("record"))
    return alone.unionByName(joined).where(F.length(F.btrim("record")) > 0)


def numbered_heads(records: DataFrame, n: int) -> DataFrame:
    """The first *n* records of every file with their number ``nth`` from 1."""
    order = Window.partitionBy("path").orderBy("start", "line")
    return records.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n)
