"""Matching many table headers against many templates.

Inputs are relations: ``headers(dataset_id, pos, name)``, ``templates(template_id,
col_pos, column, cand_pos, candidate, required)`` with one row per name or alias,
and ``pairs(dataset_id, template_id)`` saying which template a table is held
against. Nothing is paired beyond that relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.functions.text import normalize_column_name
from cellsieve.spec import Template

# Up to this many rows of a side are broadcast; a row is a few short names, so about 100 MB at most.
BROADCAST_ROWS = 500_000
# Tables of one template that meet in one task; a template on more tables is copied.
TABLES_PER_TASK = 100_000


def template_candidates(spark, templates: list[Template]) -> DataFrame:
    """Template objects as the relation the matcher reads."""
    rows = [
        (t.id, col_pos, col.name, cand_pos, candidate, col.required)
        for t in templates
        for col_pos, col in enumerate(t.columns)
        for cand_pos, candidate in enumerate((col.name, *col.aliases))
    ]
    return spark.createDataFrame(
        rows,
        "template_id string, col_pos int, column string, cand_pos int, candidate string, required boolean",
    )


def each_pair(
    pairs: DataFrame,
    templates: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    tables_per_task: int = TABLES_PER_TASK,
) -> DataFrame:
    """Every template candidate of every pair.

    Templates are broadcast while they are few. Beyond that only templates held against very many tables are
    copied, as often as their number of tables asks for.
    """
    if templates.count() <= broadcast_rows:
        return pairs.join(F.broadcast(templates), "template_id")
    copies = pairs.groupBy("template_id").agg(
        F.ceil(F.count("*") / tables_per_task).cast("int").alias("_copies"))
    hot = copies.where("_copies > 1")  # at most one in tables_per_task pairs
    known = F.coalesce(F.col("_copies"), F.lit(1))
    left = pairs.join(F.broadcast(hot), "template_id", "left").withColumn(
        "_salt", F.pmod(F.xxhash64("dataset_id"), known).cast("int")).drop("_copies")
    right = templates.join(F.broadcast(hot), "template_id", "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), known - 1))).drop("_copies")
    return left.join(right, ["template_id", "_salt"]).drop("_salt")


def matched_columns(
    headers: DataFrame,
    templates: DataFrame,
    pairs: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    tables_per_task: int = TABLES_PER_TASK,
) -> DataFrame:
    """``dataset_id, template_id, column, col_pos, required, name``.

    The candidate that comes first wins; of equally named table columns the
    later one does. ``name`` is null where no candidate is present.
    """
    # (dataset, normalised name) is the join key, so no key is shared by tables.
    present = (
        headers.withColumn("norm", normalize_column_name(F.col("name")))
        .groupBy("dataset_id", "norm")
        .agg(F.max_by("name", "pos").alias("name"))
    )
    wanted = each_pair(pairs, templates, broadcast_rows, tables_per_task).withColumn(
        "norm", normalize_column_name(F.col("candidate"))
    )
    hits = wanted.join(present, ["dataset_id", "norm"], "left")
    best = F.min_by("name", F.when(F.col("name").isNotNull(), F.col("cand_pos")))
    return hits.groupBy("dataset_id", "template_id", "col_pos", "column").agg(
        F.bool_or("required").alias("required"), best.alias("name")
    )


def match_schema_catalog(
    headers: DataFrame,
    templates: DataFrame,
    pairs: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    tables_per_task: int = TABLES_PER_TASK,
) -> DataFrame:
    """``dataset_id, template_id, status, column, name``.

    Status is ``matched`` (both names set), ``unresolved`` (template column
    without a table column), ``missing`` (the required ones of those) or
    ``extra`` (table column no template column was matched to).
    """
    best = matched_columns(headers, templates, pairs, broadcast_rows, tables_per_task)
    ids = ("dataset_id", "template_id")
    states = (
        F.when(F.col("name").isNotNull(), F.array(F.lit("matched")))
        .when(F.col("required"), F.array(F.lit("unresolved"), F.lit("missing")))
        .otherwise(F.array(F.lit("unresolved")))
    )
    decided = best.select(*ids, F.explode(states).alias("status"), "column", "name")
    taken = best.where(F.col("name").isNotNull()).select(*ids, "name")
    # A table has few templates; a wide table with many is a join that Spark can split.
    extra = (
        headers.select("dataset_id", "name").join(pairs, "dataset_id")
        .join(taken, [*ids, "name"], "left_anti")
        .select(*ids, F.lit("extra").alias("status"), F.lit(None).cast("string").alias("column"), "name")
    )
    return decided.unionByName(extra)


def missing_columns(headers: DataFrame, expected: DataFrame) -> DataFrame:
    """``dataset_id, code, column, message`` of required columns a table lacks.

    *expected* is ``(dataset_id, column, required)``, keyed by table column.
    """
    lacking = expected.where("required").join(
        headers.select("dataset_id", F.col("name").alias("column")), ["dataset_id", "column"], "left_anti"
    )
    message = F.concat(F.lit("Required column '"), F.col("column"), F.lit("' is missing from the file"))
    return lacking.select("dataset_id", F.lit("MISSING_COLUMN").alias("code"), "column", message.alias("message"))


def extra_columns(headers: DataFrame, expected: DataFrame) -> DataFrame:
    """``dataset_id, code, column, message`` of columns no specification covers."""
    unknown = headers.select("dataset_id", F.col("name").alias("column")).join(
        expected.select("dataset_id", "column"), ["dataset_id", "column"], "left_anti"
    )
    message = F.concat(F.lit("Unexpected column '"), F.col("column"), F.lit("' (strict mode)"))
    return unknown.select("dataset_id", F.lit("EXTRA_COLUMN").alias("code"), "column", message.alias("message"))
