"""XML files as all-string tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve.functions.text import blank_missing, py_strip
from cellsieve.scratch import new_path, remove_at_exit
from cellsieve.sources.xml_tags import Walk, XmlFiles, pieces
from cellsieve.spec import Template

MAX_CANDIDATE_DEPTH = 6  # Fixed value: levels below the root that are offered.


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "record_path", "n_children", "depth", "visit_order", "root"]
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"]):
            walk, root, child, levels = Walk(path, 0), None, None, False
            for piece in pieces(content.encode() if isinstance(content, str) else content):
                opened, closed = walk.take(piece)
                if opened is not None:
                    root = root or opened
                    child = child or (opened.name if opened.depth == 1 else None)
                if closed is not None and closed.repeats:
                    levels = True
                    out.append((path, f"{closed.path}.{closed.low}", closed.children, closed.depth, closed.nth, root.name))
            walk.end()
            if root is None:
                raise walk.malformed("it has no element")
            if not levels:  # the root's children are the rows, but no choice to offer
                out.append((path, f"{root.name}.{child or 'record'}", root.children, None, 0, root.name))
        yield pd.DataFrame(out, columns=names).astype({"depth": "Int32"})


_CANDIDATE_SCHEMA = (
    "path string, record_path string, n_children long, depth int, visit_order int, root string"
)


def xml_candidates(documents: DataFrame) -> DataFrame:
    """Repeated levels of every document of ``(path, content)``: elements whose children all share one tag.

    A document is one row and is walked tag by tag with one stack. ``visit_order`` is the position of the element's
    start tag, which is the order of preference. For files see ``file_record_paths``.
    """
    return documents.select("path", "content").mapInPandas(_candidates, _CANDIDATE_SCHEMA)


def detect_xml_record_paths(documents: DataFrame) -> DataFrame:
    """``path, record_path, n_children``: the level taken as the rows."""
    first = F.min(F.struct("visit_order", "record_path", "n_children")).alias("_first")
    return xml_candidates(documents).groupBy("path").agg(first).select(
        "path", "_first.record_path", "_first.n_children"
    )


def xml_path_candidates(documents: DataFrame) -> DataFrame:
    """``path, record_path, visit_order`` a user may choose from."""
    shallow = F.col("depth") <= MAX_CANDIDATE_DEPTH
    offered = xml_candidates(documents).groupBy("path").agg(
        F.array_sort(F.collect_list(F.when(shallow, F.struct("visit_order", "record_path")))).alias("c"),
        F.min("root").alias("root"),
    )
    default = F.array(F.struct(F.lit(0).alias("visit_order"), F.col("root").alias("record_path")))
    chosen = F.when(F.size("c") > 0, F.col("c")).otherwise(default)
    return offered.select("path", F.inline(chosen)).select("path", "record_path", "visit_order")


def file_record_paths(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, record_path, n_children`` of files, as ``detect_xml_record_paths`` finds them; splits of large files are read apart."""
    levels, paths = XmlFiles(spark, path).places()
    return _found_paths(levels, paths).select(F.col("file").alias("path"), "record_path", "n_children")


def _found_paths(levels: DataFrame, paths: DataFrame) -> DataFrame:
    """``file, root, record_path, n_children``, one row per file."""
    depth = F.length("found") - F.length(F.replace(F.col("found"), F.lit("."), F.lit("")))
    roots = paths.withColumn("depth", depth).where("depth < 2").groupBy("file").agg(
        F.max(F.when(F.col("depth") == 0, F.col("found"))).alias("root"),
        F.min(F.when(F.col("depth") == 1, F.struct("at", "nth", "found"))).alias("child"),
        F.coalesce(F.sum(F.when(F.col("depth") == 1, F.col("n"))), F.lit(0)).alias("children"))
    first = levels.groupBy("file").agg(F.min(F.struct("at", "nth", "record_path", "n")).alias("level"))
    return roots.join(first, "file", "left").select(
        "file", "root",
        F.coalesce("level.record_path", "child.found", F.concat("root", F.lit(".record"))).alias("record_path"),
        F.coalesce("level.n", "children").alias("n_children"))


def record_places(files: XmlFiles, record_path: str | None = None) -> DataFrame:
    """``file, record_path, records, elsewhere`` of every file; without a path each one's own is found.

    ``elsewhere`` tells whether the tag of the records also stands at another path, or may stand in a comment or in CDATA.
    """
    levels, paths = files.places()
    wanted = _found_paths(levels, paths).withColumn("record_path", F.lit(record_path) if record_path else F.col("record_path"))
    below_root = (F.col("record_path") == F.col("root")) | F.col("record_path").startswith(F.concat("root", F.lit(".")))
    wanted = wanted.select("file", "record_path", F.when(below_root, F.col("record_path")).otherwise(
        F.concat_ws(".", "root", "record_path")).alias("whole"))
    tag = F.substring_index("whole", ".", -1)
    at_path = F.col("found") == F.col("whole")
    same_tag = F.substring_index("found", ".", -1) == tag
    return wanted.join(paths.select("file", "found", "n"), "file").groupBy("file", "record_path").agg(
        F.coalesce(F.sum(F.when(at_path, F.col("n"))), F.lit(0)).alias("records"),
        F.coalesce(F.bool_or(same_tag & ~at_path | (F.col("found") == "")), F.lit(False)).alias("elsewhere"))


def xml_children_to_columns(df: DataFrame) -> DataFrame:
    """Children and attributes of record elements as text columns.

    A repeated child counts with its last occurrence, a nested child with its
    own text; text of the record element itself is not a cell.
    """
    def text(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.ArrayType):
            return text(F.try_element_at(value, F.lit(-1)), kind.elementType)
        if isinstance(kind, T.StructType):
            return value["_VALUE"] if "_VALUE" in kind.fieldNames() else F.lit("")
        return value.cast("string")

    return df.select(
        *[
            blank_missing(
                _trimmed(text(F.col(f"`{f.name}`"), f.dataType), f.name)
            ).alias(f.name)
            for f in df.schema.fields
            if f.name != "_VALUE"
        ]
    )


def _trimmed(value: Column, name: str) -> Column:
    value = F.coalesce(value, F.lit(""))
    return value if name.startswith("@") else py_strip(value)


def scan_xml(
    spark: SparkSession,
    path: str | Sequence[str],
    record_path: str | None = None,
    exact: bool | None = None,
    schema: T.StructType | None = None,
    template: Template | None = None,
) -> DataFrame:
    """Record elements as rows, their children and ``@attributes`` as columns.

    Only elements at the very path count. Without a path every file's own one is found. One pass over the tags of the files
    tells in which of them the record tag also stands elsewhere. Of these, and of files so large that they have several
    splits, the records are cut out first, one line each, by all splits at once; Spark's reader takes the
    others as they are, each file in one task. ``exact=True`` cuts the records out of all files and ``exact=False`` of none,
    taking the tag wherever it stands; with a path, both save the pass.
    """
    if record_path is None and template is not None:
        record_path = template.xml_record_path
    record_path = record_path and record_path.strip()
    if record_path and exact is False:
        return _read_records(spark, path, record_path, schema)
    files = XmlFiles(spark, path)
    groups: dict[tuple[str, bool], list[str]] = {}
    if record_path and exact:
        groups[record_path, True] = sorted(files.paths)
    else:
        for file in record_places(files, record_path).collect():  # one row per file
            if file["records"]:
                cut_out = file["elsewhere"] or files.is_cut(file["file"]) if exact is None else exact
                groups.setdefault((file["record_path"], cut_out), []).append(file["file"])
    if not groups:
        raise ValueError(f"No elements found at record_path='{record_path}'" if record_path else "no XML records")
    parts = []
    for (found, cut_out), names in sorted(groups.items()):
        if cut_out:
            target = new_path(spark, "xml-records")
            remove_at_exit(spark, target)
            files.records(found.split("."), names).select("record").write.text(target)
            parts.append(_read_records(spark, target, found, schema, lines=True))
        else:
            parts.append(_read_records(spark, [files.paths[name] for name in names], found, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns])


def _read_records(spark, path, record_path: str, schema: T.StructType | None, lines: bool = False) -> DataFrame:
    """Elements with the last tag of the path, wherever they stand; with *lines* each line is one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    found = (
        reader.format("xml")
        .options(
            rowTag=record_path.rpartition(".")[2],
            multiLine=str(not lines).lower(),
            attributePrefix="@",
            valueTag="_VALUE",
            ignoreNamespace="true",
            inferSchema="false",
            ignoreSurroundingSpaces="false",
        )
        .load(path)
    )
    if not found.columns:
        raise ValueError(f"No elements found at record_path='{record_path}'")
    return xml_children_to_columns(found)
