"""JSON files and JSON text columns as all-string tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve.functions.text import blank_missing
from cellsieve.scratch import new_path, remove_at_exit
from cellsieve.sources.json_records import json_records

# Keys under which an object may hold its records, in order.
WRAPPER_KEYS = ("data", "records", "rows", "items", "results", "values")
PEEK_ROWS = 12  # Fixed value: length of a preview.
# Fixed value: control characters, which no JSON text holds, so that a document is one line.
WHOLE = "\x01\x02\x03\x04\x05\x06\x07\x08"


def _as_text(kind: T.DataType) -> T.DataType:
    """The same shape with every primitive read as its text."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _as_text(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_as_text(kind.elementType))
    return T.StringType()


def _cell(value: Column, kind: T.DataType) -> Column:
    """Text of one JSON value; nested values stay JSON."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        value = F.to_json(value)
    elif isinstance(kind, T.BooleanType):
        value = F.initcap(value)
    return blank_missing(F.coalesce(value, F.lit("")))


def json_unwrap_records(df: DataFrame, native: T.StructType, key: str) -> DataFrame:
    """One row per record of the list under *key*; a list of plain values is one column ``0``.

    *df* holds one parsed object per row with primitives as text; *native* is
    the same schema with the original primitive types.
    """
    kind = native[key].dataType
    if not isinstance(kind, T.ArrayType):  # every list is empty
        return df.where(F.lit(False)).select(F.lit("").alias("0"))
    if isinstance(kind.elementType, T.StructType):
        return _flatten(df.select(F.inline(F.col(f"`{key}`"))), kind.elementType)
    values = df.select(F.explode(F.col(f"`{key}`")).alias("0"))
    return _flatten(values, T.StructType([T.StructField("0", kind.elementType)]))


def _flatten(df: DataFrame, native: T.StructType) -> DataFrame:
    return df.select(
        *[_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name.strip()) for f in native.fields]
    )


def scan_json(
    spark: SparkSession,
    path: str | Sequence[str],
    lines: bool = False,
    columns: Sequence[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Records of JSON documents (or of JSON Lines, which can be split).

    A document is an array of objects, an object wrapping a list of records, or a
    single object. That is found out file by file, and files of one layout are read together. Of documents larger than a
    split, all splits cut the records out, one line each and in order; only a single object or a list of plain
    values is one task's input. Other documents are read as one line each: Spark's multi-line reader opens the file once more for every
    number, truth value and nested value it returns as text. Lines are records as they are. *columns* fixes the column order; readers sort by
    name. With a *schema* of the objects (documents: of one layout) types are not looked for.
    """
    if lines:
        parts = [_scan_layout(spark, path, None, LINES, schema)]
    else:
        groups, large, cut = _grouped(spark, path)
        if not groups and not large and not cut:
            raise ValueError(f"no JSON documents under {path}")
        parts = [_scan_layout(spark, files, layout, {"lineSep": WHOLE}, schema) for layout, files in _in_order(groups)]
        parts += [_scan_layout(spark, files, layout, {"multiLine": "true"}, schema) for layout, files in _in_order(large)]
        parts += [_scan_layout(spark, files, None, LINES, _record_schema(schema, layout)) for layout, files in _in_order(cut)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in out.columns])
    return out.select(*[f"`{c}`" for c in columns]) if columns else out


Groups = dict[str | None, list[str]]
LINES: dict[str, str] = {}  # the reader's options for JSON Lines


def _in_order(groups: Groups) -> list[tuple[str | None, list[str]]]:
    return sorted(groups.items(), key=lambda group: (group[0] is not None, group[0]))


def _record_schema(schema: T.StructType | None, layout: str | None) -> T.StructType | None:
    return schema if schema is None or layout is None else schema[layout].dataType.elementType


def _grouped(spark: SparkSession, path: str | Sequence[str]) -> tuple[Groups, Groups, Groups]:
    """Files by layout: documents of a split at most, larger ones whose records cannot be cut out, and folders with the records
    of the others, one line each."""
    listed = spark.read.format("binaryFile").load(path).select(
        "path", F.col("_metadata.file_path").alias("file"), "length").collect()  # one row per file; contents are not read
    by_file = {row["file"]: row["path"] for row in listed}
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    large = {row["path"] for row in listed if row["length"] > split}
    small = [row["path"] for row in listed if row["length"] <= split]
    groups: Groups = {}
    whole: Groups = {}
    apart: Groups = {}
    found = _layouts(spark, small).withColumn("apart", F.lit(False)).collect() if small else []  # one row per file
    records = None
    if large:
        told, records = json_records(spark, sorted(large), WRAPPER_KEYS)
        found += told.collect()
    for file in found:
        if file["layout"] == "other":
            raise ValueError(f"a JSON document must be an array of objects or an object: {file['path']}")
        of = apart if file["apart"] else whole if by_file[file["path"]] in large else groups
        of.setdefault(file["layout"], []).append(file["path"])
    cut: Groups = {}
    for layout, files in apart.items():
        target = new_path(spark, "json-records")
        remove_at_exit(spark, target)
        # outside of strings, where no line break can stand, one is a blank
        line = F.translate("record", "\r\n", "  ").alias("value")
        records.where(F.col("path").isin(*files)).sort("path", "start", "line").select(line).write.text(target)
        cut[layout] = [target]
    named = [{layout: [by_file[file] for file in files] for layout, files in of.items()} for of in (groups, whole)]
    return *named, cut


def _layouts(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, layout``: the key under which an object holds its list, null for arrays and plain objects.

    Anything else is ``other``. Documents are parsed in the JVM, one row each.
    """
    documents = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("_v"), "value")
    root = F.substring(F.regexp_extract("value", r"^[\s\x{FEFF}]*(\S)", 1), 1, 1)
    held = F.lit(None).cast("string")
    for key in reversed(WRAPPER_KEYS):
        inner = F.variant_get("_v", f"$.{key}", "variant")
        held = F.when(F.schema_of_variant(inner).startswith("ARRAY"), F.lit(key)).otherwise(held)
    layout = F.when(root == "[", F.lit(None).cast("string")).when(root == "{", held).otherwise(F.lit("other"))
    return documents.select("path", layout.alias("layout"))


def _scan_layout(spark, path, key: str | None, options: dict[str, str], schema: T.StructType | None) -> DataFrame:
    native = schema or spark.read.options(**options).json(path).schema
    corrupt = spark.conf.get("spark.sql.columnNameOfCorruptRecord")
    if native.fieldNames() and set(native.fieldNames()) <= {corrupt}:
        raise ValueError("a JSON document must be an array of objects or an object")
    native = T.StructType([f for f in native.fields if f.name != corrupt])
    reader = spark.read.options(**options).option("mode", "FAILFAST")
    df = reader.schema(_as_text(native)).json(path)
    return _flatten(df, native) if key is None else json_unwrap_records(df, native, key)


def unwrap_json_column(df: DataFrame, column: str, record_schema: str, keys: Sequence[str]) -> DataFrame:
    """Records held by a JSON text column, with the columns *keys* of its row."""
    listed = T.StructType(
        [T.StructField(k, T.ArrayType(T._parse_datatype_string(record_schema))) for k in WRAPPER_KEYS]
    )
    parsed = F.from_json(F.col(column), listed)
    records = F.coalesce(*[F.when(F.size(parsed[k]) >= 0, parsed[k]) for k in WRAPPER_KEYS])
    single = F.array(F.from_json(F.col(column), T._parse_datatype_string(record_schema)))
    return df.select(*keys, F.inline(F.coalesce(records, single)))


def peek_json(spark: SparkSession, path: str, n: int = PEEK_ROWS) -> DataFrame:
    """``row, cells`` of the first records of a document, in its order; an unreadable one gives no rows."""
    schema = "row int, cells array<string>"
    try:
        records = scan_json(spark, path)
        # a document is one task's input, whose rows come in order
        first = records.select(F.array(*[F.col(f"`{c}`") for c in records.columns]).alias("cells")).head(n)
    except Exception:  # a preview degrades to nothing
        first = []
    return spark.createDataFrame([(i, r["cells"]) for i, r in enumerate(first)], schema)
