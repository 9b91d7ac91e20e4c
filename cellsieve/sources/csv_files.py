"""CSV files as all-string tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve.functions.text import blank_missing, safe_str
from cellsieve.plans.rowid import position_in_file, tag_scan
from cellsieve.scratch import write_table
from cellsieve.sources.csv_records import csv_records, numbered_heads

# Delimiters considered, sample size and preview length.
DELIMITERS = ",;\t|"
FALLBACK_DELIMITER = ","
SNIFF_CHARS = 8192
PEEK_ROWS = 12
# Lines looked at per record of a preview.
PEEK_LINES = 64

_OVERFLOW = "_overflow"
# The JVM's names of the encodings in use.
_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1"}


def _file_heads(
    spark: SparkSession, path: str | Sequence[str], header_row: int = 0, delimiter: str | None = None
) -> DataFrame:
    """``path, encoding, delimiter, header, quoted_breaks`` of every file, in one pass over their lines.

    A file is UTF-8 when all its lines are, else Latin-1. A line with an odd number of quotes opens or ends a cell
    that holds a line break. Both are folded line by line in the JVM, so large files are split as usual. Of the first
    lines of a file, which one task reads in order, at most the sniffer's sample is kept; ``header`` holds the
    cells of its record *header_row* (blank lines are no records), null if the file has none.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value"),
    )
    quotes = F.octet_length("value") - F.octet_length(F.regexp_replace("value", '"', ""))
    folded = lines.groupBy("path").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("quoted_breaks")
    ).select(
        "path", F.when(F.col("utf8"), F.lit("utf-8")).otherwise(F.lit("latin-1")).alias("encoding"), "quoted_breaks"
    )

    def sniff(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        samples: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}
        filled: dict[str, int] = {}
        for batch in batches:
            for file, found in batch.groupby("path", sort=False)["line"]:
                kept = samples.setdefault(file, [])
                for line in found:
                    if sizes.get(file, 0) >= SNIFF_CHARS and filled.get(file, 0) > header_row:
                        break
                    kept.append(_decoded(line))
                    sizes[file] = sizes.get(file, 0) + len(kept[-1]) + 1
                    filled[file] = filled.get(file, 0) + bool(kept[-1].strip())
        out = []
        for file, kept in samples.items():
            sep = delimiter or sniff_delimiter("\n".join(kept) + "\n")
            kept[:1] = [kept[0].lstrip("\ufeff")]
            full = [line for line in kept if line.strip()]
            out.append((file, sep, _cells(full[header_row], sep) if len(full) > header_row else None))
        if out:
            yield pd.DataFrame(out, columns=["path", "delimiter", "header"])

    heads = lines.where("start = 0").select("path", F.col("value").cast("binary").alias("line"))
    sniffed = heads.mapInPandas(sniff, "path string, delimiter string, header array<string>")
    # One row per file on either side.
    return folded.join(sniffed, "path", "left").select(
        "path", "encoding", F.coalesce("delimiter", F.lit(delimiter or FALLBACK_DELIMITER)).alias("delimiter"), "header",
        "quoted_breaks"
    )


def _cells(record: str, delimiter: str) -> list[str]:
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=delimiter), [])


def _decoded(line: bytes) -> str:
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def detect_csv_dialect(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``path, encoding, delimiter`` of every file."""
    return _file_heads(spark, path).select("path", "encoding", "delimiter")


def sniff_delimiter(sample: str) -> str:
    try:
        return csv.Sniffer().sniff(sample[:SNIFF_CHARS], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return FALLBACK_DELIMITER


def repair_names(names: Sequence[str]) -> list[str]:
    """Unique column names: blanks are numbered, repeats get a counter."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(names):
        base = name.strip() or f"Unnamed: {i}"
        label = base
        while label in out:
            seen[base] = seen.get(base, 0) + 1
            label = f"{base}.{seen[base]}"
        out.append(label)
    return out


def _reader(spark: SparkSession, delimiter: str, encoding: str):
    return (
        spark.read.option("sep", delimiter)
        .option("encoding", _CHARSETS.get(encoding.lower(), encoding))
        .option("quote", '"')
        .option("escape", '"')
    )


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    delimiter: str | None = None,
    encoding: str | None = None,
    header_row: int = 0,
) -> DataFrame:
    """All cells as text, missing as the empty string, no value read as null.

    Files that differ in dialect or header are read group by group and united by
    column name. Large files are split, also those with line breaks in cells. Records with too many fields are an error, short ones are
    filled up. Rows above *header_row* are dropped from every file.
    """
    groups: dict[tuple, list[str]] = {}
    broken: dict[tuple, list[str]] = {}
    for file in _file_heads(spark, path, header_row, delimiter).collect():  # one row per file
        dialect = (file["delimiter"], encoding or file["encoding"])
        if file["quoted_breaks"]:
            broken.setdefault(dialect, []).append(file["path"])
            continue
        if file["header"] is None:
            raise _no_header(file["path"], header_row)
        groups.setdefault((*dialect, tuple(repair_names(file["header"]))), []).append(file["path"])
    if not groups and not broken:
        raise ValueError(f"no CSV lines under {path}")
    parts = [_scan_group(spark, files, *key, header_row) for key, files in sorted(groups.items())]
    for key, files in sorted(broken.items()):
        parts += _scan_broken(spark, files, *key, header_row)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.select(*[safe_str(F.col(f"`{c}`")).alias(c) for c in out.columns])


def _no_header(path: str, header_row: int) -> ValueError:
    return ValueError(f"no header: {path} has fewer than {header_row + 1} lines")


def _schema(names: Sequence[str]) -> T.StructType:
    # Values beyond the header land in an extra field.
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, _OVERFLOW]])


def _checked(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    too_long = F.raise_error(F.lit("CSV record has more fields than the header")).cast("boolean")
    rows = rows.where(F.when(F.col(_OVERFLOW).isNotNull(), too_long).otherwise(F.lit(True)))
    return rows.select(*[blank_missing(safe_str(F.col(f"`{n}`"))).alias(n) for n in names])


def _scan_group(spark, files, delimiter, encoding, names, header_row) -> DataFrame:
    reader = _reader(spark, delimiter, encoding).schema(_schema(names))
    if header_row == 0:
        rows = reader.option("header", True).csv(list(files))
    else:
        # Only the split at the start of a file holds the leading rows, and a
        # reader cannot number rows: the scan is stored once, tags included.
        tagged = write_table(tag_scan(reader.csv(list(files))), "csv")
        rows = position_in_file(tagged).where(F.col("_pos") > header_row)
    return _checked(rows, names)


def _scan_broken(spark, files, delimiter, encoding, header_row) -> list[DataFrame]:
    """Files with line breaks in cells, a table for each header."""
    records = write_table(csv_records(spark, files, delimiter, _CHARSETS.get(encoding.lower(), encoding)), "csv-records")
    heads = numbered_heads(records, header_row + 1).where(F.col("nth") == header_row + 1)
    groups: dict[tuple, list[tuple]] = {}
    found = set()
    for head in heads.collect():  # one row per file
        found.add(head["path"])
        names = tuple(repair_names(_cells(head["record"].lstrip("\ufeff"), delimiter)))
        groups.setdefault(names, []).append((head["path"], head["start"], head["line"]))
    for file in files:
        if file not in found:
            raise _no_header(file, header_row)
    out = []
    for names, of in sorted(groups.items()):
        # as many rows as there are files
        side = F.broadcast(spark.createDataFrame(of, "_path string, _start long, _line long"))
        below = records.join(side, F.col("path") == F.col("_path")).where(
            F.struct("start", "line") > F.struct("_start", "_line"))
        options = {"sep": delimiter, "quote": '"', "escape": '"'}
        rows = below.select(F.from_csv("record", _ddl(names), options).alias("r"))
        out.append(_checked(rows.select("r.*"), names))
    return out


def _ddl(names: Sequence[str]) -> str:
    quoted = [n.replace("`", "``") for n in [*names, _OVERFLOW]]
    return ", ".join(f"`{n}` string" for n in quoted)


def peek_rows(
    spark: SparkSession, path: str, n: int = PEEK_ROWS, delimiter: str | None = None, encoding: str | None = None
) -> DataFrame:
    """``row, cells`` of the first records of a file, the header included.

    Cells may hold line breaks. Without an *encoding* the lines read are UTF-8 if they all are, else Latin-1. An
    unreadable file gives no rows.
    """
    schema = "row int, cells array<string>"
    filled = F.length(F.btrim("value")) > 0
    try:
        # so many lines at most hold a preview of records with some line breaks
        lines = spark.read.text(path).where(filled).select(F.col("value").cast("binary").alias("v")).head(n * PEEK_LINES)
        raw = b"".join(bytes(r["v"]) + b"\n" for r in lines)
        text = raw.decode(encoding) if encoding else _decoded(raw)
    except Exception:  # a preview degrades to nothing
        return spark.createDataFrame([], schema)
    shown = text.lstrip("\ufeff").splitlines(keepends=True)
    sep = delimiter or sniff_delimiter("".join(shown[:n]))
    records = (r for r in csv.reader(shown, delimiter=sep) if r)
    return spark.createDataFrame([(i, r) for i, r in zip(range(n), records)], schema)
