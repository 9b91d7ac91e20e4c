"""What the operators share: words, statistics of a text, Arrow rows, labelled samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than the six ASCII white-space ones. ``bytes.split()`` cuts alike.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_arrow(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType,
             limit: int = 1 << 24, column: str | None = None) -> DataFrame:
    """One output batch per input batch of about ``limit`` bytes of ``column`` (else the first string column) at most.

    Arrow batches hold a number of rows whatever their length, so very long texts
    are handed on in smaller slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, limit, column):
                yield work(part)

    return docs.mapInArrow(run, schema)


def sliced(batch: pa.RecordBatch, limit: int = 1 << 24, column: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least.

    Measured is ``column``, else the first string column.
    """
    text = batch.column(column) if column else next((c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)
                 or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)), None)
    if batch.num_rows < 2 or text is None or batch.nbytes <= limit:
        yield batch
        return
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    ends = np.frombuffer(text.buffers()[1], dtype=np.int64 if wide else np.int32)
    ends = ends[text.offset:text.offset + len(text) + 1].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text; null is the empty text."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


# --- statistics of one text ----------------------------------------------------------------

SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
UPPER = np.arange(ord("A"), ord("Z") + 1)
LOWER = np.arange(ord("a"), ord("z") + 1)
DIGITS = np.arange(ord("0"), ord("9") + 1)
MARKS = np.frombuffer(b"!?.,;:", np.uint8)

#: Names of what ``text_statistics`` returns, in its order.
STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio",
    "digit_ratio", "mark_ratio", "distinct_ratio", "top_word_ratio", "log_words",
)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three words found twice or more, the first included."""
    n = len(ids)
    if n < 4:
        return 0
    width = int(ids.max()) + 1
    pairs = ids[:-1] * width + ids[1:]
    if width > 2_000_000:  # the third word would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * width + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    hit[:-2] |= often
    hit[1:-1] |= often
    hit[2:] |= often
    return int(hit.sum())


def text_statistics(raw: bytes) -> tuple[list[float], dict[bytes, int], np.ndarray]:
    """Statistics of a text, its distinct words with their numbers, and the word numbers in order."""
    words = raw.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(counts[0x80:0xC0].sum())  # code points
    word_chars = chars - int(counts[SPACES].sum())
    lines: set[bytes] = set()
    n_lines = n_dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in lines:
                n_dup += 1
            else:
                lines.add(line)
    repeat = repeated_words(ids)
    symbols = int(counts[SYMBOLS].sum())
    upper, lower = int(counts[UPPER].sum()), int(counts[LOWER].sum())
    top = int(np.bincount(ids).max()) if n else 0
    some, per_char = max(n, 1), max(word_chars, 1)
    return [
        n, word_chars, symbols, n_dup, repeat,
        word_chars / some, symbols / per_char, n_dup / max(n_lines, 1), repeat / some,
        upper / max(upper + lower, 1), int(counts[DIGITS].sum()) / per_char,
        int(counts[MARKS].sum()) / per_char, len(seen) / some, top / some, float(np.log1p(n)),
    ], seen, ids


# --- labelled samples ----------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Rows kept away from training: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """``(doc_id, text, label)`` of at most ``rows`` labelled documents outside the held-out part.

    The sample is the rows with the smallest hash of their id, so it does not depend on
    file order. It holds at most ``rows`` ids; their labels are small enough to broadcast.
    A document with several labels counts with the smallest, null labels do not count.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["_id"]).select("doc_id", "text", "label")


def bounded_collect(sample: DataFrame, rows: int) -> list:
    """At most ``rows`` rows on the driver, in an order that depends on their values only.

    Several documents may share a labelled id, so the sample is bounded once more.
    """
    order = [F.xxhash64("doc_id"), *[F.col(c) for c in sample.columns]]
    return sample.orderBy(*order).limit(rows).collect()
