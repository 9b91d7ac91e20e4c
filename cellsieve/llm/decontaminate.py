"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of digits, a-z and non-ASCII characters after lower-casing A-Z. A window is ten
consecutive words of a benchmark item, or all words of a shorter one. Every document window is hashed and
looked up among the hashes of the benchmark's windows; a hit counts only if the words themselves are equal.

One scan of the documents: windows are generated and probed inside one generated stage, and only hits,
plus one row per document, are shuffled by document. Everything is DataFrame functions, without Python.

The set is broadcast while it is below ``BROADCAST_BYTES`` (measured first); beyond that the windows are
joined by shuffle, with their own words only.

Defined results: null and empty texts have no words and are clean; null item ids are the item named ``null``; items of
one id are one item; items without words are ignored; equal rows and equal or null document ids are judged
row by row; empty tables give empty or clean results; only ``doc_id``, ``text`` and ``item_id``, ``text`` are read by
``contamination``, and ``clean_documents`` keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.scratch import write_table

WINDOW = 10
BROADCAST_BYTES = 200_000_000
#: ASCII characters outside words, capitals and small letters; separators become blanks.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text, in order; without a regular expression, which would take four times as long."""
    mapped = F.translate(F.coalesce(text, F.lit("")), BETWEEN + CAPITALS, " " * len(BETWEEN) + SMALL)
    return F.array_remove(F.split(mapped, " "), "")


def window_hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item``, ``len``, ``hash`` and ``words`` of every distinct window of every item, as a work table."""
    base = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("_words")
    ).where(F.size("_words") > 0)
    base = base.select("item", "_words", F.least(F.size("_words"), F.lit(window)).alias("len"))
    at = F.explode(F.sequence(F.lit(0), F.size("_words") - F.col("len"))).alias("_at")
    hashed = F.lit(None).cast("long")
    for n in range(1, window + 1):
        hashed = F.when(F.col("len") == n, window_hash(F.col("_words"), F.col("_at"), n)).otherwise(hashed)
    cut = F.array_join(F.slice("_words", F.col("_at") + 1, F.col("len")), " ")
    found = base.select("item", "len", "_words", at).select("item", "len", hashed.alias("hash"), cut.alias("words"))
    # nearly always 1: tells windows with equal hashes apart
    nth = F.dense_rank().over(Window.partitionBy("hash").orderBy("words", "len"))
    return write_table(found.distinct().withColumn("nth", nth), "windows")


def _hits(docs: DataFrame, keys: list[str], items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(*keys, n_words, pos, len, hash, nth)``, and the items of each ``(hash, nth)``.

    Every document has a row of its own with ``pos`` -1, and one per verified hit.
    """
    pairs = benchmark_windows(items, window)
    numbered = pairs.select(F.col("hash").alias("_hash"), F.col("words").alias("_item_words"), "nth").distinct()
    owners = pairs.select(F.col("hash").alias("_hash"), F.col("nth").alias("_nth"), "item")
    size = pairs.agg(F.collect_set("len").alias("lengths"), F.sum(F.octet_length("words") + 64).alias("bytes")).first()
    small = (size["bytes"] or 0) <= BROADCAST_BYTES
    words = docs.select(*keys, words_of(F.col("text")).alias("_words"))
    # an array of positions is opened, then hashes are computed in generated code
    at = words.select(*keys, "_words", F.explode(F.sequence(F.lit(-1), F.size("_words") - 1)).alias("pos"))
    at = at.where((F.col("pos") < 0) | (F.col("pos") <= F.size("_words") - min(size["lengths"], default=1)))
    probes = [
        F.struct(F.lit(n).alias("len"), F.when(
            (F.col("pos") >= 0) & (F.col("pos") <= F.size("_words") - n),
            window_hash(F.col("_words"), F.col("pos"), n)).alias("hash"))
        for n in sorted(size["lengths"]) or [1]
    ]
    n_words = F.size("_words").cast("long").alias("n_words")
    if len(probes) == 1:
        rows = at.select(*keys, n_words, "_words", "pos", probes[0].alias("_w"))
    else:
        rows = at.select(*keys, n_words, "_words", "pos", F.explode(F.array(*probes)).alias("_w"))
    rows = rows.select(*keys, "n_words", "_words", "pos", "_w.len", "_w.hash")
    cut = F.array_join(F.slice("_words", F.col("pos") + 1, F.col("len")), " ")
    if small:
        joined = rows.join(F.broadcast(numbered), F.col("hash") == F.col("_hash"), "left")
        hit = joined.where((F.col("pos") < 0) | (F.col("_item_words") == cut))
    else:
        # a document's own row gets a hash of its own, so that those rows are dealt evenly
        texts = rows.withColumn("_cut", F.when(F.col("pos") >= 0, cut)).drop("_words").withColumn(
            "hash", F.coalesce("hash", F.xxhash64(*keys, "n_words", F.rand(0))))
        joined = texts.join(numbered, F.col("hash") == F.col("_hash"), "left")
        hit = joined.where((F.col("pos") < 0) | (F.col("_item_words") == F.col("_cut")))
    hit = hit.select(*keys, "n_words", "pos", "len", "hash", "nth")
    return hit, F.broadcast(owners) if small else owners


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` and ``spans`` of every document.

    ``spans`` holds the word positions of the hit windows, ends exclusive.
    """
    # the number tells rows with equal ids apart, within this one scan
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), "text")
    hit, owners = _hits(rows, ["_row", "doc_id"], items, window)
    is_hit = F.col("pos") >= 0
    of_doc = hit.groupBy("_row", "doc_id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(is_hit, F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))))).alias("spans"),
        F.collect_set(F.when(is_hit, F.struct("hash", "nth"))).alias("_found"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("spans", start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["pos"], a["upto"]))).alias("n"),
        F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["n"])
    counted = of_doc.select("_row", "doc_id", "n_words", "spans", covered.cast("long").alias("n_hit"),
                            F.explode_outer("_found").alias("_w"))
    named = counted.join(
        owners, (F.col("_w.hash") == F.col("_hash")) & (F.col("_w.nth") == F.col("_nth")), "left")
    items_of = named.groupBy("_row", "doc_id").agg(
        F.first("n_words").alias("n_words"), F.first("n_hit").alias("n_hit"), F.first("spans").alias("spans"),
        F.array_sort(F.collect_set("item")).alias("_items"))
    return items_of.select(
        "doc_id", "n_words", "n_hit", F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a hit, with all their columns.

    Whether a document is hit depends on its text alone, so the hit texts' digests say which rows go.
    """
    digest = F.sha2(docs["text"], 256)
    hit, _ = _hits(docs.select(digest.alias("_digest"), "text"), ["_digest"], items, window)
    dirty = hit.where(F.col("pos") >= 0).select(F.col("_digest").alias("_dirty")).distinct()
    return docs.join(dirty, digest == dirty["_dirty"], "left_anti")
