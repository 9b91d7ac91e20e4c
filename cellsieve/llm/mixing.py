"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The documents of a source stand in one sequence: 16 shards after each other, seeded hash order within.
The sequence is cut into blocks of ``BLOCK_WORDS`` words. Blocks go to the sources by the highest
quotients target / (2 k + 1), then the blocks of a source to its shards by the same rule, which gives
an integer quota per shard. A quota of q blocks over n takes every block q // n times and a seeded
run of q % n consecutive blocks once more. A run is an interval of words, so what a document gives
is an intersection of intervals: blocks are never listed, and few documents are cut.

Positions come from sums over 256 hash cells of each shard, so no task holds a source or shard. The driver sees
one row per source and shard (16 times the sources), never rows that grow with documents.

Defined results: null texts and texts without words have size 0 and give nothing; a null source is a source
and comes last; a source of size 0 has target 0; equal rows are placed one after the other; an empty table
gives an empty result; ``doc_id``, ``text`` and ``source`` are read, and ``mixed_texts`` keeps all other columns.
A source ends within three blocks of its target (rounding, and the unfilled part of its last block), so blocks are short; as
they are never listed, their number costs nothing. Sequences of more than 10**17 words per source are not supported.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsieve.llm.base import in_arrow, word_count
from cellsieve.scratch import write_table

BLOCK_WORDS = 4
SHARDS = 16  # the first hexadecimal digit of the order key
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2  # times a source, and a document, is taken at most
SEED = "mix-0"


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: int = MOST) -> list[float]:
    """Shares of ``share`` times all sizes by weight, cut at ``most`` times a size, the excess shared again."""
    cut = [False] * len(sizes)
    while True:
        rest = share * sum(sizes) - sum(most * s for s, c in zip(sizes, cut) if c)
        weight = sum(w for w, c in zip(weights, cut) if not c)
        found = [float(most * s) if c else w * rest / weight for s, w, c in zip(sizes, weights, cut)]
        above = [i for i, t in enumerate(found) if not cut[i] and t > most * sizes[i]]
        if not above:
            return found
        for i in above:
            cut[i] = True


def sainte_lague(seats: int, votes: Sequence[float], caps: Sequence[int]) -> list[int]:
    """``seats`` dealt by the highest quotients votes / (2 k + 1); earlier entries win ties.

    No entry gets more than its cap. Most seats are dealt at once from a quotient that too few reach,
    the last ones one by one.
    """
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    if seats <= 0:
        return [0] * len(votes)

    def reach(quotient: float) -> list[int]:
        return [min(c, int((v / quotient + 1) / 2)) if v > 0 else 0 for v, c in zip(votes, caps)]

    low, high = 0.0, 2.0 * max(votes)
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        if sum(reach(middle)) > seats:
            low = middle
        else:
            high = middle
    dealt = [max(0, n - 1) for n in reach(high)]
    queue = [(-v / (2 * n + 1), i) for i, (v, n, c) in enumerate(zip(votes, dealt, caps)) if n < c and v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(dealt)):
        _, i = heapq.heappop(queue)
        dealt[i] += 1
        if dealt[i] < caps[i]:
            heapq.heappush(queue, (-votes[i] / (2 * dealt[i] + 1), i))
    return dealt


@dataclass(frozen=True)
class Mix:
    """Placed documents and, per source, its target and the intervals of words that are taken."""

    placed: DataFrame
    plan: DataFrame


def _order_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "/"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def _start(seed: str, source: str | None, shard: int, blocks: int) -> int:
    """Where the run of a shard begins."""
    import hashlib

    named = f"{seed}/{'null' if source is None else 's' + source}/{shard}"
    return int(hashlib.md5(named.encode()).hexdigest()[:12], 16) % blocks


def plan_source(source: str | None, shard_words: Sequence[int], blocks: int, block: int, seed: str) -> list[tuple]:
    """Intervals ``(from, to, times)`` of the word sequence of a source that takes ``blocks`` blocks."""
    edges = [0]
    for n in shard_words:
        edges.append(edges[-1] + n)
    total = edges[-1]
    first = [-(-e // block) for e in edges]  # a block belongs to the shard in which it starts
    counts = [b - a for a, b in zip(first, first[1:])]
    quotas = sainte_lague(blocks, counts, [MOST * n for n in counts])
    out = []
    for shard, (n, quota) in enumerate(zip(counts, quotas)):
        if not n or not quota:
            continue
        every, more = divmod(quota, n)
        start = _start(seed, source, shard, n)
        runs = [(0, n, every)] if every else []
        if more:
            runs.append((start, min(start + more, n), 1))
            if start + more > n:
                runs.append((0, start + more - n, 1))
        out += [((first[shard] + a) * block, min((first[shard] + b) * block, total), k) for a, b, k in runs]
    return out


def make_mix(docs: DataFrame, block: int = BLOCK_WORDS, seed: str = SEED, keep_text: bool = False) -> Mix:
    spark: SparkSession = docs.sparkSession
    text = F.col("text")
    key = _order_key(F.col("doc_id"), seed)
    inner = docs.select(
        F.struct("*").alias("_row") if keep_text else F.col("doc_id"),
        F.col("source").alias("_source"), key.alias("_key"), word_count(text).alias("size"),
        F.xxhash64(text).alias("_tie"))
    rows = write_table(
        inner.withColumn("_shard", F.conv(F.substring("_key", 1, 1), 16, 10).cast("int"))
        .withColumn("_cell", F.substring("_key", 2, 2)), "mix")
    cells = rows.groupBy("_source", "_shard", "_cell").agg(F.sum("size").alias("_words"))
    shards = cells.groupBy("_source", "_shard").agg(F.sum("_words").alias("words")).collect()
    words: dict[str | None, list[int]] = {}
    for r in shards:
        words.setdefault(r["_source"], [0] * SHARDS)[r["_shard"]] = r["words"]
    names = sorted(words, key=lambda s: (s is None, s or ""))
    sizes = [sum(words[s]) for s in names]
    goal = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(names))]) if names else []
    seats = sainte_lague(
        math.floor(SHARE * sum(sizes) / block + 0.5), goal, [MOST * -(-s // block) for s in sizes])
    plan = spark.createDataFrame(
        [(s, n, t, plan_source(s, words[s], q, block, seed)) for s, n, t, q in zip(names, sizes, goal, seats)],
        "_of string, source_size long, target double, runs array<struct<lo: bigint, hi: bigint, times: bigint>>")
    before = Window.partitionBy("_source").orderBy("_shard", "_cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(  # at most 4,096 rows of a source
        F.col("_source").alias("_s"), F.col("_shard").alias("_h"), F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    within = (
        Window.partitionBy("_source", "_shard", "_cell").orderBy("_key", "size", "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.sum("size").over(within)
    placed = rows.withColumn("_last", last).join(
        bases, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")) & (F.col("_cell") == F.col("_c")))
    placed = placed.withColumn("_to", F.col("_base") + F.col("_last")).withColumn("_from", F.col("_to") - F.col("size"))
    return Mix(placed, plan)


def _overlap(run: Column) -> Column:
    return F.greatest(F.lit(0), F.least(run["hi"], F.col("_to")) - F.greatest(run["lo"], F.col("_from")))


def taken_report(docs: DataFrame, block: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` of every document."""
    mix = make_mix(docs.select("doc_id", "text", "source"), block, seed)
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda sum_, run: sum_ + run["times"] * _overlap(run))
    return mix.placed.join(mix.plan, F.col("_source").eqNullSafe(F.col("_of"))).select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"))


_WORDS = regex.compile(rb"[^\x20\x09-\x0D]+")


def _pieces(raw: bytes, size: int, runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The taken parts of a text: for each time it is taken, its maximal runs of words."""
    out = []
    if all(lo == 0 and hi == size for lo, hi, _ in runs):
        return [raw] * sum(t for _, _, t in runs)
    ends = [m.span() for m in _WORDS.finditer(raw)]
    marks = [0] * (size + 1)
    for lo, hi, times in runs:
        marks[lo] += times
        marks[hi] -= times
    depth = 0
    open_at: list[int] = []
    for at, change in enumerate(marks):
        for _ in range(change):
            open_at.append(at)
        for _ in range(-change):
            lo = open_at.pop()
            out.append(raw if (lo, at) == (0, size) else raw[ends[lo][0]:ends[at - 1][1]])
        depth += change
    return sorted(out, key=len, reverse=True)


def mixed_texts(docs: DataFrame, block: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """The mix as documents: a row for each whole or partial copy that is taken.

    A part of a document keeps the spelling between its first and last word; ``n_chars``, where there is
    such a column, follows the text.
    """
    schema = docs.schema
    mix = make_mix(docs, block, seed, keep_text=True)
    run = F.transform("runs", lambda r: F.struct(
        (F.greatest(r["lo"], F.col("_from")) - F.col("_from")).alias("lo"),
        (F.least(r["hi"], F.col("_to")) - F.col("_from")).alias("hi"), r["times"].alias("times")))
    rows = (
        mix.placed.join(mix.plan, F.col("_source").eqNullSafe(F.col("_of")))
        .select(F.col("_row"), F.col("size"), F.filter(run, lambda r: r["lo"] < r["hi"]).alias("runs"))
        .where(F.size("runs") > 0)
    )
    flat = rows.select(
        F.col("_row.text").alias("_text"), "size", "runs", "_row")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        sizes, runs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        index, out = [], []
        for i, (raw, size, found) in enumerate(zip(texts, sizes, runs)):
            for piece in _pieces(raw, size, [(r["lo"], r["hi"], r["times"]) for r in found]):
                index.append(i)
                out.append(piece.decode())
        row = batch.column(3)
        columns = []
        for i, name in enumerate(schema.names):
            column = row.field(i).take(pa.array(index, pa.int64()))
            if name == "text":
                column = pa.array(out, column.type)
            elif name == "n_chars" and pa.types.is_integer(column.type):
                column = pa.array([len(t) for t in out]).cast(column.type)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return in_arrow(flat, work, schema)
