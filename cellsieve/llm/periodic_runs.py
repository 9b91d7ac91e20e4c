"""Periodic runs of words: maximal repetitions of a text, found in tiles of every period octave.

A run is a stretch of words with smallest period q that is at least ``max(MIN_WORDS, 2 * q)`` long and cannot be extended.

1. *Tiles.* Periods are dealt with by octaves ``[2^k, 2^(k+1))``. In octave k boundaries lie ``2^k`` words apart, and a tile
   reaches ``2^k`` words before its boundary and ``2^(k+2)`` after it. The tiles of a text overlap, and each
   can be solved alone. A run repeats its first ``MIN_WORDS / 2`` words one period later, so tiles without a window of
   so many words that comes back within the octave's reach hold none and are not made; most texts have no tile.
2. *Boundary Z-functions.* For a boundary b one Z-function gives for every period how far the words after b agree with those one
   period later, another one, of the reversed words, how far those before b do. Where both together are a period at
   least, they are a stretch with that period. The first boundary in a run finds its start, since
   it is less than ``2^k`` words away; those after it overlap by a period at least. Tiles of the octaves below ``2^LOW``
   compare the words with themselves one period later, for all boundaries at once.
3. *Stitching.* Fragments go to the key (document, period); overlapping by a period at least, they are one stretch. Of
   equal stretches of a document the smallest period stays (the others are multiples of it).

Tiles of ``SPAN`` boundaries are solved where the text is read; of texts longer than ``LONG`` words they are dealt to other tasks
as rows, so no task solves all octaves of a text of any length. Texts without any fragment are finished in the same pass;
only the others are kept for the last step.

Words are compared by their numbers within the text, so nothing depends on hashes but which tiles are made (equal windows have equal
hashes). Defined results: null and empty texts have no words and no runs; null ids plant nothing; rows equal in id and text give
equal rows; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellsieve.llm.base import sliced
from cellsieve.scratch import write_table

MIN_WORDS = 12
#: Octaves below compare words one period apart directly.
LOW = 4
#: Boundaries in a tile row.
SPAN = 32
#: Tiles of texts with more words are dealt to other tasks.
LONG = 200_000
SLICE = 1 << 22

_ODD = np.random.default_rng(17).integers(1, 1 << 63, MIN_WORDS // 2, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

Fragment = tuple[int, int, int]  # period, first word, end (exclusive)


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document, by a checksum of its id, with a stretch repeated."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def comes_back(codes: np.ndarray) -> np.ndarray:
    """For every word the distance to the next equal window of ``MIN_WORDS / 2`` words, 0 for none."""
    size = MIN_WORDS // 2
    n = len(codes) - size + 1
    if n < 2:
        return np.zeros(max(n, 0), np.int64)
    hashes = np.zeros(n, np.uint64)
    wide = codes.astype(np.uint64)
    for k in range(size):
        hashes += (wide[k:k + n] + np.uint64(1)) * _ODD[k]
    hashes ^= hashes >> np.uint64(31)
    hashes *= _MIX
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    out = np.zeros(n, np.int64)
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def octaves(n: int) -> range:
    """Octaves with a period that ``n`` words can hold twice."""
    return range((n // 2).bit_length())


def tiles(n: int, back: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Octave, first and end boundary (in words) of the rows of tiles that may hold a run of ``n`` words."""
    at = np.flatnonzero(back)
    if not len(at):
        return
    gap = back[at]
    for k in octaves(n):
        near = at[gap < (2 << k)]
        if not len(near):
            continue
        step = 1 << k if k >= LOW else 1 << LOW
        # boundaries whose tile holds such a window, from one step before it to two after
        first = near // step
        wanted = np.unique(np.concatenate([first + d for d in range(-2, 3)]))
        wanted = wanted[(wanted >= 0) & (wanted * step < n)]
        breaks = np.flatnonzero(np.diff(wanted) > 1)
        for lo, hi in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks + 1, [len(wanted)]])):
            begin, stop = int(wanted[lo]), int(wanted[hi - 1]) + 1
            for b in range(begin, stop, SPAN):
                yield k, b * step, min(b + SPAN, stop) * step


def reach(k: int, first: int, stop: int, n: int) -> tuple[int, int]:
    """Words that a row of tiles needs."""
    step = 1 << max(k, LOW)
    return max(first - step, 0), min(stop + (4 << k) + step, n)


def z_function(word: list[int], upto: int) -> list[int]:
    """How many numbers from every place on agree with the beginning, for the places below ``upto``."""
    n = len(word)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        size = 0
        if i < right:
            size = z[i - left]
            if size < right - i:
                z[i] = size
                continue
            size = right - i
        while i + size < n and word[size] == word[i + size]:
            size += 1
        z[i] = size
        left, right = i, i + size
    return z


def _low_tile(codes: np.ndarray, k: int) -> Iterator[Fragment]:
    """Stretches of a tile with the periods of a low octave."""
    for q in range(1 << k, 2 << k):
        if len(codes) < 2 * q:
            return
        same = np.concatenate([[False], codes[q:] == codes[:-q], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(turns[::2].tolist(), turns[1::2].tolist()):
            if b - a >= q:
                yield q, a, b + q


def _boundary(codes: np.ndarray, b: int, k: int) -> Iterator[Fragment]:
    """Stretches with the periods of an octave around a boundary."""
    q0, n = 1 << k, len(codes)
    forth = z_function(codes[b:b + 4 * q0].tolist(), min(2 * q0, n - b))
    first = max(b - q0, 0)
    text = codes[first:b + 2 * q0][::-1].tolist()  # its place i holds word last - i
    last = first + len(text) - 1
    size = b - first
    # for period q the comparison of word b - 1 with word b + q - 1 is at place last - (b + q - 1)
    back = z_function([*codes[first:b][::-1].tolist(), -1, *text], size + 1 + max(last - b - q0 + 2, 0)) if size else []
    for q in range(q0, min(2 * q0, n - b)):
        after = forth[q]
        place = size + 1 + last - (b + q - 1)
        before = min(back[place], size) if size else 0
        if after + before >= q:
            yield q, b - before, b + q + after


def solved(codes: np.ndarray, base: int, k: int, first: int, stop: int) -> list[Fragment]:
    """Stitched fragments of a row of tiles; ``codes`` are the words from ``base`` on."""
    if k < LOW:
        found = list(_low_tile(codes, k))
    else:
        found = [f for b in range(first - base, min(stop - base, len(codes)), 1 << k) for f in _boundary(codes, b, k)]
    return stitched([(q, a + base, b + base) for q, a, b in found])


def stitched(fragments: list[Fragment]) -> list[Fragment]:
    """Fragments of a period that overlap by it at least become one; of equal stretches the smallest period stays."""
    out: dict[tuple[int, int], int] = {}
    q = start = stop = -1
    for p, a, b in [*sorted(fragments), (-1, 0, 0)]:
        if p == q and stop - a >= q:
            stop = max(stop, b)
            continue
        if q > 0:
            out[start, stop] = min(q, out.get((start, stop), q))
        q, start, stop = p, a, b
    return sorted((q, a, b) for (a, b), q in out.items())


def found_in(codes: np.ndarray) -> list[Fragment]:
    """Fragments of a text from all its tiles."""
    n, out = len(codes), []
    for k, first, stop in tiles(n, comes_back(codes)):
        lo, hi = reach(k, first, stop, n)
        out += solved(codes[lo:hi], lo, k, first, stop)
    return stitched(out)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words outside of all repetitions; ``runs`` are (start, length, period)."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k]


_FRAGMENT = pa.struct([("period", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())])
_TILE = pa.struct([("octave", pa.int32()), ("first", pa.int32()), ("stop", pa.int32()), ("base", pa.int32()), ("codes", pa.binary())])
_FRAGMENT_SQL = "struct<period:int,start:int,stop:int>"
_TILE_SQL = "struct<octave:int,first:int,stop:int,base:int,codes:binary>"


def _tiled(docs: DataFrame, plant: bool) -> DataFrame:
    """Texts with what their tiles give; ``words`` are kept where there is anything to stitch, else the digest is final.

    Tiles of long texts are rows of their own, with the ``row`` of their text.
    """
    names = ["row", "doc_id", "words", "fragments", "tile", "digest"]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(_FRAGMENT), _TILE, pa.string())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, SLICE, "text"):
                rows = []
                for row, doc_id, raw in zip(*[part.column(c).to_pylist() for c in ("row", "doc_id")],
                                            part.column("text").cast(pa.binary()).to_pylist()):
                    words = raw.split()
                    if plant:
                        words = planted(words, doc_id)
                    codes = numbers(words)
                    fragments, dealt = [], False
                    if len(words) > LONG:
                        for k, first, stop in tiles(len(codes), comes_back(codes)):
                            lo, hi = reach(k, first, stop, len(codes))
                            dealt = True
                            yield batch_of([(row, doc_id, None, None, {
                                "octave": k, "first": first, "stop": stop, "base": lo, "codes": codes[lo:hi].tobytes()}, None)])
                    else:
                        fragments = [{"period": q, "start": a, "stop": b} for q, a, b in found_in(codes)]
                    whole = b" ".join(words)
                    open_ = dealt or fragments
                    rows.append((row, doc_id, whole if open_ else None, fragments, None,
                                 None if open_ else hashlib.sha256(whole).hexdigest()))
                yield batch_of(rows)

    given = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(run, f"row long, doc_id long, words binary, fragments array<{_FRAGMENT_SQL}>, "
                                 f"tile {_TILE_SQL}, digest string")


def _dealt_tiles(tiled: DataFrame) -> DataFrame:
    """``row`` and fragments of the tiles of long texts, solved where they are dealt to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, tile = batch.column("row")[i].as_py(), batch.column("tile")[i].as_py()
                got = solved(np.frombuffer(tile["codes"], np.int32), tile["base"], tile["octave"], tile["first"], tile["stop"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(got), pa.int64()),
                     pa.array([{"period": q, "start": a, "stop": b} for q, a, b in got], _FRAGMENT)], ["row", "f"])

    each = tiled.where(F.col("tile").isNotNull()).select("row", "tile")
    return each.repartition("row", "tile.octave", "tile.first").mapInArrow(run, f"row long, f {_FRAGMENT_SQL}")


def stitched_runs(fragments: DataFrame) -> DataFrame:
    """``row`` and its sorted ``runs`` (start, length, period) from fragments of all tiles."""
    by_start = Window.partitionBy("row", "period").orderBy("start", "stop")
    reached = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reached - F.col("start") >= F.col("period"), 0).otherwise(1)
    groups = fragments.select("row", "f.*").withColumn("fresh", fresh).withColumn("nth", F.sum("fresh").over(
        by_start.rowsBetween(Window.unboundedPreceding, 0)))
    whole = groups.groupBy("row", "period", "nth").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    smallest = whole.groupBy("row", "start", "stop").agg(F.min("period").alias("period"))
    length = F.col("stop") - F.col("start")
    runs = smallest.where((length >= MIN_WORDS) & (length >= 2 * F.col("period")))
    # a text has fewer runs than words
    return runs.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", length.alias("length"), "period"))).alias("runs"))


RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")


def _described(words: bytes, runs: list[dict]) -> tuple:
    shown = [(r["start"], r["length"], r["period"]) for r in runs]
    kept = hashlib.sha256(b" ".join(kept_words(words.split(), shown))).hexdigest()
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in shown).encode()).hexdigest()
    if not shown:
        return 0, None, None, None, None, listed, kept
    start, length, period = min(shown, key=lambda r: (-r[1], r[0], r[2]))
    return len(shown), start, length, period, 1000 * length // period, listed, kept


def _stored(docs: DataFrame, plant: bool) -> tuple[DataFrame, DataFrame]:
    """Tiled texts with a row number, and the runs of each."""
    # written once: row numbers stay, and texts are read and tiled once
    tiled = write_table(_tiled(docs, plant), "tiled")
    fragments = tiled.select("row", F.explode("fragments").alias("f")).unionByName(_dealt_tiles(tiled))
    return tiled, stitched_runs(fragments)


def _with_runs(tiled: DataFrame, runs: DataFrame) -> DataFrame:
    """Texts that have something to stitch, with their runs; null where nothing came of it."""
    found = runs.withColumnRenamed("row", "_row")
    return tiled.where(F.col("words").isNotNull()).select("row", "doc_id", "words").join(
        found, F.col("row") == F.col("_row"), "left").select("doc_id", "words", "runs")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``length`` and ``period`` of every run of the texts as they are."""
    tiled, runs = _stored(docs, plant=False)
    return _with_runs(tiled, runs).select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.*")


def collapsed_report(docs: DataFrame) -> DataFrame:
    """Every document's runs, after the planted repetitions, and the digest of what is left without them."""
    tiled, runs = _stored(docs, plant=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, SLICE, "words"):
                told = [_described(w, r or []) for w, r in zip(part.column("words").to_pylist(), part.column("runs").to_pylist())]
                types = (pa.int64(),) * 5 + (pa.string(),) * 2
                columns = list(zip(*told)) or [()] * 7
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                    [c.split()[0] for c in RESULT.split(", ")])

    none = F.lit(None).cast("long")
    without = tiled.where(F.col("digest").isNotNull()).select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"), none.alias("start"), none.alias("length"), none.alias("period"),
        none.alias("exponent_milli"), F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"),
        F.col("digest").alias("collapsed_sha256"))
    return without.unionByName(_with_runs(tiled, runs).mapInArrow(run, RESULT))
