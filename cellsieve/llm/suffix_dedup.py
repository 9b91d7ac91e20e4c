"""Removal of byte strings that repeat anywhere in the corpus, by two-stage suffix sorting.

A byte is removed if a string of ``LENGTH`` (100) bytes that covers it also starts earlier: in a document with a
smaller id, or further left in the same one.

Only suffixes that can have a partner are sorted together:

1. Every string of 100 bytes has an anchor, the 32-byte gram in it with the smallest hash (the leftmost of
   equal ones). Consecutive strings with one anchor form a context, about 35 strings. Equal strings have
   equal anchors, so contexts are dealt by anchor. An anchor seen once is dropped. Of contexts that are equal as
   a whole all but the first are covered; within an Arrow batch they are recognised before anything is
   shuffled, so a passage shared by many documents sends one row per batch.
2. Different contexts of one anchor may still share strings. Their bytes are cut out of the documents and dealt by
   anchor and the 34 bytes left or right of it (every string has one of them). In each slice a suffix array over the
   strings' starts is built by two-stage sorting: suffixes not larger than their
   successor are sorted directly, eight bytes at a time; the rest are induced by one scan over the buckets of
   first bytes. Adjacent common prefixes of 100 or more give the equal strings; the earliest stays.
3. Covered ranges are merged per document and cut out.

Of an anchor with more than ``HOT`` different contexts step 2 compares hashes of 128 bits of the single strings: the earliest of
each comes from an aggregation combined map-side, the others from a join with it, so no slice and no task
holds the occurrences of a string. Step 1 streams the sorted rows of an anchor without holding them.

Defined results: null and empty texts have no bytes; shorter texts lose nothing; null ids come before all
others; rows with one id are ordered by a hash of their texts; rows equal in id and text are one document and get one
result each; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.llm.base import in_arrow, raw_texts, sliced
from cellsieve.scratch import write_table

LENGTH = 100
GRAM = 32
SIDE = 34  # GRAM + 2 * SIDE <= LENGTH: every string holds the side left or right of its anchor
WINDOW = LENGTH - GRAM + 1
CHUNK = 1 << 21
SLICE = 1 << 21
HOT = 50_000
#: Up to this many contexts or ranges (of three numbers, so about 50 MB) are broadcast to the texts, else texts are
#: shuffled.
BROADCAST_ITEMS = 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- anchors -------------------------------------------------------------------------------

def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every gram, by doubling."""
    out, size, power = _TABLE[raw], 1, int(_ODD)
    while size < GRAM:
        out = out[:-size] * np.uint64(power) + out[size:]
        size, power = size * 2, power * power % (1 << 64)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (width - size)], values[width - size:]) if size < width else values


def contexts(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of concatenated documents: document, first start, number of starts, anchor offset, anchor hash, digest.

    Starts and offsets are within the document.
    """
    parts = []
    begins = np.concatenate([[0], ends[:-1]])
    low = np.uint64((1 << 24) - 1)
    for at in range(0, max(len(raw) - LENGTH + 1, 0), CHUNK):
        part = raw[at:at + CHUNK + LENGTH - 1]
        grams = gram_hashes(part)
        # the place is within a chunk, so 24 bits hold it and the leftmost of equal hashes wins
        least = sliding_least((grams & ~low) | np.arange(len(grams), dtype=np.uint64), WINDOW)
        start = np.arange(len(least))
        doc = np.searchsorted(ends, start + at, side="right")
        inside = start + at + LENGTH <= ends[doc]
        start, doc, anchor = start[inside], doc[inside], (least[inside] & low).astype(np.int64)
        if not len(start):
            continue
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        last = np.concatenate([first[1:], [len(start)]]) - 1
        s, n, p, doc = start[first], last - first + 1, anchor[first], doc[first]
        digest = np.zeros(len(s), np.uint64)
        size = n + LENGTH - 1
        for step in range(-(-(WINDOW + LENGTH) // GRAM)):  # grams that cover the whole context
            digest ^= grams[s + np.minimum(step * GRAM, size - GRAM)]
            digest *= _ODD
            digest ^= digest >> np.uint64(31)
        digest ^= (n * 4096 + (p - s)).astype(np.uint64)
        digest *= _ODD
        digest ^= digest >> np.uint64(29)
        parts.append((doc, s + at - begins[doc], n, p - s, grams[p].view(np.int64), digest.view(np.int64)))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _packed(start: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << 16) | (n << 8) | offset


ROWS = "o long, tie long, place long, anchor long, digest long, covered boolean"


def _rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row per context; all but the first of equal ones are marked as covered."""
    order = batch.column("o").to_numpy(zero_copy_only=False)
    tie = batch.column("tie").to_numpy(zero_copy_only=False)
    texts = raw_texts(batch.column("text"))
    ends = np.cumsum([len(t) for t in texts])
    doc, start, n, offset, anchor, digest = contexts(np.frombuffer(b"".join(texts), np.uint8), ends)
    doc = doc.astype(np.int64)
    o, t, place = order[doc], tie[doc], _packed(start, n, offset)
    covered = np.zeros(len(doc), bool)
    by = np.argsort(anchor ^ (digest * np.int64(3)), kind="stable")
    same = (anchor[by[1:]] == anchor[by[:-1]]) & (digest[by[1:]] == digest[by[:-1]])
    again = np.zeros(len(by), bool)
    again[1:] |= same
    again[:-1] |= same
    some = by[again]
    some = some[np.lexsort((place[some], t[some], o[some], digest[some], anchor[some]))]
    a, b = some[1:], some[:-1]
    starts = np.ones(len(some), bool)
    starts[1:] = (anchor[a] != anchor[b]) | (digest[a] != digest[b])
    first = some[np.maximum.accumulate(np.where(starts, np.arange(len(some)), 0))]
    # a row equal in id and text is the same document again, not a later one
    covered[some] = (o[some] != o[first]) | (t[some] != t[first]) | (place[some] != place[first])
    # a covered row needs no anchor any more: it may go to any task
    anchor = np.where(covered, digest ^ (place * np.int64(-7046029254386353131)) ^ o, anchor)
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (o, t, place, anchor, np.where(covered, 0, digest), covered)],
        ["o", "tie", "place", "anchor", "digest", "covered"])


#: ``open``: to be compared with other contexts of its anchor; else covered as a whole.
EVENTS = "o long, tie long, place long, anchor long, open boolean"


def _events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by anchor, digest and occurrence. The state is the last row, and a first context in waiting."""
    last = None  # anchor, digest, o, tie, place
    waiting = None  # the only context of the running anchor so far, as (o, tie, place, anchor)
    several = False  # the running anchor has different contexts
    for batch in batches:
        o, tie, place, anchor, digest, covered = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        out = [(o[covered], tie[covered], place[covered], anchor[covered], np.zeros(int(covered.sum()), bool))]
        live = ~covered
        o, tie, place, anchor, digest = o[live], tie[live], place[live], anchor[live], digest[live]
        if len(o):
            before = [np.concatenate([[v], c[:-1]]) for v, c in zip(last or (0, 0, 0, 0, 0), (anchor, digest, o, tie, place))]
            new_anchor = anchor != before[0]
            new_digest = new_anchor | (digest != before[1])
            if last is None:
                new_anchor[0] = new_digest[0] = True
            equal = ~new_digest & (o == before[2]) & (tie == before[3]) & (place == before[4])  # the same row again
            again = ~new_digest & ~equal
            run = np.cumsum(new_anchor)  # 0: the anchor that ran before this batch
            kinds = np.bincount(run, new_digest, run[-1] + 1).astype(np.int64)
            kinds[0] += 2 if several else waiting is not None
            is_open = new_digest & (kinds[run] > 1)
            if waiting is not None and kinds[0] > 1 and not several:
                out.append(tuple(np.array([v]) for v in waiting) + (np.array([True]),))
            take = again | is_open
            out.append((o[take], tie[take], place[take], anchor[take], is_open[take]))
            # the last anchor may go on
            if run[-1] > 0 or kinds[0] > 1:
                waiting = None
            several = bool(kinds[-1] > 1)
            if not several and waiting is None:
                at = int(np.flatnonzero(new_digest)[-1])
                waiting = (o[at], tie[at], place[at], anchor[at])
            if several:
                waiting = None
            last = (anchor[-1], digest[-1], o[-1], tie[-1], place[-1])
        columns = [np.concatenate(c) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["o", "tie", "place", "anchor", "open"])


# --- suffix sorting ------------------------------------------------------------------------

def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one big-endian number."""
    return np.ndarray(shape=(len(raw) - 7,), dtype=">u8", buffer=raw.data, strides=(1,))


def sort_suffixes(raw: np.ndarray, wanted: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Positions marked in ``wanted``, in the order of their suffixes up to ``depth`` bytes.

    ``raw`` ends in at least ``depth + 16`` zero bytes. A suffix whose first byte is larger than its second is of the induced kind,
    all others are sorted directly. Suffixes that induce a wanted one are sorted along.
    """
    induced = np.zeros(len(raw), bool)
    induced[:-1] = raw[:-1] > raw[1:]
    needed = wanted.copy()
    front = np.flatnonzero(needed & induced)
    while len(front):  # as often as bytes fall in a row
        front = front[~needed[front + 1]] + 1
        needed[front] = True
        front = front[induced[front]]
    words = _words(raw)
    direct = np.flatnonzero(needed & ~induced)
    key = words[direct].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    direct, key = direct[order], key[order]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]])) if len(direct) else np.zeros(0, np.int64)
    for step in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1) if len(group) else group
        if not len(tied):
            break
        at = direct[tied]
        key = words[at + step].astype(np.uint64)
        order = np.lexsort((key, group[tied]))
        direct[tied], key = at[order], key[order]
        # tied places keep their groups' order, so groups split in place
        split = np.zeros(len(direct), bool)
        same_group = group[tied[1:]] == group[tied[:-1]]
        split[tied[1:]] = same_group & (key[1:] != key[:-1])
        split[1:] |= group[1:] != group[:-1]
        group = np.cumsum(split)
    buckets = np.searchsorted(raw[direct], np.arange(257))
    collected: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for byte in range(256):
        bucket = np.concatenate([*collected[byte], direct[buckets[byte]:buckets[byte + 1]]])
        if not len(bucket):
            continue
        bucket = bucket.astype(np.int64)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & induced[before]]
        first = raw[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else []
        for a, b in zip(cuts, [*cuts[1:], len(first)]):
            collected[first[a]].append(before[a:b])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def common_prefixes(raw: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to ``depth``; 0 for the first."""
    words = _words(raw)
    out = np.zeros(len(order), np.int64)
    at = np.arange(1, len(order))
    for step in range(0, depth, 8):
        if not len(at):
            break
        differ = words[order[at] + step].astype(np.uint64) ^ words[order[at - 1] + step].astype(np.uint64)
        equal_bytes = np.full(len(at), 8)
        for k in range(8):
            equal_bytes -= differ >= (np.uint64(1) << np.uint64(8 * k))
        out[at] += equal_bytes
        at = at[differ == 0]
    return np.minimum(out, depth)


def repeated_starts(parts: list[bytes], starts: np.ndarray, o: np.ndarray, tie: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """For each part, which of its first ``starts`` positions begin a string that begins earlier in another part.

    Earlier is by ``o``, ``tie`` and place (``base`` plus position).
    """
    raw = np.frombuffer(b"".join(parts) + bytes(LENGTH + 16), np.uint8)
    sizes = np.array([len(p) for p in parts])
    at = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(parts)), starts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(starts) - starts, starts)
    places = at[owner] + within
    wanted = np.zeros(len(raw), bool)
    wanted[places] = True
    order = sort_suffixes(raw, wanted)
    equal = common_prefixes(raw, order) >= LENGTH
    number = np.zeros(len(raw), np.int64)
    number[places] = np.arange(len(places))
    found = number[order]  # number of each start, in the order of suffixes
    group = np.cumsum(~equal)
    own = owner[found]
    place = base[own] + within[found]
    rank = np.lexsort((place, tie[own], o[own], group))
    group, found, own, place = group[rank], found[rank], own[rank], place[rank]
    later = np.zeros(len(rank), bool)
    later[1:] = group[1:] == group[:-1]
    covered = np.zeros(len(places), bool)
    covered[found[later]] = True
    return np.split(covered, np.cumsum(starts)[:-1])


# --- jobs ----------------------------------------------------------------------------------

PARTS = "key long, o long, tie long, base long, starts long, bytes binary"
SPANS = "o long, tie long, lo long, hi long"


def _cut_parts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The bytes of open contexts, left and right of the anchor's middle, with a key of anchor and side."""
    out: list[tuple] = []
    columns = [batch.column(n).to_pylist() for n in ("o", "tie", "wanted")]
    for raw, o, tie, wanted in zip(raw_texts(batch.column("text")), *columns):
        for item in wanted:
            place, hot = item["place"], item["hot"]
            start, n, offset = place >> 16, place >> 8 & 0xFF, place & 0xFF
            anchor = start + offset
            seed = item["anchor"] & 0xFFFFFFFFFFFFFFFF
            if hot:
                continue
            middle = min(max(anchor - SIDE + 1, start), start + n)  # starts before it hold the left side
            if middle > start:
                side = xxhash.xxh3_64_intdigest(raw[anchor - SIDE:anchor], seed)
                out.append((side, o, tie, start, middle - start, raw[start:middle - 1 + LENGTH]))
            if middle < start + n:
                side = xxhash.xxh3_64_intdigest(raw[anchor + GRAM:anchor + GRAM + SIDE], seed ^ 1)
                out.append((side, o, tie, middle, start + n - middle, raw[middle:start + n - 1 + LENGTH]))
    keys = np.array([r[0] for r in out], np.uint64).view(np.int64)
    types = [pa.int64()] * 4 + [pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), *[pa.array([r[i] for r in out], t) for i, t in enumerate(types, 1)]],
        ["key", "o", "tie", "base", "starts", "bytes"])


STRINGS = "h1 long, h2 long, o long, tie long, lo long"


def _cut_strings(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row per string of the open contexts of hot anchors."""
    hashes, out = [], []
    columns = [batch.column(n).to_pylist() for n in ("o", "tie", "wanted")]
    for raw, o, tie, wanted in zip(raw_texts(batch.column("text")), *columns):
        for item in wanted:
            if item["hot"]:
                start, n = item["place"] >> 16, item["place"] >> 8 & 0xFF
                for s in range(start, start + n):
                    hashes.append(xxhash.xxh3_128_digest(raw[s:s + LENGTH]))
                    out.append((o, tie, s))
    both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays(
        [pa.array(both[:, 0]), pa.array(both[:, 1]), *[pa.array([r[i] for r in out], pa.int64()) for i in range(3)]],
        ["h1", "h2", "o", "tie", "lo"])


def _later(strings: DataFrame) -> DataFrame:
    """Spans of all strings but the earliest of equal ones."""
    first = strings.groupBy("h1", "h2").agg(
        F.min(F.struct("o", "tie", "lo")).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first", "n")
    first = write_table(first, "first")
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    if first.count() * 2 <= BROADCAST_ITEMS:
        found = strings.join(F.broadcast(first), same)
    else:
        # strings that occur more than HOT times are at most one in HOT rows, the others are no large keys
        often = F.broadcast(first.where(F.col("n") > HOT))
        found = strings.join(often, same).unionByName(
            strings.join(often, same, "left_anti").join(first.where(F.col("n") <= HOT), same))
    return found.where(F.struct("o", "tie", "lo") != F.col("first")).select(
        "o", "tie", "lo", (F.col("lo") + LENGTH).alias("hi"))


def _spans_of(parts: list[tuple]) -> pa.RecordBatch:
    o, tie, base, starts = [np.array([p[i] for p in parts], np.int64) for i in range(4)]
    found = repeated_starts([p[4] for p in parts], starts, o, tie, base)
    rows: list[tuple[int, int, int, int]] = []
    for i, covered in enumerate(found):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            rows.append((o[i], tie[i], base[i] + a, base[i] + b - 1 + LENGTH))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["o", "tie", "lo", "hi"])


def _sorted_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts sorted by key: whole keys are collected into slices and sorted; a part alone has no partner."""
    ready: list[tuple] = []
    size = 0
    key, running = None, []
    for batch in batches:
        for k, *part in zip(*[c.to_pylist() for c in batch.columns]):
            if k != key:
                if len(running) > 1:
                    ready += running
                    size += sum(len(p[4]) for p in running)
                    if size >= SLICE:
                        yield _spans_of(ready)
                        ready, size = [], 0
                key, running = k, []
            running.append(part)
    if len(running) > 1:
        ready += running
    if ready:
        yield _spans_of(ready)


def _numbered(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, and the order of documents as ``o`` and ``tie``."""
    doc_id = F.col("doc_id").cast("long")
    given = docs.select(doc_id.alias("doc_id"), "text")
    several = given.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    # with unique ids nothing is left to decide, and a constant costs no space
    tie = F.lit(0).cast("long") if several.isEmpty() else F.coalesce(F.xxhash64("text"), F.lit(0).cast("long"))
    return given.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("o"), tie.alias("tie"))


def removed_ranges(numbered: DataFrame) -> DataFrame:
    """``(o, tie, runs)``: the maximal ranges of bytes to remove, of every document that has some."""
    rows = in_arrow(numbered.select("o", "tie", "text"), _rows, ROWS, SLICE)
    events = write_table(
        rows.repartition("anchor").sortWithinPartitions("anchor", "digest", "o", "tie", "place")
        .mapInArrow(_events, EVENTS), "events")
    opened = events.where("open").select("o", "tie", "place", "anchor")
    hot = write_table(opened.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(
        F.col("anchor").alias("_anchor"), F.lit(True).alias("hot")), "hot")
    # at most one in HOT rows is a hot anchor
    marked = opened.join(F.broadcast(hot), F.col("anchor") == F.col("_anchor"), "left").select(
        "o", "tie", F.struct("place", "anchor", F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = write_table(
        marked.groupBy("o", "tie").agg(F.collect_list("w").alias("wanted")).select(
            F.col("o").alias("_o"), F.col("tie").alias("_tie"), "wanted"), "wanted")
    texts = _beside_texts(numbered.dropDuplicates(["o", "tie"]) if _has_twins(numbered) else numbered, wanted).select(
        "text", "o", "tie", "wanted")
    parts = in_arrow(texts, _cut_parts, PARTS)
    shared = parts.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_slices, SPANS)
    if not hot.isEmpty():
        shared = shared.unionByName(_later(write_table(in_arrow(texts, _cut_strings, STRINGS), "strings")))
    start, n = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(0xFF))
    whole = events.where("not open").select("o", "tie", start.alias("lo"), (start + n - 1 + LENGTH).alias("hi"))
    spans = whole.unionByName(shared).groupBy("o", "tie").agg(
        F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    return write_table(spans.mapInArrow(_merged, RUNS), "runs")


RUNS = "_o long, _tie long, runs array<struct<lo:long,hi:long>>"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of a document that overlap or touch become one."""
    kind = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
    for batch in batches:
        out = []
        for lo, hi in zip(batch.column("lo"), batch.column("hi")):
            lo, hi = lo.values.to_numpy(), hi.values.to_numpy()
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            first = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
            last = np.concatenate([first[1:], [len(lo)]]) - 1
            out.append([{"lo": a, "hi": b} for a, b in zip(lo[first].tolist(), hi[last].tolist())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("o"), batch.column("tie"), pa.array(out, pa.list_(kind))], ["_o", "_tie", "runs"])


def _has_twins(numbered: DataFrame) -> bool:
    """Whether rows are equal in id and text; they would be cut twice."""
    return not numbered.groupBy("o", "tie").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _beside_texts(numbered: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    items = found.agg(F.sum(F.size(found.columns[2]) + 1)).first()[0] or 0
    side = F.broadcast(found) if items <= BROADCAST_ITEMS else found
    return numbered.join(side, (F.col("o") == F.col("_o")) & (F.col("tie") == F.col("_tie")), how)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def without_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id``, counts, ``kept_sha256`` and, if asked for, ``kept_text`` (bytes) of every document."""
    numbered = _numbered(docs)
    rows = _beside_texts(numbered, removed_ranges(numbered), "left").select("text", "doc_id", "runs")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for raw, doc_id, runs in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kept, at, gone = [], 0, 0
            for run in runs or []:
                kept.append(raw[at:run["lo"]])
                at = run["hi"]
                gone += run["hi"] - run["lo"]
            kept.append(raw[at:])
            rest = b"".join(kept)
            out.append((doc_id, len(raw), gone, len(runs or []), hashlib.sha256(rest).hexdigest(), rest if with_text else None))
        types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(types)],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    found = in_arrow(rows, work, KEPT)
    return found if with_text else found.drop("kept_text")
