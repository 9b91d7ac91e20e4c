"""Byte-level BPE as a monoid: texts are encoded in halves and joined, ids are decoded and concatenated up the tree.

``encode(a + b)`` follows from ``encode(a)`` and ``encode(b)`` and the text around the cut. Texts of up to ``LEAF`` characters are
leaves, given to the tokenizer library; above, neighbours are joined:

1. The window around the cut grows to the next certain ends of matches on both sides. A match of the splitting pattern never goes on
   from a character to white space after it, nor from a letter or digit to another kind of character, nor from other signs to a
   digit. Both sides have such ends at the same places as the whole text, so the ids outside the window are those of the
   whole text, and only the window is encoded again.
2. Where no such end is near (texts without blanks, long runs of blanks or signs), the matches of the window are found, short ones are
   encoded again, and a long match is put together from the ids that both sides have inside it: the bytes of the last ids of the left and the
   first of the right are merged again, in windows of doubling size, until the pairs of ids at both edges are *compatible*: merging
   their bytes gives these two ids. A row of ids whose neighbours are all compatible is what merging the
   whole gives: the first merge across two ids would happen in that pair alone too. So what lies outside is final.

Texts longer than ``PART`` characters are dealt to tasks in parts; rounds of grouped joins (``FAN`` parts a group) build the upper
tree in Spark, so no task encodes a whole text of any length. Decoding works the same way downwards.

Defined results: null is the empty text, which has no ids; strings that look like special tokens are text; equal rows give
equal rows; bytes that are not UTF-8 count as U+FFFD; an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellsieve.llm.base import raw_texts, sliced
from cellsieve.scratch import write_table

LEAF = 2048
PART = 1 << 20
FAN = 16
#: Ids that are decoded at once.
DECODED = 1 << 16
SLICE = 1 << 22
#: Characters looked at first on each side of a cut.
NEAR = 16

# The characters with the White_Space property.
WHITE = frozenset(
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

_KINDS: dict[str, str] = {}


def kind(char: str) -> str:
    """``S`` white space, ``L`` letter, ``N`` number, ``O`` other; ``?`` where libraries may disagree."""
    known = _KINDS.get(char)
    if known is None:
        category = unicodedata.category(char)
        if char in WHITE:
            known = "S"
        elif category == "Cn" or "\x1c" <= char <= "\x1f":  # not assigned yet; separators that some count as blanks
            known = "?"
        else:
            known = category[0] if category[0] in "LN" else "O"
        _KINDS[char] = known
    return known


#: Kinds of two neighbours between which a match always ends.
CERTAIN = frozenset(("LS", "NS", "OS", "LN", "LO", "NL", "NO", "ON"))


def certain(text: str, at: int) -> bool:
    return kind(text[at - 1]) + kind(text[at]) in CERTAIN


class Coder:
    """Ids of texts by a file of ranks and a splitting pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.longest = max(map(len, self.ranks))
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for piece, rank in self.ranks.items():
            self.bytes_of[rank] = piece
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.leaf, self.compatible = LEAF, {}

    # --- merging -----------------------------------------------------------------------------

    def merged(self, raw: bytes) -> list[int]:
        """Ids after all merges, lowest rank first, then leftmost; no look-up of the whole."""
        if len(raw) > self.longest:  # cannot be an id itself
            return self.core._encode_single_piece(raw)
        ranks, parts = self.ranks, [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            at = min(found)[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two ids gives the same two."""
        key = a << 32 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 200_000:
                self.compatible.clear()
            known = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.compatible[key] = known
        return known

    def spliced(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids of two neighbouring parts of one match, from the merged ids of both."""
        i, j = min(1, len(left)), min(1, len(right))
        while i and j:
            middle = self.merged(self.decode(left[len(left) - i:]) + self.decode(right[:j]))
            fits_left = i == len(left) or self.fits(int(left[-i - 1]), middle[0])
            fits_right = j == len(right) or self.fits(middle[-1], int(right[j]))
            if fits_left and fits_right:
                return np.concatenate([left[:len(left) - i], np.array(middle, np.uint32), right[j:]])
            if not fits_left:
                i = min(2 * i, len(left))
            if not fits_right:
                j = min(2 * j, len(right))
        return np.concatenate([left, right])

    # --- encoding ----------------------------------------------------------------------------

    def _direct(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), np.uint32)

    def encode(self, text: str) -> np.ndarray:
        """Halves are encoded alone and joined."""
        def node(start: int, stop: int) -> np.ndarray:
            if stop - start <= self.leaf:
                return self._direct(text[start:stop])
            middle = (start + stop) // 2
            return self.join(text, start, middle, stop, node(start, middle), node(middle, stop))

        return node(0, len(text))

    def join(self, text: str, start: int, cut: int, stop: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of ``text[start:stop]`` from those of its parts before and after ``cut``."""
        if start == cut or cut == stop:
            return right if start == cut else left
        a = b = cut
        while a > start and not certain(text, a):
            a -= 1
        while b < stop and not certain(text, b):
            b += 1
        if a == b:
            return np.concatenate([left, right])
        before = len(text[a:cut].encode())
        after = len(text[cut:b].encode())
        # ids of the left that lie in the window, counted from its end, and of the right from its start
        i = self._count(left[::-1], before)
        j = self._count(right, after)
        if b - a <= max(self.leaf, NEAR):
            middle = self._direct(text[a:b])
        else:
            middle = self._long(text[a:b], cut - a, left[len(left) - i:], right[:j])
        return np.concatenate([left[:len(left) - i], middle, right[j:]])

    def _count(self, ids: np.ndarray, size: int) -> int:
        """So many of the first ids have ``size`` bytes together."""
        step, done = 64, 0
        while True:
            ends = np.cumsum(self.lengths[ids[:step]])
            done = int(np.searchsorted(ends, size))
            if not size:
                return 0
            if done < len(ends):
                if ends[done] != size:
                    raise ValueError("an id crosses a certain end of a match")
                return done + 1
            if step >= len(ids):
                raise ValueError("ids do not cover their text")
            step *= 8

    def _long(self, text: str, cut: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of a long window from those of its parts before and after ``cut``."""
        if any(kind(c) == "?" for c in set(text)):
            return self._direct(text)
        known = [*self._pieces(text[:cut], 0, left), *self._pieces(text[cut:], len(text[:cut].encode()), right)]
        out, at, first = [], 0, 0
        for match in self.pattern.finditer(text):
            raw = match.group().encode()
            stop = at + len(raw)
            if len(raw) <= max(self.leaf, self.longest):
                out.append(np.array(self.core._encode_single_piece(raw), np.uint32))
            else:
                while known[first][1] <= at:
                    first += 1
                whole, k = np.zeros(0, np.uint32), first
                while k < len(known) and known[k][0] < stop:
                    for part in self._inside(*known[k], at, stop):
                        whole = self.spliced(whole, part)
                    k += 1
                out.append(whole)
            at = stop
        return np.concatenate(out)

    def _pieces(self, text: str, at: int, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Matches of a part of the window with their places in bytes and their ids."""
        ends = np.cumsum(self.lengths[ids])
        done, begin = 0, at
        for match in self.pattern.finditer(text):
            stop = begin + len(match.group().encode())
            upto = int(np.searchsorted(ends, stop - at)) + 1
            yield begin, stop, ids[done:upto]
            done, begin = upto, stop

    def _inside(self, begin: int, stop: int, ids: np.ndarray, lo: int, hi: int) -> Iterator[np.ndarray]:
        """Merged ids of the part of a match that lies between ``lo`` and ``hi``."""
        if len(ids) == 1:  # a whole match may be an id that no merge gives
            raw = self.decode(ids)[max(lo - begin, 0):min(hi, stop) - begin]
            yield np.array(self.merged(raw), np.uint32)
            return
        ends = begin + np.cumsum(self.lengths[ids])
        first = int(np.searchsorted(ends - self.lengths[ids], lo))
        last = max(int(np.searchsorted(ends, hi, side="right")), first)
        begins = ends[first] - self.lengths[ids[first]] if first < len(ids) else stop
        closes = ends[last - 1] if last > first else begins
        whole = self.decode(ids)
        if begin < lo < begins:
            yield np.array(self.merged(whole[lo - begin:min(begins, hi) - begin]), np.uint32)
        if last > first:
            yield ids[first:last]
        if closes < min(hi, stop) and closes >= lo:
            yield np.array(self.merged(whole[closes - begin:min(hi, stop) - begin]), np.uint32)

    # --- decoding ----------------------------------------------------------------------------

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: halves are decoded alone and concatenated."""
        if len(ids) > DECODED:
            middle = len(ids) // 2
            return self.decode(ids[:middle]) + self.decode(ids[middle:])
        if len(ids) < 64:
            return b"".join([self.bytes_of[i] for i in ids.tolist()])
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.flat[at].tobytes()


_CODERS: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One per Python worker."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = Coder(path, pattern)
    return _CODERS[path, pattern]


Finish = Callable[[Coder, list[np.ndarray]], list[pa.Array]]


def _parts_of_long(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``row``, ``doc_id`` and ``ids`` of texts that are encoded in parts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, doc_id, text = (batch.column(c)[i] for c in range(3))
                text = text.cast(pa.binary()).as_py().decode("utf-8", "replace")
                for k, at in enumerate(range(0, len(text), PART)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row.as_py()], pa.int64()), pa.array([doc_id.as_py()], pa.int64()), pa.array([k], pa.int64()),
                         pa.array([text[at:at + PART]])], ["row", "doc_id", "part", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*one.columns, pa.array([code.encode(one.column(3)[0].as_py()).tobytes()], pa.binary())],
                    ["row", "doc_id", "part", "text", "ids"])

    def join(table: pa.Table) -> pa.Table:
        code = coder(path, pattern)
        order = np.argsort(table.column("part").to_numpy())
        texts = [table.column("text")[int(k)].as_py() for k in order]
        ids = [np.frombuffer(table.column("ids")[int(k)].as_py(), np.uint32) for k in order]
        while len(ids) > 1:  # neighbours, level by level
            joined = [code.join(a + b, 0, len(a), len(a) + len(b), x, y)
                      for a, b, x, y in zip(texts[::2], texts[1::2], ids[::2], ids[1::2])]
            ids = joined + ids[len(ids) - len(ids) % 2:]
            texts = [a + b for a, b in zip(texts[::2], texts[1::2])] + texts[len(texts) - len(texts) % 2:]
        part = int(table.column("part")[0].as_py()) // FAN
        return pa.table([
            table.column("row")[:1], table.column("doc_id")[:1], pa.array([part], pa.int64()), pa.array(texts),
            pa.array([ids[0].tobytes()], pa.binary())], ["row", "doc_id", "part", "text", "ids"])

    columns = "row long, doc_id long, part long, text string"
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    # written once: the parts of a text keep their row
    cuts = write_table(given.mapInArrow(cut, columns), "parts")
    nodes = write_table(cuts.repartition("row", "part").mapInArrow(encode, f"{columns}, ids binary"), "nodes")
    while (nodes.agg(F.max("part").alias("last")).first()["last"] or 0) > 0:
        nodes = write_table(nodes.groupBy("row", F.expr(f"part div {FAN}")).applyInArrow(
            join, f"{columns}, ids binary"), "nodes")
    return nodes.select("doc_id", "ids")


def _each(docs: DataFrame, path: str, pattern: str, finish: Finish, columns: str) -> DataFrame:
    """``doc_id`` and what ``finish`` makes of the ids of every document."""
    names = [c.split()[0] for c in columns.split(", ")]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > PART

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            for part in sliced(batch, SLICE, "text"):
                ids = [code.encode(raw.decode("utf-8", "replace")) for raw in raw_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *finish(code, ids)], ["doc_id", *names])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = [np.frombuffer(batch.column("ids")[i].as_py(), np.uint32)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *finish(code, ids)], ["doc_id", *names])

    schema = f"doc_id long, {columns}"
    out = given.where(~is_long).mapInArrow(run, schema)
    long_texts = given.where(is_long)
    if long_texts.isEmpty():
        return out
    return out.unionByName(_parts_of_long(long_texts, path, pattern).mapInArrow(joined, schema))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian 32-bit numbers) of every document."""
    def finish(code: Coder, ids: list[np.ndarray]) -> list[pa.Array]:
        return [pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary())]

    return _each(docs, path, pattern, finish, "ids binary")


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ``doc_id`` and ``ids``; null ids give the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            for part in sliced(batch, SLICE, "ids"):
                texts = [code.decode(np.frombuffer(v or b"", "<u4")).decode("utf-8", "replace") for v in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``n_tokens`` and the digests of the ids and of the bytes they decode to."""
    def finish(code: Coder, ids: list[np.ndarray]) -> list[pa.Array]:
        return [
            pa.array([len(i) for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]),
            pa.array([hashlib.sha256(code.decode(i)).hexdigest() for i in ids])]

    return _each(docs, path, pattern, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string")
