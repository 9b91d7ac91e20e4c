"""Token ids as directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of every id; a bitmap
says which ids go on, and only those have a chunk on the next level. A directory of
counts per 512 bits makes the number of set bits before a position a look-up, so any
id is found by one step per level, without decoding a block.

File format: Parquet rows, one segment each, in ``part=`` order and, within, in ``segment`` order:
``part``, ``segment``, ``start`` (ids of the part before the segment), ``doc_ids``, ``lengths`` and ``codes``, the
segment's ids in the form above. A segment holds whole documents, about a million ids. Segments in order
hold the documents in ascending order of id, null first.

Documents are dealt to tasks by ranges of ids, each sorts its own (Spark spills where needed) and encodes
them as a stream. Words between white space are encoded alone and remembered, at most
``REMEMBERED`` of them and those of one slice: the tokenizer's normaliser and splitting never look across white space
(tested against whole texts). A slice's words are split and numbered in Arrow, looked up once per different word, and
their ids gathered from one array.

Defined results: a null or empty text has the end id only; equal ids are ordered by a hash of the text;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsieve.llm.base import sliced
from cellsieve.scratch import new_path, remove_at_exit

END_ID = 2
SEGMENT_IDS = 1 << 20
REMEMBERED = 800_000
#: Ids of remembered words.
REMEMBERED_IDS = 1 << 23
#: Bytes of text that are encoded together.
SLICE = 1 << 22
BLOCK_BITS = 512
MAGIC = b"DAC1"
PUNCTUATION = string.punctuation.encode()
#: Letters that no normal form changes and whose small ones are found alike everywhere.
PLAIN_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")

SEGMENTS = (
    "part int, segment int, start long, n_tokens long, doc_ids array<bigint>, lengths array<bigint>, codes binary"
)


def encode_codes(ids: np.ndarray) -> bytes:
    """Levels of chunks with continuation bitmaps and rank directories."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        chunks = (rest & 0xFF).astype(np.uint8)
        more = rest > 0xFF
        rest = rest[more] >> 8
        bits = np.packbits(more, bitorder="little").tobytes()
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.uint64) if len(more) else []
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8").tobytes()
        levels.append((len(chunks), chunks.tobytes(), bits, ranks))
        if not len(rest):
            break
    out = [MAGIC, struct.pack("<B", len(levels))]
    for n, chunks, bits, ranks in levels:
        out += [struct.pack("<QQQ", n, len(bits), len(ranks)), chunks, bits, ranks]
    return b"".join(out)


class Codes:
    """Random access to the ids of a segment."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        at, self.levels = 5, []
        for _ in range(raw[4]):
            n, n_bits, n_ranks = struct.unpack_from("<QQQ", raw, at)
            at += 24
            chunks = np.frombuffer(raw, np.uint8, n, at)
            bits = np.frombuffer(raw, np.uint8, n_bits, at + n)
            ranks = np.frombuffer(raw, "<u8", n_ranks // 8, at + n + n_bits)
            self.levels.append((chunks, bits, ranks))
            at += n + n_bits + n_ranks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, at: int) -> int:
        """Ids before ``at`` that go on to the next level."""
        _, bits, ranks = self.levels[level]
        block = at // BLOCK_BITS
        first = block * BLOCK_BITS
        inside = np.unpackbits(bits[first // 8:(at + 7) // 8], bitorder="little")[:at - first]
        return int(ranks[block]) + int(inside.sum())

    def __getitem__(self, at: int) -> int:
        if not 0 <= at < len(self):
            raise IndexError(at)
        value = shift = level = 0
        while True:
            chunks, bits, _ = self.levels[level]
            value |= int(chunks[at]) << shift
            if not bits[at // 8] >> (at % 8) & 1:
                return value
            at, shift, level = self._rank(level, at), shift + 8, level + 1

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, reached by rank, nothing before them is decoded."""
        start, stop = max(start, 0), min(stop, len(self))
        values = np.zeros(max(stop - start, 0), np.uint32)
        where, shift = np.arange(len(values)), 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start >= stop:
                break
            values[where] |= chunks[start:stop].astype(np.uint32) << shift
            more = np.unpackbits(bits[start // 8:(stop + 7) // 8], bitorder="little")
            more = more[start % 8:start % 8 + stop - start].astype(bool)
            if not more.any():
                break
            start = self._rank(level, start)
            where = where[more]
            stop, shift = start + len(where), shift + 8
        return values


def _visible_bytes() -> dict[int, str]:
    """The characters by which byte-level models show bytes: printable Latin-1 ones as they are, the others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Words:
    """Ids of words in flat arrays, found by the word's number."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.hits = np.zeros(1024, bool)  # met again in a later slice
        self.ids, self.used = np.zeros(4096, np.uint32), 0

    def _room(self, name: str, size: int) -> None:
        held = getattr(self, name)
        if size > len(held):
            grown = np.zeros(max(size, 2 * len(held)), held.dtype)
            grown[:len(held)] = held
            setattr(self, name, grown)

    def add(self, words: list[bytes], ids: list[list[int]]) -> None:
        """New words with their ids."""
        if not words:
            return
        first, stop = len(self.number), len(self.number) + len(words)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        upto = self.used + int(sizes.sum())
        for name, size in (("starts", stop), ("sizes", stop), ("hits", stop), ("ids", upto)):
            self._room(name, size)
        self.number.update(zip(words, range(first, stop)))
        self.sizes[first:stop] = sizes
        self.starts[first:stop] = self.used + np.cumsum(sizes) - sizes
        self.hits[first:stop] = False
        self.ids[self.used:upto] = np.fromiter(chain.from_iterable(ids), np.uint32, upto - self.used)
        self.used = upto

    def join(self, words: list[bytes], parts: list[list[bytes]]) -> None:
        """New words with the ids of known ones in a row; ``parts`` are as many lists of words."""
        at = np.stack([np.fromiter(map(self.number.__getitem__, p), np.int64, len(p)) for p in parts], axis=1)
        ids, ends = self.gathered(at.ravel())
        first, stop, upto = len(self.number), len(self.number) + len(words), self.used + len(ids)
        for name, size in (("starts", stop), ("sizes", stop), ("hits", stop), ("ids", upto)):
            self._room(name, size)
        self.number.update(zip(words, range(first, stop)))
        ends = ends[len(parts) - 1::len(parts)]
        self.sizes[first:stop] = np.diff(ends, prepend=0)
        self.starts[first:stop] = self.used + ends - self.sizes[first:stop]
        self.hits[first:stop] = False
        self.ids[self.used:upto] = ids
        self.used = upto

    def gathered(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and where each word ends."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.arange(total) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)], ends

    def forget(self) -> "Words":
        """Only the words met again, or nothing where these are most."""
        keep = np.flatnonzero(self.hits[:len(self.number)])
        out = Words()
        if 4 * len(keep) > 3 * REMEMBERED:
            return out
        names = list(self.number)
        ids, ends = self.gathered(keep)
        out.number = {names[k]: i for i, k in enumerate(keep.tolist())}
        out.sizes = self.sizes[keep]
        out.starts = ends - out.sizes
        out.hits, out.ids, out.used = np.zeros(len(keep), bool), ids, len(ids)
        return out


class Encoder:
    """Ids of texts by the given tokenizer.

    Words of ASCII are looked up in lower case, as the tokenizer lowers them anyway, and so are words of Latin letters, which it
    does not compose; other words stay as they are, because it composes them before it lowers them. A word that ends in a letter and
    punctuation is put together from both, which the tokenizer splits anyway. Texts that may hold a special token go
    through the tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        # tasks already use all cores; threads of small batches would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Words()
        self.shown = _visible_bytes()
        model = self.tokenizer.model
        suffix = getattr(model, "end_of_word_suffix", None)
        size = self.tokenizer.get_vocab_size()
        #: ids that end a word, where the model marks them
        self.ends = np.array([suffix in (self.tokenizer.id_to_token(i) or "") for i in range(size)]) if suffix else None
        probes = [*"abcdefghijklmnopqrstuvwxyz", "word", "tokenizers", "dont", "zzyzx", "abcdefghijklmnopqrstuvwxyz"]
        #: whether words of small ASCII letters pass normaliser and splitting unchanged
        self.direct = self._passes(probes)
        #: whether words of other small Latin letters pass as the bytes of UTF-8
        self.direct_bytes = self.direct and self._passes([chr(c) for c in range(0xDF, 0x100) if c != 0xF7] + ["größe", "élève", "añoüé"])

    def _passes(self, words: list[str]) -> bool:
        return all(self._model(w.encode()) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in words)

    def _model(self, word: bytes) -> list[int]:
        """Ids of a word by the tokenizer's model alone."""
        text = word.decode() if word.isascii() else word.decode("latin-1").translate(self.shown)
        return [t.id for t in self.tokenizer.model.tokenize(text)]

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.

        Small Latin letters go to the tokenizer's model at once where that was found to be the same. Other words of letters
        stay whole, so they go as one text and are told apart by their ends.
        """
        found: list[list[int]] = [[]] * len(words)
        letters, rest = [], []
        for i, word in enumerate(words):
            if self.direct and word.isalpha():  # of bytes: ASCII letters, here small ones
                found[i] = self._model(word)
            elif self.direct_bytes and PLAIN_LETTERS.fullmatch(word.decode()):
                found[i] = self._model(word)
            elif self.ends is not None and word.decode().lower().isalpha():
                letters.append(i)
            else:
                rest.append(i)
        ids = np.array(self._encode([" ".join([words[i].decode() for i in letters])])[0], np.uint32)
        stops = (np.flatnonzero(self.ends[ids]) + 1).tolist() if letters else []
        if len(stops) == len(letters):
            whole = ids.tolist()
            for i, a, b in zip(letters, [0, *stops], stops):
                found[i] = whole[a:b]
        else:
            rest += letters
        for i, got in zip(rest, self._encode([words[i].decode() for i in rest])):
            found[i] = got
        return found

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, word: bytes) -> tuple[bytes, ...]:
        """A word as it is looked up: in lower case where that changes nothing, punctuation at its end apart."""
        if word.isalpha():  # of bytes: ASCII letters
            return (word.lower(),)
        core = word.rstrip(PUNCTUATION)
        end = word[len(core):]
        if word.isascii():
            core = core.lower()
        elif PLAIN_LETTERS.fullmatch(core.decode()):
            core = core.decode().lower().encode()
        if core and end and (core[-1:].isalpha() or core.decode().lower()[-1].isalpha()):
            return core, end
        return (core + end,)

    def _learn(self, words: list[bytes]) -> None:
        known = self.known.number
        parts = [self._parts(w) for w in words]
        fresh = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in known]
        self.known.add(fresh, self._encode_words(fresh))
        left = [(w, p) for w, p in zip(words, parts) if w not in known]
        for n in (1, 2):
            some = [(w, p) for w, p in left if len(p) == n]
            if some:
                self.known.join([w for w, _ in some], [[p[k] for _, p in some] for k in range(n)])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null has none."""
        if len(self.known.number) > REMEMBERED or self.known.used > REMEMBERED_IDS:
            self.known = self.known.forget()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(special), "", texts))
        words = pc.dictionary_encode(split.flatten())
        several = _split(words.dictionary)
        numbers = np.fromiter(map(self.known.number.get, several, repeat(-1)), np.int64, len(several))
        missing = np.flatnonzero(numbers < 0)
        self.known.hits[numbers[numbers >= 0]] = True
        if len(missing):
            self._learn([several[k] for k in missing.tolist()])
            numbers[missing] = [self.known.number[several[k]] for k in missing.tolist()]
        ids, ends = self.known.gathered(numbers[words.indices.to_numpy()])
        per_text = np.cumsum(pc.list_value_length(split).to_numpy())
        stops = np.concatenate([[0], ends])[per_text].tolist()
        found = [ids[a:b] for a, b in zip([0, *stops], stops)]
        for i in np.flatnonzero(special).tolist():
            found[i] = np.array(self._encode([texts[i].as_py()])[0], np.uint32)
        return found


def _split(words: pa.Array) -> list[bytes]:
    """Words without blanks as bytes: one text of all, cut again, is several times faster than one by one."""
    if not len(words):
        return []
    row = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.large_binary()))
    return pc.binary_join(row, pa.scalar(b" ", pa.large_binary()))[0].as_py().split(b" ")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and tokenizer: what a task has remembered serves the next ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_codes(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of all documents, in ascending order of id, to ``path``."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer)
        end = struct.pack("<I", end_id)
        doc_ids, lengths, ids, held = [], [], [], 0
        segment = start = 0

        def closed() -> pa.RecordBatch:
            row = [[part], [segment], [start], [held], [doc_ids], [lengths],
                   [encode_codes(np.frombuffer(b"".join(ids), "<u4"))]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)],
                ["part", "segment", "start", "n_tokens", "doc_ids", "lengths", "codes"])

        for batch in batches:
            for slice_ in sliced(batch, SLICE, "text"):
                for doc_id, got in zip(slice_.column(0).to_pylist(), encode(slice_.column(1))):
                    doc_ids.append(doc_id)
                    lengths.append(len(got) + 1)
                    ids += [got.astype("<u4").tobytes(), end]
                    held += lengths[-1]
                    if held >= SEGMENT_IDS:
                        yield closed()
                        segment, start = segment + 1, start + held
                        doc_ids, lengths, ids, held = [], [], [], 0
        if doc_ids:
            yield closed()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(parts, F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"))
        .mapInArrow(run, SEGMENTS)
        .write.option("compression", "zstd").parquet(path)
    )


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files.

    The parts' sizes are one row per range of ids; their running sum is the only window over all.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("part").alias("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # as many rows as there are ranges
    rows = segments.join(F.broadcast(bases), F.col("part") == F.col("_part")).select(
        "codes", (F.col("_base") + F.col("start")).alias("start"), "doc_ids", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes = Codes(batch.column(0)[i].as_py())
                lengths = np.array(batch.column(3)[i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crcs = [
                    zlib.crc32(codes.slice(a, b).astype("<u4").tobytes()) for a, b in zip(begins.tolist(), ends.tolist())
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(batch.column(2)[i].as_py(), pa.int64()), pa.array(batch.column(1)[i].as_py() + begins),
                     pa.array(lengths), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored_codes(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Write to the shared folder and read back."""
    path = new_path(docs.sparkSession, "codes")
    write_codes(docs, tokenizer, path, end_id)
    remove_at_exit(docs.sparkSession, path)
    return read_codes(docs.sparkSession, path)
