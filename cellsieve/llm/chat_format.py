"""Chat formatting by columnar byte assembly.

Template of a turn, in bytes::

    ### <role>\\n<text></turn>\\n

Control strings inside texts are escaped by a backslash: every backslash, ``###`` and ``</turn>`` of a text,
every backslash and line break of a role. Dropping the backslash restores them.

A batch of turns, sorted by conversation and turn, is formatted at once: numpy finds the bytes to escape,
segment lengths give offsets by cumulative sums, and headers, roles, texts and ends are scattered into one
preallocated buffer, which becomes the data buffer of the Arrow column without another copy. A row of
the output is a piece of a conversation: its formatted text, the number of its turns, and the loss mask as
code-point spans over the texts of assistant turns. A conversation that goes on in the next batch goes on
in its next piece, so no conversation has to fit into memory.

``read_back`` parses pieces as a stream and hashes turn by turn.

Defined results: null texts and roles are empty; null ``conv_id`` is one conversation; turns sort by number, null
first, then by role and text, so equal turns are repeated; a conversation without rows does not exist; an
empty table gives an empty result; only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsieve.llm.base import sliced
from cellsieve.scratch import new_path, remove_at_exit

HEAD = b"### "
AFTER_ROLE = b"\n"
END = b"</turn>\n"
LOSS_ROLE = b"assistant"

PIECES = (
    "conv_id long, piece long, n_turns long, formatted string, loss_from array<bigint>, loss_to array<bigint>"
)
#: One turn as it stands in the output; possessive, so it runs in linear time and constant space.
TURN = re.compile(rb"### ((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
ESCAPED = re.compile(rb"\\(.)", re.S)


def unescape(raw: bytes) -> bytes:
    return ESCAPED.sub(rb"\1", raw) if b"\\" in raw else raw


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a string column after each other, and their offsets; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _starts_with(raw: np.ndarray, offsets: np.ndarray, what: bytes) -> np.ndarray:
    """Where ``what`` starts and ends within one value."""
    found = np.zeros(len(raw), bool)
    if len(raw) >= len(what):
        inside = raw[:len(raw) - len(what) + 1] == what[0]
        for i in range(1, len(what)):
            inside &= raw[i:len(raw) - len(what) + 1 + i] == what[i]
        at = np.flatnonzero(inside)
        ends = offsets[np.searchsorted(offsets, at, side="right")]
        found[at[at + len(what) <= ends]] = True
    return found


def _escaped(raw: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes to write, how far each is shifted by backslashes, and the new lengths of the values."""
    before = np.concatenate([[0], np.cumsum(marks)])
    lengths = np.diff(offsets) + before[offsets[1:]] - before[offsets[:-1]]
    return before, lengths, marks


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array) -> dict:
    """Formatted bytes of turns sorted by conversation number ``conv`` (0, 0, 1, ...), and their places."""
    role_raw, role_at = _bytes_of(role)
    text_raw, text_at = _bytes_of(text)
    role_marks = (role_raw == ord("\\")) | (role_raw == ord("\n"))
    text_marks = (text_raw == ord("\\")) | _starts_with(text_raw, text_at, b"###") | _starts_with(
        text_raw, text_at, b"</turn>")
    role_before, role_len, _ = _escaped(role_raw, role_at, role_marks)
    text_before, text_len, _ = _escaped(text_raw, text_at, text_marks)
    turn_len = len(HEAD) + role_len + len(AFTER_ROLE) + text_len + len(END)
    turn_at = np.concatenate([[0], np.cumsum(turn_len)])
    out = np.zeros(int(turn_at[-1]), np.uint8)

    def constant(what: bytes, at: np.ndarray) -> None:
        for i, byte in enumerate(what):
            out[at + i] = byte

    def scatter(raw, offsets, before, marks, at) -> None:
        sizes = np.diff(offsets)
        # a byte lands at its value's place, plus its place in the value, plus the backslashes before it
        shift = np.repeat(at - offsets[:-1] - before[offsets[:-1]], sizes)
        place = np.arange(len(raw)) + shift + before[1:]
        out[place] = raw
        out[place[marks] - 1] = ord("\\")

    role_to = turn_at[:-1] + len(HEAD)
    text_to = role_to + role_len + len(AFTER_ROLE)
    constant(HEAD, turn_at[:-1])
    scatter(role_raw, role_at, role_before, role_marks, role_to)
    constant(AFTER_ROLE, role_to + role_len)
    scatter(text_raw, text_at, text_before, text_marks, text_to)
    constant(END, text_to + text_len)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    first = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1]) if len(conv) else np.zeros(0, np.int64)
    return {"bytes": out, "turn_at": turn_at, "text_to": text_to, "text_len": text_len, "points": points, "first": first}


def format_turns(turns: DataFrame) -> DataFrame:
    """``PIECES`` of all conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, piece = object(), 0
        for whole in batches:
            # either column may hold what is long
            chosen = whole.select(["conv_id", "role", "text"])
            for batch in (b for part in sliced(chosen, column="role") for b in sliced(part, column="text")):
                ids = batch.column("conv_id").to_pylist()
                changes = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
                conv = np.zeros(len(ids), np.int64)
                conv[changes] = 1
                made = assemble(np.cumsum(conv), batch.column("role"), batch.column("text"))
                starts = made["first"]
                ends = np.append(starts[1:], len(ids))
                is_loss = np.array([r == "assistant" for r in batch.column("role").to_pylist()])
                points = made["points"]
                rows = []
                for a, b in zip(starts.tolist(), ends.tolist()):
                    piece = piece + 1 if ids[a] == last else 0
                    last = ids[a]
                    base = points[made["turn_at"][a]]
                    loss = np.flatnonzero(is_loss[a:b]) + a
                    begin = made["text_to"][loss]
                    rows.append((ids[a], piece, b - a, points[begin] - base,
                                 points[begin + made["text_len"][loss]] - base))
                offsets = made["turn_at"][np.append(starts, len(ids))].astype(np.int32)
                formatted = pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(made["bytes"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                     pa.array([r[2] for r in rows], pa.int64()), formatted,
                     pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                     pa.array([r[4] for r in rows], pa.list_(pa.int64()))],
                    ["conv_id", "piece", "n_turns", "formatted", "loss_from", "loss_to"])

    ordered = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    return (
        turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .repartition("conv_id").sortWithinPartitions(*ordered)
        .select("conv_id", "role", "text").mapInArrow(run, PIECES)
    )


READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, taken from its formatted text and loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for whole in batches:
            for batch in sliced(whole):
                done = []
                for conv_id, formatted, starts, ends in zip(*[c.to_pylist() for c in batch.columns]):
                    if now is None or now["conv_id"] != conv_id:
                        if now is not None:
                            done.append(now)
                        now = {"conv_id": conv_id, "turns": 0, "hash": hashlib.sha256(), "loss": 0,
                               "loss_hash": hashlib.sha256(), "chars": 0}
                    raw = formatted.encode()
                    at = 0
                    while at < len(raw):
                        turn = TURN.match(raw, at)
                        if turn is None:
                            raise ValueError(f"conversation {conv_id}: no turn at byte {at}")
                        now["hash"].update(unescape(turn[1]) + b"\n" + unescape(turn[2]) + b"\n")
                        now["turns"] += 1
                        at = turn.end()
                    for a, b in zip(starts, ends):
                        text = unescape(formatted[a:b].encode())
                        now["loss_hash"].update(text)
                        now["loss"] += len(text.decode())
                    now["chars"] += len(formatted)
                if done:
                    yield _digests(done)
        if now is not None:
            yield _digests([now])

    return (
        pieces.select("conv_id", "piece", "formatted", "loss_from", "loss_to")
        .repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "piece")
        .select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(run, READ)
    )


def _digests(done: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([d["conv_id"] for d in done], pa.int64()), pa.array([d["turns"] for d in done], pa.int64()),
         pa.array([d["hash"].hexdigest() for d in done]), pa.array([d["loss"] for d in done], pa.int64()),
         pa.array([d["loss_hash"].hexdigest() for d in done]), pa.array([d["chars"] for d in done], pa.int64())],
        ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def stored_chats(turns: DataFrame) -> DataFrame:
    """Format, write to the shared folder, read back."""
    spark: SparkSession = turns.sparkSession
    path = new_path(spark, "chats")
    format_turns(turns).write.parquet(path)
    remove_at_exit(spark, path)
    return read_back(spark.read.schema(PIECES).parquet(path))
