"""XML files as a stream of tags: paths, counts and records, found by all splits at once.

Spark reads a file as pieces that end in ``>``, so that every tag is a piece and a large file has many splits. Where a split
starts depends on all tags before it. What a split does is found for every state it can be entered in (between tags, or inside
a comment, CDATA section, instruction, DOCTYPE or quoted attribute): how many open elements it closes, which it
leaves open and in which state it ends. One row per split and state is composed in the order of the file, which gives every split
the elements that are open where it starts. Then each is walked on its own with one stack, so memory goes with the depth.

Encodings must agree with ASCII in the characters of markup. Names are compared without their prefix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsieve.scratch import write_table

# States between two pieces; nothing well-formed follows DEAD.
NORMAL, COMMENT, CDATA, INSTRUCTION, DOCTYPE, DOUBLE, SINGLE, DEAD = range(8)
_CLOSING = {COMMENT: b"--", CDATA: b"]]", INSTRUCTION: b"?", DOCTYPE: b"]"}
_TAG = re.compile(rb"""<([^\s/"'<]++)(?:[^"'<]++|"[^"<]*+"|'[^'<]*+')*+""")
_ATTRIBUTES = re.compile(rb"""(?:[^"'<]++|"[^"<]*+"|'[^'<]*+')*+""")
_SELF = b""  # the name an empty element is closed by
_REMEMBERED = 20_000  # tags and names a worker keeps


def _after(piece: bytes, end: int) -> tuple[int, bool]:
    """State after a start tag whose attributes were read up to *end*, and whether it closes itself."""
    if end == len(piece):
        return NORMAL, piece.endswith(b"/")
    return {0x22: DOUBLE, 0x27: SINGLE}.get(piece[end], DEAD), False


def step(state: int, piece: bytes) -> tuple[int, bytes | None, bytes | None]:
    """State after a piece (without its ``>``), the name it opens and the name it closes."""
    if state == NORMAL:
        at = piece.find(b"<")
        if at < 0:
            return NORMAL, None, None
        kind = piece[at + 1:at + 2]
        if kind == b"/":
            return NORMAL, None, piece[at + 2:].rstrip()
        if kind == b"!" or kind == b"?":
            return _declaration(piece[at:]), None, None
        tag = _TAG.match(piece, at)
        if tag is None:
            return DEAD, None, None
        state, closed = _after(piece, tag.end())
        return state, tag[1], _SELF if closed else None
    if state in _CLOSING:
        inner = piece.rstrip() if state == DOCTYPE else piece
        return NORMAL if inner.endswith(_CLOSING[state]) else state, None, None
    if state == DEAD:
        return DEAD, None, None
    at, tag_at = piece.find(b'"' if state == DOUBLE else b"'"), piece.find(b"<")
    if tag_at >= 0 and not 0 <= at < tag_at:  # no attribute holds a `<`
        return DEAD, None, None
    if at < 0:
        return state, None, None
    state, closed = _after(piece, _ATTRIBUTES.match(piece, at + 1).end())
    return state, None, _SELF if closed else None


def _declaration(markup: bytes) -> int:
    if markup.startswith(b"<!--"):
        return NORMAL if len(markup) >= 6 and markup.endswith(b"--") else COMMENT
    if markup.startswith(b"<![CDATA["):
        return NORMAL if markup.endswith(b"]]") else CDATA
    if markup.startswith(b"<?"):
        return NORMAL if len(markup) > 2 and markup.endswith(b"?") else INSTRUCTION
    return DOCTYPE if b"[" in markup and not markup.rstrip().endswith(b"]") else NORMAL


class _Tags(dict):
    """What pieces between tags do, by their part from the first `<` on; the same few tags make up most of a file."""

    def __missing__(self, tail: bytes) -> tuple[int, bytes | None, bytes | None]:
        if len(self) >= _REMEMBERED:
            self.clear()
        done = self[tail] = step(NORMAL, tail)
        return done


_TAGS = _Tags()


def _stepped(state: int, piece: bytes) -> tuple[int, bytes | None, bytes | None]:
    """As ``step``, by what is remembered. A piece without a `<` is known by its last byte."""
    return _TAGS[piece[piece.find(b"<"):]] if state == NORMAL else step(state, piece)


class _Names(dict):
    """Names of elements by their bytes."""

    def __missing__(self, raw: bytes) -> str:
        if len(self) >= _REMEMBERED:
            self.clear()
        local = raw.rpartition(b":")[2]
        try:
            name = local.decode()
        except UnicodeDecodeError:
            name = local.decode("latin-1")
        self[raw] = name
        return name


_NAMES = _Names()


def _name(raw: bytes) -> str:
    return _NAMES[raw]


class Element:
    """An open element: where it was opened, its path and what its children are called."""

    __slots__ = ("name", "path", "start", "nth", "depth", "low", "high", "children")

    def __init__(self, name: str, above: Element | None, start: int, nth: int):
        self.name, self.start, self.nth = name, start, nth
        self.path, self.depth = (name, 0) if above is None else (f"{above.path}.{name}", above.depth + 1)
        self.low = self.high = None
        self.children = 0

    def add(self, name: str) -> None:
        self.children += 1
        if self.low is None:
            self.low = self.high = name
        elif name < self.low:
            self.low = name
        elif name > self.high:
            self.high = name

    @property
    def repeats(self) -> bool:
        return self.children > 1 and self.low == self.high


class Walk:
    """The open elements of one split while its pieces go by."""

    def __init__(self, file: str, start: int, state: int = NORMAL, opened: Sequence[tuple[str, int, int]] = ()):
        self.file, self.start, self.state, self.nth = file, start, state, 0
        self.stack: list[Element] = []
        for name, at, nth in opened:
            self.stack.append(Element(name, self.stack[-1] if self.stack else None, at, nth))

    def malformed(self, why: str) -> ValueError:
        return ValueError(f"{self.file} is not well-formed: {why}, {self.nth} tags after byte {self.start}")

    def take(self, piece: bytes) -> tuple[Element | None, Element | None]:
        """The elements that a piece opens and closes."""
        self.state, opens, closes = _stepped(self.state, piece)
        if self.state == DEAD:
            raise self.malformed("a tag cannot be read")
        self.nth += 1
        opened = closed = None
        if opens is not None:
            above = self.stack[-1] if self.stack else None
            opened = Element(_name(opens), above, self.start, self.nth)
            if above is not None:
                above.add(opened.name)
            self.stack.append(opened)
        if closes is not None:
            closed = self.stack.pop() if self.stack else None
            if closed is None or closes != _SELF and _name(closes) != closed.name:
                raise self.malformed("an end tag without its start tag")
        return opened, closed

    def end(self) -> None:
        if self.stack or self.state != NORMAL:
            raise self.malformed("it ends within an element")


def pieces(content: bytes) -> Iterator[bytes]:
    """The pieces of a document held in memory, one at a time."""
    if content[:2] in (b"\xff\xfe", b"\xfe\xff"):
        content = content.decode("utf-16").encode()
    at = 0
    while (end := content.find(b">", at)) >= 0:
        yield content[at:end]
        at = end + 1
    yield content[at:]


# --- files -------------------------------------------------------------------

def _key() -> Column:
    """A number for a file: paths beside every piece took two thirds of the time to hand pieces to Python."""
    return F.xxhash64(F.col("_metadata.file_path")).alias("file")


def _pieces_of(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    return spark.read.option("lineSep", ">").text(list(files)).select(
        _key(), F.col("_metadata.file_block_start").alias("start"),
        F.col("value").cast("binary").alias("piece"))


def _splits(batches: Iterator[pa.RecordBatch], names: dict[int, str] | None) -> Iterator[tuple[str, int, pa.Array, bool]]:
    """``file, start, pieces, last`` as they come: pieces of one split in one or more arrays, in order; *names* of the files by key."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, starts, found = batch.columns
        # where another split begins; most batches are of one
        turns = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(starts[1:], starts[:-1]))
        ends = [*(i + 1 for i in pc.indices_nonzero(turns).to_pylist()), len(found)]
        at = 0
        for end in ends:
            name = keys[at].as_py()
            key = (names[name] if names else name, starts[at].as_py())
            if held is not None:
                yield *held, held[:2] != key
            held = (*key, found.slice(at, end - at))
            at = end
    if held is not None:
        yield *held, True


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_OPEN = pa.list_(pa.struct([("name", pa.string()), ("at", pa.int64()), ("nth", pa.int64())]))
_EFFECT = pa.schema([("file", pa.string()), ("start", pa.int64()), ("entered", pa.int64()), ("left", pa.int64()),
                     ("closed", pa.int64()), ("opened", _OPEN)])
_OPEN_TYPE = "array<struct<name string, at bigint, nth bigint>>"
_EFFECT_TYPE = f"file string, start bigint, entered bigint, left bigint, closed bigint, opened {_OPEN_TYPE}"


def _only_tags(found: pa.Array) -> tuple[list, np.ndarray, np.ndarray] | None:
    """Of pieces after which all is between tags, entered there: the name that each different one opens, the change of depth by
    each, and which one every piece is. None if there are others, or too many."""
    tails = pc.replace_substring_regex(found, pattern="^[^<]+", replacement="").dictionary_encode()
    if len(tails.dictionary) > _REMEMBERED:
        return None
    done = [_TAGS[tail] for tail in tails.dictionary.to_pylist()]
    if any(state != NORMAL for state, _, _ in done):
        return None
    turns = np.array([(opens is not None) - (closes is not None) for _, opens, closes in done], np.int64)
    return [opens for _, opens, _ in done], turns, tails.indices.to_numpy()


def _may_close(state: int, found: pa.Array) -> bool:
    """Whether a piece may end the comment, CDATA section, instruction or DOCTYPE that all pieces stand in."""
    # blanks may follow the bracket that ends a DOCTYPE
    looks = pc.match_substring if state == DOCTYPE else pc.ends_with
    return pc.any(looks(found, _CLOSING[state])).as_py()


def _go_by_tags(way: list, tags: tuple[list, np.ndarray, np.ndarray], nth: int) -> None:
    """As ``_go``, of all pieces at once."""
    names, turns, which = tags
    turn = turns[which]
    depth = np.cumsum(turn)
    ends = max(0, -int(depth.min()))  # elements closed that were open before
    kept = max(0, len(way[3]) - ends)
    way[2] += ends - (len(way[3]) - kept)
    del way[3][kept:]
    least = np.minimum.accumulate(depth[::-1])[::-1]
    way[3].extend((names[which[i]], nth + 1 + i) for i in np.flatnonzero((turn == 1) & (depth <= least)).tolist())


def _go(way: list, found: list[bytes], nth: int) -> None:
    """Take a way (entered, state, closed, opened) through pieces of which *nth* came before."""
    _, state, closed, opened = way
    for nth, piece in enumerate(found, nth + 1):
        state, opens, closes = _TAGS[piece[piece.find(b"<"):]] if state == NORMAL else step(state, piece)
        if opens is not None:
            opened.append((opens, nth))
        if closes is not None:
            if opened:
                opened.pop()
            else:
                closed += 1
        if state == DEAD:
            break
    way[1:3] = state, closed


def _effects(batches: Iterator[pa.RecordBatch], names: dict[int, str] | None = None) -> Iterator[pa.RecordBatch]:
    """What each split does, for every state it can be entered in."""
    live: list[list] | None = None
    nth = 0
    for file, start, found, last in _splits(batches, names):
        if live is None:  # entered, state, closed, opened
            live = [[state, state, 0, []] for state in range(DEAD if start else COMMENT)]
            nth = 0
        tags = _only_tags(found)
        listed = None
        for way in live:
            if way[1] == NORMAL and tags is not None:
                _go_by_tags(way, tags, nth)
            elif way[1] not in _CLOSING or _may_close(way[1], found):
                listed = listed or found.to_pylist()
                _go(way, listed, nth)
        nth += len(found)
        live = [way for way in live if way[1] != DEAD]
        if last:
            yield _rows([(file, start, entered, left, closed,
                          [{"name": _name(name), "at": start, "nth": n} for name, n in opened])
                         for entered, left, closed, opened in live], _EFFECT)
            live = None


def _composed(effects: pd.DataFrame) -> pd.DataFrame:
    """Per split of one file the state and the open elements it is entered with; one row per split and state comes in."""
    out, state, stack = [], NORMAL, []
    file = effects["file"].iloc[0]
    for start, ways in effects.sort_values("start", kind="stable").groupby("start", sort=True):
        out.append((file, start, state, list(stack)))
        way = ways[ways["entered"] == state]
        closed = int(way["closed"].iloc[0]) if len(way) else 0
        if not len(way) or closed > len(stack):
            raise ValueError(f"{file} is not well-formed: tags after byte {start} do not fit those before")
        stack = stack[:len(stack) - closed] + list(way["opened"].iloc[0])
        state = int(way["left"].iloc[0])
    if stack or state != NORMAL:
        raise ValueError(f"{file} is not well-formed: it ends within an element")
    return pd.DataFrame(out, columns=["file", "start", "state", "opened"])


class XmlFiles:
    """The files under a path, and what is open where their splits start."""

    def __init__(self, spark: SparkSession, path: str | Sequence[str]):
        self.spark = spark
        listed = spark.read.format("binaryFile").load(path).select(
            "path", F.col("_metadata.file_path").alias("file"), "length", _key().alias("key")).collect()  # one row per file; contents are not read
        self.paths = {row["file"]: row["path"] for row in listed}
        names = {row["key"]: row["file"] for row in listed}
        if len(names) < len(self.paths):
            raise ValueError("two paths have the same 64-bit hash")
        self.names = names = spark.sparkContext.broadcast(names)
        conf = spark._jsparkSession.sessionState().conf()
        # a file up to this size is never cut
        whole = min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())
        cut = [row["path"] for row in listed if row["length"] > whole]
        self.entries: dict[tuple[str, int], tuple[int, list]] = {}
        if cut:
            composed = _pieces_of(spark, cut).mapInArrow(
                lambda batches: _effects(batches, names.value), _EFFECT_TYPE).groupBy("file").applyInPandas(
                _composed, f"file string, start bigint, state bigint, opened {_OPEN_TYPE}")
            # one row per split of the large files, as the driver lists them to plan the scan
            self.entries = {(row["file"], row["start"]): (row["state"], [tuple(o) for o in row["opened"]])
                            for row in composed.collect()}

    def is_cut(self, file: str) -> bool:
        return (file, 0) in self.entries

    def _entry(self):
        held = self.spark.sparkContext.broadcast(self.entries)

        def entry(file: str, start: int) -> Walk:
            state, opened = held.value.get((file, start), (NORMAL, ()))
            if start and (file, start) not in held.value:
                raise ValueError(f"{file} was cut at byte {start} after its splits had been read")
            return Walk(file, start, state, opened)

        return entry, lambda file: (file, 0) in held.value

    def places(self) -> tuple[DataFrame, DataFrame]:
        """Levels and paths of all files.

        Levels: ``file, at, nth, record_path, n`` of elements whose children share one name; of those that lie within one
        split, the first. Paths: ``file, found, n, at, nth``, elements of every path and where the first of them stands; under the
        empty path, what a reader that looks for tags only could take for markup.
        """
        entry, is_cut = self._entry()
        names = self.names
        schema = pa.schema([("file", pa.string()), ("kind", pa.string()), ("at", pa.int64()), ("nth", pa.int64()),
                            ("found", pa.string()), ("low", pa.string()), ("high", pa.string()), ("n", pa.int64())])

        def row(file, kind, e):
            return file, kind, e.start, e.nth, e.path, e.low, e.high, e.children

        def look(batches):
            walk = None
            for file, start, found, last in _splits(batches, names.value):
                if walk is None:
                    walk, first, counts, out = entry(file, start), None, {}, []
                for piece in found.to_pylist():
                    before = walk.state
                    opened, closed = walk.take(piece)
                    no_tag = opened is None and closed is None
                    if (no_tag or before or walk.state) and _hides_markup(before, walk.state, piece, no_tag):
                        counts.setdefault("", [0, start, walk.nth])[0] += 1
                    if opened is not None:
                        seen = counts.get(opened.path)
                        if seen is None:
                            seen = counts[opened.path] = [0, opened.start, opened.nth]
                        seen[0] += 1
                    if closed is not None:
                        if closed.start != start:
                            out.append(row(file, "part", closed))
                        elif closed.repeats and (first is None or closed.nth < first.nth):
                            first = closed
                if last:
                    if not is_cut(file):
                        walk.end()
                    out += [row(file, "part", e) for e in walk.stack]
                    if first is not None:
                        out.append(row(file, "level", first))
                    out += [(file, "path", at, nth, path, None, None, n) for path, (n, at, nth) in counts.items()]
                    yield _rows(out, schema)
                    walk = None

        found = write_table(_pieces_of(self.spark, list(self.paths.values())).mapInArrow(
            look, "file string, kind string, at bigint, nth bigint, found string, low string, high string, n bigint"), "xml-places")
        # an element that reaches over splits has its children counted in each
        over = found.where("kind = 'part'").groupBy("file", "at", "nth", "found").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).where("n > 1 AND low = high")
        whole = found.where("kind = 'level'")
        level = ["file", "at", "nth", F.concat_ws(".", "found", "low").alias("record_path"), "n"]
        paths = found.where("kind = 'path'").groupBy("file", "found").agg(
            F.sum("n").alias("n"), F.min(F.struct("at", "nth")).alias("_first"))
        return (whole.select(*level).unionByName(over.select(*level)),
                paths.select("file", "found", "n", "_first.at", "_first.nth"))

    def records(self, parts: Sequence[str], files: Sequence[str]) -> DataFrame:
        """``file, at, nth, record``: every element at the very path, which may leave out the root, as text.

        The text is one line free of comments, and CDATA sections are escaped, so that every `<` of it is a tag.

        Records within one split stay where they are; the parts of others meet by their record.
        """
        entry, _ = self._entry()
        names = self.names
        cut = any(file in files for file, _ in self.entries)
        schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("nth", pa.int64()), ("part", pa.int64()),
                            ("whole", pa.bool_()), ("record", pa.string())])

        def extract(batches):
            walk = None
            for file, start, found, last in _splits(batches, names.value):
                out = []
                if walk is None:
                    walk, record, text = entry(file, start), None, []
                    target = _target(walk.stack[0].name, parts) if walk.stack else None
                    if target is not None and len(walk.stack) > target[1] and walk.stack[target[1]].path == target[0]:
                        record = walk.stack[target[1]]  # goes on from the split before
                for piece in found.to_pylist():
                    before = walk.state
                    opened, closed = walk.take(piece)
                    if opened is not None and record is None:
                        if opened.depth == 0:
                            target = _target(opened.name, parts)
                        if opened.depth == target[1] and opened.path == target[0]:
                            record = opened
                            tag = piece[piece.index(b"<"):]
                            raw = _TAG.match(tag)[1]
                            piece = b"<" + raw.rpartition(b":")[2] + tag[1 + len(raw):]
                    if record is not None:
                        if closed is record:
                            piece = _plain_end(piece)
                        text.append(_as_plain(before, walk.state, piece))
                        if closed is record:
                            out.append((file, record.start, record.nth, start, record.start == start, _joined(text)))
                            record, text = None, []
                if last:
                    if record is not None:
                        out.append((file, record.start, record.nth, start, False, _joined(text)))
                    walk = None
                if out:
                    yield _rows(out, schema)

        found = _pieces_of(self.spark, [self.paths[file] for file in files]).mapInArrow(
            extract, "file string, at bigint, nth bigint, part bigint, whole boolean, record string")
        if not cut:
            return found.select("file", "at", "nth", "record")
        found = write_table(found, "xml-parts")
        over = found.where("NOT whole").groupBy("file", "at", "nth").agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("part", "record")))["record"], "").alias("record"))
        return found.where("whole").select("file", "at", "nth", "record").unionByName(over).orderBy("file", "at", "nth")


def _target(root: str, parts: Sequence[str]) -> tuple[str, int]:
    """The whole path of the records and their depth; a given path may start below the root."""
    names = list(parts) if parts[0] == root else [root, *parts]
    return ".".join(names), len(names) - 1


def _plain_end(piece: bytes) -> bytes:
    """The end tag of a record without its prefix."""
    before, slash, name = piece.rpartition(b"</")
    return before + slash + name.rpartition(b":")[2] if slash and not piece.endswith(b"/") else piece


def _hides_markup(before: int, after: int, piece: bytes, no_tag: bool) -> bool:
    """Whether a piece holds a `<` or `>` that is not markup."""
    if after in (DOUBLE, SINGLE) or before in _CLOSING:
        return b"<" in piece or after in (DOUBLE, SINGLE)
    return before == NORMAL and no_tag and piece.count(b"<") > 1


def _as_plain(before: int, after: int, piece: bytes) -> bytes:
    """The same content on one line, without comments, instructions and CDATA, and with `>` for the ends of tags only."""
    if before in (COMMENT, INSTRUCTION):
        return b""
    piece = piece.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    end = b"&gt;" if after in (DOUBLE, SINGLE) else b">"
    text = b""
    if before == NORMAL:
        at = piece.find(b"<")
        if at < 0:
            return piece.replace(b"\n", b"&#10;") + b"&gt;"
        text, piece = piece[:at].replace(b"\n", b"&#10;"), piece[at:]
        if piece[1:2] not in (b"!", b"?"):
            return text + piece.replace(b"\n", b" ") + end
        if not piece.startswith(b"<![CDATA["):
            return text
        piece = piece[9:]
    elif before != CDATA:
        return piece.replace(b"\n", b" ") + end
    inner = piece + b">" if after == CDATA else piece[:-2]
    for char, name in (b"&", b"&amp;"), (b"<", b"&lt;"), (b">", b"&gt;"), (b"\n", b"&#10;"):
        inner = inner.replace(char, name)
    return text + inner


def _joined(text: list[bytes]) -> str:
    return b"".join(text).decode("utf-8", "replace")
