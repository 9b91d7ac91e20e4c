"""Full-match regular expressions written in Python's dialect."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Python's word characters: letters, all numbers and the underscore. Java's Unicode class has others.
_WORD = r"\p{L}\p{N}_"
_SAME_ESCAPES = set("dD") | set("nrtfv") | set("\\.^$*+?{}[]|()-/\"'#&~@!%,:;<>= _`")


def compiles(pattern: str) -> bool:
    """A pattern Python rejects is dropped from the specification's rules."""
    try:
        re.compile(pattern)
    except (re.error, OverflowError, RecursionError, TypeError):
        return False
    return True


def to_java(pattern: str) -> str | None:
    """The same pattern for the JVM, or None if it uses something we do not map."""
    flags = re.match(r"\(\?([is]+)\)", pattern)
    given = flags.group(1) if flags else ""
    if flags:
        pattern = pattern[flags.end():]
        if not pattern.isascii():
            return None  # the dialects fold other letters differently
    out: list[str] = []
    names: dict[str, str] = {}
    unicode_classes = False
    in_class = False
    i, n = 0, len(pattern)
    while i < n:
        ch = pattern[i]
        if ch == "\\":
            if i + 1 >= n:
                return None
            nxt = pattern[i + 1]
            if nxt == "Z" and not in_class:
                out.append(r"\z")
            elif nxt == "A" and not in_class:
                out.append(r"\A")
            elif nxt in "xu":
                width = 2 if nxt == "x" else 4
                digits = pattern[i + 2 : i + 2 + width]
                if not re.fullmatch("[0-9a-fA-F]{%d}" % width, digits):
                    return None
                out.append("\\" + nxt + digits)
                i += 2 + width
                continue
            elif nxt in "123456789" and not in_class and not pattern[i + 2 : i + 3].isdigit():
                out.append("\\" + nxt)
            elif nxt == "v":
                out.append(r"\x0B")  # in Java \v is a class
            elif nxt == "b" and in_class:
                out.append(r"\x08")
            elif nxt == "w":
                out.append(_WORD if in_class else f"[{_WORD}]")
            elif nxt == "W":
                if in_class:
                    return None
                out.append(f"[^{_WORD}]")
            elif nxt in "bB" and not in_class:
                one_side = f"(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}])"
                both_or_none = f"(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}])"
                out.append(f"(?:{one_side if nxt == 'b' else both_or_none})")
            elif nxt in "sSB":
                # Python's whitespace also holds the four separators below.
                if nxt == "s":
                    out.append(r"\s\x1c-\x1f" if in_class else r"[\s\x1c-\x1f]")
                elif nxt == "S" and not in_class:
                    out.append(r"[^\s\x1c-\x1f]")
                else:
                    return None
                unicode_classes = True
            elif nxt in _SAME_ESCAPES:
                unicode_classes = unicode_classes or nxt in "dD"
                out.append("\\" + nxt)
            else:
                return None
            i += 2
            continue
        if in_class:
            if ch == "]":
                in_class = False
                out.append("]")
            elif ch in "[&":
                out.append("\\" + ch)  # nested classes and intersections are Java only
            else:
                out.append(ch)
            i += 1
            continue
        if ch == "[":
            in_class = True
            out.append("[")
            i += 1
            if pattern[i : i + 1] == "^":
                out.append("^")
                i += 1
            if pattern[i : i + 1] == "]":
                out.append(r"\]")
                i += 1
            continue
        if ch == "(" and pattern[i + 1 : i + 2] == "?":
            rest = pattern[i + 2 :]
            named = re.match(r"P<([^>]+)>", rest)
            back = re.match(r"P=([^)]+)\)", rest)
            if named:
                names[named.group(1)] = f"g{len(names)}x"
                out.append(f"(?<{names[named.group(1)]}>")
                i += 2 + named.end()
                continue
            if back and back.group(1) in names:
                out.append(rf"\k<{names[back.group(1)]}>")
                i += 2 + back.end()
                continue
            if rest[:1] in (":", "=", "!", ">") or rest[:2] in ("<=", "<!"):
                out.append("(?")
                i += 2
                continue
            return None  # flags, conditionals and comments take the slower path
        if ch == ".":
            # Java's dot also stops at other line ends
            out.append("(?s:.)" if "s" in given else r"[^\n]")
            i += 1
            continue
        if ch == "$":
            out.append(r"(?=\n?\z)")
            i += 1
            continue
        out.append(ch)
        i += 1
    prefix = ("(?U)" if unicode_classes else "") + ("(?iu)" if "i" in given else "")
    return prefix + r"\A(?:" + "".join(out) + r")\z"


def _java_accepts(java: str) -> bool:
    """Plan-time check that the JVM compiles the translated pattern."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return False
    try:
        spark.sql("SELECT rlike('', :p) AS ok", args={"p": java}).collect()
    except Exception:  # any rejection just selects the slower path
        return False
    return True


def full_match(stripped: Column, pattern: str) -> Column:
    """True where the whole value matches *pattern*."""
    java = to_java(pattern)
    if java is not None and (_plain(java) or _java_accepts(java)):
        return stripped.rlike(java)

    @F.pandas_udf(T.BooleanType())
    def matches(values: pd.Series) -> pd.Series:
        compiled = re.compile(pattern)
        return values.map(lambda v: None if v is None else compiled.fullmatch(v) is not None)

    return matches(stripped)


def _plain(java: str) -> bool:
    """Patterns of classes, literals and simple repeats compile in both dialects."""
    return re.search(r"\(\?<[=!]|\{|\+\+|\*\+|\?\+|\\k", java) is None
