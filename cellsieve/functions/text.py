"""Text normalisation: strip, null tokens, keys, slugs."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every code point Python's str.strip() treats as whitespace.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Tokens that always mean "empty cell" (compared lower-cased).
NULL_TOKENS = ("", " ", "NA", "N/A", "NULL", "null", "n/a", "na", "-", "--")

# Texts an upstream tool writes for a missing cell.
MISSING_TEXTS = ("None", "NaN", "<NA>", "nan")

# Keys longer than this many bytes are shuffled as a digest.
KEY_DIGEST_BYTES = 64


def py_strip(value: Column) -> Column:
    """Strip Unicode whitespace on both ends (built-in trim only strips blanks).

    Values that begin and end with a printable ASCII character, which is nearly
    all of them, are returned without looking at what lies between.
    """
    first, last = F.substring(value, 1, 1), F.substring(value, -1, 1)
    plain = first.between("!", "~") & last.between("!", "~")
    return F.when(plain, value).otherwise(F.btrim(value, F.lit(PY_WHITESPACE)))


def safe_str(value: Column) -> Column:
    """Text of a cell, missing becomes the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def null_token_set(extra: Iterable[str] = ()) -> tuple[str, ...]:
    """Lower-cased null tokens; extra tokens only ever add to the fixed ones."""
    return tuple(sorted({t.lower() for t in NULL_TOKENS} | {str(t).lower() for t in extra}))


def is_null_token(stripped: Column, tokens: Sequence[str] | None = None) -> Column:
    """True where an already stripped value is one of the null tokens."""
    return F.lower(stripped).isin(*(tokens if tokens is not None else null_token_set()))


def norm_key(value: Column) -> Column:
    """Case-insensitive, strip-insensitive comparison key of a cell."""
    return F.lower(py_strip(safe_str(value)))


def normalize_column_name(name: Column) -> Column:
    """Header text as used when matching specifications to tables."""
    return norm_key(name)


def normalize_name(name: object) -> str:
    """Plan-time twin of :func:`normalize_column_name`."""
    return str(name).strip().lower()


def blank_missing(value: Column) -> Column:
    """Cells that spell out a missing value become the empty string."""
    return F.when(value.isin(*MISSING_TEXTS), F.lit("")).otherwise(value)


def composite_key(parts: Sequence[Column]) -> Column:
    """One text key for several cells.

    Every part is prefixed with its length, so different tuples never produce
    the same text. Long keys travel as a 256-bit digest: the shuffle then moves
    a bounded number of bytes per row whatever the cells hold.
    """
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.length(part).cast("string"), F.lit(":"), part]
    key = F.concat(*pieces)
    return F.when(F.octet_length(key) <= KEY_DIGEST_BYTES, key).otherwise(
        F.concat(F.lit("#"), F.sha2(key, 256))
    )


@F.pandas_udf(T.StringType())
def _ascii_fold(values: pd.Series) -> pd.Series:
    def fold(value):
        if value is None:
            return None
        return unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode("ascii")

    return values.map(fold)


def slugify(value: Column) -> Column:
    """Lower-case ASCII slug with single hyphens.

    Compatibility decomposition has no built-in, so only that step runs as an
    Arrow batch; ASCII-only values need no folding but take the same path so
    the plan holds a single evaluation.
    """
    folded = _ascii_fold(safe_str(value))
    words = F.lower(py_strip(F.regexp_replace(folded, r"[^\w\s\x1c-\x1f-]", "")))
    return F.regexp_replace(words, r"[-\s\x1c-\x1f]+", "-")
