"""Integer, number and boolean cells with Python literal grammar."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted spellings of a boolean cell.
BOOLEAN_TOKENS = ("true", "false", "yes", "no", "1", "0")
# Spellings that make a column look boolean during inference.
BOOLEAN_HINTS = ("true", "false", "yes", "no")
# Fixed value: longest decimal text Python converts to an int.
MAX_INT_DIGITS = 4300

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
INTEGER_PATTERN = rf"\A[+-]?{_DIGITS}\z"
_GROUPED_NUMBER = (
    rf"\A[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"
)

INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1


def _ungroup(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def is_integer(stripped: Column) -> Column:
    """Whole number text; a decimal point or exponent is not an integer."""
    few_digits = (F.octet_length(stripped) <= MAX_INT_DIGITS) | (
        F.length(F.regexp_replace(stripped, "[+_-]", "")) <= MAX_INT_DIGITS
    )
    return stripped.rlike(INTEGER_PATTERN) & few_digits


def _begins_and_ends(text: Column, first: tuple[str, str], last: tuple[str, str]) -> Column:
    """Cheap guard against what the JVM's readers trim or tolerate at either end."""
    return F.substring(text, 1, 1).between(*first) & F.substring(text, -1, 1).between(*last)


def integer_value(stripped: Column) -> Column:
    """The 64-bit value of an integer text; null when invalid or larger."""
    plain = _begins_and_ends(stripped, ("+", "9"), ("0", "9"))
    grouped = F.contains(stripped, F.lit("_")) & stripped.rlike(INTEGER_PATTERN)
    return F.coalesce(
        F.when(plain, stripped.try_cast("bigint")),
        F.when(grouped, _ungroup(stripped).try_cast("bigint")),
    )


def integer_as_double(stripped: Column, int64: Column) -> Column:
    """Statistics value of an integer cell, null where it exceeds a double."""
    wide = _ungroup(stripped).try_cast("double")
    return F.when(int64.isNotNull(), int64.cast("double")).otherwise(
        F.when(is_integer(stripped) & (F.abs(wide) < float("inf")), wide)
    )


def number_text_value(stripped: Column) -> Column:
    """Double value of a number text, infinite for very large ones, else null."""
    # Between such ends only hexadecimal literals are numbers to the JVM alone.
    plain = _begins_and_ends(stripped, ("+", "9"), (".", "9"))
    hexadecimal = F.contains(stripped, F.lit("x")) | F.contains(stripped, F.lit("X"))
    grouped = F.contains(stripped, F.lit("_")) & stripped.rlike(_GROUPED_NUMBER)
    return F.coalesce(
        F.when(plain & ~hexadecimal, stripped.try_cast("double")),
        F.when(grouped, _ungroup(stripped).try_cast("double")),
    )


def finite(value: Column) -> Column:
    """The value where it is finite, else null."""
    return F.when(F.abs(value) < float("inf"), value)


def number_value(stripped: Column) -> Column:
    """Finite double value of a number text, else null."""
    return finite(number_text_value(stripped))


def is_boolean(stripped: Column) -> Column:
    return F.lower(stripped).isin(*BOOLEAN_TOKENS)


def looks_boolean(stripped: Column) -> Column:
    return F.lower(stripped).isin(*BOOLEAN_HINTS)


def whole_bound(bound: int | float, below: bool) -> int | float | None:
    """Integer bound equivalent to *bound* for whole numbers.

    ``n < 2.5`` is ``n < 3`` and ``n > 2.5`` is ``n > 2``. Infinities stay
    floats; nothing is below or above NaN.
    """
    if isinstance(bound, float):
        if math.isnan(bound):
            return None
        if math.isinf(bound):
            return bound
        return math.ceil(bound) if below else math.floor(bound)
    return int(bound)


def beyond_wide(stripped: Column, bound: int | float, below: bool) -> Column:
    """Comparison of an integer text with a bound outside the 64-bit range."""

    def outside(value: Column, limit: Column) -> Column:
        return value < limit if below else value > limit

    text = _ungroup(stripped)
    limit = as_float(bound)
    coarse = outside(text.try_cast("double"), F.lit(limit))
    if isinstance(bound, float) or abs(bound) >= 10**38:
        return F.coalesce(coarse, F.lit(False))
    exact = outside(text.try_cast("decimal(38,0)"), F.lit(str(bound)).cast("decimal(38,0)"))
    return F.coalesce(exact, coarse, F.lit(False))


def as_float(bound: int | float) -> float:
    try:
        return float(bound)
    except OverflowError:
        return math.inf if bound > 0 else -math.inf


def integer_text(stripped: Column) -> Column:
    """Canonical decimal text of an integer cell (``+007`` prints ``7``)."""
    digits = F.regexp_replace(stripped, r"_|\A\+", "")
    bare = F.regexp_replace(digits, r"\A(-?)0+(?=[0-9])", "$1")
    return F.when(bare == "-0", F.lit("0")).otherwise(bare)


def float_text(value: Column) -> Column:
    """Text of a finite double as Python prints it (``1e7`` prints ``10000000.0``).

    Python prints the fewest digits that read back as the same value. The JVM may
    print one more, so 15 and 16 digits are tried first.
    """
    def digits(n: int) -> Column:
        return F.format_string(f"%.{n - 1}e", value)

    def reads_back(text: Column) -> Column:
        return text.try_cast("double") == value

    shortest = (
        F.when(reads_back(digits(15)), digits(15))
        .when(reads_back(digits(16)), digits(16))
        .otherwise(digits(17))
    )
    scientific = F.regexp_replace(shortest, r"\.?0*e", "e")
    positional = F.regexp_replace(
        shortest.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0*\z", "$1"
    )
    text, size = value.cast("string"), F.abs(value)
    plain = ~F.contains(text, F.lit("E")) & (F.length(text) < 17)
    return (
        F.when(plain, text)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )
