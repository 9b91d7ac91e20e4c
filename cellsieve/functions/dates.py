"""Date and datetime cells described by strptime formats.

Numeric formats become one anchored pattern whose groups are rearranged into
an ISO text and cast. With names of months and days, halves of days, days of the year or offsets the groups are
rearranged into a list of fields, from which one expression gives the local and another the UTC time. Weeks, names of
zones and the locale's own formats run through ``datetime.strptime`` in Arrow batches.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellsieve.functions.text import PY_WHITESPACE

# What each numeric directive may match, longest first.
_FIELD_PATTERNS = {
    "Y": "[0-9]{4}",
    "y": "[0-9]{2}",
    "m": "1[0-2]|0[1-9]|[1-9]",
    "d": "3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9]",
    "H": "2[0-3]|[01][0-9]|[0-9]",
    "M": "[0-5][0-9]|[0-9]",
    "S": "6[01]|[0-5][0-9]|[0-9]",
    "f": "[0-9]{1,6}",
}
# A field the format does not mention.
_FIELD_DEFAULTS = {"Y": "1900", "m": "01", "d": "01", "H": "00", "M": "00", "S": "00", "f": "0"}
_OTHER_DIRECTIVES = set("UwuVWGZcxX")

# Names in the C locale, and what directives beyond the numeric ones may match.
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
           "november", "december")
_DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
_NAMED_PATTERNS = {
    "a": "|".join(day[:3] for day in _DAYS),
    "A": "|".join(_DAYS),
    "b": "|".join(month[:3] for month in _MONTHS),
    "B": "|".join(_MONTHS),
    "p": "am|pm",
    "I": "1[0-2]|0[1-9]|[1-9]",
    "j": "36[0-6]|3[0-5][0-9]|[12][0-9][0-9]|0[1-9][0-9]|00[1-9]|[1-9][0-9]|0[1-9]|[1-9]",
    "z": r"[+-][0-9][0-9]:?[0-5][0-9](?::?[0-5][0-9](?:\.[0-9]{1,6})?)?|(?-iu:Z)",
}
_OFFSET = r"\A(?:Z|[+-][0-9]{4}(?:[0-9]{2}(?:\..+)?)?|[+-][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\..+)?)?)\z"
# Directives that set the same field: the last one in the format would count.
_SAME_FIELD = ("mbB", "HI", "Yy")
_PARTS = ("Y", "m", "d", "H", "M", "S", "f", "p", "j", "z")

# Formats whose canonical spelling Spark's own cast reads directly.
_ISO_SHAPES = {
    "%Y-%m-%d": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z",
    "%Y-%m-%d %H:%M": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}\z",
    "%Y-%m-%d %H:%M:%S": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z",
    "%Y-%m-%dT%H:%M:%S": r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z",
}


@dataclass(frozen=True)
class FormatPlan:
    """How one format is evaluated."""

    kind: str  # "never", "pattern", "parts" or "python"
    pattern: str = ""
    iso: str = ""  # of "parts": the fields in the order of _PARTS
    two_digit_year: bool = False
    codes: frozenset[str] = frozenset()


def plan_format(fmt: str) -> FormatPlan:
    """Compile a strptime format at plan time."""
    body: list[str] = []
    groups: dict[str, str] = {}
    group = 0
    literal_letters = False
    i = 0
    while i < len(fmt):
        ch = fmt[i]
        if ch == "%":
            i += 1
            if i >= len(fmt):
                return FormatPlan("never")
            code = fmt[i]
            if code == "%":
                body.append("%")
            elif code in groups:
                raise ValueError(f"directive %{code} appears twice in format {fmt!r}")
            elif code in _FIELD_PATTERNS:
                group += 1
                if code == "d":  # a blank-padded day is captured without the blank
                    body.append("(?:(3[01]|[12][0-9]|0[1-9]|[1-9])| ([1-9]))")
                    groups[code] = f"${group}${group + 1}"
                    group += 1
                elif code == "Y":
                    body.append("((?!0000)[0-9]{4})")
                    groups[code] = f"${group}"
                else:
                    body.append(f"({_FIELD_PATTERNS[code]})")
                    groups[code] = f"${group}"
            elif code in _NAMED_PATTERNS:
                group += 1
                body.append(f"((?iu:{_NAMED_PATTERNS[code]}))")
                groups[code] = f"${group}"
            elif code in _OTHER_DIRECTIVES:
                return FormatPlan("python")
            else:
                return FormatPlan("never")
        elif ch.isspace():
            while i + 1 < len(fmt) and fmt[i + 1].isspace():
                i += 1
            body.append(f"[{PY_WHITESPACE}]+")
        else:
            literal_letters = literal_letters or ch.isalpha()
            body.append(ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch)
        i += 1
    if not groups or any(sum(code in groups for code in same) > 1 for same in _SAME_FIELD):
        return FormatPlan("python")
    flags = "(?iu)" if literal_letters else ""
    # The match is taken greedily first and only then compared with the end.
    pattern = rf"{flags}\A(?>{''.join(body)})\z"
    two_digit = "y" in groups
    field = {**_FIELD_DEFAULTS, **groups}
    year = groups["y"] if two_digit else field["Y"]
    if not groups.keys() <= _FIELD_PATTERNS.keys():
        found = {**field, "Y": year, "m": groups.get("b", groups.get("B", field["m"])), "H": groups.get("I", field["H"])}
        parts = "|".join(found.get(part, "") for part in _PARTS)
        return FormatPlan("parts", pattern, parts, two_digit, frozenset(groups))
    iso = f"{year}-{field['m']}-{field['d']} {field['H']}:{field['M']}:{field['S']}.{field['f']}"
    return FormatPlan("pattern", pattern, iso, two_digit)


def _pattern_column(text: Column, fmt: str, plan: FormatPlan) -> Column:
    iso = F.regexp_replace(text, plan.pattern, plan.iso)
    if plan.two_digit_year:
        century = F.when(F.substring(iso, 1, 2) <= "68", F.lit("20")).otherwise(F.lit("19"))
        iso = F.concat(century, iso)
    parsed = F.when(text.rlike(plan.pattern), iso.try_cast("timestamp_ntz"))
    shape = _ISO_SHAPES.get(fmt)
    if shape is None:
        return parsed
    dated = F.substring(text, 1, 4) != "0000"
    return F.when(text.rlike(shape), F.when(dated, text.try_cast("timestamp_ntz"))).otherwise(parsed)


def _from_parts(text: Column, plan: FormatPlan) -> tuple[Column, Column]:
    """Local time and offset in seconds, both null where the text does not parse; no offset is null too.

    The fields are bound in a lambda: spelled out they would be generated, and evaluated, once for every use.
    """
    fields = F.split(F.regexp_replace(text, plan.pattern, plan.iso), r"\|")
    both = F.transform(F.array(fields), lambda parts: _fields_to_time(parts, plan))
    found = F.when(text.rlike(plan.pattern), F.get(both, F.lit(0)))
    return found["local"], found["offset"]


def _fields_to_time(fields: Column, plan: FormatPlan) -> Column:
    part = {name: F.get(fields, F.lit(i)) for i, name in enumerate(_PARTS)}
    year = part["Y"]
    if plan.two_digit_year:
        year = F.concat(F.when(year <= "68", F.lit("20")).otherwise(F.lit("19")), year)
    month, hour = part["m"], part["H"]
    if plan.codes & {"b", "B"}:
        # every month starts with other letters; a name folded to others is none
        names = _MONTHS if "B" in plan.codes else [name[:3] for name in _MONTHS]
        month = F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.lower(month)), F.lit(0)).cast("string")
    if "I" in plan.codes:
        half = F.when(F.lower(part["p"]) == "pm", 12).otherwise(0)
        hour = (hour.try_cast("int") % 12 + half).cast("string")
    day = F.concat_ws("-", year, F.coalesce(month, F.lit("-")), part["d"]).try_cast("date")
    if "j" in plan.codes:  # counts, whatever month and day say; day 366 may be the first of the next year
        day = F.date_add(F.concat(year, F.lit("-01-01")).try_cast("date"), part["j"].try_cast("int") - 1)
        day = F.when(F.year(day) <= 9999, day)
        day = F.when(month.isNotNull(), day)
    time = F.concat(F.lit(" "), hour, F.lit(":"), part["M"], F.lit(":"), part["S"], F.lit("."), part["f"])
    local = F.concat(day.cast("string"), time).try_cast("timestamp_ntz")
    if "z" not in plan.codes:
        return F.struct(local.alias("local"), F.lit(None).cast("decimal(18,6)").alias("offset"))
    digits = F.replace(part["z"], F.lit(":"), F.lit(""))

    def number(at: int, length: int, kind: str = "int") -> Column:
        return F.coalesce(F.substring(digits, at, length).try_cast(kind), F.lit(0).cast(kind))

    seconds = number(2, 2) * 3600 + number(4, 2) * 60 + number(6, 9, "decimal(18,6)")
    offset = F.when(part["z"].startswith("-"), -seconds).otherwise(seconds)
    valid = part["z"].rlike(_OFFSET) & (seconds < 86400)
    return F.struct(F.when(valid, local).alias("local"), F.when(valid, offset).alias("offset"))


def _python_texts(fmt: str):
    """Arrow helper giving ``local`` or ``local|utc`` ISO texts for one format."""

    def one(value):
        if value is None:
            return None
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                parsed = datetime.strptime(value, fmt)
        except ValueError:
            return None
        local = parsed.replace(tzinfo=None).isoformat(sep=" ")
        if parsed.tzinfo is None:
            return local
        try:
            utc = parsed.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
        except OverflowError:
            utc = local
        return f"{local}|{utc}"

    @F.pandas_udf(T.StringType())
    def parse(values: pd.Series) -> pd.Series:
        return values.map(one)

    return parse


def has_offset(formats) -> bool:
    return any(re.search(r"(?<!%)(?:%%)*%z", f) for f in formats)


def strptime(text: Column, fmt: str) -> Column:
    """Local timestamp of a text under one format, null where it does not parse."""
    plan = plan_format(fmt)
    if plan.kind == "never":
        return F.lit(None).cast("timestamp_ntz")
    if plan.kind == "python":
        both = _python_texts(fmt)(text)
        return F.substring_index(both, "|", 1).try_cast("timestamp_ntz")
    if plan.kind == "parts":
        return _from_parts(text, plan)[0]
    return _pattern_column(text, fmt, plan)


def strptime_utc(text: Column, fmt: str) -> Column:
    """UTC timestamp for formats that carry an offset, else null."""
    if not has_offset([fmt]):
        return F.lit(None).cast("timestamp_ntz")
    plan = plan_format(fmt)
    if plan.kind == "parts":
        local, offset = _from_parts(text, plan)
        utc = local - F.make_dt_interval(secs=offset)
        return F.when(F.year(utc).between(1, 9999), utc).otherwise(local)  # out of range: as it is
    both = _python_texts(fmt)(text)
    return F.when(F.contains(both, F.lit("|")), F.substring_index(both, "|", -1)).try_cast(
        "timestamp_ntz"
    )


def any_format(text: Column, formats) -> Column:
    """First format that parses wins; an empty list parses nothing."""
    options = [strptime(text, f) for f in formats]
    if not options:
        return F.lit(None).cast("timestamp_ntz")
    return options[0] if len(options) == 1 else F.coalesce(*options)


def any_format_utc(text: Column, formats) -> Column:
    """UTC timestamp of the format that wins; null when that one is naive."""
    out = None
    for fmt in formats:
        hit = strptime(text, fmt).isNotNull()
        utc = strptime_utc(text, fmt)
        out = F.when(hit, utc) if out is None else out.when(hit, utc)
    return out


@dataclass(frozen=True)
class DateBound:
    """A parsed bound of a date rule."""

    value: datetime  # naive; UTC when *aware*
    aware: bool
    text: str


def parse_bound(raw: object, fmt: str) -> DateBound | None:
    """A bound that does not parse drops its rule."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            parsed = datetime.strptime(str(raw), fmt)
    except ValueError:
        return None
    if parsed.tzinfo is None:
        return DateBound(parsed, False, str(raw))
    return DateBound(parsed.astimezone(timezone.utc).replace(tzinfo=None), True, str(raw))


def day_text(value: Column) -> Column:
    """The calendar day as printed in messages (years are not padded)."""
    return F.regexp_replace(value.cast("date").cast("string"), r"\A0+(?=[0-9])", "")
