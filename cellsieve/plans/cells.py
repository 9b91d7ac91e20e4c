"""The cell pass: every check of every cell in one scan, without an exchange.

A row is opened into its cells and one generic check runs over (position, text).
What differs between columns - type, bounds, lists, message parts - is looked up
by position in literal arrays, so the size of the generated code does not grow
with the number of columns and stays compilable for wide tables. Only date
formats, patterns and user functions add a branch each.

The outcome of a cell is an integer mask with one bit per failed check. Cells
with mask 0 leave the plan before any message is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellsieve import codes
from cellsieve.functions import dates, numbers, patterns
from cellsieve.functions.registry import USER_RULES, USER_TYPES, CellContext
from cellsieve.functions.text import null_token_set, py_strip, safe_str
from cellsieve.spec import ColumnSpec, DatasetSpec

ROW = "row"
ISSUE_COLUMNS = (ROW, "column", "code", "message")
ORDER_COLUMNS = ("phase", "rule_id", "col_pos", ROW, "rule_pos")

# Bits of the mask, in the order in which a cell reports its issues. User rules
# follow in registration order.
EMPTY, MISTYPED, FAILED, REGEX, MIN_LEN, MAX_LEN, MIN, MAX, NOT_IN, FIRST_USER = range(10)

# Lists up to this length are searched in place, longer ones become hash sets.
SHORT_LIST = 40

# Rows of up to this many columns take part in whole-stage compilation.
COMPILED_WIDTH = 90

# What a message shows between its prefix and suffix.
NOTHING, TEXT, LENGTH, WHOLE, DECIMAL, DAY, OWN = range(7)

_OFFSET_ERROR = "Internal error: can't compare offset-naive and offset-aware datetimes"


@dataclass(frozen=True)
class Part:
    """Code and message of one kind of failure of one column."""

    code: str
    prefix: str
    shows: int = NOTHING
    suffix: str = ""


@dataclass
class ColumnPlan:
    """One validated column at plan time."""

    spec: ColumnSpec
    pos: int  # in the table
    parts: dict[int, Part] = field(default_factory=dict)  # by bit

    @property
    def kind(self) -> str:
        return self.spec.checked_type

    @property
    def formats(self) -> tuple[str, ...]:
        return tuple(self.spec.rules.get("formats") or ())

    @property
    def numeric(self) -> bool:
        return self.spec.type in ("integer", "number")

    def bound(self, key: str) -> dates.DateBound | None:
        if key not in self.spec.rules:
            return None
        return dates.parse_bound(
            self.spec.rules[key], self.spec.rules.get("date_format", "%Y-%m-%d")
        )

    @property
    def pattern(self) -> str | None:
        """The column's pattern, unless it is one Python would reject."""
        pattern = self.spec.rules.get("regex")
        return pattern if pattern is not None and patterns.compiles(pattern) else None


def row_column(row_key: str | Sequence[str]) -> Column:
    """The row identity: one column as it is, several as an ordered struct."""
    keys = [row_key] if isinstance(row_key, str) else list(row_key)
    return F.col(f"`{keys[0]}`") if len(keys) == 1 else F.struct(*[F.col(f"`{k}`") for k in keys])


def table_columns(df: DataFrame, row_key: str | Sequence[str]) -> list[str]:
    """Columns that hold cells.

    A single key column is pure row identity; the columns of a composite key
    are data as well and stay cells.
    """
    return [c for c in df.columns if not (isinstance(row_key, str) and c == row_key)]


def plan_columns(
    df: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str]
) -> list[ColumnPlan]:
    """Columns that are both present and validated, in table order."""
    wanted = spec.by_name()
    return [
        _plan_column(wanted[name], pos)
        for pos, name in enumerate(table_columns(df, row_key))
        if name in wanted and not wanted[name].unvalidated
    ]


def _plan_column(spec: ColumnSpec, pos: int) -> ColumnPlan:
    plan = ColumnPlan(spec, pos)
    rules, kind, parts = spec.rules, plan.kind, plan.parts

    def expected(what: str, code: str = codes.TYPE_MISMATCH) -> Part:
        return Part(code, f"Expected {what}, got '", TEXT, "'")

    if spec.must_be_filled:
        parts[EMPTY] = Part(codes.REQUIRED_EMPTY, "Required field is empty")
    if kind in ("integer", "number"):
        parts[MISTYPED] = expected(kind)
    elif kind == "boolean":
        parts[MISTYPED] = expected("boolean (true/false/yes/no/1/0)")
    elif kind in ("date", "datetime"):
        listed = f"Expected format(s): {', '.join(plan.formats)}"
        none = f"No {kind} format specified — all {kind}s rejected"
        parts[MISTYPED] = Part(codes.DATE_PARSE_FAILED, listed if plan.formats else none)
    elif kind == "enum":
        allowed = list(rules.get("allowed") or ())
        parts[MISTYPED] = Part(
            codes.ENUM_NOT_ALLOWED, "'", TEXT, f"' not in allowed values: {allowed}"
        )
    elif kind in USER_TYPES:
        parts[MISTYPED] = expected(USER_TYPES[kind].expected, USER_TYPES[kind].code)

    if kind == "string":
        if plan.pattern is not None:
            parts[REGEX] = Part(
                codes.REGEX_MISMATCH, f"Value does not match pattern {plan.pattern}"
            )
        if "min_len" in rules:
            parts[MIN_LEN] = Part(
                codes.MIN_LEN_VIOLATED, "Length ", LENGTH, f" < min {rules['min_len']}"
            )
        if "max_len" in rules:
            parts[MAX_LEN] = Part(
                codes.MAX_LEN_VIOLATED, "Length ", LENGTH, f" > max {rules['max_len']}"
            )
    elif kind in ("integer", "number"):
        shows = WHOLE if kind == "integer" else DECIMAL
        if "min" in rules:
            parts[MIN] = Part(codes.MIN_VIOLATED, "Value ", shows, f" < min {rules['min']}")
        if "max" in rules:
            parts[MAX] = Part(codes.MAX_VIOLATED, "Value ", shows, f" > max {rules['max']}")
    elif kind in ("date", "datetime"):
        low, high = plan.bound("min_date"), plan.bound("max_date")
        if low:
            parts[MIN] = Part(codes.MIN_VIOLATED, "Date ", DAY, f" is before minimum {low.text}")
        if high:
            parts[MAX] = Part(codes.MAX_VIOLATED, "Date ", DAY, f" is after maximum {high.text}")
        if (low or high) and (_aware(plan) or dates.has_offset(plan.formats)):
            # A value and a bound of which only one carries an offset cannot be
            # compared; such a cell reports the failure and nothing else.
            parts[FAILED] = Part(codes.PARSE_ERROR, _OFFSET_ERROR)
    if "not_in" in rules:
        parts[NOT_IN] = Part(codes.NOT_IN_VIOLATED, "'", TEXT, "' is in the blocklist")
    for number, (name, user) in enumerate(USER_RULES.items()):
        if name in rules:
            parts[FIRST_USER + number] = Part(user.code, "", OWN)
    return plan


def _aware(plan: ColumnPlan) -> bool:
    return any(b is not None and b.aware for b in (plan.bound("min_date"), plan.bound("max_date")))


def _parses(token: str, reader: Callable[[str], object]) -> bool:
    try:
        reader(token.strip())
    except ValueError:
        return False
    return True


class _Cells:
    """Builds the generic check over the columns ``cell`` and ``text``."""

    def __init__(self, plans: Sequence[ColumnPlan], tokens: Sequence[str]):
        self.plans = plans
        self.tokens = tokens
        self.cell, self.text, self.low = F.col("cell"), F.col("text"), F.col("low")
        self.whole, self.number, self.at = F.col("whole"), F.col("number"), F.col("at")

    def per_column(self, values: Iterable, kind: str | None = None) -> Column:
        """The literal belonging to the cell's column."""
        literals = [v if isinstance(v, Column) else F.lit(v) for v in values]
        if kind is not None:
            literals = [v.cast(kind) for v in literals]
        return F.get(F.array(*literals), self.cell)

    def where(self, test: Callable[[ColumnPlan], bool]) -> Column:
        """True for cells of the columns that satisfy *test*."""
        chosen = [test(p) for p in self.plans]
        return F.lit(chosen[0]) if len(set(chosen)) == 1 else self.per_column(chosen)

    def has(self, test: Callable[[ColumnPlan], bool]) -> bool:
        return any(test(p) for p in self.plans)

    def by_value(
        self, pick: Callable[[ColumnPlan], object], build: Callable[[object], Column]
    ) -> Column | None:
        """One branch per distinct value of *pick* among the columns."""
        distinct = dict.fromkeys(v for v in map(pick, self.plans) if v is not None)
        out = None
        for value in distinct:
            here = self.where(lambda p: pick(p) == value)
            out = F.when(here, build(value)) if out is None else out.when(here, build(value))
        return out

    # -- values ------------------------------------------------------------

    def whole_value(self) -> Column:
        return self._value("integer", "bigint", numbers.integer_value, int)

    def number_value(self) -> Column:
        return self._value("number", "double", numbers.number_text_value, float)

    def _value(self, kind, sql_type, parse, reader) -> Column:
        if not self.has(lambda p: p.kind == kind):
            return F.lit(None).cast(sql_type)
        wanted = self.where(lambda p: p.kind == kind)
        if any(_parses(t, reader) for t in self.tokens):
            wanted = wanted & ~self.low.isin(*self.tokens)  # a null token has no value
        return F.when(wanted, parse(self.text))

    def time_value(self, utc: bool = False) -> Column:
        def formats(plan):
            dated = plan.kind in ("date", "datetime") and plan.formats
            return plan.formats if dated and (not utc or dates.has_offset(plan.formats)) else None

        def build(chosen):
            parse = dates.any_format_utc if utc else dates.any_format
            value = parse(self.text, chosen)
            if any(
                _parses(t, lambda s, f=f: datetime.strptime(s, f))
                for t in self.tokens
                for f in chosen
            ):
                value = F.when(~self.low.isin(*self.tokens), value)
            return value

        value = self.by_value(formats, build)
        return F.lit(None).cast("timestamp_ntz") if value is None else value

    # -- outcome -----------------------------------------------------------

    def mask(self) -> Column:
        valued = self.whole.isNotNull() | self.number.isNotNull() | self.at.isNotNull()
        empty = self.per_column([1 << EMPTY if p.spec.must_be_filled else 0 for p in self.plans])
        rules = self._rules()
        # A value is never a null token, so cells with one skip that lookup.
        return (
            F.when(~valued & self.low.isin(*self.tokens), empty)
            .when(~valued & self._mistyped(), F.lit(1 << MISTYPED))
            .otherwise(rules)
        )

    def _mistyped(self) -> Column:
        tests: list[Column] = []

        def add(kind: Callable[[ColumnPlan], bool], wrong: Column) -> None:
            if self.has(kind):
                tests.append(self.where(kind) & wrong)

        add(lambda p: p.kind == "integer", ~numbers.is_integer(self.text))
        add(lambda p: p.kind in ("number", "date", "datetime"), F.lit(True))
        add(lambda p: p.kind == "boolean", ~self.low.isin(*numbers.BOOLEAN_TOKENS))
        add(lambda p: p.kind == "enum", ~self._listed("allowed", lambda p: p.kind == "enum"))
        for name, user in USER_TYPES.items():
            add(
                lambda p, n=name: p.kind == n,
                ~F.coalesce(user.parse(self.text)["ok"], F.lit(False)),
            )
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)

    def _listed(self, rule: str, applies: Callable[[ColumnPlan], bool]) -> Column:
        """Case-insensitive membership in the column's own list."""

        def values(plan):
            if not applies(plan) or plan.spec.rules.get(rule) is None:
                return ()
            return tuple(sorted({str(v).lower() for v in plan.spec.rules[rule]}))

        short = [v if len(v) <= SHORT_LIST else () for v in map(values, self.plans)]
        lists = [F.array(*[F.lit(x) for x in v]).cast("array<string>") for v in short]
        found = F.array_contains(self.per_column(lists), self.low)
        long = self.by_value(
            lambda p: values(p) if len(values(p)) > SHORT_LIST else None,
            lambda chosen: self.low.isin(*chosen),
        )
        return found if long is None else found | F.coalesce(long, F.lit(False))

    def _rules(self) -> Column:
        bits: list[Column] = []

        def add(bit: int, violated: Column | None) -> None:
            if violated is not None and self.has(lambda p: bit in p.parts):
                bits.append(F.when(violated, F.lit(1 << bit)).otherwise(F.lit(0)))

        def limits(rule: str) -> Column:
            texts = [p.spec.rules.get(rule) if p.kind == "string" else None for p in self.plans]
            return self.per_column(texts, "int")

        matched = self.by_value(
            lambda p: p.pattern if p.kind == "string" else None,
            lambda pattern: patterns.full_match(self.text, pattern),
        )
        add(REGEX, None if matched is None else ~matched)
        size = F.length(self.text)
        add(MIN_LEN, size < limits("min_len"))
        add(MAX_LEN, size > limits("max_len"))
        add(MIN, self._beyond("min", "min_date", below=True))
        add(MAX, self._beyond("max", "max_date", below=False))
        if self.has(lambda p: NOT_IN in p.parts):
            add(NOT_IN, self._listed("not_in", lambda p: True))
        for number in range(len(USER_RULES)):
            add(FIRST_USER + number, self.own_message(FIRST_USER + number).isNotNull())
        rules = reduce(lambda a, b: a.bitwiseOR(b), bits) if bits else F.lit(0)
        if self.has(lambda p: FAILED in p.parts):
            utc = F.col("utc")
            aware = self.where(_aware)
            failed = self.where(lambda p: FAILED in p.parts) & (aware == utc.isNull())
            rules = F.when(failed, F.lit(1 << FAILED)).otherwise(rules)
        return rules

    def _beyond(self, rule: str, date_rule: str, below: bool) -> Column:
        """A value on the wrong side of its column's bound."""
        tests: list[Column] = []

        def outside(value: Column, limit: Column) -> Column:
            return value < limit if below else value > limit

        def number_limits(kind):
            return [p.spec.rules.get(rule) if p.kind == kind else None for p in self.plans]

        floats = number_limits("number")
        if any(b is not None for b in floats):
            exact = [None if b is None else numbers.as_float(b) for b in floats]
            # Comparisons with NaN are false in Python; Spark sorts NaN last.
            exact = [None if b is not None and math.isnan(b) else b for b in exact]
            tests.append(outside(self.number, self.per_column(exact, "double")))
        wholes = [
            None if b is None else numbers.whole_bound(b, below) for b in number_limits("integer")
        ]
        if any(b is not None for b in wholes):
            near = [
                b if isinstance(b, int) and numbers.INT64_MIN <= b <= numbers.INT64_MAX else None
                for b in wholes
            ]
            limit = self.per_column(near, "bigint")
            negative = F.startswith(self.text, F.lit("-"))
            # Wider than 64 bits: the sign decides against any 64-bit bound.
            far = self.whole.isNull() & limit.isNotNull() & (negative if below else ~negative)
            tests.append(F.coalesce(outside(self.whole, limit), far))
            for plan, bound in zip(self.plans, wholes):
                if bound is not None and bound not in near:
                    here = self.where(lambda p, q=plan: p is q)
                    tests.append(here & numbers.beyond_wide(self.text, bound, below))
        bounds = [p.bound(date_rule) if p.kind in ("date", "datetime") else None for p in self.plans]
        if any(b is not None for b in bounds):
            texts = [None if b is None else b.value.isoformat(sep=" ") for b in bounds]
            limit = self.per_column(texts, "timestamp_ntz")
            moment = F.when(self.where(_aware), F.col("utc")).otherwise(self.at)
            tests.append(outside(moment if self.has(_aware) else self.at, limit))
        if not tests:
            return F.lit(False)
        return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])

    def own_message(self, bit: int) -> Column:
        """Message of a user rule, null where it holds or does not apply."""
        name = list(USER_RULES)[bit - FIRST_USER]
        out = F.lit(None).cast("string")
        for plan in self.plans:
            if bit in plan.parts:
                context = CellContext(
                    plan.spec.name, plan.kind, F.col("raw"), self.text, self._typed(plan)
                )
                message = USER_RULES[name].message(context, plan.spec.rules[name])
                out = F.when(self.where(lambda p, q=plan: p is q), message).otherwise(out)
        return out

    def _typed(self, plan: ColumnPlan) -> Column:
        if plan.kind in USER_TYPES:
            return USER_TYPES[plan.kind].parse(self.text)["value"]
        by_kind = {"integer": self.whole, "number": self.number, "date": self.at, "datetime": self.at}
        return by_kind.get(plan.kind, self.text)


def open_cells(
    df: DataFrame, columns: Sequence[str], row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """``row, pos, raw``: one row per cell, ``pos`` counting the given columns."""
    row = row_column(row_key).alias(ROW)
    texts = F.array(*[safe_str(F.col(f"`{c}`")) for c in columns])
    # The generator takes an expression: for a plain column Spark would infer a
    # filter on the array's size and build the array a second time.
    if len(columns) <= COMPILED_WIDTH:
        return df.select(row, F.posexplode(texts).alias("pos", "raw"))
    # Operators over wide rows are not compiled, so those end before the generator.
    wide = df.select(row, texts.alias("cells"))
    return wide.select(ROW, F.posexplode(F.slice("cells", 1, len(columns))).alias("pos", "raw"))


def checked_cells(
    df: DataFrame,
    plans: Sequence[ColumnPlan],
    tokens: Sequence[str],
    row_key: str | Sequence[str] = ROW,
) -> DataFrame:
    """One row per cell: ``row, cell, raw, text, low, whole, number, at, utc, mask``.

    ``cell`` counts the given plans; ``low`` is the lower-cased stripped text.
    """
    build = _Cells(plans, tokens)
    out = open_cells(df, [p.spec.name for p in plans], row_key).withColumnRenamed("pos", "cell")
    out = out.select("*", py_strip(F.col("raw")).alias("text"))
    out = out.select("*", F.lower(F.col("text")).alias("low"))
    out = out.select(
        "*",
        build.whole_value().alias("whole"),
        build.number_value().alias("number"),
        build.time_value().alias("at"),
        build.time_value(utc=True).alias("utc"),
    )
    out = out.withColumn("number", numbers.finite(F.col("number")))
    return out.select("*", build.mask().alias("mask"))


def spec_cells(
    df: DataFrame, spec: DatasetSpec, plans: Sequence[ColumnPlan], row_key: str | Sequence[str]
) -> DataFrame:
    """:func:`checked_cells` with the null tokens of a specification."""
    return checked_cells(df, plans, null_token_set(spec.null_values), row_key)


def is_filled(tokens: Sequence[str]) -> Column:
    """A cell of :func:`checked_cells` that is not a null token."""
    return ~F.col("low").isin(*tokens)


def statistics_value(plans: Sequence[ColumnPlan]) -> Column:
    """The number a valid cell adds to its column's statistics, else null."""
    value = F.col("number")
    if any(p.spec.type == "integer" for p in plans):
        build = _Cells(plans, ())
        whole = numbers.integer_as_double(F.col("text"), F.col("whole"))
        value = F.when(build.where(lambda p: p.spec.type == "integer"), whole).otherwise(value)
    return value


def cell_issues(
    df: DataFrame, spec: DatasetSpec, row_key: str | Sequence[str] = ROW
) -> DataFrame:
    """Null, type and rule violations of every cell; also for streaming tables."""
    plans = plan_columns(df, spec, row_key)
    if not any(p.parts for p in plans):
        return empty_issues(df, row_key)
    return issues_from(spec_cells(df, spec, plans, row_key), plans)


def issues_from(cells: DataFrame, plans: Sequence[ColumnPlan]) -> DataFrame:
    """Issue rows of checked cells; valid cells stop at the filter."""
    build = _Cells(plans, ())
    used = sorted({bit for p in plans for bit in p.parts})
    # A filter on the mask would be pushed below the projections and evaluate every
    # check a second time; an array that is null for valid cells drops them here.
    found, invalid = cells, F.col("mask") != 0
    failed = [F.when(F.col("mask").bitwiseAND(F.lit(1 << b)) != 0, F.lit(b)) for b in used]
    own_bits = [b for b in used if b >= FIRST_USER]
    if own_bits:
        own = [build.own_message(b) for b in own_bits]
        found = found.select("*", F.when(invalid, F.array(*own)).alias("own"))
    found = found.select("*", F.explode(F.when(invalid, F.array(*failed))).alias("rule_pos"))
    found = found.where(F.col("rule_pos").isNotNull())

    # Codes and message parts by column and bit.
    width = used[-1] + 1
    blank = Part("", "")
    parts = [p.parts.get(bit, blank) for p in plans for bit in range(width)]
    slot = F.col("cell") * width + F.col("rule_pos")

    def by_part(values) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), slot)

    shows, text = F.col("shows"), F.col("text")
    found = found.select("*", by_part([p.shows for p in parts]).alias("shows"))
    kinds = {p.shows for p in parts}
    middle: Column = F.lit("")
    for kind, shown in (
        (TEXT, text),
        (LENGTH, F.length(text).cast("string")),
        (WHOLE, numbers.integer_text(text)),
        (DECIMAL, numbers.float_text(F.col("number"))),
        (DAY, dates.day_text(F.col("at"))),
        (OWN, F.get(F.col("own"), F.col("rule_pos") - own_bits[0]) if own_bits else None),
    ):
        if kind in kinds:
            middle = F.when(shows == kind, shown).otherwise(middle)
    message = F.concat(
        by_part([p.prefix for p in parts]), middle, by_part([p.suffix for p in parts])
    )
    return found.select(
        ROW,
        build.per_column([p.spec.name for p in plans]).alias("column"),
        by_part([p.code for p in parts]).alias("code"),
        message.alias("message"),
        F.lit(0).alias("phase"),
        F.lit(0).alias("rule_id"),
        build.per_column([p.pos for p in plans]).alias("col_pos"),
        "rule_pos",
    )


def empty_issues(df: DataFrame, row_key: str | Sequence[str]) -> DataFrame:
    """No issues, with the schema every issues relation has."""
    return df.where(F.lit(False)).select(
        row_column(row_key).alias(ROW),
        *[F.lit("").alias(c) for c in ("column", "code", "message")],
        *[F.lit(0).alias(c) for c in ("phase", "rule_id", "col_pos", "rule_pos")],
    )


__all__ = [
    "ISSUE_COLUMNS",
    "ORDER_COLUMNS",
    "ROW",
    "ColumnPlan",
    "cell_issues",
    "checked_cells",
    "empty_issues",
    "is_filled",
    "issues_from",
    "open_cells",
    "plan_columns",
    "row_column",
    "spec_cells",
    "statistics_value",
    "table_columns",
]
