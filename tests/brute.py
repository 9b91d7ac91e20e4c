"""A small row-by-row checker in plain Python, used as the expected result."""

import re
from datetime import datetime
from math import isfinite

NULLS = {"", "na", "n/a", "null", "-", "--"}


def _num(fn, s):
    try:
        v = fn(s)
    except ValueError:
        return None
    return v if isfinite(v) else None


def _when(s, formats):
    for f in formats:
        try:
            return datetime.strptime(s, f)
        except ValueError:
            continue
    return None


def cell(value, col, nulls):
    s, kind, rules = value.strip(), col.type, col.rules
    if s.lower() in nulls:
        return ["REQUIRED_EMPTY"] if col.required or not col.nullable else []
    out, v = [], None
    if kind == "integer":
        v = _num(int, s)
    elif kind == "number":
        v = _num(float, s)
    elif kind in ("date", "datetime"):
        v = _when(s, rules.get("formats", []))
        if v is None:
            return ["DATE_PARSE_FAILED"]
    elif kind == "boolean" and s.lower() not in ("true", "false", "yes", "no", "1", "0"):
        return ["TYPE_MISMATCH"]
    elif kind == "enum" and s.lower() not in [a.lower() for a in rules.get("allowed", [])]:
        return ["ENUM_NOT_ALLOWED"]
    if kind in ("integer", "number"):
        if v is None:
            return ["TYPE_MISMATCH"]
        out += ["MIN_VIOLATED"] * ("min" in rules and v < rules["min"])
        out += ["MAX_VIOLATED"] * ("max" in rules and v > rules["max"])
    if kind in ("date", "datetime"):
        day = lambda k: datetime.strptime(rules[k], "%Y-%m-%d")
        out += ["MIN_VIOLATED"] * ("min_date" in rules and v < day("min_date"))
        out += ["MAX_VIOLATED"] * ("max_date" in rules and v > day("max_date"))
    if kind == "string":
        out += ["REGEX_MISMATCH"] * ("regex" in rules and not re.fullmatch(rules["regex"], s))
        out += ["MIN_LEN_VIOLATED"] * ("min_len" in rules and len(s) < rules["min_len"])
        out += ["MAX_LEN_VIOLATED"] * ("max_len" in rules and len(s) > rules["max_len"])
    out += ["NOT_IN_VIOLATED"] * (s.lower() in [str(b).lower() for b in rules.get("not_in", [])])
    return out


def run(columns, spec):
    """``(row, column, code)`` in emission order."""
    nulls = NULLS | {t.lower() for t in spec.null_values}
    known = spec.by_name()
    out = []
    for name, values in columns.items():
        col = known.get(name)
        if col is None or col.unvalidated:
            continue
        seen = set()
        for row, value in enumerate(values):
            value = value or ""
            codes = cell(value, col, nulls)
            key = value.strip().lower()
            if col.rules.get("unique") and not codes and key not in nulls:
                if key in seen:
                    codes = ["UNIQUE_VIOLATED"]
                seen.add(key)
            out += [(row, name, c) for c in codes]
    for rule in spec.unique_together:
        names = [c for c in rule.columns if c in columns]
        if len(names) < 2:
            continue
        seen = set()
        for row, cells in enumerate(zip(*[columns[c] for c in names])):
            key = tuple((c or "").strip().lower() for c in cells)
            if all(k in nulls for k in key):
                continue
            if key in seen:
                out += [(row, c, "UNIQUE_TOGETHER_VIOLATED") for c in names]
            seen.add(key)
    return out
