"""Validation specifications: plan-time input, never data."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from cellsieve.functions.text import normalize_name

# Declared types and rule names a specification may use.
TYPES = ("string", "text", "integer", "number", "boolean", "date", "datetime", "enum")
RULES = (
    "regex", "min_len", "max_len", "min", "max", "allowed", "not_in",
    "formats", "unique", "min_date", "max_date", "date_format",
)


class SpecError(ValueError):
    """A specification that cannot be turned into a plan."""


@dataclass(frozen=True)
class ColumnSpec:
    """What is expected of one table column."""

    name: str
    type: str = "string"
    required: bool = False
    nullable: bool = True
    rules: Mapping[str, Any] = field(default_factory=dict)
    unvalidated: bool = False
    aliases: tuple[str, ...] = ()
    template_column: str | None = None

    def __post_init__(self):
        for key, kind in (("min_len", int), ("max_len", int)):
            if key in self.rules and not isinstance(self.rules[key], kind):
                raise SpecError(f"{self.name}: rule {key} must be a whole number")
        for key in ("min", "max"):
            if key in self.rules and (
                isinstance(self.rules[key], bool) or not isinstance(self.rules[key], (int, float))
            ):
                raise SpecError(f"{self.name}: rule {key} must be a number")

    @property
    def checked_type(self) -> str:
        return "string" if self.type == "text" else self.type

    @property
    def must_be_filled(self) -> bool:
        return self.required or not self.nullable

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "ColumnSpec":
        return cls(
            name=data["name"],
            type=data.get("type", "string"),
            required=bool(data.get("required", False)),
            nullable=bool(data.get("nullable", True)),
            rules=dict(data.get("rules") or {}),
            unvalidated=bool(data.get("unvalidated", False)),
            aliases=tuple(data.get("aliases") or ()),
            template_column=data.get("template_column"),
        )

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"name": self.name}
        if self.aliases:
            out["aliases"] = list(self.aliases)
        out |= {"type": self.type, "required": self.required, "nullable": self.nullable}
        if self.rules:
            out["rules"] = dict(self.rules)
        return out


@dataclass(frozen=True)
class UniqueTogether:
    """Rows must differ in at least one of the columns."""

    columns: tuple[str, ...]


@dataclass(frozen=True)
class DatasetSpec:
    """A resolved specification, keyed by table column."""

    columns: tuple[ColumnSpec, ...]
    strict: bool = False
    null_values: tuple[str, ...] = ()
    unique_together: tuple[UniqueTogether, ...] = ()
    id: str = ""
    name: str = ""

    def by_name(self) -> dict[str, ColumnSpec]:
        return {c.name: c for c in self.columns}

    @classmethod
    def of(cls, *columns: ColumnSpec, **options: Any) -> "DatasetSpec":
        pairs = options.pop("unique_together", ())
        rules = tuple(p if isinstance(p, UniqueTogether) else UniqueTogether(tuple(p)) for p in pairs)
        options["null_values"] = tuple(options.get("null_values", ()))
        return cls(columns=tuple(columns), unique_together=rules, **options)


@dataclass(frozen=True)
class Template:
    """A reusable specification whose columns are found by name or alias."""

    id: str
    name: str
    columns: tuple[ColumnSpec, ...] = ()
    strict: bool = False
    null_values: tuple[str, ...] = ()
    unique_together: tuple[UniqueTogether, ...] = ()
    xml_record_path: str | None = None
    version: str | None = None
    description: str | None = None

    def __post_init__(self):
        for col in self.columns:
            if col.type not in TYPES:
                raise SpecError(f"{col.name}: unknown type {col.type!r}")
            unknown = set(col.rules) - set(RULES)
            if unknown:
                raise SpecError(f"{col.name}: unknown rules {sorted(unknown)}")

    @classmethod
    def from_dict(cls, data: Mapping[str, Any]) -> "Template":
        rules = []
        for rule in data.get("dataset_rules") or ():
            if rule.get("type") == "unique_together":
                rules.append(UniqueTogether(tuple(rule.get("columns", ()))))
        return cls(
            id=data["id"],
            name=data.get("name", ""),
            columns=tuple(ColumnSpec.from_dict(c) for c in data.get("columns") or ()),
            strict=bool(data.get("strict", False)),
            null_values=tuple(data.get("null_values") or ()),
            unique_together=tuple(rules),
            xml_record_path=data.get("xml_record_path"),
            version=data.get("version"),
            description=data.get("description"),
        )

    @classmethod
    def from_json(cls, text: str) -> "Template":
        return cls.from_dict(json.loads(text))

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"id": self.id, "name": self.name}
        for key in ("version", "description", "xml_record_path"):
            if getattr(self, key) is not None:
                out[key] = getattr(self, key)
        out |= {"strict": self.strict, "null_values": list(self.null_values)}
        if self.unique_together:
            out["dataset_rules"] = [
                {"type": "unique_together", "columns": list(u.columns)} for u in self.unique_together
            ]
        out["columns"] = [c.to_dict() for c in self.columns]
        return out


@dataclass(frozen=True)
class Match:
    """How a template's columns relate to a table's columns."""

    matched: dict[str, str]
    missing: tuple[str, ...]
    extra: tuple[str, ...]
    unresolved: tuple[str, ...]


def match_columns(template: Template, table_columns: Sequence[str]) -> Match:
    """Match one template to one table header (catalogues: see ``operators.match``).

    Every pair of a candidate name and an equally normalised table column is a hit; of a template column's hits the
    one with the earliest candidate, then the latest table column, is taken.
    """
    norms = [normalize_name(name) for name in table_columns]
    hits = [
        (col_pos, cand_pos, -place)
        for col_pos, column in enumerate(template.columns)
        for cand_pos, candidate in enumerate((column.name, *column.aliases))
        for place, norm in enumerate(norms)
        if norm == normalize_name(candidate)
    ]
    best = {hit[0]: table_columns[-hit[2]] for hit in sorted(hits, reverse=True)}
    state = [(column, best.get(col_pos)) for col_pos, column in enumerate(template.columns)]
    return Match(
        matched={column.name: name for column, name in state if name is not None},
        missing=tuple(column.name for column, name in state if name is None and column.required),
        extra=tuple(name for name in table_columns if name not in best.values()),
        unresolved=tuple(column.name for column, name in state if name is None),
    )


def bind_spec(
    template: Template,
    table_columns: Sequence[str],
    overrides: Mapping[str, str] | None = None,
    force: bool = False,
) -> DatasetSpec:
    """Resolve a template against a table header.

    *overrides* maps template columns that did not match to table columns. A
    required column that stays unmapped raises unless *force* is set; it is then
    kept, so that validation reports it as missing. Composite rules follow their
    columns to the table's names.
    """
    match = match_columns(template, table_columns)
    mapping = dict(match.matched)
    for name in match.unresolved:
        target = (overrides or {}).get(name)
        if target and target != "__skip__":
            mapping[name] = target
    blocked = [n for n in match.missing if n not in mapping]
    if blocked and not force:
        raise SpecError(f"required template columns are not mapped: {blocked}")

    columns: list[ColumnSpec] = []
    used: dict[str, str] = {}
    for col in template.columns:
        target = mapping.get(col.name)
        if target is None:
            if col.required:
                columns.append(replace(col, template_column=col.name))
            continue
        if target in used:
            raise SpecError(f"template columns {used[target]!r} and {col.name!r} both map to {target!r}")
        used[target] = col.name
        columns.append(replace(col, name=target, template_column=col.name))
    columns += [
        ColumnSpec(name=c, unvalidated=True) for c in table_columns if c not in used
    ]
    return DatasetSpec(
        columns=tuple(columns),
        strict=template.strict,
        null_values=template.null_values,
        unique_together=tuple(
            UniqueTogether(tuple(mapping.get(c, c) for c in rule.columns))
            for rule in template.unique_together
        ),
        id=template.id,
        name=template.name,
    )


def manual_spec(
    table_columns: Sequence[str],
    types: Mapping[str, str] | None = None,
    empty: Mapping[str, str] | None = None,
    options: Mapping[str, Mapping[str, Any]] | None = None,
    id: str = "manual",
) -> DatasetSpec:
    """Specification from per-column choices.

    *options* holds texts as a user would type them: ``formats`` and ``allowed``
    are comma separated, ``min`` and ``max`` become floats, blank or unreadable
    numbers are ignored, and each option only applies to its type.
    """
    columns = []
    for name in table_columns:
        kind = (types or {}).get(name, "string")
        must = (empty or {}).get(name, "allowed") == "error"
        columns.append(
            ColumnSpec(
                name=name,
                type=kind,
                required=must,
                nullable=not must,
                rules=_manual_rules(kind, (options or {}).get(name, {})),
            )
        )
    return DatasetSpec(columns=tuple(columns), id=id, name="Manual")


def _manual_rules(kind: str, given: Mapping[str, Any]) -> dict[str, Any]:
    def listed(key: str) -> list[str]:
        return [part.strip() for part in str(given.get(key, "")).split(",") if part.strip()]

    rules: dict[str, Any] = {}
    if kind in ("date", "datetime"):
        rules["formats"] = listed("formats")
    elif kind == "enum":
        rules["allowed"] = listed("allowed")
    elif kind in ("integer", "number"):
        for key in ("min", "max"):
            try:
                value = float(str(given.get(key, "")).strip())
            except ValueError:
                continue
            if not math.isnan(value):
                rules[key] = value
    elif kind == "string":
        pattern = str(given.get("regex", "")).strip()
        if pattern:
            rules["regex"] = pattern
    return {k: v for k, v in rules.items() if v != []}
