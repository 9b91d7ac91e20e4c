"""User types and rules that join the one-pass plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column


@dataclass(frozen=True)
class CellContext:
    """What a user rule may look at."""

    column: str
    type: str
    raw: Column
    stripped: Column
    value: Column  # typed value of the cell; the stripped text for text-like types


@dataclass(frozen=True)
class UserRule:
    code: str
    message: Callable[[CellContext, Any], Column]


@dataclass(frozen=True)
class UserType:
    parse: Callable[[Column], Column]
    code: str
    expected: str


USER_RULES: dict[str, UserRule] = {}
USER_TYPES: dict[str, UserType] = {}


def register_rule(name: str, code: str, message: Callable[[CellContext, Any], Column]) -> None:
    """Add a rule usable as ``rules={name: param}`` on any column.

    *message* returns the message text of a violation and null for a valid cell.
    """
    USER_RULES[name] = UserRule(code, message)


def register_type(
    name: str, parse: Callable[[Column], Column], expected: str | None = None, code: str = "TYPE_MISMATCH"
) -> None:
    """Add a column type; *parse* maps stripped text to ``struct<ok, value>``."""
    USER_TYPES[name] = UserType(parse, code, expected or name)
