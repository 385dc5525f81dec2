"""Typed report parameters."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column

from tallyboard.functions.predicates import ALL, NONE, between_filter, dimension, in_filter


@dataclass(frozen=True)
class Options:
    """Where the selectable values come from: a source column, never a view."""

    source: str
    column: str
    include_null: bool = True
    null_label: str = "(Null)"


@dataclass(frozen=True)
class MultiSelect:
    options: Options
    default: Any = ALL
    empty: str = NONE
    label: str | None = None

    def __post_init__(self) -> None:
        chosen = self.default if isinstance(self.default, (list, tuple)) else [self.default]
        if not self.options.include_null and None in chosen:
            raise ValueError("a NULL default needs include_null=True")

    def problem(self, value: Any) -> str | None:
        """Why a run cannot take ``value``, or None."""
        chosen = value if isinstance(value, (list, tuple)) else [value]
        if None in chosen and not self.options.include_null:
            return "NULL is not among the options"
        return None

    def predicate(self, column: str | Column, value: Any) -> Column:
        return in_filter(
            column, value, empty=self.empty, include_null=self.options.include_null
        )


@dataclass(frozen=True)
class Select(MultiSelect):
    allow_all: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.allow_all and self.default == ALL:
            raise ValueError("a select without 'all' needs another default")

    def problem(self, value: Any) -> str | None:
        if isinstance(value, (list, tuple)):
            return "a single value is needed, not a list"
        if value == ALL and not self.allow_all:
            return "'all' is not allowed"
        return super().problem(value)


@dataclass(frozen=True)
class DateRange:
    default: Any = ALL
    label: str | None = None

    def problem(self, value: Any) -> str | None:
        if value == ALL or isinstance(value, Mapping) and set(value) <= {"start", "end"}:
            return None
        return "a date range is 'all' or has a start and an end"

    def predicate(self, column: str | Column, value: Any) -> Column:
        return between_filter(column, value)


@dataclass(frozen=True)
class Dimension:
    """A breakdown: choice name to field name."""

    choices: Mapping[str, str]
    default: str
    allow_none: bool = False
    labels: Mapping[str, str] = field(default_factory=dict)
    label: str | None = None

    def __post_init__(self) -> None:
        if not self.choices or NONE in self.choices:
            raise ValueError("a dimension needs choices, none of them named 'none'")
        if self.default != NONE and self.default not in self.choices:
            raise ValueError(f"the default {self.default!r} is not a choice")
        if self.default == NONE and not self.allow_none:
            raise ValueError("the default 'none' needs allow_none=True")

    def problem(self, value: Any) -> str | None:
        if value in self.choices or value == NONE and self.allow_none:
            return None
        return f"{value!r} is not a choice"

    def field_column(self, value: str) -> Column:
        return dimension(value, self.choices, allow_none=self.allow_none)


@dataclass(frozen=True)
class Number:
    """A plain number, for named arguments of SQL blocks."""

    default: float
    label: str | None = None

    def problem(self, value: Any) -> str | None:
        fits = isinstance(value, (int, float)) and not isinstance(value, bool)
        return None if fits else "a number is needed"


Param = MultiSelect | DateRange | Dimension | Number
