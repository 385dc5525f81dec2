"""Parameter values as boolean and grouping columns."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reserved parameter values.
ALL = "all"
NONE = "none"


def _column(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def _literal(value: Any) -> Any:
    """Booleans and finite numbers keep their type, everything else is text."""
    if isinstance(value, bool) or isinstance(value, int):
        return value
    if isinstance(value, float) and math.isfinite(value):
        return value
    return str(value)


def in_filter(
    column: str | Column,
    selection: Any,
    *,
    empty: str = NONE,
    include_null: bool = True,
) -> Column:
    """True for rows whose value is selected.

    ``selection`` is ``"all"``, one value, or a list; None stands for NULL. With
    ``include_null=False`` NULL cannot be selected. A selection without values
    keeps no row, or every row with ``empty="all"``.
    """
    if isinstance(selection, str) and selection == ALL:
        return F.lit(True)
    chosen = list(selection) if isinstance(selection, (list, tuple, set)) else [selection]
    values = [_literal(value) for value in chosen if value is not None]
    wants_null = include_null and len(values) < len(chosen)
    target = _column(column)
    # NULL never goes into isin(): IN with a NULL in its list is unknown, not false.
    tests = [target.isin(values)] if values else []
    if wants_null:
        tests.append(target.isNull())
    if not tests:
        return F.lit(empty == ALL)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def between_filter(column: str | Column, selection: Any) -> Column:
    """True from the start to the end of the last day; the column stays bare so
    both bounds reach the Parquet scan."""
    if isinstance(selection, str) and selection == ALL:
        return F.lit(True)
    bounds = selection if isinstance(selection, Mapping) else {}
    start, end = bounds.get("start"), bounds.get("end")
    if start is None or end is None:
        raise ValueError("a date range needs both start and end")
    target = _column(column)
    day_after = F.date_add(F.lit(str(end)).cast("date"), 1)
    return (target >= F.lit(str(start))) & (target < day_after)


def dimension(choice: str, fields: Mapping[str, str], *, allow_none: bool = False) -> Column:
    """The field of the chosen breakdown; ``"none"`` gives one empty-text group."""
    if choice == NONE and allow_none:
        return F.lit("")
    if choice not in fields:
        raise ValueError(f"{choice!r} is not one of the declared breakdowns {sorted(fields)}")
    return F.col(fields[choice])


def option_label(column: str | Column, null_label: str = "(Null)") -> Column:
    """Text shown for an option value."""
    return F.coalesce(_column(column).cast("string"), F.lit(null_label))
