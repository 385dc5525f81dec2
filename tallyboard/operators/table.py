"""Table projection and result values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.csv_text import is_unsafe, result_value
from tallyboard.functions.numbers import field_type, quoted


def table_projection(rows: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """The configured columns in their order, missing ones NULL; all when none are given."""
    present = set(rows.columns)
    return rows.select(
        *[
            F.col(quoted(name)) if name in present else F.lit(None).cast("string").alias(name)
            for name in (columns or rows.columns)
        ]
    )


def unsafe_columns(rows: DataFrame) -> list[str]:
    """Columns with an integer, at any depth, that no double holds exactly; one aggregate."""
    tests = {name: is_unsafe(F.col(quoted(name)), field_type(rows, name)) for name in rows.columns}
    wanted = {name: test for name, test in tests.items() if test is not None}
    if not wanted:
        return []
    found = rows.agg(*[F.bool_or(test).alias(f"unsafe_{n}") for n, test in enumerate(wanted.values())]).first()
    return [name for n, name in enumerate(wanted) if found[f"unsafe_{n}"]]


def normalize_result(rows: DataFrame, unsafe: Sequence[str] = ()) -> DataFrame:
    """Result values as a reader gets them: ISO times, decimals as doubles.

    A reader's numbers are doubles. Columns in ``unsafe``, as ``unsafe_columns`` finds them, have
    integers beyond that; since a column has one type, all of their integers become text.
    """
    return rows.select(*[result_value(rows, name, name in unsafe).alias(name) for name in rows.columns])
