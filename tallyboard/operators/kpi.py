"""Single values and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.formatting import (
    MISSING, ValueFormat, format_number, format_signed_percent, format_value,
)
from tallyboard.functions.numbers import is_blank, numeric, quoted

NEUTRAL, HIGHER, LOWER = "neutral", "higher_is_better", "lower_is_better"
COMPACT = ValueFormat(notation="compact")


def first_row(rows: DataFrame, order: Sequence[Column] = ()) -> DataFrame:
    """The first row in the given order; planned as a top-1, not a full sort."""
    return rows.orderBy(*order).limit(1) if order else rows.limit(1)


def kpi_value(
    rows: DataFrame, value: str, *, order: Sequence[Column] = (), style: ValueFormat = COMPACT
) -> DataFrame:
    """Value of the first row and its text; blank is missing, zero is a value."""
    row = first_row(rows, order)
    blank = is_blank(row, value)
    return row.select(
        F.when(~blank, F.col(quoted(value))).alias("value"),
        F.when(blank, MISSING).otherwise(format_value(row, value, style)).alias("display"),
    )


def kpi_delta(
    rows: DataFrame, value: str, compare: str, *, direction: str = NEUTRAL,
    order: Sequence[Column] = (), style: ValueFormat = COMPACT, delta: str = "both",
) -> DataFrame:
    """Current, previous, difference, share of change, verdict and the shown text.

    There is no delta unless both values are finite numbers, and no share when
    the previous value is zero.
    """
    row = first_row(rows, order)
    current, previous = numeric(row, value), numeric(row, compare)
    change = F.col("current_value") - F.col("previous_value")
    better = {HIGHER: F.col("delta") > 0, LOWER: F.col("delta") < 0}.get(direction, F.lit(False))
    worse = {HIGHER: F.col("delta") < 0, LOWER: F.col("delta") > 0}.get(direction, F.lit(False))
    absolute_text = format_number(F.col("delta"), style, signed=True)
    percent_text = F.coalesce(format_signed_percent(F.col("delta_share")), F.lit(MISSING))
    shown = {
        "absolute": absolute_text,
        "percent": F.when(F.col("delta").isNotNull(), percent_text),
        "both": F.concat(absolute_text, F.lit(" · "), percent_text),
    }[delta]
    numbers = row.select(current.alias("current_value"), previous.alias("previous_value"))
    changed = numbers.withColumn("delta", change).withColumn(
        "delta_share", F.try_divide("delta", F.abs("previous_value"))
    )
    return changed.select(
        "*",
        F.when(better, "good").when(worse, "bad").when(F.col("delta").isNotNull(), "neutral")
        .alias("verdict"),
        shown.alias("delta_text"),
    )
