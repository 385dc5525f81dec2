"""Line and bar frames: columns, axis type, series ranks, period comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.csv_text import has_time
from tallyboard.functions.numbers import field_type, quoted
from tallyboard.functions.text_types import iso_instant
from tallyboard.plans.grouped import position

TEMPORAL, NOMINAL = "temporal", "nominal"
ISO_AXIS_TEXT = r"^\d{4}-\d{2}-\d{2}(T.*)?$"


def effective_series(group: str | None, color: str | None) -> str | None:
    return group or color


def series_frame(
    rows: DataFrame, x: str, y: str, *,
    group: str | None = None, color: str | None = None, details: Sequence[str] = (),
) -> DataFrame:
    """x, y, the effective series and the details; rows stay as they are."""
    series = effective_series(group, color)
    wanted = [x, y, *([series] if series else []), *details]
    return rows.select(*[F.col(quoted(name)) for name in dict.fromkeys(wanted)])


def _is_iso(text: Column) -> Column:
    return text.rlike(ISO_AXIS_TEXT) & iso_instant(text).isNotNull()


def axis_kind(
    rows: DataFrame, x: str, order: Sequence[str], *, side_by_side: bool = False
) -> Column:
    """An aggregate: ``temporal`` when the first non-NULL x is an ISO date or datetime.

    ``order`` says which row is first. Bars placed side by side are nominal. Several
    axes of one frame can share an aggregation, and so a scan.
    """
    data_type = field_type(rows, x)
    column = F.col(quoted(x))
    if side_by_side:
        return F.lit(NOMINAL)
    if isinstance(data_type, T.DateType) or has_time(data_type):
        return F.when(F.count(column) > 0, TEMPORAL).otherwise(NOMINAL)
    if isinstance(data_type, T.StringType):
        key = F.when(column.isNotNull(), F.struct(*[F.col(quoted(name)) for name in order]))
        return F.when(_is_iso(F.min_by(column, key)), TEMPORAL).otherwise(NOMINAL)
    return F.lit(NOMINAL)


def axis_type(
    rows: DataFrame, x: str, order: Sequence[str], *, side_by_side: bool = False
) -> DataFrame:
    """One row with the ``axis_kind`` of x."""
    return rows.agg(axis_kind(rows, x, order, side_by_side=side_by_side).alias("axis_type"))


def axis_key(rows: DataFrame, x: str, temporal: bool = False) -> Column:
    """What makes two x values equal: the instant on a temporal text axis, else the value."""
    column = F.col(quoted(x))
    if temporal and isinstance(field_type(rows, x), T.StringType):
        instant = iso_instant(column)
        return F.struct(instant, F.when(instant.isNull(), column))
    return column


def series_rank(
    rows: DataFrame, series: str, *, reverse: bool = False,
) -> DataFrame:
    """Distinct series with their 0-based place on a sequential colour scale."""
    distinct = rows.select(F.col(quoted(series)).alias("series")).distinct()
    ranked = position(distinct, [], ["series"], "place")
    if not reverse:
        return ranked.select("series", (F.col("place") - 1).alias("color_rank"))
    last = ranked.agg(F.max("place").alias("last"))
    # One row on the right.
    return ranked.join(F.broadcast(last), F.lit(True)).select(
        "series", (F.col("last") - F.col("place")).alias("color_rank")
    )


def period_compare(rows: DataFrame, month: str, value: Column) -> DataFrame:
    """Monthly totals with the total of the month before in the same row.

    The window runs after the aggregation, over one row per calendar month: a
    date has at most 120,000 of them.
    """
    months = rows.groupBy(F.trunc(F.col(month).cast("date"), "MM").alias("period")).agg(
        value.alias("current_value")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("period")
    return months.select(
        "period", "current_value", F.lag("current_value").over(before).alias("previous_value")
    )
