"""Shared tooltips: every row of one x, in query order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.numbers import quoted
from tallyboard.operators.series import axis_key
from tallyboard.plans.grouped import position


def detail_label(field: str) -> str:
    text = field.replace("_", " ")
    return text[:1].upper() + text[1:]


def detail_fields(details: str | Sequence[str]) -> list[str]:
    """Field names of a comma list, or the names given."""
    parts = details.split(",") if isinstance(details, str) else details
    return [part.strip() for part in parts if part.strip()]


def tooltip_entries(
    rows: DataFrame, x: str, y: str, order: Sequence[str], *,
    series: str | None = None, color_field: str | None = None,
    details: str | Sequence[str] = (), normalized: str | None = None,
    labels: dict[str, str] | None = None, temporal: bool = False,
) -> DataFrame:
    """One row per tooltip entry: x, its place, series, colour value, value, details.

    A bucket is the set of rows with one x, and is never gathered into one cell:
    its size has no bound. ``order`` is the query's order.
    """
    fields = detail_fields(details)
    names = labels or {}
    series_value = F.col(quoted(series or y))
    color_value = F.col(quoted(color_field)) if color_field else series_value
    pairs = [
        F.struct(
            F.lit(names.get(field, detail_label(field))).alias("label"),
            F.col(quoted(field)).cast("string").alias("value"),
        )
        for field in fields
    ]
    keyed = rows.withColumn("__x", axis_key(rows, x, temporal))
    placed = position(keyed, ["__x"], order, "__place")
    return placed.select(
        F.col(quoted(x)).alias("x"),
        F.col("__place").alias("place"),
        series_value.alias("series"),
        color_value.alias("color_value"),
        F.col(quoted(y)).alias("value"),
        *([F.col(quoted(normalized)).alias("normalized_value")] if normalized else []),
        (F.array(*pairs) if pairs else F.array().cast("array<struct<label:string,value:string>>"))
        .alias("details"),
    )
