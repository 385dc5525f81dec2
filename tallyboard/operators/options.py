"""Selectable values of a parameter."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.numbers import quoted
from tallyboard.functions.predicates import ALL, option_label
from tallyboard.plans.grouped import free_name


def distinct_options(source: DataFrame, column: str, *, include_null: bool = True) -> DataFrame:
    """Distinct values as ``value``, unsorted; partial distinct runs before the shuffle."""
    if column not in source.columns:
        raise ValueError(f"options need column {column!r}, which the source does not have")
    options = source.select(F.col(quoted(column)).alias("value")).distinct()
    return options if include_null else options.where(F.col("value").isNotNull())


def param_options(source: DataFrame, column: str, *, include_null: bool = True) -> DataFrame:
    """Distinct values as ``value``, ascending with NULL last."""
    options = distinct_options(source, column, include_null=include_null)
    return options.orderBy(F.col("value").asc_nulls_last())


def option_labels(options: DataFrame, null_label: str = "(Null)") -> DataFrame:
    """Options with the text shown for them."""
    label = free_name(options.columns, "label")
    return options.withColumn(label, option_label("value", null_label))


def collapse_selection(
    source: DataFrame, column: str, selection: list[Any], *, include_null: bool = True
) -> DataFrame:
    """One row: ``all`` when every option is selected, else ``partial`` or ``none``.

    ``all`` brings back rows outside the option list, such as NULLs that cannot
    be selected. The options are counted where they are; only the count moves.
    """
    options = distinct_options(source, column, include_null=include_null)
    values = [value for value in selection if value is not None]
    chosen = F.col("value").isin(values) if values else F.lit(False)
    if include_null and len(values) < len(selection):
        chosen = F.col("value").isNull() | chosen
    counts = options.agg(
        F.count(F.lit(1)).alias("options"),
        F.count(F.when(F.coalesce(chosen, F.lit(False)), 1)).alias("selected"),
    )
    every = (F.col("options") > 0) & (F.col("options") == F.col("selected"))
    state = (
        F.when(every, ALL).when(F.col("selected") == 0, "none").otherwise("partial")
    )
    return counts.select("options", "selected", state.alias("selection"))


def commit_selection(
    source: DataFrame, column: str, selection: list[Any], *, include_null: bool = True
) -> Any:
    """The parameter value a selection stands for: ``"all"`` or the list itself."""
    state = collapse_selection(source, column, selection, include_null=include_null).first()
    return ALL if state["selection"] == ALL else list(selection)
