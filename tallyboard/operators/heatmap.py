"""Heatmap cells, colour domain and row metric."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.formatting import MISSING, ValueFormat, format_number
from tallyboard.functions.numbers import is_blank, numeric, quoted
from tallyboard.plans.grouped import attach


def heatmap_cells(
    rows: DataFrame, x: str, y: str, value: str, *,
    details: Sequence[str] = (), percent_label: bool = False,
) -> DataFrame:
    """Cells sorted by x and y; with ``percent_label`` a label of value times 100."""
    names = list(dict.fromkeys([x, y, value, *details]))
    cells = rows.select(*[F.col(quoted(name)) for name in names])
    if percent_label:
        cells = cells.withColumn("cell_label", numeric(rows, value) * 100)
    return cells.orderBy(F.col(quoted(x)).asc_nulls_last(), F.col(quoted(y)).asc_nulls_last())


def heatmap_matrix(
    rows: DataFrame, x: str, y: str, value: str, x_values: Sequence[Any]
) -> DataFrame:
    """One row per y and one column per given x; without a cell the value is NULL."""
    return rows.groupBy(quoted(y)).pivot(quoted(x), list(x_values)).agg(F.max(quoted(value)))


def heatmap_domain(rows: DataFrame, y: str, value: str) -> DataFrame:
    """One row: scale, its ends, and the number of heatmap rows.

    Zero always belongs to the domain; a negative value makes it symmetric.
    """
    number = numeric(rows, value)
    per_row = rows.groupBy(quoted(y)).agg(F.min(number).alias("low"), F.max(number).alias("high"))
    ends = per_row.agg(
        F.least(F.coalesce(F.min("low"), F.lit(0.0)), F.lit(0.0)).alias("low"),
        F.greatest(F.coalesce(F.max("high"), F.lit(0.0)), F.lit(0.0)).alias("high"),
        F.count(F.lit(1)).alias("row_count"),
    )
    diverging = F.col("low") < 0
    limit = F.greatest(F.abs("low"), F.abs("high"))
    return ends.select(
        F.when(diverging, "diverging").otherwise("sequential").alias("scale"),
        F.when(diverging, -limit).otherwise(F.col("low")).alias("domain_low"),
        F.when(diverging, limit).otherwise(F.col("high")).alias("domain_high"),
        "row_count",
    )


def row_metric_conflicts(rows: DataFrame, y: str, metric: str) -> DataFrame:
    """The y values whose metric is not one number."""
    return _metric_groups(rows, y, metric).where(
        (F.col("__bad") > 0) | (F.col("__low") < F.col("__high"))
    )


def _metric_groups(rows: DataFrame, y: str, metric: str) -> DataFrame:
    number = numeric(rows, metric)
    bad = ~is_blank(rows, metric) & number.isNull()
    return rows.groupBy(F.col(quoted(y)).alias(y)).agg(
        F.min(number).alias("__low"), F.max(number).alias("__high"),
        F.count(F.when(bad, 1)).alias("__bad"),
    )


def heatmap_row_metric(
    rows: DataFrame, y: str, metric: str, style: ValueFormat = ValueFormat()
) -> DataFrame:
    """One row per y: the metric, its shown text and its full text.

    The metric may be repeated or be on one row only; two values, or one that is
    not a number, fail the query that reads it.
    """
    groups = _metric_groups(rows, y, metric)
    shown_y = F.coalesce(F.col(quoted(y)).cast("string"), F.lit(MISSING))

    def refusal(problem: str):
        text = F.lit(f"heatmap row metric {metric!r} {problem} for {y}=")
        return F.raise_error(F.concat(text, shown_y)).cast("double")

    single = (
        F.when(F.col("__bad") > 0, refusal("is not a number"))
        .when(F.col("__low") < F.col("__high"), refusal("has more than one value"))
        .otherwise(F.col("__high"))
    )
    full = ValueFormat(style.format, style.currency, "standard")
    metrics = groups.select(F.col(quoted(y)), single.alias("metric"))
    return metrics.select(
        "*",
        F.coalesce(format_number(F.col("metric"), style), F.lit(MISSING)).alias("metric_display"),
        F.coalesce(format_number(F.col("metric"), full), F.lit(MISSING)).alias("metric_tooltip"),
    )


def with_row_metric(
    rows: DataFrame, y: str, metric: str, style: ValueFormat = ValueFormat()
) -> DataFrame:
    """Cells with the metric text of their row."""
    metrics = heatmap_row_metric(rows, y, metric, style).select(
        F.col(quoted(y)).alias("__row"), "metric_tooltip"
    )
    return attach(rows, metrics, {"__row": F.col(quoted(y))})
