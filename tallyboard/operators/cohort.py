"""Cohort retention frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cohort_retention(rows: DataFrame, member: str, time: str) -> DataFrame:
    """Cohort month, period, cohort size, retained members and the retained share.

    Members are shuffled once, each as the set of months it was active in: a
    date has at most 120,000 months, so a member with very many rows stays small
    and is merged before the shuffle. The size window runs over one row per
    cohort and period.
    """
    month = F.trunc(F.col(time).cast("date"), "MM")
    active = rows.where(F.col(time).isNotNull() & F.col(member).isNotNull())
    members = active.groupBy(member).agg(F.collect_set(month).alias("months"))
    spread = members.select(
        F.array_min("months").alias("cohort_month"), F.explode("months").alias("month")
    )
    number = (
        (F.year("month") - F.year("cohort_month")) * 12
        + F.month("month") - F.month("cohort_month")
    ).alias("period_number")
    cells = spread.groupBy("cohort_month", number).agg(F.count(F.lit(1)).alias("retained"))
    # Every member is active in period 0, the largest one of its cohort.
    size = F.max("retained").over(Window.partitionBy("cohort_month"))
    return cells.select(
        "cohort_month", "period_number", size.alias("cohort_size"), "retained",
        (F.col("retained") / size).alias("retention"),
    )
