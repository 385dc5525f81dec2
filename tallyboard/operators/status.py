"""Roll-up over sources and the per-source status view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.operators.profile import PASSED, WARNING

NOT_CONFIGURED = "Not configured"


def freshness_rollup(passports: DataFrame, checks: DataFrame) -> DataFrame:
    """One row: overall status, latest data time, latest processing time.

    The status is that of all checks, not only of the freshness ones.
    """
    status = checks.agg(
        F.when(F.coalesce(F.bool_or(F.col("status") == WARNING), F.lit(False)), WARNING)
        .otherwise(PASSED)
        .alias("status")
    )
    times = passports.agg(
        F.max("data_max_at").alias("data_through"), F.max("processed_at").alias("processed_at")
    )
    # One row on each side.
    return status.join(F.broadcast(times), F.lit(True))


def shown_time(instant: Column, granularity: Column, timezone: str) -> Column:
    """Date-only values keep their day; instants move to the report's zone."""
    day = F.date_format(instant, "MMM dd, yyyy")
    local = F.from_utc_timestamp(instant, timezone)
    moment = F.date_format(local, "MMM dd, yyyy, hh:mm a")
    return F.coalesce(
        F.when(granularity == "date", day).otherwise(moment), F.lit(NOT_CONFIGURED)
    )


def data_status(passports: DataFrame, timezone: str = "UTC") -> DataFrame:
    """What a reader sees per source: through, processed, rows, status."""
    return passports.select(
        "name",
        shown_time(F.col("data_max_at"), F.col("data_time_granularity"), timezone).alias("through"),
        shown_time(
            F.col("processed_at"), F.col("processed_time_granularity"), timezone
        ).alias("processed"),
        F.format_number(F.col("rows"), 0).alias("rows"),
        F.col("freshness_status").alias("status"),
    )
