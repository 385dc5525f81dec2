"""Stacked and normalised bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.exact import (
    WHOLE, exact_totals, from_units, in_units, largest_exponent,
)
from tallyboard.functions.numbers import numeric, quoted
from tallyboard.operators.series import axis_key
from tallyboard.plans.grouped import attach, free_name, sum_before

STANDARD, GROSS, NET = "normalize", "normalize_gross", "normalize_net"
MODES = (STANDARD, GROSS, NET)


def stack_totals(rows: DataFrame, x: str, y: str, *, temporal: bool = False) -> DataFrame:
    """Per x: net sum, gross sum and least value of the numeric y values.

    The sums are the same to the bit however the rows are dealt over tasks.
    """
    return exact_totals(rows, {"__x": axis_key(rows, x, temporal)}, numeric(rows, y), "__least")


def _offends(mode: str) -> Column:
    if mode == STANDARD:
        return F.col("__least") < 0
    if mode == NET:
        return F.col("__net") == 0
    return F.lit(False)


def stack_offenders(
    rows: DataFrame, x: str, y: str, mode: str, *, temporal: bool = False
) -> DataFrame:
    """The x values that a mode cannot normalise: negative parts, or a zero net sum."""
    totals = stack_totals(rows, x, y, temporal=temporal)
    return totals.where(_offends(mode)).select(
        F.col("__x").alias("x"), F.col("__net").alias("net"), F.col("__least").alias("least")
    )


def stack_normalize(
    rows: DataFrame, x: str, y: str, mode: str = STANDARD, *,
    into: str | None = None, temporal: bool = False,
) -> DataFrame:
    """Add the share of y in its x.

    ``normalize`` divides by the sum and refuses negative values;
    ``normalize_gross`` divides by the sum of sizes and keeps the sign;
    ``normalize_net`` divides by the size of the sum and refuses a zero sum.
    Non-numeric y stays NULL. A refused stack fails the query that reads it;
    ``stack_offenders`` lists them beforehand.
    """
    if mode not in MODES:
        raise ValueError(f"unknown stack mode {mode!r}")
    name = into or free_name(rows.columns, f"{y}_normalized")
    totals = stack_totals(rows, x, y, temporal=temporal)
    shares = attach(rows, totals, {"__x": axis_key(rows, x, temporal)})
    value = numeric(rows, y)
    whole = {STANDARD: F.col("__net"), GROSS: F.col("__gross"), NET: F.abs("__net")}[mode]
    problem = {
        STANDARD: f"stack '{mode}' needs values of {y} that are not negative, at {x}=",
        GROSS: "",
        NET: f"stack '{mode}' needs a sum of {y} that is not zero, at {x}=",
    }[mode]
    shown = F.coalesce(F.col(quoted(x)).cast("string"), F.lit("—"))
    refusal = F.raise_error(F.concat(F.lit(problem), shown)).cast("double")
    share = F.coalesce(F.try_divide(value, whole), F.lit(0.0))
    guarded = share if mode == GROSS else F.when(_offends(mode), refusal).otherwise(share)
    return shares.withColumn(name, F.when(value.isNotNull(), guarded)).drop(
        "__net", "__gross", "__least"
    )


def stack_zero(
    rows: DataFrame, x: str, y: str, order: Sequence[str], *,
    temporal: bool = False,
) -> DataFrame:
    """Add ``y0`` and ``y1``: positive values pile up, negative ones down, per x.

    Both ends are sums of whole numbers, so they are the same to the bit however the rows are
    dealt over tasks, and a value's upper end is the next one's lower end.
    """
    value = numeric(rows, y)
    # Values that are not numbers take no room and get no position.
    side = F.coalesce(value < 0, F.lit(False))
    keyed = rows.select(
        "*", axis_key(rows, x, temporal).alias("__x"), side.alias("__down"), value.alias("__y")
    )
    group = ["__x", "__down"]
    tops = largest_exponent(keyed, group, F.col("__y"))
    scaled = attach(keyed, tops, {name: F.col(name) for name in group})
    scaled = scaled.withColumn("__units", in_units(F.col("__y"), F.col("__top")))
    piled = sum_before(scaled, F.col("__units"), group, order, "__before")
    ends = {
        "y0": F.col("__before").cast(WHOLE), "y1": (F.col("__before") + F.col("__units")).cast(WHOLE),
    }
    shown = [
        F.when(F.col("__y").isNotNull(), from_units(end, F.col("__top"))).alias(name)
        for name, end in ends.items()
    ]
    return piled.select(*rows.columns, *shown)
