"""Sums of doubles that do not depend on the order of the rows.

Adding doubles rounds, so their sum depends on how rows are dealt over tasks. Whole numbers
can be added in any order. A double is a whole number times a power of two: values are
put into bins of neighbouring powers, where they are whole numbers of 64 bits, and a bin is
summed exactly. The few bins of a group are then added in their order. For running sums, all
values of a group become whole numbers of one unit, that of the group's largest value; what
lies below 2**-80 of it is rounded, value by value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbouring powers of two in one bin: values of a bin have at most 60 bits.
BIN = 8
MANTISSA = 52
#: Bits of the largest value of a group in units of the group; 126 fit a decimal, which leaves
#: room for the sum of 2**40 values.
UNIT_BITS = 85
HALF = 43
WHOLE = "decimal(38,0)"


def exponent(value: Column) -> Column:
    """The power of two at or below the size of a value; NULL for zero and NULL.

    The logarithm may be off by one near a power of two; powers of two are exact.
    """
    size = F.abs(value)
    guess = F.floor(F.log2(F.when(size > 0, size))).cast("int")
    power = F.pow(F.lit(2.0), guess.cast("double"))
    return F.when(size < power, guess - 1).when(size / 2 >= power, guess + 1).otherwise(guess)


def times_power(value: Column, power: Column) -> Column:
    """``value`` times two to the ``power``, in two steps, since one may be out of range."""
    first = F.floor(power / 2).cast("double")
    return value * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), power.cast("double") - first)


def exact_totals(
    rows: DataFrame, keys: Mapping[str, Column], value: Column, least: str | None = None
) -> DataFrame:
    """``keys`` with ``__net`` and ``__gross``, the sums of the values and of their sizes.

    NULL values take no part; a group without any has NULL sums. ``least`` names a column for
    the smallest value. Equal rows give equal bits, however they are dealt and ordered.
    """
    binned = rows.select(
        *[column.alias(name) for name, column in keys.items()], value.alias("__value"),
        F.coalesce(F.floor(exponent(value) / BIN), F.lit(0)).cast("int").alias("__bin"),
    )
    whole = times_power(F.col("__value"), F.lit(MANTISSA) - F.col("__bin") * BIN).cast("long")
    bins = binned.withColumn("__whole", whole.cast("decimal(20,0)")).groupBy(*keys, "__bin").agg(
        F.sum("__whole").alias("net"), F.sum(F.abs("__whole")).alias("gross"),
        F.min("__value").alias("__low"),
    )
    held = F.when(F.col("net").isNotNull(), F.struct(F.col("__bin").alias("bin"), "net", "gross"))
    groups = bins.groupBy(*keys).agg(
        F.sort_array(F.collect_list(held), asc=False).alias("__bins"), F.min("__low").alias("__low"),
    )

    def total(name: str) -> Column:
        part = lambda b: times_power(b[name].cast("double"), b["bin"] * BIN - MANTISSA)
        added = F.aggregate("__bins", F.lit(0.0), lambda whole, b: whole + part(b))
        return F.when(F.size("__bins") > 0, added)

    return groups.select(
        *keys, total("net").alias("__net"), total("gross").alias("__gross"),
        *([F.col("__low").alias(least)] if least else []),
    )


def largest_exponent(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """``keys`` with ``__top``, the exponent of the group's largest value; zero without any."""
    return rows.groupBy(*keys).agg(F.coalesce(F.max(exponent(value)), F.lit(0)).alias("__top"))


def in_units(value: Column, top: Column) -> Column:
    """A value as a whole number of units of its group; 0 for NULL.

    A double holds no more than 53 bits, so the number is put together from two halves, each
    of which is exact.
    """
    scaled = F.rint(times_power(F.coalesce(value, F.lit(0.0)), F.lit(UNIT_BITS - 1) - top))
    high = F.floor(scaled / F.lit(2.0**HALF)).cast("long")
    low = (scaled - high.cast("double") * F.lit(2.0**HALF)).cast("long")
    return (high.cast(WHOLE) * F.lit(2**HALF).cast("decimal(14,0)") + low.cast(WHOLE)).cast(WHOLE)


def from_units(number: Column, top: Column) -> Column:
    """The double nearest to a whole number of units."""
    return times_power(number.cast("double"), top - F.lit(UNIT_BITS - 1))
