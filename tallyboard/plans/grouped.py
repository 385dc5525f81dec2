"""Per-group values over frames in which one group may hold most rows.

A plain ``Window.partitionBy(group)`` puts a whole group into one task. These
helpers aggregate first (partial sums run before the shuffle) and bring the
small per-group result back, or cut a hot group into ordered pieces.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.session import cut_lineage

def free_name(columns: Sequence[str], base: str) -> str:
    """``base``, with underscores appended until no column has that name."""
    name = base
    while name in columns:
        name += "_"
    return name


def attach(rows: DataFrame, per_group: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Add the columns of ``per_group`` to every row of its group.

    ``keys`` maps the key columns of ``per_group`` to expressions over ``rows``;
    NULL keys match NULL keys. The join is left to AQE: a small measured side is
    broadcast, a hot key on the left side is split over several tasks.
    """
    side = per_group.withColumnsRenamed({key: f"__side_{key}" for key in keys})
    condition = reduce(
        lambda left, right: left & right,
        [expression.eqNullSafe(F.col(f"__side_{key}")) for key, expression in keys.items()],
    )
    return rows.join(side, condition, "left").drop(*[f"__side_{key}" for key in keys])


def sum_before(
    rows: DataFrame, value: Column, group: Sequence[str], order: Sequence[str], into: str
) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the earlier rows of the same group.

    The rows are range-partitioned by (group, order), summed inside each range, and
    shifted by the totals of the ranges before it, so no task holds a group. Rows
    equal in all of that are dealt by their number in the input, so that a run of
    them is split as well; which of them comes first does not change the sums.
    """
    earlier = [F.col(name).asc_nulls_last() for name in order]
    # The checkpoint fixes ranges and numbers, so both uses below see the same ones.
    ranged = cut_lineage(
        rows.withColumn("__value", value)
        .withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(*group, *earlier, F.col("__tie"))
        .withColumn("__range", F.spark_partition_id())
    )
    inside = Window.partitionBy("__range", *group).orderBy(*earlier, "__tie").rowsBetween(
        Window.unboundedPreceding, -1
    )
    pieces = ranged.groupBy("__range", *group).agg(F.sum("__value").alias("__piece"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = pieces.select(
        "__range", *group, F.coalesce(F.sum("__piece").over(before), F.lit(0)).alias("__shift")
    )
    summed = ranged.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return (
        attach(summed, shifts, {name: F.col(name) for name in ["__range", *group]})
        .withColumn(into, F.col("__inside") + F.col("__shift"))
        .drop("__value", "__tie", "__range", "__inside", "__shift")
    )


def position(rows: DataFrame, group: Sequence[str], order: Sequence[str], into: str) -> DataFrame:
    """Add ``into``: the 1-based place of the row in its group."""
    counted = sum_before(rows, F.lit(1).cast("long"), group, order, into)
    return counted.withColumn(into, F.col(into) + F.lit(1))
