"""CSV rows with fewer or more cells than the header, with the place they come from.

Such rows are read all the same: missing cells are NULL, further ones are dropped. Here they
are data: which rows they are, and how many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.functions.numbers import quoted
from tallyboard.plans.grouped import free_name

SHORT, LONG = "short_rows", "long_rows"
# A quoted stretch of a record. Possessive, so that the match stays linear.
_QUOTED_TEXT = r'"(?:[^"]++|"")*+"'


def cells(record: Column) -> Column:
    """Number of cells of a CSV record: one more than the commas outside quotes."""
    bare = F.regexp_replace(record, _QUOTED_TEXT, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def kind_of(count: Column, columns: int) -> Column:
    return F.when(count < columns, SHORT).when(count > columns, LONG)


def ragged_counts(line: Column, columns: int) -> list[Column]:
    """Aggregates over the lines of files whose records are one line each; blank lines are none."""
    kind = F.when(F.trim(line) != "", kind_of(cells(line), columns))
    return [F.count(F.when(kind == name, 1)).alias(name) for name in (SHORT, LONG)]


def quarantine(spark: SparkSession, path: str, columns: list[str], spans: bool = False) -> DataFrame:
    """(file, line, kind, cells, record): the rows of the CSV files below ``path`` that do not fit.

    ``columns`` is the header. Lines are counted from one in every file, over any number
    of splits. ``spans`` is for files with records of several lines: the reader finds their
    records, and tells no line.
    """
    if spans:
        return _records(spark, path, columns)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("record"),
    )
    # The lines of a split have consecutive places. One row a split, not one a line, is sorted.
    splits = lines.groupBy("file", "start").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("held")
    )
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    count = cells(F.col("record"))
    odd = lines.where(F.trim("record") != "").select("*", count.alias("cells")).withColumn(
        "kind", kind_of(F.col("cells"), len(columns))
    ).where(F.col("kind").isNotNull())
    return odd.join(splits, ["file", "start"]).select(
        "file", (F.col("place") - F.col("first") + F.col("before") + 1).alias("line"),
        "kind", "cells", "record",
    )


def _records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    broken = free_name(columns, "broken_record")
    schema = ", ".join(f"{quoted(column)} string" for column in [*columns, broken])
    rows = (
        spark.read.schema(schema).option("header", True).option("escape", '"')
        .option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", broken).csv(path)
    )
    # The reader reports a broken record only to a query that reads other columns as well.
    others = F.length(F.concat_ws("", *[F.col(quoted(column)) for column in columns])) >= 0
    record = F.col(quoted(broken))
    return (
        rows.where(record.isNotNull() & others)
        .select(F.col("_metadata.file_path").alias("file"), F.lit(None).cast("long").alias("line"),
                kind_of(cells(record), len(columns)).alias("kind"), cells(record).alias("cells"),
                record.alias("record"))
        .where(F.col("kind").isNotNull())
    )
