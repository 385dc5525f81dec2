"""Row counts, value counts and ranges of Parquet sources from their file footers.

Spark's own Parquet reader answers counts, and minima and maxima of whole numbers and dates,
from the statistics in the footers if the aggregate is pushed down to it. No row is
read then, so the cost grows with the files and not with the rows. Times and texts have no
exact statistics; they are scanned, and so is a source with a file that was written without
any.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyboard.functions.numbers import quoted

#: Types whose footer statistics are exact.
SERVED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
#: The readers of the first generation, which take no aggregates, are left to other formats.
OTHER_READERS = "avro,csv,json,kafka,orc,text"


@dataclass(frozen=True)
class ColumnFacts:
    values: int
    low: Any = None
    high: Any = None


@dataclass(frozen=True)
class FooterFacts:
    """``pushed`` tells whether the footers alone answered; otherwise rows were scanned."""

    rows: int
    columns: dict[str, ColumnFacts]
    pushed: bool


def served(data_type: T.DataType) -> bool:
    return isinstance(data_type, SERVED)


def footer_plan(spark: SparkSession, path: str, names: Sequence[str], pushdown: bool = True) -> DataFrame:
    """One row: rows, and for each column its values and, where it has an exact range, that range.

    The frame belongs to a session of its own, since the reader is chosen by settings that
    other reads of this session should not see.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if pushdown:
        own.conf.set("spark.sql.sources.useV1SourceList", OTHER_READERS)
        own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    frame = own.read.parquet(path)
    wanted = [F.count(F.lit(1)).alias("rows")]
    for number, name in enumerate(names):
        column = F.col(quoted(name))
        wanted.append(F.count(column).alias(f"values_{number}"))
        if served(frame.schema[name].dataType):
            wanted += [F.min(column).alias(f"low_{number}"), F.max(column).alias(f"high_{number}")]
    return frame.agg(*wanted)


def is_pushed(plan: DataFrame) -> bool:
    """Whether the reader answers all of the aggregate of ``footer_plan``."""
    text = plan._jdf.queryExecution().executedPlan().toString()
    return "PushedAggregation: [COUNT(*)" in text


def footer_facts(spark: SparkSession, path: str, names: Sequence[str]) -> FooterFacts:
    """Facts of top-level columns of the Parquet files below ``path``.

    Names in ``names`` may be of any type; those without an exact range get counts only.
    Where some file lacks statistics, the same aggregate is answered by a scan.
    """
    plan = footer_plan(spark, path, names)
    pushed = is_pushed(plan)
    try:
        row = plan.first()
    except (PySparkException, Py4JJavaError):
        if not pushed:
            raise
        # A footer has no statistics for one of the columns. If something else is wrong with
        # the file, the scan raises it.
        pushed, row = False, footer_plan(spark, path, names, pushdown=False).first()
    found = row.asDict()
    return FooterFacts(
        found["rows"],
        {
            name: ColumnFacts(found[f"values_{n}"], found.get(f"low_{n}"), found.get(f"high_{n}"))
            for n, name in enumerate(names)
        },
        pushed,
    )
