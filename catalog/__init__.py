"""The registered queries, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.session import prepare, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(
    name: str, oracle: str | None = None, dates: tuple[str, ...] = ()
) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``oracle`` is its SQL counterpart.

    ``dates`` are date columns of both; results show dates as ISO text.
    """

    def keep(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = build(prepare(spark), sf_dir)
            shown = {date: F.date_format(date, "yyyy-MM-dd") for date in dates}
            return result.withColumns(shown) if shown else result

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            texts = ", ".join(f"strftime({date}, '%Y-%m-%d') AS {date}" for date in dates)
            ORACLE[name] = f"SELECT * REPLACE ({texts}) FROM ({oracle})" if dates else oracle
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def scratch(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder the cluster shares for intermediate data."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def load_all() -> None:
    """Import the modules that register queries."""
    from catalog import export, frames, parameters, profiles, shapes  # noqa: F401
