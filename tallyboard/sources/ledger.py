"""Content hashes and profiles of growing sources, kept per file.

The ledger is a Parquet dataset with one row for each file of a source that was ever measured:
its path, length and time of change, the schema it was read with, and the measures of
its rows. A build reads only files that the ledger does not have; the measures of all files
that are there now add up to those of the source. So adding a file costs that file, and
a file that is gone is simply not added.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.operators import measure
from tallyboard.operators.identity import schema_text
from tallyboard.plans.grouped import free_name
from tallyboard.sources import folders
from tallyboard.sources.load import ContractError, Source, source_files

#: What makes a file the same one: any change of it changes one of these.
FILE = ["path", "length", "changed_at"]
SCHEMA = (
    "source string, layout string, path string, length long, changed_at timestamp, "
    + ", ".join(f"{name} {kind}" for name, kind in measure.KINDS.items())
)


def plain(path: Column) -> Column:
    """A path with one slash behind its scheme, however many it was given with."""
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def written(path: Column) -> Column:
    """A path of the reader, which encodes special characters, as the listing has it."""
    return plain(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


@dataclass(frozen=True)
class LedgerState:
    """The measures of a source, and how many of its files had to be read for them."""

    measures: dict[str, Any]
    files: int
    scanned: int
    bytes: int


def layout(source: Source) -> str:
    """What measures depend on beside the rows: the schema and the freshness columns."""
    settings = [repr(source.freshness.data_time_column), repr(source.freshness.processed_time_column)]
    text = "|".join([schema_text(source.raw, source.raw.columns), *settings])
    return hashlib.sha256(text.encode()).hexdigest()


class ContentLedger:
    """The ledger below ``folder``, which all executors have to see.

    Runs append rows and never change any, so a run that stops leaves a ledger that knows
    less and nothing that is wrong; a file that two runs measured has two equal rows, which
    count once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        if not folders.exists(self.spark, self.folder):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.folder)

    def update(self, source: Source) -> LedgerState:
        """Measure the files of ``source`` that the ledger lacks; the measures of them all.

        Only sources in Parquet files have files that can be measured one by one.
        """
        if not source.in_files:
            raise ContractError(f"source {source.name} is not one of Parquet files")
        mark = layout(source)
        files = self._listed(source.path)
        known = self.rows().where(F.col("layout") == mark).select(*FILE).distinct()
        unseen = [row["path"] for row in files.join(known, FILE, "left_anti").select("path").collect()]
        if unseen:
            self._measure(source, mark, files, unseen)
        return self._state(mark, files, len(unseen))

    def _listed(self, path: str) -> DataFrame:
        hidden = F.col("file_name").rlike("^[_.]")
        return source_files(self.spark, path).where(~hidden).select(*FILE)

    def _measure(self, source: Source, mark: str, files: DataFrame, unseen: list[str]) -> None:
        reader = self.spark.read.schema(source.raw.schema)
        if folders.is_folder(self.spark, source.path):
            # Partition values are in the paths below the source's own.
            reader = reader.option("basePath", source.path)
        # The reader lists the given files anyway, so their names pass through the driver.
        place = free_name(source.raw.columns, "place")
        frame = reader.parquet(*unseen).withColumn(place, written(F.col("_metadata.file_path")))
        rows, found = measure.measures(source, frame)
        per_file = rows.groupBy(F.col(place).alias("place")).agg(
            *[value.alias(name) for name, value in found.items()]
        )
        # A file without rows has no measures, but is known from now on.
        (
            files.where(F.col("path").isin(unseen)).withColumn("place", plain(F.col("path")))
            .join(per_file, "place", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
            .select(F.lit(source.name).alias("source"), F.lit(mark).alias("layout"), *FILE, *measure.KINDS)
            .write.mode("append").parquet(self.folder)
        )

    def _state(self, mark: str, files: DataFrame, scanned: int) -> LedgerState:
        known = self.rows().where(F.col("layout") == mark).drop("source", "layout")
        # Equal rows of one file count once.
        once = known.join(files, FILE, "left_semi").dropDuplicates(FILE)
        row = measure.merged(once.withColumn("one", F.lit(1)), "one").first()
        sizes = files.agg(F.count(F.lit(1)), F.sum("length")).first()
        found = {name: row[name] if row else None for name in measure.KINDS}
        return LedgerState(found | {"rows": found["rows"] or 0}, sizes[0], scanned, sizes[1] or 0)
