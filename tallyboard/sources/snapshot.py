"""Complete copies of the sources next to a report."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from tallyboard.functions.numbers import quoted
from tallyboard.operators import measure
from tallyboard.plans.grouped import free_name
from tallyboard.sources import folders
from tallyboard.sources.footers import footer_facts
from tallyboard.sources.load import ContractError, Source


@dataclass(frozen=True)
class Layout:
    """How a copy is laid out for the reports that read it.

    Rows are clustered by ``cluster_by``, usually the data time, so that a range of it lies in
    few files and row groups and the rest is skipped by their statistics. ``lookups`` are
    columns that reports filter by single values: Bloom filters of about ``distinct`` values a
    row group tell which groups cannot have one. ``group_bytes`` is the size of row groups.
    """

    cluster_by: str | None = None
    lookups: tuple[str, ...] = ()
    distinct: int = 100_000
    group_bytes: int = 64 << 20

    def writer(self, frame: DataFrame) -> DataFrameWriter:
        if self.cluster_by is not None:
            # Ranges are dealt by a sample and are of nearly equal size; rows of one time may
            # lie in several, so a time that most rows have is no single task.
            at = F.col(quoted(self.cluster_by)).asc_nulls_last()
            tie = free_name(frame.columns, "tie")
            rows = frame.withColumn(tie, F.monotonically_increasing_id())
            frame = rows.repartitionByRange(at, F.col(tie)).sortWithinPartitions(at).drop(tie)
        writer = frame.write.option("parquet.block.size", self.group_bytes)
        for name in self.lookups:
            writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(
                f"parquet.bloom.filter.expected.ndv#{name}", self.distinct)
        return writer


def snapshot_sources(
    sources: Iterable[Source], folder: str, *, mode: str = "errorifexists",
    layouts: Mapping[str, Layout] | None = None,
) -> dict[str, str]:
    """Write each source to ``folder/sources/<name>.parquet``; returns the paths.

    ``layouts`` says for a source how its copy is laid out; others keep their rows' order.
    """
    written = {}
    for source in sources:
        path = f"{folder.rstrip('/')}/sources/{source.name}.parquet"
        layout = (layouts or {}).get(source.name)
        writer = source.frame.write if layout is None else layout.writer(source.frame)
        writer.mode(mode).parquet(path)
        written[source.name] = path
    return written


@dataclass(frozen=True)
class Snapshot:
    """Copies of sources in a folder of their own, and what was measured on the way there."""

    spark: SparkSession
    folder: str
    measures: dict[str, dict[str, Any]]

    def settle(self, home: str) -> None:
        """Move the copies to ``home/sources``; equal ones that are there already are kept.

        ``home`` is named after the content, so what is there has the same rows.
        """
        folders.move(self.spark, f"{self.folder}/sources", f"{home.rstrip('/')}/sources")
        self.drop()

    def drop(self) -> None:
        folders.remove(self.spark, self.folder)


def measured_snapshot(spark: SparkSession, sources: Iterable[Source], folder: str) -> Snapshot:
    """Write each source below a fresh folder in ``folder`` and measure its rows as they pass.

    Every source is read once. The footers of what was written have to have as many rows as
    were measured.
    """
    copies = Snapshot(spark, f"{folder.rstrip('/')}/.copies-{uuid.uuid4().hex}", {})
    for source in sources:
        rows, seen = measure.observed(source)
        path = f"{copies.folder}/sources/{source.name}.parquet"
        rows.write.parquet(path)
        found = dict(seen.get)
        held = footer_facts(spark, path, []).rows
        if held != found["rows"]:
            copies.drop()
            raise ContractError(f"source {source.name}: {found['rows']} rows were read and {held} written")
        copies.measures[source.name] = found
    return copies
