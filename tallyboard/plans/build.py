"""Building a report: profile and check the sources, identify, record, publish."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard import __version__
from tallyboard.operators.identity import content_identity
from tallyboard.operators.measure import facts as measured_facts
from tallyboard.operators.measure import fingerprint, measured
from tallyboard.operators.profile import (
    WARNING, data_checks, passport, require_passed, timezone_check, union_all,
)
from tallyboard.plans.report import Report
from tallyboard.sources.ledger import ContentLedger
from tallyboard.sources.load import Source, source_files
from tallyboard.sources.manifest import build_manifest, write_manifest
from tallyboard.sources.registry import latest_record, publish
from tallyboard.sources.snapshot import measured_snapshot

HASH_SCHEMA = "name string, file_name string, file_size_bytes long, sha256 string"


@dataclass(frozen=True)
class Build:
    """What a build found. The frames hold a few rows per source."""

    artifact_id: str
    passports: DataFrame
    checks: DataFrame
    manifest: DataFrame
    warnings: list[str]


def measure_sources(
    sources: Iterable[Source], ledger: ContentLedger | None = None
) -> dict[str, dict[str, Any]]:
    """The measures of every source, each read once at most.

    With a ledger only new files of Parquet sources are read. All others are measured in
    one job.
    """
    found, others = {}, []
    for source in sources:
        if ledger is not None and source.in_files:
            found[source.name] = ledger.update(source).measures
        else:
            others.append(source)
    return found | measured(others)


def hash_rows(sources: Iterable[Source], measures: Mapping[str, Mapping[str, Any]]) -> list[tuple]:
    """Name, file name, bytes and row fingerprint of the sources; tables have no file facts."""
    sources = list(sources)
    sizes = [
        source_files(source.frame.sparkSession, source.path)
        .agg(F.lit(source.name).alias("name"), F.sum("length").alias("bytes"))
        for source in sources if source.path is not None
    ]
    held = {row["name"]: row["bytes"] for row in union_all(sizes).collect()} if sizes else {}
    return [
        (
            source.name,
            source.path and source.path.rstrip("/").rsplit("/", 1)[-1], held.get(source.name),
            fingerprint(source, measures[source.name]),
        )
        for source in sources
    ]


def compile_report(
    report: Report, built_at: datetime, *, ledger: ContentLedger | None = None,
    measures: Mapping[str, Mapping[str, Any]] | None = None,
) -> Build:
    """Check the declarations and the sources; nothing but the ledger is written.

    Each source is read once, for its profile and its hash together, and not at all if
    ``measures`` has it already. The results are one row per source, so they go through
    the driver.
    """
    report.check()
    sources = list(report.sources.values())
    known = measure_sources(sources, ledger) if measures is None else measures
    facts = {source.name: measured_facts(source, known[source.name]) for source in sources}
    checks = union_all([data_checks(s, built_at, facts[s.name]) for s in sources])
    checks = held(checks.unionByName(timezone_check(checks, report.timezone)))
    require_passed(checks)

    hashes = report.spark.createDataFrame(hash_rows(sources, known), HASH_SCHEMA)
    versions = {"tool_version": __version__, "runtime_version": f"spark-{report.spark.version}"}
    identity = held(
        content_identity(
            hashes.select("name", "sha256"), report.slug, report.definition_sha256(), **versions
        )
    )
    passports = union_all([passport(s, built_at, facts[s.name]) for s in sources]).join(
        F.broadcast(hashes), "name"
    )
    manifest = build_manifest(
        passports, checks, identity, slug=report.slug, title=report.title,
        built_at=built_at, timezone=report.timezone, **versions,
    )
    artifact_id = identity.first()["artifact_id"]
    warned = checks.where((F.col("status") == WARNING) & F.col("message").isNotNull())
    warnings = [row.message for row in warned.orderBy("source", "name").collect()]
    return Build(artifact_id, passports, checks, manifest, warnings)


def build_report(
    report: Report, folder: str, built_at: datetime, *,
    registry: str | None = None, snapshot: bool = False, ledger: ContentLedger | None = None,
) -> Build:
    """Compile, write the manifest below ``folder``, and publish the version.

    A snapshot is written first: profile and hash are measured while the rows pass, so a
    source is read once. A build that is refused leaves no copies.
    """
    copies = measured_snapshot(report.spark, report.sources.values(), folder) if snapshot else None
    try:
        build = compile_report(
            report, built_at, ledger=ledger, measures=copies.measures if copies else None
        )
    except Exception:
        if copies:
            copies.drop()
        raise
    home = f"{folder.rstrip('/')}/{build.artifact_id}"
    if copies:
        copies.settle(home)
    write_manifest(build.manifest, f"{home}/manifest", mode="overwrite")
    if registry is not None:
        publish(latest_record(build.manifest), registry)
    report.snapshot_id = build.artifact_id
    return build


def held(frame: DataFrame) -> DataFrame:
    """A frame of a few rows, computed once and kept as local rows."""
    return frame.sparkSession.createDataFrame(frame.collect(), frame.schema)
