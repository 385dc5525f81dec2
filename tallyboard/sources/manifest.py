"""The manifest of a report build: one nested row, written and read as JSON."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.operators.status import freshness_rollup

# JSON times with microseconds and offset.
TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
# What a written manifest is read as.
SCHEMA = """
    report struct<slug string, title string, spec_version string, timezone string>,
    artifact struct<id string, content_sha256 string, status string>,
    build struct<built_at timestamp, tool_name string, tool_version string,
        runtime_version string, build_mode string>,
    freshness struct<status string, data_through timestamp, processed_at timestamp>,
    sources array<struct<name string, source_format string, rows bigint, columns int,
        column_names array<string>, inferred_column_types map<string, string>,
        loaded_into_report_at timestamp, data_min_at timestamp, data_max_at timestamp,
        data_time_granularity string, processed_at timestamp,
        processed_time_granularity string, freshness_status string,
        file_name string, file_size_bytes bigint, sha256 string>>,
    checks struct<status string,
        tests array<struct<source string, name string, status string, message string>>>
"""


def _by_name(left: Column, right: Column) -> Column:
    first, second = left.getField("name"), right.getField("name")
    return F.when(first < second, -1).when(first > second, 1).otherwise(0)


def build_manifest(
    passports: DataFrame, checks: DataFrame, identity: DataFrame, *,
    slug: str, title: str, built_at: datetime, timezone: str | None,
    spec_version: str = "0.1.0", tool_name: str = "tallyboard",
    tool_version: str, runtime_version: str,
) -> DataFrame:
    """One row. There is one passport per source and a few checks for each, so the
    arrays are as long as the report's own configuration."""
    rollup = freshness_rollup(passports, checks)
    # The comparator looks at names only: a struct with a map has no order of its own.
    sources = passports.agg(
        F.array_sort(F.collect_list(F.struct(*passports.columns)), _by_name).alias("sources")
    )
    tests = checks.agg(
        F.array_sort(
            F.collect_list(F.struct("source", "name", "status", "message"))
        ).alias("tests")
    )
    one = F.lit(True)
    return (
        rollup.join(F.broadcast(sources), one)
        .join(F.broadcast(tests), one)
        .join(F.broadcast(identity), one)
        .select(
            F.struct(
                F.lit(slug).alias("slug"), F.lit(title).alias("title"),
                F.lit(spec_version).alias("spec_version"),
                F.lit(timezone or "UTC").alias("timezone"),
            ).alias("report"),
            F.struct(
                F.col("artifact_id").alias("id"), "content_sha256",
                F.lit("local").alias("status"),
            ).alias("artifact"),
            F.struct(
                F.lit(built_at).alias("built_at"), F.lit(tool_name).alias("tool_name"),
                F.lit(tool_version).alias("tool_version"),
                F.lit(runtime_version).alias("runtime_version"),
                F.lit("local").alias("build_mode"),
            ).alias("build"),
            F.struct("status", "data_through", "processed_at").alias("freshness"),
            "sources",
            F.struct("status", "tests").alias("checks"),
        )
    )


def write_manifest(manifest: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    manifest.write.mode(mode).option("timestampFormat", TIMES).json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A written manifest with the types it was built with: maps and times stay such."""
    return spark.read.schema(SCHEMA).option("timestampFormat", TIMES).json(path)


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """One row per source of a manifest, with the build it belongs to."""
    source = F.col("source")
    return manifest.select(
        F.col("report.slug").alias("slug"),
        F.col("artifact.id").alias("artifact_id"),
        F.col("checks.status").alias("checks_status"),
        F.explode("sources").alias("source"),
    ).select(
        "slug", "artifact_id", "checks_status",
        source.getField("name").alias("source_name"),
        source.getField("source_format").alias("source_format"),
        source.getField("rows").alias("rows"),
        source.getField("columns").cast("int").alias("columns"),
        source.getField("freshness_status").alias("freshness_status"),
    )
