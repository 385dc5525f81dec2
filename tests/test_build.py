from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from conftest import values
from tallyboard.operators.identity import table_fingerprint
from tallyboard.plans.build import build_report, compile_report, hash_rows, measure_sources
from tallyboard.plans.report import Report, ReportError
from tallyboard.sources.load import ContractError, Freshness, load_source, table_source
from tallyboard.sources.manifest import manifest_summary, read_manifest
from tallyboard.sources.registry import read_registry, registry_latest

EARLY = datetime(2026, 7, 1, 8, tzinfo=timezone.utc)
LATE = datetime(2026, 7, 1, 9, tzinfo=timezone.utc)


@pytest.fixture
def make(spark, tmp_path):
    def build(text="id,at\n1,2026-06-30 10:00:00\n", freshness=Freshness("at", None, 24), zone=None):
        path = tmp_path / "orders.csv"
        path.write_text(text)
        report = Report(spark, "test", "Test", timezone=zone)
        report.source(load_source(spark, "orders", str(path), freshness=freshness))
        report.source(table_source("extra", spark.range(3)))
        report.sql_block("query", "n", "SELECT count(*) AS n FROM {orders}", reads=["orders"])
        return report

    return build


def test_build_writes_manifest_snapshot_and_registry(spark, make, tmp_path):
    folder, registry = str(tmp_path / "out"), str(tmp_path / "registry")
    report = make()
    build = build_report(report, folder, EARLY, registry=registry, snapshot=True)
    assert build.artifact_id.startswith("test__") and report.snapshot_id == build.artifact_id
    assert len(build.warnings) == 2
    manifest = read_manifest(spark, f"{folder}/{build.artifact_id}/manifest")
    row = manifest.first()
    assert row.artifact.id == build.artifact_id and row.checks.status == "warning"
    orders = {s.name: s for s in row.sources}["orders"]
    assert (orders.file_name, orders.file_size_bytes, orders.rows) == ("orders.csv", 28, 1)
    assert sorted(values(manifest_summary(manifest), "source_name", "rows")) == [
        ("extra", 3), ("orders", 1)
    ]
    assert spark.read.parquet(f"{folder}/{build.artifact_id}/sources/orders.parquet").count() == 1
    latest = registry_latest(read_registry(spark, registry)).first()
    assert (latest.slug, latest.artifact_id) == ("test", build.artifact_id)


def test_identity_follows_content_not_time(make):
    first = compile_report(make(), EARLY).artifact_id
    assert compile_report(make(), LATE).artifact_id == first
    assert compile_report(make("id,at\n2,2026-06-30 10:00:00\n"), EARLY).artifact_id != first
    changed = make()
    changed.sql_block("query", "m", "SELECT 1 FROM {orders}", reads=["orders"])
    assert compile_report(changed, EARLY).artifact_id != first


def test_a_broken_source_stops_the_build(make):
    with pytest.raises(ContractError, match="lacks its freshness columns missing_at"):
        compile_report(make(freshness=Freshness("missing_at")), EARLY)
    broken = make()
    broken.sql_block("query", "bad", "SELECT 1", reads=["nothing"])
    with pytest.raises(ReportError):
        compile_report(broken, EARLY)


def test_known_types_spare_the_type_pass(spark, make, tmp_path):
    make()
    path = str(tmp_path / "orders.csv")
    source = load_source(
        spark, "orders", path, multiline=False, column_types={"id": "number", "at": "datetime"}
    )
    assert source.columns is None
    assert values(source.frame) == [(1.0, datetime(2026, 6, 30, 10))]


def test_sources_are_hashed_by_schema_and_rows(spark, make, tmp_path):
    def hash_row(source):
        return hash_rows([source], measure_sources([source]))[0]

    source = make().sources["orders"]
    assert hash_row(source)[3] == table_fingerprint(source.raw).first().fingerprint
    one = spark.createDataFrame([(1, "2")], "a int, b string")
    other = spark.createDataFrame([("1", 2)], "x string, y int")
    assert table_fingerprint(one).first() != table_fingerprint(other).first()
    # A partition value lives in a path, not in a file, and counts all the same.
    one.withColumn("dt", F.lit("a")).write.partitionBy("dt").parquet(str(tmp_path / "p1.parquet"))
    one.withColumn("dt", F.lit("b")).write.partitionBy("dt").parquet(str(tmp_path / "p2.parquet"))
    prints = {
        hash_row(load_source(spark, "p", str(tmp_path / f"p{i}.parquet")))[3] for i in (1, 2)
    }
    assert len(prints) == 2


def test_kept_views_are_released(spark, make):
    report = make()

    @report.view("doubled", reads=["extra"], keep=True)
    def doubled(inputs):
        return inputs["extra"].select((F.col("id") * 2).alias("id"))

    report.sql_block("query", "total", "SELECT sum(id) AS s FROM {doubled}", reads=["doubled"])
    run = report.run(outputs=["total"])
    assert values(run.outputs["total"]) == [(6,)]
    kept = run.kept[0]
    assert kept.is_cached
    run.release()
    assert not kept.is_cached
