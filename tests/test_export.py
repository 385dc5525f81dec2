from datetime import datetime, timezone

from pyspark.sql import functions as F

from conftest import values
from tallyboard.operators.export import (
    BAR, HEATMAP, LINE, TABLE, Output, csv_lines, visible_columns, visible_data, write_csv,
)
from tallyboard.operators.identity import content_identity
from tallyboard.operators.profile import data_checks, passport
from tallyboard.sources.load import Freshness, load_source, table_source
from tallyboard.sources.manifest import (
    build_manifest, manifest_summary, read_manifest, write_manifest,
)
from tallyboard.sources.registry import (
    latest_record, publish, read_registry, registry_latest, registry_outdated,
)


def test_a_line_shows_what_it_draws(frame):
    rows = frame(
        [(7, "w12", "tram", 41, 5.5)], "depot_no int, week string, vehicle string, trips int, fare double"
    )
    output = Output(LINE, x="week", y="fare", group="vehicle", details=["trips"])
    shown = visible_data(rows, output)
    assert shown.columns == ["week", "vehicle", "trips", "fare"]
    assert values(shown) == [("w12", "tram", 41, 5.5)]


def test_a_normalised_bar_has_its_share_beside_the_value(frame):
    rows = frame(
        [("w12", 30.0, "tram"), ("w12", 10.0, "bus")], "week string, fare double, vehicle string"
    )
    output = Output(BAR, x="week", y="fare", group="vehicle", stack="normalize")
    shown = visible_data(rows, output).orderBy("vehicle")
    assert shown.columns == ["week", "fare", "fare_normalized", "vehicle"]
    assert values(shown, "fare_normalized") == [(0.25,), (0.75,)]
    taken = visible_data(rows.withColumn("fare_normalized", F.lit(1)), output)
    assert taken.columns == ["week", "fare", "fare_normalized_", "vehicle"]
    plain = Output(BAR, x="week", y="fare", color="vehicle")
    assert visible_data(rows, plain).columns == ["week", "fare", "vehicle"]


def test_a_heatmap_shows_cells_and_row_metric(frame):
    rows = frame(
        [(4, "n", "d1", 9, 0.5, 18)],
        "hour int, note string, depot string, late int, share double, trips int",
    )
    output = Output(
        HEATMAP, x="hour", y="depot", value="share", row_metric="trips",
        details=["late", "trips", "absent"],
    )
    assert visible_columns(rows, output) == ["hour", "depot", "late", "share", "trips", "absent"]


def test_table_export(frame):
    rows = frame([(1, "x")], "a int, b string")
    assert visible_data(rows, Output(TABLE)).columns == ["a", "b"]
    shown = visible_data(rows, Output(TABLE, columns=["c", "b"]))
    assert values(shown) == [(None, "x")]


CELLS = [('A, "quoted"', "=2+2", None), ("  padded ", "", "two\nlines")]


def test_csv_lines(frame):
    rows = frame(CELLS, "name string, value string, missing string")
    assert sorted(values(csv_lines(rows))) == sorted(
        [('"A, ""quoted""",\'=2+2,',), ('  padded ,,"two\nlines"',)]
    )


def test_written_csv(spark, frame, tmp_path):
    rows = frame(CELLS, "name string, value string, `a,b` string")
    write_csv(rows.coalesce(1), str(tmp_path / "out.csv"))
    (part,) = (tmp_path / "out.csv").glob("part-*")
    assert part.read_bytes().decode("utf-8") == (
        '\ufeffname,value,"a,b"\r\n"A, ""quoted""",\'=2+2,\r\n  padded ,,"two\nlines"\r\n'
    )
    # Every part file has the header, and the folder reads back as one source.
    many = spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("t")).repartition(4)
    write_csv(many, str(tmp_path / "many.csv"))
    assert len(list((tmp_path / "many.csv").glob("part-*"))) == 4
    back = load_source(spark, "t", str(tmp_path / "many.csv")).frame
    assert sorted(values(back)) == sorted((i, f"t{i}") for i in range(100))


def test_an_empty_result_is_a_header(spark, tmp_path):
    write_csv(spark.range(5).where("id > 9"), str(tmp_path / "none.csv"))
    written = [p.read_bytes() for p in (tmp_path / "none.csv").glob("part-*")]
    assert [w for w in written if w] == ["\ufeffid\r\n".encode()]
    assert load_source(spark, "t", str(tmp_path / "none.csv")).frame.columns == ["id"]


def built(spark, hour):
    built_at = datetime(2026, 7, 1, hour, tzinfo=timezone.utc)
    source = table_source(
        "orders", spark.sql("SELECT 1 id, timestamp'2026-06-30 10:00:00' at"),
        Freshness("at", max_lag_hours=24),
    )
    hashes = spark.createDataFrame([("orders", "ab")], "name string, sha256 string")
    versions = {"tool_version": "1", "runtime_version": "2"}
    return build_manifest(
        passport(source, built_at), data_checks(source, built_at),
        content_identity(hashes, "test", "d", **versions),
        slug="test", title="Test", built_at=built_at, timezone="UTC", **versions,
    )


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "manifest")
    write_manifest(built(spark, 8), path)
    read = read_manifest(spark, path)
    row = read.first()
    assert row.freshness.status == "passed" and row.report.timezone == "UTC"
    assert row.sources[0].inferred_column_types == {"at": "datetime", "id": "integer"}
    assert row.build.built_at == datetime(2026, 7, 1, 8)
    assert row.sources[0].data_max_at == datetime(2026, 6, 30, 10) and row.freshness.processed_at is None
    assert [test.name for test in row.checks.tests] == ["data_freshness", "parquet_valid"]
    assert values(manifest_summary(read), "slug", "source_name", "rows", "columns") == [
        ("test", "orders", 1, 2)
    ]
    # Building again later keeps the identity.
    assert built(spark, 9).first().artifact.id == row.artifact.id


def test_registry(spark, tmp_path):
    folder = str(tmp_path / "registry")
    early, late = latest_record(built(spark, 8)), latest_record(built(spark, 9))
    publish(late, folder)
    publish(early.withColumn("artifact_id", F.lit("test__old")), folder)
    publish(early.withColumn("artifact_id", F.lit(None).cast("string")), folder)
    builds = read_registry(spark, folder)
    latest = registry_latest(builds)
    row = latest.first()
    assert latest.count() == 1 and row.slug == "test" and row.schema_version == "0.1"
    assert row.artifact_id == late.first().artifact_id
    assert row.built_at == datetime(2026, 7, 1, 9)
    outdated = registry_outdated(builds, latest)
    assert values(outdated, "artifact_id") == [("test__old",)]
