"""Measures of sources: in one pass, from footers, while a snapshot is written, and per file."""

import os
import shutil
from datetime import date, datetime, timezone

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import values
from tallyboard.operators import measure
from tallyboard.operators.identity import table_fingerprint
from tallyboard.operators.profile import facts_of, source_facts
from tallyboard.plans.build import build_report, compile_report, measure_sources
from tallyboard.plans.report import Report
from tallyboard.sources import folders, footers
from tallyboard.sources.ledger import ContentLedger
from tallyboard.sources.load import ContractError, Freshness, load_source, table_source
from tallyboard.sources.snapshot import measured_snapshot

BUILT = datetime(2026, 7, 1, tzinfo=timezone.utc)


@pytest.fixture
def trips(spark, tmp_path):
    """A Parquet source of several files with a day, a time, a time as text, and NULLs."""
    path = str(tmp_path / "trips.parquet")
    rows = [
        (i, date(2026, 1, 1 + i % 28) if i % 7 else None, datetime(2026, 6, 1 + i % 30, i % 24),
         f"2026-06-{1 + i % 30:02d}T08:00:00" if i % 5 else ["", None, "soon"][i % 3], i / 3, [i, None])
        for i in range(200)
    ]
    spark.createDataFrame(
        rows, "id long, day date, at timestamp, seen string, fare double, marks array<int>"
    ).repartition(4).write.parquet(path)
    return path


def rows_of(frame):
    return [tuple(row) for row in frame.collect()]


def jobs_in(spark, work):
    """How many jobs ``work`` starts."""
    group = f"group-{os.urandom(6).hex()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.mark.parametrize("settings", [
    Freshness("day"), Freshness("at", "day"), Freshness("seen", "at", 5), Freshness("fare"), Freshness(),
    Freshness("missing"), Freshness("at", "at"),
])
def test_measures_are_the_profile_and_the_hash(spark, trips, settings):
    source = load_source(spark, "trips", trips, freshness=settings)
    # The same rows as a table have no files, so they are scanned the older way.
    table = table_source("trips", spark.read.parquet(trips), settings)
    found = measure.measured([source])["trips"]
    assert rows_of(measure.facts(source, found)) == rows_of(source_facts(table))
    assert rows_of(source_facts(source)) == rows_of(source_facts(table))
    assert measure.fingerprint(source, found) == table_fingerprint(source.raw).first().fingerprint


def test_a_source_without_rows(spark, trips, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.read.parquet(trips).where("false").write.parquet(path)
    for settings in (Freshness("day"), Freshness("seen", "at")):
        source = load_source(spark, "none", path, freshness=settings)
        found = measure.measured([source])["none"]
        # Without any row there may be no count of a column's values either.
        counts = ["data_values", "data_invalid", "processed_values", "processed_invalid"]
        scanned = source_facts(table_source("none", source.frame, settings))
        assert rows_of(measure.facts(source, found).drop(*counts)) == rows_of(scanned.drop(*counts))
        assert measure.fingerprint(source, found) == table_fingerprint(source.raw).first().fingerprint


def test_csv_measures(spark, tmp_path):
    path = tmp_path / "rides.csv"
    path.write_text("id,at,fare\n1,2026-06-30T10:00:00,2.5\n2,2026-06-29,x\n3,,NA\n")
    source = load_source(spark, "rides", str(path), freshness=Freshness("at", None, 10))
    found = measure.measured([source])["rides"]
    assert rows_of(measure.facts(source, found)) == rows_of(source_facts(source))
    rows, seen = measure.observed(source)
    assert rows.schema == source.frame.schema
    assert sorted(rows_of(rows)) == sorted(rows_of(source.frame))
    assert {k: v for k, v in seen.get.items() if k.startswith("piece")} == {
        k: v for k, v in found.items() if k.startswith("piece")}


def test_footers_answer_without_reading_rows(spark, trips):
    plan = footers.footer_plan(spark, trips, ["id", "day", "seen"])
    assert footers.is_pushed(plan)
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(id), MIN(id), MAX(id), COUNT(day), MIN(day), MAX(day), COUNT(seen)]" in shown
    found = footers.footer_facts(spark, trips, ["id", "day", "seen", "at"])
    rows = spark.read.parquet(trips)
    assert found.rows == 200 and found.pushed
    for name in ("id", "day"):
        low, high, held = rows.agg(F.min(name), F.max(name), F.count(name)).first()
        assert found.columns[name] == footers.ColumnFacts(held, low, high)
    assert found.columns["at"] == footers.ColumnFacts(200)
    assert found.columns["seen"].values == rows.where("seen is not null").count()
    # The caller's own session goes on as before.
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_files_without_statistics_are_scanned(spark, tmp_path):
    path = str(tmp_path / "mixed.parquet")
    spark.createDataFrame([(1, date(2026, 1, 2)), (5, None)], "id long, day date").coalesce(1).write.parquet(path)
    bare = pa.table({"id": pa.array([9, None], pa.int64()), "day": pa.array([date(2026, 3, 1), date(2025, 1, 1)])})
    pq.write_table(bare, f"{path}/part-9.parquet", write_statistics=False)
    found = footers.footer_facts(spark, path, ["id", "day"])
    assert not found.pushed and found.rows == 4
    assert found.columns["id"] == footers.ColumnFacts(3, 1, 9)
    assert found.columns["day"] == footers.ColumnFacts(3, date(2025, 1, 1), date(2026, 3, 1))
    row = source_facts(load_source(spark, "mixed", path, freshness=Freshness("day"))).first()
    assert (row.rows, row.data_min_at, row.data_time_granularity) == (4, datetime(2025, 1, 1), "date")


def test_a_date_window_is_read_from_footers(spark, trips):
    source = load_source(spark, "trips", trips, freshness=Freshness("day"))
    plan = source_facts(source)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [" not in plan
    timed = load_source(spark, "trips", trips, freshness=Freshness("at"))
    assert "Relation [" in source_facts(timed)._jdf.queryExecution().optimizedPlan().toString()


def test_many_sources_are_one_job(spark, trips):
    sources = [load_source(spark, f"s{i}", trips, freshness=Freshness("at")) for i in range(3)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, jobs = jobs_in(spark, lambda: measure.measured(sources))
        facts, more = jobs_in(spark, lambda: facts_of(sources))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert jobs == more == 1 and set(found) == set(facts) == {"s0", "s1", "s2"}


def test_a_snapshot_is_measured_while_it_is_written(spark, trips, tmp_path):
    source = load_source(spark, "trips", trips, freshness=Freshness("seen", "at", 5))
    rows, _ = measure.observed(source)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "CollectMetrics" in plan
    copies = measured_snapshot(spark, [source], str(tmp_path / "out"))
    alone = measure.measured([source])["trips"]
    assert copies.measures["trips"] == {k: alone[k] for k in copies.measures["trips"]}
    copies.settle(str(tmp_path / "out" / "id"))
    back = spark.read.parquet(str(tmp_path / "out" / "id" / "sources" / "trips.parquet"))
    assert table_fingerprint(back).first() == table_fingerprint(source.raw).first()
    assert [name for name, _ in folders.children(spark, str(tmp_path / "out"))] == ["id"]


def report_of(spark, path, **settings):
    report = Report(spark, "trips", "Trips")
    report.source(load_source(spark, "trips", path, freshness=Freshness("at", None, 10**6), **settings))
    report.sql_block("query", "n", "SELECT count(*) AS n FROM {trips}", reads=["trips"])
    return report


def test_builds_agree_whichever_way_they_measure(spark, trips, tmp_path):
    plain = compile_report(report_of(spark, trips), BUILT)
    ledger = ContentLedger(spark, str(tmp_path / "ledger"))
    kept = [compile_report(report_of(spark, trips), BUILT, ledger=ledger) for _ in range(2)]
    copied = [build_report(report_of(spark, trips), str(tmp_path / "out"), BUILT, snapshot=True) for _ in range(2)]
    assert {b.artifact_id for b in [*kept, *copied]} == {plain.artifact_id}
    for build in [*kept, *copied]:
        assert rows_of(build.manifest) == rows_of(plain.manifest)
    # The second build's copies gave way to those that were there.
    inside = sorted(name for name, _ in folders.children(spark, str(tmp_path / "out")))
    assert inside == [plain.artifact_id]


def test_a_refused_build_leaves_no_copies(spark, trips, tmp_path):
    report = Report(spark, "trips", "Trips")
    report.source(load_source(spark, "trips", trips, freshness=Freshness("nothing")))
    with pytest.raises(ContractError):
        build_report(report, str(tmp_path / "out"), BUILT, snapshot=True)
    assert folders.children(spark, str(tmp_path / "out")) == []


def test_a_ledger_reads_new_files_only(spark, trips, tmp_path):
    ledger = ContentLedger(spark, str(tmp_path / "ledger"))

    def update():
        source = load_source(spark, "trips", trips, freshness=Freshness("seen", "day"))
        state = ledger.update(source)
        assert measure.fingerprint(source, state.measures) == table_fingerprint(source.raw).first().fingerprint
        whole = measure.measured([source])["trips"]
        assert state.measures == {k: whole[k] for k in state.measures}
        return state

    first = update()
    assert (first.files, first.scanned) == (4, 4) and first.bytes > 0
    assert update().scanned == 0
    spark.read.parquet(trips).limit(30).coalesce(1).write.mode("append").parquet(trips)
    added = update()
    assert (added.files, added.scanned, added.measures["rows"]) == (5, 1, 230)
    gone = sorted(name for name in os.listdir(trips) if name.startswith("part-"))[0]
    os.remove(f"{trips}/{gone}")
    removed = update()
    assert (removed.files, removed.scanned) == (4, 0)
    # Another freshness column is another thing to measure.
    other = load_source(spark, "trips", trips, freshness=Freshness("at"))
    assert ledger.update(other).scanned == 4


def test_known_files_are_not_opened(spark, trips, tmp_path):
    ledger = ContentLedger(spark, str(tmp_path / "ledger"))
    source = load_source(spark, "trips", trips)
    before = ledger.update(source)
    name = sorted(n for n in os.listdir(trips) if n.startswith("part-"))[0]
    path, facts = f"{trips}/{name}", os.stat(f"{trips}/{name}")
    with open(path, "wb") as file:
        file.write(b"x" * facts.st_size)
    os.utime(path, ns=(facts.st_atime_ns, facts.st_mtime_ns))
    assert ledger.update(source).measures == before.measures


def test_partitioned_and_odd_paths(spark, tmp_path):
    path = str(tmp_path / "a b+c%20d.parquet")
    spark.range(40).select("id", (F.col("id") % 3).cast("int").alias("p"), F.lit("x y").alias("q")).write \
        .partitionBy("p", "q").parquet(path)
    ledger = ContentLedger(spark, str(tmp_path / "ledger"))
    source = load_source(spark, "odd", path)
    for scanned in (True, False):
        state = ledger.update(source)
        assert bool(state.scanned) == scanned and state.measures["rows"] == 40
        assert measure.fingerprint(source, state.measures) == table_fingerprint(source.raw).first().fingerprint
    shutil.rmtree(f"{path}/p=0")
    source = load_source(spark, "odd", path)
    state = ledger.update(source)
    assert (state.scanned, state.measures["rows"]) == (0, 26)
    one = tmp_path / "one.parquet"
    pq.write_table(pa.table({"id": [1, 2]}), one)
    assert measure_sources([load_source(spark, "one", str(one))], ledger)["one"]["rows"] == 2
    with pytest.raises(ContractError):
        ledger.update(table_source("t", spark.range(3)))
    assert values(ledger.rows().where("source = 'one'"), "rows") == [(2,)]
