"""The registry as a log with folds, and snapshots laid out for their readers."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyboard.functions.predicates import between_filter, in_filter
from tallyboard.sources import folders, registry
from tallyboard.sources.load import table_source
from tallyboard.sources.snapshot import Layout, snapshot_sources

START = datetime(2026, 1, 1)


def records(spark, *rows):
    return spark.createDataFrame(
        [("0.1", slug, slug.title(), artifact, START + timedelta(hours=hour), "1", "2") for slug, artifact, hour in rows],
        registry.RECORD,
    )


def latest(log):
    return {(r.slug, r.artifact_id) for r in log.latest().collect()}


@pytest.fixture
def log(spark, tmp_path):
    return registry.RegistryLog(spark, str(tmp_path / "registry"))


def test_folds_change_nothing_that_is_read(spark, log):
    assert latest(log) == set() and log.fold() is None and log.vacuum() == 0
    assert log.publish(records(spark, ("a", "a1", 1), ("b", "b5", 5))) == 1
    assert log.publish(records(spark, ("a", "a3", 3))) == 2
    expected = {("a", "a3"), ("b", "b5")}
    assert latest(log) == expected and log.tail() == [1, 2]
    assert log.fold() == 2
    assert latest(log) == expected and log.tail() == []
    # A build that is published late, and one with the latest time.
    log.publish(records(spark, ("a", "a2", 2), ("b", "b9", 9), ("c", "c1", 1)))
    expected = {("a", "a3"), ("b", "b9"), ("c", "c1")}
    assert latest(log) == expected and log.tail() == [3]
    assert log.fold() == 3 and log.vacuum() == 4
    assert latest(log) == expected
    assert log.publish(records(spark, ("d", "d1", 1))) == 4
    assert latest(log) == expected | {("d", "d1")}


def test_an_interrupted_fold_or_publication_is_not_seen(spark, log, monkeypatch):
    log.publish(records(spark, ("a", "a1", 1)))

    def stop(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(folders, "write_once", stop)
        with pytest.raises(KeyboardInterrupt):
            log.fold()
        with pytest.raises(KeyboardInterrupt):
            log.publish(records(spark, ("a", "a2", 2)))
    assert len(folders.children(spark, f"{log.folder}/folded")) == 1
    assert log.last_fold() is None and latest(log) == {("a", "a1")} and log.tail() == [1]
    assert log.fold() == 1 and latest(log) == {("a", "a1")}


def test_commits_at_once_get_numbers_of_their_own(spark, log):
    other = registry.RegistryLog(spark, log.folder)
    log.publish(records(spark, ("a", "a1", 1)))
    number = folders.write_once(spark, log._file("commits", 2), json.dumps("batch-of-another"))
    assert number
    folders.remove(spark, log._file("commits", 2))
    assert [other.publish(records(spark, ("b", "b1", 1))), log.publish(records(spark, ("c", "c1", 1)))] == [2, 3]
    assert latest(other) == {("a", "a1"), ("b", "b1"), ("c", "c1")}


def rows_scanned(frame):
    """Rows that the scan of an executed frame gave."""
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    found = 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        found += metric.get().value() if metric.isDefined() else 0
    return found


def test_a_clustered_copy_is_read_in_part(spark, tmp_path):
    rows = spark.range(60_000).select(
        "id", F.expr("date_add(date'2026-01-01', cast(id * 7919 % 365 as int))").alias("day"),
        F.concat(*[F.sha2(F.col("id").cast("string"), 512)] * 2).alias("ticket"),
    ).repartition(4)
    source = table_source("trips", rows)
    plain = snapshot_sources([source], str(tmp_path / "plain"))["trips"]
    layout = Layout("day", ("ticket",), distinct=5000, group_bytes=300_000)
    laid = snapshot_sources([source], str(tmp_path / "laid"), layouts={"trips": layout})["trips"]
    week = between_filter("day", {"start": "2026-03-02", "end": "2026-03-08"})
    found = []
    for path in (plain, laid):
        part = spark.read.parquet(path).where(week).select("id", "day")
        found.append((sorted(map(tuple, part.collect())), rows_scanned(part)))
    assert found[0][0] == found[1][0] and len(found[0][0]) > 1000
    assert all(date(2026, 3, 2) <= day <= date(2026, 3, 8) for _, day in found[1][0])
    assert found[1][1] < 20_000 < found[0][1]
    # A value that no row has: the ranges of the texts hold it, nearly all Bloom filters do not.
    for path, most in ((plain, 60_000), (laid, 9000)):
        none = spark.read.parquet(path).where(in_filter("ticket", ["8" * 256])).select("id", "ticket")
        assert none.collect() == [] and rows_scanned(none) <= most
        assert path == laid or rows_scanned(none) == 60_000
