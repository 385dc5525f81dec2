"""The durable result store and what tells one block from another."""

import functools
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import values
from tallyboard.plans import definition
from tallyboard.plans.report import Report, ReportError
from tallyboard.plans.store import COMMIT, ResultStore
from tallyboard.sources import folders
from tallyboard.sources.load import table_source

FACTOR = 2


def scaled(value):
    return value * FACTOR


def report_with(spark, store, build, **options):
    report = Report(spark, "r", "R", cache=store)
    report.source(table_source("t", spark.range(5)))
    report.query("q", reads=["t"], **options)(build)
    report.snapshot_id = "r__1"
    return report


def test_a_later_session_reads_the_result(spark, tmp_path):
    made = []

    def total(inputs):
        made.append(1)
        return inputs["t"].agg(F.sum("id").alias("s"))

    folder = str(tmp_path / "results")
    first = report_with(spark, ResultStore(spark, folder), total, version="1")
    assert values(first.run().outputs["q"]) == [(10,)]
    other = spark.newSession()
    second = report_with(other, ResultStore(other, folder), total, version="1")
    assert values(second.run().outputs["q"]) == [(10,)]
    assert (len(made), second.cache.hits) == (1, 1)
    changed = report_with(spark, ResultStore(spark, folder), total, version="2")
    assert values(changed.run().outputs["q"]) == [(10,)]
    assert (len(made), changed.cache.hits) == (2, 0)


def test_order_and_types_come_back(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "results"))
    frame = spark.range(2000).select(
        (F.col("id") * 7919 % 2000).alias("n"), F.lit(None).cast("string").alias("place"),
        F.array(F.lit(1.5)).alias("a"), F.lit("2026-01-01").cast("date").alias("d"),
    )
    kept = store.get("ordered", lambda: frame.orderBy(F.col("n").desc()))
    assert [r.n for r in kept.collect()] == list(range(1999, -1, -1))
    assert kept.dtypes == frame.dtypes
    again = store.get("ordered", lambda: 1 / 0)
    assert [r.n for r in again.collect()] == list(range(1999, -1, -1)) and store.hits == 1
    assert store.get("empty", lambda: frame.where("false")).count() == 0
    assert store.get("empty", lambda: 1 / 0).count() == 0


def test_what_was_not_committed_is_no_result(spark, tmp_path):
    folder = str(tmp_path / "results")
    store = ResultStore(spark, folder)
    with pytest.raises(ZeroDivisionError):
        store.get("k", lambda: 1 / 0)

    def broken():
        return spark.range(10).select(F.raise_error(F.lit("no")).alias("x"))

    with pytest.raises(Exception, match="no"):
        store.get("k", broken)
    assert store.get("k", lambda: spark.range(3)).count() == 3
    # A write that stopped before its commit.
    home = store._home("half")
    spark.range(4).write.parquet(f"{home}/attempt")
    assert store.get("half", lambda: spark.range(5)).count() == 5
    # Of two that write at once the first commit counts.
    def slow():
        ResultStore(spark, folder).get("race", lambda: spark.range(7))
        return spark.range(7)

    assert store.get("race", slow).count() == 7


def test_eviction_by_age(spark, tmp_path):
    folder = str(tmp_path / "results")
    store = ResultStore(spark, folder)
    for key in ("a", "b"):
        store.get(key, lambda: spark.range(2))
    home = store._home("a")
    commit = json.loads(folders.read_text(spark, f"{home}/{COMMIT}"))
    commit["committed_at"] = (datetime.now(timezone.utc) - timedelta(days=9)).isoformat()
    folders.remove(spark, f"{home}/{COMMIT}")
    folders.write_once(spark, f"{home}/{COMMIT}", json.dumps(commit))
    spark.range(1).write.parquet(f"{store._home('c')}/attempt")
    assert store.evict(timedelta(days=7)) == 1
    assert not folders.exists(spark, home) and store.get("b", lambda: 1 / 0).count() == 2
    later = datetime.now(timezone.utc) + timedelta(days=1)
    assert store.evict(timedelta(hours=1), later) == 2
    store.clear()
    assert folders.children(spark, folder) == [] and store.evict(timedelta(0)) == 0


def text_of(build):
    return definition.definition_text(build)


def test_constants_and_helpers_are_part_of_a_definition(monkeypatch):
    def block(inputs):
        return inputs["t"].select([scaled(F.col(name)) for name in inputs["t"].columns])

    before = text_of(block)
    assert text_of(block) == before
    monkeypatch.setitem(globals(), "FACTOR", 3)
    # The constant is used by a helper, which is used inside a comprehension.
    assert text_of(block) != before


def test_defaults_are_part_of_a_definition():
    def made(factor, more):
        def block(inputs, n=factor, *, m=more):
            return inputs["t"].select(F.col("id") * n + m)

        return block

    texts = {text_of(made(a, b)) for a in (1, 2) for b in (1, 2)}
    assert len(texts) == 4 and text_of(made(1, 2)) in texts


def test_functions_may_refer_to_themselves_and_each_other():
    def down(n):
        return n if n <= 0 else up(n - 1)

    def up(n):
        return down(n - 1)

    def block(inputs):
        return inputs["t"].limit(down(3)), block

    assert text_of(block) == text_of(block)


class Maker:
    def block(self, inputs):
        return inputs["t"]


@pytest.mark.parametrize("build", [Maker().block, functools.partial(scaled, 2), len])
def test_what_has_no_text_needs_a_version(spark, build):
    report = Report(spark, "r", "R")
    report.source(table_source("t", spark.range(1)))
    with pytest.raises(ReportError, match="give the block a version"):
        report.query("q", reads=["t"])(build)
    report.query("q", reads=["t"], version="1")(build)


def test_a_changed_constant_is_another_result(spark, tmp_path, monkeypatch):
    def block(inputs):
        return inputs["t"].agg(F.sum(scaled(F.col("id"))).alias("s"))

    found = []
    for factor in (2, 5, 2):
        monkeypatch.setitem(globals(), "FACTOR", factor)
        report = report_with(spark, ResultStore(spark, str(tmp_path / "results")), block)
        found.append((values(report.run().outputs["q"])[0][0], report.cache.hits))
    assert found == [(20, 0), (50, 0), (20, 1)]
